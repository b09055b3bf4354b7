"""Operator 11 against a context tree in plain Python, and the mixture's properties."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.llm import ctw

from llm_fixtures import SF_CHECK, SF_SMALL, _shipped, edge, edge_rows, empty  # noqa: F401


def normal(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return words, (" ".join(words) + "\n").encode()


def log_kt(a, b):
    return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - 2 * math.lgamma(.5)


class Tree:
    """One node for each (context, binary node): counts, and the recursion read straight from its definition."""

    def __init__(self, texts):
        self.count = collections.defaultdict(lambda: [0, 0])
        self.children = collections.defaultdict(set)
        self.memo = {}
        for data in texts:
            for node, bit, context in self.decisions(data):
                for d in range(ctw.DEPTH + 1):
                    self.count[context[:d], node][bit] += 1
                    if d:
                        self.children[context[:d - 1], node].add(context[d - 1])

    @staticmethod
    def decisions(data):
        """(node, bit, context with the nearest byte first) of each binary decision."""
        padded = ctw.END * ctw.DEPTH + data
        for i, byte in enumerate(data):
            context = padded[i:i + ctw.DEPTH][::-1]
            node = 1
            for k in range(7, -1, -1):
                bit = byte >> k & 1
                yield node, bit, context
                node = node * 2 + bit

    def log_w(self, context, node):
        key = context, node
        if key not in self.memo:
            stop = log_kt(*self.count[key]) if key in self.count else 0.0
            if len(context) < ctw.DEPTH:
                go = sum(self.log_w(context + bytes([c]), node) for c in self.children.get(key, ()))
                self.memo[key] = np.logaddexp(stop, go) - math.log(2)
            else:
                self.memo[key] = stop
        return self.memo[key]

    def p(self, context, node, bit, d=0):
        at = context[:d]
        a = self.count[at, node] if (at, node) in self.count else (0, 0)
        own = (a[bit] + .5) / (a[0] + a[1] + 1)
        if d == ctw.DEPTH:
            return own
        stay = math.exp(log_kt(*a) - math.log(2) - self.log_w(at, node))
        return stay * own + (1 - stay) * self.p(context, node, bit, d + 1)

    def log10(self, data):
        return sum(math.log10(self.p(context, node, bit)) for node, bit, context in self.decisions(data))


def brute(rows):
    """rows of (id, text, train) -> counter of the integer columns, and the scores by them."""
    texts = [(i, train, *normal(t)) for i, t, train in rows]
    counts = collections.Counter(w for _, train, words, _ in texts if train for w in [*words, None])
    n, v = sum(counts.values()), len(counts)
    tree = Tree([data for _, train, _, data in texts if train])
    known = {}
    out = []
    for i, train, words, data in texts:
        tokens = [*words, None]
        if data not in known:
            known[data] = tree.log10(data)
        base = sum(math.log10((counts[w] + .5) / (n + .5 * (v + 1))) for w in tokens)
        out.append((i, train, len(tokens), sum(counts[w] > 0 for w in tokens), n, base, known[data], len(data)))
    return out


def check(df, train, rows):
    key = lambda r: (str(r[0]), r[1], r[2], r[7], r[6])
    got = sorted(((r.doc_id, r.train, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.n_bytes)
                  for r in ctw.score_texts(df, train).collect()), key=key)
    want = sorted(brute(rows), key=key)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5] for x in got], [x[5] for x in want], rtol=1e-9)
    assert np.allclose([x[6] for x in got], [x[6] for x in want], rtol=1e-9)
    return got


def short(edge_rows):
    return [(r[0], None if r[1] is None else r[1][:400], r[3]) for r in edge_rows]


def test_scores_match_a_plain_tree(spark, edge_rows):
    rows = short(edge_rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = check(df, F.col("source") == "s1", [(i, t, s == "s1") for i, t, s in rows])
    assert any(x[3] < x[2] for x in got) and len(got) == len(rows)


def test_many_chunks_and_slices_give_the_same(spark, edge_rows, monkeypatch):
    rows = short(edge_rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)
    monkeypatch.setattr(ctw, "CHUNK_BYTES", 700)
    monkeypatch.setattr(ctw, "SLICE_BYTES", 300)
    monkeypatch.setattr(ctw, "WORD_GROUPS", 3)
    check(df, F.col("source") == "s2", [(i, t, s == "s2") for i, t, s in rows])


def test_nothing_to_learn_from_and_empty_table(spark, empty):
    df = spark.createDataFrame([(1, "ab c"), (2, None), (None, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in ctw.score_texts(df, F.lit(False)).collect()}
    assert got[1].score == pytest.approx(-5 * 8 * math.log10(2)) and got[1].base_score == 0 and got[1].n_known == 0
    assert got[2].n_tokens == 1 and got[None].n_bytes == 1 and got[2].bits_per_byte == pytest.approx(8)
    assert ctw.score_texts(empty, F.lit(True)).collect() == []


def test_whole_edge_rows_with_long_texts_and_clashing_names(edge, edge_rows):
    out = ctw.score_texts(edge, F.lit(True)).collect()
    assert len(out) == len(edge_rows)
    assert max(r.n_tokens for r in out) == max(len(normal(t)[0]) for _, t, *_ in edge_rows) + 1
    assert all(r.n_known == r.n_tokens and r.score < 0 for r in out)


def test_log_gamma():
    x = np.concatenate([np.arange(1, 4000) / 2, [1e6 + .5, 1e9, 1e13]])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-13, atol=1e-12)


def test_query_counts_and_quality(spark):
    got = {r.doc_id: r for r in ctw.query(spark, SF_CHECK).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    words = {i: normal(t)[0] for i, t in docs}
    counts = collections.Counter(w for i in words if not held(i) for w in [*words[i], None])
    n, v = sum(counts.values()), len(counts)
    for i, w in words.items():
        r, tokens = got[i], [*w, None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(tokens), sum(counts[x] > 0 for x in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + .5) / (n + .5 * (v + 1))) for x in tokens), rel=1e-9)
    out = [r for r in got.values() if r.held_out and r.n_tokens > 1]
    assert len(got) == len(docs) and len(out) > 100
    assert sum(r.bits_per_byte * r.n_bytes for r in out) / sum(r.n_bytes for r in out) < 2.2
