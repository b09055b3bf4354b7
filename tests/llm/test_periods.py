"""Operator 12 against brute force over all periods."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.llm import periods

from llm_fixtures import SF_SMALL, _shipped, edge, edge_rows, empty  # noqa: F401


def brute(words):
    """(start, length, period) of every run, by trying every period."""
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(6, 4 * q) and not any(
                    all(words[k] == words[k + p] for k in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {k for s, size, q in runs for k in range(s + q, s + size)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def cases():
    rng = random.Random(5)
    out = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 97, list("ab" * 4), list("ab" * 30 + "c" + "ab" * 30), fibonacci(300),
           list("aab" * 2 * 10 + "b") * 6, [bin(i).count("1") % 2 and "x" or "y" for i in range(512)],
           (["a"] * 15 + ["b"]) * 5 + ["a"] * 40, (list("aaaaaab") * 5 + ["c"]) * 5]
    for letters in ("ab", "abc"):
        out += [[rng.choice(letters) for _ in range(rng.randrange(200))] for _ in range(40)]
    for _ in range(40):  # periodic stretches inside noise, nested
        unit = [rng.choice("abcd") for _ in range(rng.randrange(1, 23))]
        text = [rng.choice("abcdef") for _ in range(rng.randrange(30))]
        text += (unit * 9)[:rng.randrange(3, 9 * len(unit) + 1)]
        text += [rng.choice("abcdef") for _ in range(rng.randrange(30))]
        out.append(text * rng.choice((1, 1, 4, 5)))
    return out


def test_runs_match_brute_force_side_by_side():
    texts = cases()
    codes, sizes = [], []
    for words in texts:
        known = {}
        codes += [known.setdefault(w, len(known)) for w in words]
        sizes.append(len(words))
    sizes = np.array(sizes)
    got = periods.find(np.array(codes, np.int64), sizes)
    starts = np.cumsum(sizes) - sizes
    want = [(s + at, s + at + size, q) for s, words in zip(starts, texts) for at, size, q in brute(words)]
    assert [tuple(x) for x in got.T] == sorted(want, key=lambda r: (r[0], r[2]))
    assert len(want) > 100


@pytest.mark.parametrize("size", [1, 2, 8, 64])
def test_differences_are_exact_past_one_prime(size):
    rng = np.random.default_rng(size)
    codes = rng.integers(0, 3, 40 * size + 3 * size) * 700_000  # sums past 2**31 from the first scale on
    at = np.arange(40) * size
    got = periods.zero_differences(codes, at, size)
    for d in range(size):
        assert got[d].tolist() == [bool((codes[a:a + size] == codes[a + size + d:a + 2 * size + d]).all()) for a in at]
    assert len(periods.primes_for(periods.PRIMES[0][0])) == 2


def test_a_misleading_hash_is_found_again_exactly(monkeypatch):
    monkeypatch.setattr(periods.Spans, "same", lambda self, a, b, size: np.ones(len(a), bool))
    words = list("xyz" + "ab" * 9 + "q" + "c" * 8)
    codes = np.array([sorted(set(words)).index(w) for w in words], np.int64)
    got = periods.find(codes, np.array([len(words)]))
    assert [(s, e - s, q) for s, e, q in got.T] == brute(words)


def test_operator_on_edge_rows(edge, edge_rows):
    out = periods.find_runs(edge.withColumn("runs", F.lit("clash")))
    got = collections.Counter((r.doc_id, r.text, r.n_words, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed)
                              for r in out.collect())
    want = collections.Counter()
    for doc_id, t, *_ in edge_rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute(words) if len(words) < 1000 else []
        want[doc_id, t, len(words), tuple(runs), collapsed(words, runs)] += 1
    assert got == want and out.columns.count("runs") == 1 and "score" in out.columns
    assert periods.find_runs(edge.limit(0)).collect() == []


def test_very_long_periodic_texts(spark):
    unit = " ".join(f"w{i}" for i in range(9_000))
    rows = [(1, " ".join([unit] * 5) + " end"), (2, "la " * 120_000), (3, "a b c d e f g")]
    got = {r.doc_id: r for r in periods.find_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 45_000, 9_000)] and got[1].collapsed == unit + " end"
    assert [tuple(x) for x in got[2].runs] == [(0, 120_000, 1)] and got[2].collapsed == "la"
    assert got[3].runs == [] and got[3].collapsed == "a b c d e f g"


def test_query_matches_brute_force(spark):
    got = {r.doc_id: tuple(r)[1:] for r in periods.query(spark, SF_SMALL).collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    n_planted = 0
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            n_planted += 1
        runs = brute(words) if n < 3000 else None
        if runs is None:
            continue
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want = (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(collapsed(words, runs)))
        assert got[doc_id] == want, doc_id
    assert n_planted > 5 and len(got) == len(docs) and sum(r[0] > 0 for r in got.values()) >= n_planted // 2
