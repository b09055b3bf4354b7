"""Passage dedup against brute force, and in the pipeline's stage."""

import random
import re

import pytest

from tidecast.llm import passages

from llm_fixtures import _shipped, edge, edge_rows, empty  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")
N = passages.MIN_RUN


def brute_passages(rows, n=N):
    """Rows have ids of their own, so no two rank alike."""
    found = {k: [(m.start(), m.group().lower()) for m in WORD.finditer(t or "")] for k, (_, t) in enumerate(rows)}
    order = sorted(found, key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    first, out = {}, []
    for k in order:
        words = [w for _, w in found[k]]
        for p in range(len(words) - n + 1):
            first.setdefault(tuple(words[p:p + n]), (k, p))
    for k, (i, t) in enumerate(rows):
        words, gone = [w for _, w in found[k]], set()
        for p in range(len(words) - n + 1):
            doc, place = first[tuple(words[p:p + n])]
            if doc != k or p - place >= n:
                gone.update(range(p, p + n))
        edges = [s for s, _ in found[k]] + [len(t or "")]
        out.append((i, None if t is None else t[:edges[0]] + "".join(
            t[edges[j]:edges[j + 1]] for j in range(len(words)) if j not in gone)))
    return sorted(out, key=str)


def cut(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sorted(((r.doc_id, r.text) for r in passages.dedup_passages(d).collect()), key=str)


def test_passages_match_brute_force(spark, edge_rows):
    rng = random.Random(4)
    say = lambda n: [rng.choice(["Été", "straße", "İx", "a", "no."]) + str(rng.randrange(40)) for _ in range(n)]
    base = [say(rng.randint(45, 130)) for _ in range(8)]
    rows = []
    for k in range(120):
        words = []
        for _ in range(rng.randint(0, 4)):
            part = rng.choice(base)
            words += rng.choice([part, part[rng.randint(0, 30):], say(30), ["x"] * rng.randint(0, 140)])
        rows.append((k or None, "".join(w + rng.choice([" ", "  ", "\n"]) for w in words)))
    rows += [(1000 + k, r[1]) for k, r in enumerate(edge_rows) if k != 12]  # brute force is slow on two such texts
    assert cut(spark, rows) == brute_passages(rows)


def test_passages_equal_rows_nulls_and_empty_table(spark, edge, empty):
    text = " ".join(f"w{k}" for k in range(80))
    got = cut(spark, [(1, text), (1, text), (2, "new " + text.upper() + " end"), (None, text)])
    assert got == sorted([(1, text), (1, text), (2, "new end"), (None, "")], key=str)
    out = passages.dedup_passages(edge)
    assert out.columns == edge.columns and out.count() == edge.count()
    assert passages.dedup_passages(empty).count() == 0


@pytest.mark.parametrize("passage", [
    " ".join(f"p{k}" for k in range(70)),                             # begins and ends inside a sentence
    " ".join(f"a{k} b{k} c{k}." for k in range(30))])                 # sentences under five words
def test_pipeline_stage_drops_passages_that_units_keep(spark, passage):
    import corpus_pipeline as P

    rows = [(1, f"first text with {passage} and its end", 0), (2, f"another begins so {passage} then goes on", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in P.drop_repeated_units(spark, d, None).collect()}
    assert got[1] == (rows[0][1], len(rows[0][1]))
    assert got[2] == ("another begins so then goes on", 30)
