"""Operators 1, 4, 5, 8, 9 and 10 against brute force, on edge cases and on documents."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.llm import bpe, langid, mixing, quality, toxicity, units
from tidecast.llm.common import bucket_of
from tidecast.llm.kernels import span_hash

from llm_fixtures import SF_CHECK, _shipped, edge, edge_rows, empty  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def duck_rows(sql, spark, df, name="documents"):
    con = duckdb.connect()
    con.register(name, df.toPandas().astype({"doc_id": "Int64"}))
    return con.execute(sql).fetchall()


def as_set(rows):
    return collections.Counter(tuple(str(x) for x in r) for r in rows)


# ---- 4: quality rules

def repeat_words(words):
    seen = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if seen[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    return len(hit)


def test_quality_measures_match_brute_force(edge, edge_rows):
    out = quality.quality_rules(edge)
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                               r.base_failed) for r in out.collect())
    want = collections.Counter()
    for doc_id, t, *_ in edge_rows:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        rep = repeat_words(w)
        want[doc_id, len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t), len(lines) - len(set(lines)), rep,
             len(w) < 10 or 100 * rep > 20 * len(w)] += 1
    assert got == want
    assert "score" in out.columns and out.columns.count("n_words") == 1


def test_quality_plan_is_one_projection_without_python(edge):
    plan = quality.quality_rules(edge)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Scan")[0].replace("REPARTITION", "") or "RoundRobin" in plan
    assert "Python" not in plan and "Arrow" not in plan


def test_quality_rules_reject_symbols_and_empty_table(spark, empty):
    junk = " ".join(f"word{i}***" for i in range(30))
    clean = "the quick brown fox walks over the hill and then it is gone from the valley of kings"
    d = spark.createDataFrame([(1, junk), (2, clean)], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality.quality_rules(d).collect()} == {1: False, 2: True}
    assert quality.quality_rules(empty).count() == 0


# ---- 5: unit dedup

def brute_units(rows, least=units.MIN_WORDS):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    first, out = {}, {}
    for k in order:
        text = rows[k][1]
        kept, gone = [], 0
        for i, m in enumerate(x for x in re.finditer(units.UNIT, text or "") if x.group()):
            words = WORD.findall(m.group().lower())
            key = " ".join(words)
            here = (rows[k][0], text, i)
            if len(words) >= least and first.setdefault(key, here) != here:
                gone += 1
            else:
                kept.append(m.group())
        out[k] = (rows[k][0], None if text is None else "".join(kept), gone)
    return collections.Counter(out.values())


def test_units_match_brute_force(spark, edge, edge_rows):
    # rows of one id but different texts are ranked by a hash, so give every text its own id here
    rows = [(k, r[1]) for k, r in enumerate(edge_rows)]
    out = units.dedup_units(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = collections.Counter((r.doc_id, r.text, r.n_removed) for r in out.collect())
    assert got == brute_units(rows)


def test_units_tile_and_keep_offsets(edge):
    for r in units.dedup_units(edge).collect():
        if r.text is None:
            assert r.n_units == 0 and r.removed_spans == []
    for text in ("a b. c d\n\ne f", "no end", "v1.2 is out. Yes!? Ok...\tfine\n", "...", "\n"):
        tiles = units.units(text, 1)
        assert "".join(text[s:e] for s, e, _ in tiles) == text


def test_units_equal_rows_and_clashing_columns(spark, empty):
    d = spark.createDataFrame([(1, "one two three four five six.", 7), (1, "one two three four five six.", 7),
                               (2, "one two three four five six. new words", 7)], "doc_id long, text string, n_units int")
    got = sorted((r.doc_id, r.text, r.n_removed) for r in units.dedup_units(d).collect())
    assert got == [(1, "one two three four five six.", 0)] * 2 + [(2, "new words", 1)]
    assert units.dedup_units(empty).count() == 0


# ---- 8: byte-level BPE

@pytest.fixture(scope="module")
def reference_encoding():
    import public_tokenizers as P
    import tiktoken
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_rank_merging_on_all_code_points_and_fuzz(reference_encoding):
    import public_tokenizers as P
    encoder = bpe.Encoder(bpe.model_json(bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))))
    rng = random.Random(3)
    bits = ["a", " ", "  ", "\n", "\t", "'s", "'S", "'re", "'", "'d", "'ve", "é", "中", "😀", "1", "22", "...", "the",
            "\u0085", " ", "aaaa", "\x00", "\x1c", "l", "<|endoftext|>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(20_000)]
    texts += [f"a{chr(c)}{chr(c)} {chr(c)}1 {chr(c)}" for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    for got, text in zip(encoder.encode(texts), texts):
        assert got.tolist() == reference_encoding.encode_ordinary(text), text


def test_bpe_round_trip_and_offsets(edge, edge_rows, reference_encoding, empty):
    out = bpe.decode(bpe.encode(edge, offsets=True)).select("doc_id", "text", "n_tokens", "ids", "offsets", "decoded")
    for r in out.collect():
        text = r.text or ""
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == reference_encoding.encode_ordinary(text) and r.n_tokens == len(ids)
        assert bytes(r.decoded).decode("utf-8") == text
        spans = np.frombuffer(r.offsets, "<u4").reshape(-1, 2)
        for token, (s, e) in list(zip(ids, spans.tolist()))[:300]:
            assert reference_encoding.decode_single_token_bytes(token) in text[s:e].encode()
    assert bpe.encode(empty).count() == 0


# ---- 9: mixing

def test_mixing_matches_sql_on_edge_cases(spark, edge, edge_rows):
    rows = [(k, r[1], r[3]) for k, r in enumerate(edge_rows)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan_mix(d.repartition(3)).select(
        F.col("id"), "size", "source_size", "target", "copies", "taken").collect()
    want = duck_rows(mixing.SQL, spark, d)
    assert as_set(got) == as_set(tuple(w[:6]) for w in want)


def test_mixing_targets_and_caps(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * 1 for _ in range(rng.randint(1, 60))), rng.choice("aab") + "x" * (i % 7 == 0))
            for i in range(3000)]
    plan = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    by = plan.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("goal"),
                                    F.first("source_size").alias("s"), F.max("copies").alias("c")).collect()
    assert sum(r.goal for r in by) == pytest.approx(sum(r.s for r in by))
    for r in by:
        assert r.c <= mixing.MAX_REPEATS and r.goal <= 3 * r.s + 1e-6
        assert abs(r.t - r.goal) <= 60


def test_mixing_one_dominating_text(spark):
    """A text that holds half of its source shuts out none of the small ones, whatever the target."""
    small = [(i, "w " * 20, "a") for i in range(1, 1001)]
    other = lambda words: [(10_000 + i, "v " * 100, "b") for i in range(words // 100)]
    for words in (3000, 8000, 20_000, 44_000):  # targets of the first source: a third of all words, at most three times its own
        d = spark.createDataFrame([(0, "w " * 20_000, "a"), *small, *other(words)], "doc_id long, text string, source string")
        plan = mixing.plan_mix(d).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("goal"), F.sum(
            F.when(F.col("size") == 20, F.col("copies"))).alias("small"), F.max("copies").alias("c")).collect()
        for r in plan:
            assert abs(r.t - r.goal) <= max(0.01 * r.goal, 50) and r.c <= 3
            assert r.source == "b" or r.small > 0


def test_mixing_whole_tables_come_near_their_targets(spark):
    d = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    plan = mixing.plan_mix(d).groupBy("source").agg(
        F.sum("taken").alias("t"), F.first("target").alias("goal"), F.min("size").alias("least")).collect()
    for r in plan:
        assert abs(r.t - r.goal) <= max(0.01 * r.goal, r.least)


def test_mixing_weights_and_schedules_are_arguments(spark):
    rows = [(i, "w " * (1 + i % 9), "ab"[i % 2]) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.plan_mix(d, weights=(1, 4), schedules=((0, 1, 0), (1,) * 2))
    by = {r.source: r for r in plan.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("goal")).collect()}
    assert by["b"].goal == pytest.approx(4 * by["a"].goal) and abs(by["a"].t - by["a"].goal) <= 1
    times = {s: sorted(t for r in plan.where(F.col("source") == s).collect() for t in r.positions) for s in "ab"}
    early = sum(t < 0.25 for t in times["a"]) / len(times["a"])
    assert early == pytest.approx(0.125, abs=0.03) and sum(t < 0.25 for t in times["b"]) / len(times["b"]) == pytest.approx(0.25, abs=0.03)


def test_mixing_positions_follow_the_schedule(spark, edge, empty):
    t = spark.range(0, 101).select((F.col("id") / 100).alias("share"))
    for knots in ((1.6, 0.4), (0.8, 1.2), (0, 2), (3, 0), (1, 3, 0, 2), (0, 0, 5)):
        n = len(knots) - 1
        total = sum((a + b) / 2 / n for a, b in zip(knots, knots[1:]))
        for r in t.select("share", F.expr(mixing.invert_demand("share", knots)).alias("t")).collect():
            at, done = r.t * n, 0.0
            for k in range(n):
                x = min(max(at - k, 0), 1)
                done += (knots[k] * x + (knots[k + 1] - knots[k]) * x * x / 2) / n / total
            assert done == pytest.approx(r.share, abs=1e-9)
    out = mixing.mix(edge)
    assert set(out.columns) == {*edge.columns, "position"}
    assert out.count() == mixing.plan_mix(edge).agg(F.sum("copies")).first()[0]
    assert mixing.mix(empty).count() == 0


def test_mixing_of_a_file_table_is_sorted_and_whole(spark):
    d = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    out = mixing.mix(d)
    got = [r.position for r in out.select("position").collect()]
    assert got == sorted(got)
    plan = {r.id: r.copies for r in mixing.plan_mix(d).collect()}
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {i: c for i, c in plan.items() if c}
    clash = d.withColumn("row", F.lit(1)).withColumn("_metadata", F.lit("x")).withColumn("position", F.lit(2))
    assert mixing.mix(clash).count() == len(got)


# ---- 1: toxicity

def test_toxicity_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(d.select("doc_id", "text"), labels.where(bucket_of("doc_id", 5) != 0))
    out = toxicity.score(d.select("doc_id", "text"), model).join(labels, "doc_id").where(
        bucket_of("doc_id", 5) == 0).toPandas()
    hit = out[out.toxic == 1]
    assert (hit.predicted == 1).mean() > 0.6
    assert (out[out.toxic == 0].predicted == 1).mean() < 0.01
    assert len(model[1]) < toxicity.BUCKETS / 20  # most weights are exactly zero


def test_toxicity_edge_cases(spark, edge, edge_rows, empty):
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(16)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(edge, labels)
    out = toxicity.score(edge, model).collect()
    assert len(out) == len(edge_rows) and all(0 <= r.score <= 1 for r in out)
    none = toxicity.fit(edge, labels.limit(0))
    assert {r.predicted for r in toxicity.score(edge, none).collect()} == {0}
    assert toxicity.score(empty, model).count() == 0


def test_ftrl_learns_a_word_and_leaves_others_at_zero():
    data = [f"{'bad' if k % 4 == 0 else 'fine'} w{k % 50} x{k % 7}".encode() for k in range(400)]
    of, bucket = toxicity.features(data)
    parts = np.split(bucket, np.searchsorted(of, np.arange(1, len(data))))
    z, n = np.zeros(toxicity.BUCKETS + 1), np.zeros(toxicity.BUCKETS + 1)
    toxicity.learn([(p, float(k % 4 == 0)) for k, p in enumerate(parts)], z, n, 5)
    w = toxicity.weights_of(z[:-1], n[:-1])
    _, bad = toxicity.features([b"bad"])
    assert w[bad[0]] > 0.5 and (w == 0).mean() > 0.999


# ---- 10: language

def test_language_held_out(spark):
    out = langid.query(spark, SF_CHECK).join(
        spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (out[out.held_out].lang == out[out.held_out].lang_pred).mean() > 0.98
    held = out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)
    assert (held == out.held_out).all()


def test_language_mixture_and_edge_cases(spark, edge, edge_rows, empty):
    d = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    model = langid.fit(d)
    some = {r.lang: r.text for r in d.where("length(text) > 2000").dropDuplicates(["lang"]).collect()}
    both = spark.createDataFrame([(1, some["en"][:1500] + " " + some["de"][:1500])], "doc_id long, text string")
    shares = langid.predict(both, model).first().lang_shares
    assert shares["en"] > 0.3 and shares["de"] > 0.3 and "fr" not in shares
    out = langid.predict(edge, model).collect()
    assert len(out) == len(edge_rows)
    for r in out:
        letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letter) and 0 <= r.score <= 1
    nothing = langid.fit(d.where("lang is null"))
    assert {r.lang_pred for r in langid.predict(edge, nothing).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0


def test_span_hash_depends_on_bytes_only():
    data = np.frombuffer(b"abcXabcYabd", np.uint8)
    h = span_hash(data, np.array([0, 4, 8]), np.array([3, 7, 11]), 0x9E3779B97F4A7C15)
    assert h[0] == h[1] != h[2]
    assert hashlib.md5(h.tobytes()).hexdigest()
