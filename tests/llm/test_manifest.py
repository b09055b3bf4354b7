"""Operator 13 against a tree built in plain Python, and its DuckDB twin on documents."""

import collections
import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidecast.llm import manifest

from llm_fixtures import SF_CHECK, _shipped, edge, edge_rows, empty  # noqa: F401

FIELDS = ("doc_id", "source", "lang", "n_words", "text")


def digest(s):
    return hashlib.sha256(s.encode("utf-8")).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    """The levels of a tree, lowest first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def way(levels, at):
    out = []
    for level in levels[:-1]:
        run = level[at // 8 * 8:at // 8 * 8 + 8]
        out.append(("".join(run[:at % 8]), "".join(run[at % 8 + 1:])))
        at //= 8
    return out


def brute(rows, id_of=lambda r: r[0], group_of=lambda r: r[2]):
    """rows: (doc_id, source, lang, n_words, text) -> counter of (doc_id, leaf, subroot, root, proof, tampered root)."""
    groups = collections.defaultdict(list)
    for r in rows:
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        text = r[4]
        if bad and text is not None:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        groups[r[2]].append((r[0] is not None, r[0], digest("".join(map(enc, r))), digest("".join(map(enc, (*r[:4], text))))))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        trees[g] = tree([x[2] for x in groups[g]])
    top = tree([trees[g][-1][0] for g in names])
    out = collections.Counter()
    for i, g in enumerate(names):
        for j, (_, doc_id, leaf, bad) in enumerate(groups[g]):
            path = way(trees[g], j) + way(top, i)
            h = bad
            for left, right in path:
                h = digest(left + h + right)
            out[doc_id, leaf, trees[g][-1][0], top[-1][0], digest("".join(a + b for a, b in path)), h] += 1
    return out


def found(df):
    bad = manifest.leaf_hash(*[F.translate("text", manifest.UPPER, manifest.LOWER) if c == "text" else F.col(c) for c in FIELDS])
    hit = F.col("doc_id").isNotNull() & (manifest.bucket_of("doc_id", 3) == 0)
    out = manifest.manifest(df, fields=FIELDS, carry={"tampered": F.when(hit, bad)})
    return collections.Counter((r.doc_id, r.leaf, r.subroot, r.root, r.p, r.f) for r in out.select(
        "*", manifest.sibling_hash("path").alias("p"), manifest.fold(F.coalesce("tampered", "leaf"), "path").alias("f")).collect())


def plain(df):
    return [tuple(r) for r in df.select(*FIELDS).collect()]


def test_edge_rows_match_brute_force(edge):
    assert found(edge) == brute(plain(edge))


@pytest.mark.parametrize("count", [1, 2, 8, 9, 64, 65, 512, 513, 4097])
def test_every_tree_shape_matches_brute_force(spark, count):
    df = spark.range(count).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"),
        F.when(F.col("id") % 50 == 7, None).when(F.col("id") % 3 == 0, "é").otherwise("Z").alias("lang"),
        F.lit(1).alias("n_words"), F.concat(F.lit("Text "), F.col("id").cast("string")).alias("text")).repartition(5)
    assert found(df) == brute(plain(df))


def test_many_groups_need_several_top_levels(spark):
    df = spark.range(700).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("source"),
                                 F.col("id").cast("string").alias("lang"), F.lit(1).alias("n_words"), F.lit("").alias("text"))
    assert found(df) == brute(plain(df))


def test_rows_that_repeat_an_id_and_equal_rows(spark):
    rows = [(1, "s", "en", 1, "A")] * 40 + [(1, "s", "en", 1, f"b{i % 7}") for i in range(900)] + [(None, None, "en", None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_words int, text string").repartition(4)
    assert found(df) == brute(plain(df))


def test_empty_table_and_clashing_names(empty, edge):
    assert manifest.manifest(empty, fields=FIELDS).collect() == []
    clash = edge.withColumn("tree", F.lit(1)).withColumn("pos", F.lit(2)).withColumn("hash", F.lit("h"))
    assert found(clash) == brute(plain(edge))


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF_CHECK}/documents.parquet'")
    want = con.execute(manifest.SQL).fetchall()
    got = [tuple(r) for r in manifest.query(spark, SF_CHECK).collect()]
    assert sorted(got) == sorted(want) and len(got) == 1000
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)
