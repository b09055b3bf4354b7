"""The pipeline's stages on null, empty, very long and repeated rows, an empty table and clashing names."""

import collections

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from llm_fixtures import _shipped, edge_rows  # noqa: F401

SCHEMA = "doc_id long, text string, lang string, source string, kept string, __row int, position double, digest string, row int"


def rows_of(edge_rows):
    long_text = edge_rows[11][1]
    prose = " ".join(f"the word{i} of that day was {i * 7 % 101}" for i in range(40))
    texts = [(i, t, lang, source) for i, t, lang, source, *_ in edge_rows]
    texts += [(100, prose, "en", "s1"), (100, prose, "en", "s1"), (101, prose, "en", None), (102, long_text, "en", "s2"), (None, prose, None, None)]
    return [(*r, "x", 3, 0.5, "d", 9) for r in texts]


@pytest.mark.parametrize("empty", [False, True])
def test_stages_in_order(spark, tmp_path, edge_rows, empty):
    rows = [] if empty else rows_of(edge_rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    columns, counts = docs.columns, []
    for k, (name, fn) in enumerate(P.STAGES):
        path = str(tmp_path / name)
        fn(spark, docs, None).write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns
            assert docs.where("kept <> 'x' or __row <> 3 or digest <> 'd'").count() == 0
            assert docs.where("text is null").count() == 0
    if empty:
        assert counts == [0] * 5
        return
    # near copies: one document of each text, the earliest id's
    copies = spark.read.parquet(str(tmp_path / "near_copies")).select("doc_id", F.md5(F.col("text").cast("binary")).alias("h")).collect()
    assert max(collections.Counter(r.h for r in copies).values()) == 1
    assert 100 in {r.doc_id for r in copies} and not {101, 102, None} & {r.doc_id for r in copies}
    assert counts[0] > counts[1] and counts[3] == counts[4] > 0


def test_stages_delete_what_the_stage_before_made(spark, tmp_path, edge_rows):
    docs = spark.createDataFrame(rows_of(edge_rows), SCHEMA)
    P.STAGES[1][1](spark, docs, None).write.parquet(str(tmp_path / "a"))
    made = list(P._left)
    exists = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(
        spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))
    assert made and all(map(exists, made))
    P.STAGES[0][1](spark, spark.read.parquet(str(tmp_path / "a")), None).write.parquet(str(tmp_path / "b"))
    assert not any(map(exists, made))
