"""The inverted index: same answers as reading the texts, a plan without texts, ties, filters and empty input."""

import os
from datetime import datetime, timedelta

import pytest

from tidecast.operators import text as X

ARTS = "doc_id LONG, company STRING, lang STRING, published_at TIMESTAMP_NTZ, title STRING, url STRING, text STRING"


def arts(spark):
    t0 = datetime(2024, 1, 1)
    texts = ["apple stock apple\nmore", "Apple pie", "stock of stock", None, "", "banana", "apple", "APPLE-stock banana stock"]
    rows = [(i, "c", "fr" if i == 6 else "en", t0 + timedelta(hours=i), f"t{i}", f"u{i}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ARTS)


def search(spark, path, rows, **how):
    q = spark.createDataFrame(rows, "query STRING, words STRING")
    return sorted((r.query, r["rank"], r.doc_id, r.score) for r in X.search_index(spark, path, q, **how).collect())


@pytest.fixture()
def index(spark, tmp_dir):
    return X.build_index(arts(spark), os.path.join(tmp_dir, "index"))


def test_scores_ties_and_top(spark, index):
    got = search(spark, index, [("a", "apple stock"), ("b", "Banana"), ("none", "cherry"), ("same", "apple apple")])
    assert got == [("a", 1, 0, 3), ("a", 2, 7, 3), ("a", 3, 2, 2), ("a", 4, 1, 1), ("a", 5, 6, 1),
                   ("b", 1, 5, 1), ("b", 2, 7, 1), ("same", 1, 0, 2), ("same", 2, 1, 1), ("same", 3, 6, 1), ("same", 4, 7, 1)]
    assert [r[2] for r in search(spark, index, [("a", "apple stock")], page_size=2)] == [0, 7]
    assert [r[2] for r in search(spark, index, [("a", "apple")], lang="fr")] == [6]
    assert [r[2] for r in search(spark, index, [("a", "apple")], start="2024-01-01 01:00:00", end="2024-01-01 07:00:00")] == [1, 6]


def test_same_as_reading_the_texts(spark, index):
    want = [(r.doc_id, r.score) for r in X.search(arts(spark), "apple").collect()]
    got = [(d, s) for _, _, d, s in search(spark, index, [("a", "apple stock")], lang="en")]
    assert got == want


def test_the_plan_reads_no_text(spark, index):
    q = spark.createDataFrame([("a", "apple")], "query STRING, words STRING")
    plan = X.search_index(spark, index, q)._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan and "postings" in plan
    facts = spark.read.parquet(f"{index}/facts")
    assert "text" not in facts.columns and {r.doc_id: r.n_tokens for r in facts.collect()}[0] == 4


def test_empty_articles(spark, tmp_dir):
    path = X.build_index(arts(spark).limit(0), os.path.join(tmp_dir, "none"))
    assert search(spark, path, [("a", "apple")]) == []
