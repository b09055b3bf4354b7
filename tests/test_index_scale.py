"""The inverted index holds every count and is read in the buckets of the queries' words only."""

import os
import re

from pyspark.sql import functions as F

from tidecast.operators import text as X

TEXTS = [(1, "b a b C-c c9c a"), (2, None), (3, ""), (4, "... 12"), (5, "one"), (1, "b again"), (None, "a lost id"), (6, "z " * 5000 + "y")]


def articles(spark):
    return spark.createDataFrame(TEXTS, "doc_id LONG, text STRING").select(
        "doc_id", F.lit("c").alias("company"), F.lit("en").alias("lang"), F.lit("2024-01-01").cast("timestamp_ntz").alias("published_at"),
        F.lit("t").alias("title"), F.lit("u").alias("url"), "text")


def test_counts_in_the_index(spark, tmp_dir):
    posts = spark.read.parquet(X.build_index(articles(spark), os.path.join(tmp_dir, "index")) + "/postings")
    got = sorted(((r.doc_id or 0, r.term, r.tf) for r in posts.collect()))
    assert got == [(0, "a", 1), (0, "id", 1), (0, "lost", 1), (1, "a", 2), (1, "again", 1), (1, "b", 3), (1, "c", 4),
                   (5, "one", 1), (6, "y", 1), (6, "z", 5000)]


def test_articles_of_one_id_add_up_and_other_buckets_stay_unread(spark, tmp_dir):
    path = X.build_index(articles(spark), os.path.join(tmp_dir, "index"))
    found = X.search_index(spark, path, spark.createDataFrame([("q", "b a")], "query STRING, words STRING"))
    assert [(r.doc_id, r.score) for r in found.orderBy("rank").collect()] == [(1, 5)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|INSET|=)", plan)
