"""Helpers shared by the training-data operators: tables, shared scratch tables, skew-safe lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# Fixed value: a word is a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


MADE: list[str] = []  # paths of all intermediate tables, in order


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    MADE.append(scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}"))
    return MADE[-1]


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def bucket_of(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id falls in bucket 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % n, F.lit(0))


HOT_KEYS = 1000


def lookup_skewed(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left join of ``rows`` with one fact row per key, where one key may hold most of the rows.

    ``facts[count]`` says how many of the ``total`` rows carry the key. At most ``HOT_KEYS`` keys can
    each hold more than ``total / HOT_KEYS`` rows, so those facts are broadcast: that is the proof of
    the bound. All other keys are small and take the shuffle join.
    """
    share = max(1, total // HOT_KEYS)
    hot = facts.where(F.col(count) > share)
    hot_keys = F.broadcast(hot.select(F.col(key), F.lit(True).alias("_hot")))
    marked = rows.join(hot_keys, key, "left")
    near = marked.where("_hot").drop("_hot").join(F.broadcast(hot), key, "left")
    far = marked.where("_hot is null").drop("_hot").join(facts.where(F.col(count) <= share), key, "left")
    return near.unionByName(far)
