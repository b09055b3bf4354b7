"""Corpus preparation: documents in, token ids out, in stages that are each written and read again.

A stage deletes the intermediate tables of the stage before it when it begins, as that one's result is written
by then. Defined cases, for every stage: null and empty texts fail the quality rules, as do texts under ten words;
a null id or source is a value like any other; rows equal in id and text are one document to the stages that
compare texts; very long texts are processed whole, one at a time in a task; columns other than doc_id, text,
source and n_chars are carried along, whatever their names; an empty table passes through every stage.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import functions as F

from tidecast.llm import bpe, forest, mixing, passages, quality, ship_by_value, units
from tidecast.llm.common import MADE, discard, materialise, table
from tidecast.session import scratch_path

ship_by_value()

ORACLE_SQL = None  # similarity groups and token ids cannot be said in SQL; tests/llm holds a brute-force twin


OWN = ("doc_id", "text", "source", "n_chars")
_left: list[str] = []  # intermediate tables of the last stage


def stage(fn):
    """A stage that deletes what the stage before has left, and carries the columns it does not name in one
    struct, so that their names clash with none of its own."""
    @functools.wraps(fn)
    def run(spark, docs, sf_dir):
        discard(spark, *_left)
        mark = len(MADE)
        rest = [c for c in docs.columns if c not in OWN]
        own = [F.col(c) for c in docs.columns if c in OWN]
        out = fn(spark, docs.select(*own, F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")) if rest else docs, sf_dir)
        if "rest" in out.columns and rest:
            out = out.select(*[F.col("rest")[c].alias(c) if c in rest else F.col(c) for c in docs.columns])
        _left[:] = MADE[mark:]
        return out
    return run


@stage
def drop_low_quality(spark, docs, sf_dir):
    """Documents that fail the quality rules go."""
    # the row number keeps Spark from pushing the filter below the measures, which would then be taken twice
    judged = quality.quality_rules(docs.select("text", F.struct("*").alias("__row"))).withColumn("__n", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("__n") >= 0)).select("__row.*")


@stage
def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of similar ones stays: the earliest."""
    return forest.drop_similar(docs)


@stage
def drop_repeated_units(spark, docs, sf_dir):
    """Lines and sentences that stand in an earlier place go, then passages that do, wherever they begin and
    however short their sentences; the text's length follows."""
    cut = materialise(units.dedup_units(docs).select(*[F.col(f"`{c}`") for c in docs.columns]), "unit-cut")
    cut = passages.dedup_passages(cut)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns])


@stage
def mix_sources(spark, docs, sf_dir):
    """Each document as often as the mixture takes it, in training order."""
    return mixing.mix(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


@stage
def encode_tokens(spark, docs, sf_dir):
    """Token ids (little-endian unsigned 32-bit integers), with digests of them and of their decoding."""
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "text")).drop("text"))
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_rules", drop_low_quality), ("near_copies", drop_near_copies),
          ("unit_dedup", drop_repeated_units), ("curriculum_mix", mix_sources), ("byte_bpe", encode_tokens)]


def run(spark, sf_dir):
    docs, before = table(spark, sf_dir, "documents"), []
    for name, fn in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}-{uuid.uuid4().hex}")
        out = fn(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        discard(spark, *before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
