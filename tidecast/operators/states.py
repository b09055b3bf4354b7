"""Mergeable partial states: bars and moments that are stored small, roll up, and take late rows.

A bar's state has its first and last tick with their order keys, its extremes, and count, mean and M2 (the sum of
squared differences from the mean). States of one bar merge into that bar, and states of minutes into hours and
of hours into days, without the ticks: every part has an associative merge. Means and M2 merge by Chan's
formula, which needs no large sums of squares, folded over the at most ``FAN`` states that one group has at a time.

``BarStore`` keeps minute states by batch. A late tick is one more state of its minute, so nothing stored is read or
written again to take it.

Defined cases: NULL prices count for nothing (a bar of such ticks only has none), a NULL ticker is a series like
any other, ticks of equal time follow their sequence number, and empty input gives no bar.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = ("first_ts", "first_seq", "open", "last_ts", "last_seq", "close", "high", "low", "n_ticks", "mean", "m2")
FAN = 4096


def moments(value: str | Column) -> dict[str, Column]:
    """Aggregates that make a state of moments from rows."""
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    return {"n": F.count(x), "mean": F.avg(x), "m2": F.var_pop(x) * F.count(x)}


def merged_moments(parts: Column) -> Column:
    """One state from an array of them (structs of n, mean, m2), by Chan's formula; NULL means for no rows."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(a, b):
        n = a["n"] + b["n"]
        gap = b["mean"] - a["mean"]
        return F.when(b["n"] == 0, a).otherwise(F.struct(
            n.alias("n"), (a["mean"] + gap * b["n"] / n).alias("mean"),
            (a["m2"] + b["m2"] + gap * gap * a["n"] * b["n"] / n).alias("m2")))

    return F.aggregate(parts, zero, add, lambda s: F.struct(
        s["n"].alias("n"), F.when(s["n"] > 0, s["mean"]).alias("mean"), F.when(s["n"] > 0, s["m2"]).alias("m2")))


def merge_moments(states: DataFrame, by: list[str], order: str) -> DataFrame:
    """Merge (``by``, n, mean, m2) rows; ``order`` fixes in which order. A group of more than FAN states is merged
    in steps, so that no list grows past it."""
    part = F.struct(order, "n", "mean", "m2")
    stepped = states.withColumn("_step", F.pmod(F.xxhash64(order), F.lit(FAN)))
    for keys in ([*by, "_step"], by):
        fold = merged_moments(F.transform(F.sort_array(F.collect_list(part)), lambda p: F.struct(p["n"], p["mean"], p["m2"])))
        stepped = stepped.groupBy(*keys).agg(fold.alias("s"), F.min(order).alias(order)).select(*keys, order, "s.*")
    return stepped.drop(order)


def spread(n: Column, m2: Column) -> Column:
    """Sample standard deviation of a state; NULL for fewer than two rows."""
    return F.when(n > 1, F.sqrt(m2 / (n - 1)))


def bar_states(ticks: DataFrame, unit: str = "minute") -> DataFrame:
    """Ticks (ticker, ts, price, seq) -> a state for each (ticker, bar)."""
    t = ticks.where("price is not null")
    first, last = (f(F.struct("ts", "seq", "price"), F.struct("ts", "seq")) for f in (F.min_by, F.max_by))
    m = moments("price")
    g = t.groupBy("ticker", F.date_trunc(unit, "ts").alias("bar_ts")).agg(
        first.alias("a"), last.alias("z"), F.max("price").alias("high"), F.min("price").alias("low"),
        m["n"].alias("n_ticks"), m["mean"].alias("mean"), m["m2"].alias("m2"))
    return g.select("ticker", "bar_ts", F.col("a.ts").alias("first_ts"), F.col("a.seq").alias("first_seq"), F.col("a.price").alias("open"),
                    F.col("z.ts").alias("last_ts"), F.col("z.seq").alias("last_seq"), F.col("z.price").alias("close"),
                    "high", "low", "n_ticks", "mean", "m2")


def merge_bars(states: DataFrame, unit: str) -> DataFrame:
    """States of bars of ``unit`` or finer -> one state for each bar of ``unit``.

    A bar has at most the finer bars inside it, times the batches that brought ticks for them.
    """
    order = F.struct("first_ts", "first_seq")
    part = F.struct("first_ts", "first_seq", F.col("n_ticks").alias("n"), "mean", "m2")
    g = states.groupBy("ticker", F.date_trunc(unit, "bar_ts").alias("bar_ts")).agg(
        F.min_by(F.struct("first_ts", "first_seq", "open"), order).alias("a"),
        F.max_by(F.struct("last_ts", "last_seq", "close"), F.struct("last_ts", "last_seq")).alias("z"),
        F.max("high").alias("high"), F.min("low").alias("low"),
        merged_moments(F.transform(F.sort_array(F.collect_list(part)), lambda p: F.struct(p["n"], p["mean"], p["m2"]))).alias("m"))
    return g.select("ticker", "bar_ts", "a.*", "z.*", "high", "low", F.col("m.n").alias("n_ticks"), "m.mean", "m.m2").select(
        "ticker", "bar_ts", *STATE)


def bars_of(states: DataFrame) -> DataFrame:
    """The bars that states stand for, with the ticks' mean and sample standard deviation."""
    return states.select("ticker", "bar_ts", "open", "high", "low", "close", "n_ticks", "mean",
                         spread(F.col("n_ticks"), F.col("m2")).alias("std"))


class BarStore:
    """Minute states in a shared folder, one part for each batch of ticks."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, ticks: DataFrame, batch_id: int) -> None:
        """Store the states of a batch; a replayed batch replaces its own. Fits ``foreachBatch``."""
        bar_states(ticks).write.mode("overwrite").parquet(os.path.join(self.path, f"batch_id={batch_id}"))

    def states(self, *units: str) -> dict[str, DataFrame]:
        """The states of each unit, finest first, each rolled up from the one before."""
        below, out = self.spark.read.parquet(self.path).drop("batch_id"), {}
        for unit in units:
            below = out[unit] = merge_bars(below, unit)
        return out
