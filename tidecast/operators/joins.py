"""Time-aligned joins: hour-bucketed interval join and a chunked as-of join.

Both keep Spark on equi-joins (hash or sort-merge, with AQE skew splitting) instead of the nested-loop
join an inequality-only condition would get.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str,
                  lo_hours: int, hi_hours: int, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of ``right`` with ``left_ts - lo_hours <= right_ts < left_ts - hi_hours``.

    Each left row is expanded to the hour buckets its window touches (``lo - hi + 1`` at most) and
    joined on (keys, bucket); the exact bounds are then applied.
    """
    if lo_hours <= hi_hours:
        raise ValueError("lo_hours must exceed hi_hours")
    lt = F.col(left_ts)
    lo = lt - F.make_dt_interval(hours=F.lit(lo_hours))
    hi = lt - F.make_dt_interval(hours=F.lit(hi_hours))
    buckets = F.sequence(F.date_trunc("hour", lo),
                         F.date_trunc("hour", hi - F.make_dt_interval(secs=F.lit(0.000001))),
                         F.expr("INTERVAL 1 HOUR"))
    l2 = left.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_bucket", F.explode(buckets))
    r2 = right.withColumn("_bucket", F.date_trunc("hour", F.col(right_ts)))
    j = l2.join(r2, [*keys, "_bucket"])
    return (j.where((F.col(right_ts) >= F.col("_lo")) & (F.col(right_ts) < F.col("_hi")))
            .drop("_lo", "_hi", "_bucket"))


def asof_latest(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str,
                right_cols: Sequence[str], chunk_unit: str = "day") -> DataFrame:
    """Each left row with the right row of the same key having the greatest ``right_ts < left_ts``.

    Both sides are cut into time chunks. Inside a (key, chunk) the latest earlier right row comes
    from a running ``last(ignorenulls)`` over the merged rows; the latest right row of all earlier
    chunks comes from a running ``last`` over the per-chunk summaries, a table smaller than the data
    by the chunk size. No task holds a whole key. Left rows with no earlier right row get NULLs.
    """
    rcols = list(right_cols)
    rstruct = F.struct(F.col(right_ts).alias("_rt"), *[F.col(c) for c in rcols])
    lcols = [c for c in left.columns]
    chunk = lambda c: F.date_trunc(chunk_unit, F.col(c))

    l_rows = left.select(F.col(key).alias("_key"), F.col(left_ts).alias("_t"), F.lit(0).alias("_side"),
                         F.struct(*lcols).alias("_l"), F.lit(None).cast(
                             right.select(rstruct.alias("r")).schema["r"].dataType).alias("_r"))
    r_rows = right.select(F.col(key).alias("_key"), F.col(right_ts).alias("_t"),
                          F.lit(1).alias("_side"),
                          F.lit(None).cast(left.select(F.struct(*lcols).alias("l"))
                                           .schema["l"].dataType).alias("_l"),
                          rstruct.alias("_r"))
    u = l_rows.unionByName(r_rows).withColumn("_chunk", F.date_trunc(chunk_unit, F.col("_t")))
    w_in = (Window.partitionBy("_key", "_chunk").orderBy("_t", "_side")
            .rowsBetween(Window.unboundedPreceding, 0))
    inside = (u.withColumn("_hit", F.last("_r", ignorenulls=True).over(w_in))
              .where(F.col("_side") == 0))

    # latest right row of all chunks before each left chunk
    r_last = right.groupBy(F.col(key).alias("_key"), chunk(right_ts).alias("_chunk")).agg(
        F.max_by(rstruct, F.col(right_ts)).alias("_last"))
    l_chunks = left.select(F.col(key).alias("_key"), chunk(left_ts).alias("_chunk")).distinct()
    both = (l_chunks.withColumn("_side", F.lit(0)).withColumn("_last", F.lit(None).cast(
        r_last.schema["_last"].dataType))
        .unionByName(r_last.withColumn("_side", F.lit(1))))
    w_c = (Window.partitionBy("_key").orderBy("_chunk", "_side")
           .rowsBetween(Window.unboundedPreceding, 0))
    carry = (both.withColumn("_carry", F.last("_last", ignorenulls=True).over(w_c))
             .where(F.col("_side") == 0).select("_key", "_chunk", "_carry"))

    out = inside.join(carry, ["_key", "_chunk"], "left")
    best = F.coalesce(F.col("_hit"), F.col("_carry"))
    return out.select("_l.*", best["_rt"].alias(right_ts),
                      *[best[c].alias(c) for c in rcols])
