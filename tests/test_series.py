"""Blocked series windows equal plain per-series windows; index, counts and scaling edge cases."""

from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidecast.operators import bars as B
from tidecast.operators import windows as W
from tidecast.plans import series
from tidecast.sources import tables as T

from conftest import SF_SMALL


def _bars(spark, counts):
    rows = []
    t0 = datetime(2024, 1, 1)
    for tk, n in counts.items():
        for i in range(n):
            # missing hours: every 7th hour skipped, so rows are not equally spaced in time
            rows.append((tk, t0 + timedelta(hours=i + i // 7), float((i * 37) % 101)))
    return spark.createDataFrame(rows, "ticker STRING, bar_ts TIMESTAMP_NTZ, close DOUBLE")


def test_series_index_matches_row_number(spark):
    bars = B.resample(T.ticks(spark, SF_SMALL), "hour")
    got = series.series_index(bars, "ticker", "bar_ts", B.chunk_of("hour"))
    ref = bars.withColumn("idx", F.row_number().over(
        Window.partitionBy("ticker").orderBy("bar_ts")) - 1)
    a = sorted(got.select("ticker", "bar_ts", "idx").collect())
    b = sorted(ref.select("ticker", "bar_ts", "idx").collect())
    assert a == b


def test_small_blocks_equal_plain_window(spark):
    bars = _bars(spark, {"a": 130, "b": 61, "c": 5})
    plain = bars.withColumn("s", F.collect_list("close").over(
        Window.partitionBy("ticker").orderBy("bar_ts").rowsBetween(-5, -1)))

    def cols(w):
        return {"s": F.collect_list("close").over(w.rowsBetween(-5, -1))}

    blocked = series.rolling(bars, "ticker", "bar_ts", F.date_trunc("day", "bar_ts"), 5, cols,
                             block_rows=7)
    a = sorted((r.ticker, r.bar_ts, tuple(r.s)) for r in blocked.collect())
    b = sorted((r.ticker, r.bar_ts, tuple(r.s)) for r in plain.collect())
    assert a == b


def test_window_counts_for_short_series(spark):
    bars = _bars(spark, {"z0": 0, "z59": 59, "z60": 60, "z61": 61}).where(F.col("ticker") != "z0")
    sw = W.sequence_windows(bars, block_rows=64)
    counts = {r.ticker: r["count"] for r in sw.groupBy("ticker").count().collect()}
    assert counts.get("z59", 0) == 0 and counts.get("z60", 0) == 0 and counts["z61"] == 1


def test_flat_window_scales_to_zero_and_round_trips(spark):
    t0 = datetime(2024, 1, 1)
    flat = spark.createDataFrame([("f", t0 + timedelta(hours=i), 5.0) for i in range(60)],
                                 "ticker STRING, bar_ts TIMESTAMP_NTZ, close DOUBLE")
    r = W.minmax_roundtrip(W.window_minmax(flat)).collect()
    assert len(r) == 1 and r[0].scaled == 0.0 and r[0].restored == 5.0 and r[0].exact


def test_tail_counts_rows_not_time(spark):
    bars = _bars(spark, {"a": 100})
    t = B.tail_n(bars, 60).collect()
    assert len(t) == 60
    assert max(x.rn for x in t) == 60


def test_lookback_span_formula():
    assert B.lookback_span(60, "d") == (90, "days", True)
    assert B.lookback_span(60, "h") == (528, "hours", True)
    assert B.lookback_span(365, "d")[0] == 494
    assert B.lookback_span(365, "h")[0] == 1752
    assert B.lookback_span(60, "m") == (90, "minutes", False)
    import pytest
    with pytest.raises(ValueError):
        B.lookback_span(60, "q")
