"""Price bars: resampling, look-back ranges, last-N rows, whole-series min-max scaling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Interval of a bar source -> date_trunc unit, and the chunk unit used to number a series of such
# bars (a chunk then holds at most 168 hourly, 1,440 minute or 366 daily bars of one ticker).
BAR_UNITS = {"1h": "hour", "1d": "day", "1m": "minute"}
CHUNK_UNITS = {"hour": "week", "day": "year", "minute": "day"}


def resample(ticks: DataFrame, unit: str, ticker: str = "ticker", ts: str = "ts",
             price: str = "price", seq: str = "seq") -> DataFrame:
    """Ticks -> OHLC bars per (ticker, date_trunc(unit, ts)); open/close by (ts, seq) order.

    Aggregation is partial per map task before the shuffle, so a hot ticker is reduced to at most
    one row per bar and task before it moves.
    """
    order = F.struct(F.col(ts), F.col(seq))
    return ticks.groupBy(
        F.col(ticker).alias("ticker"), F.date_trunc(unit, F.col(ts)).alias("bar_ts")
    ).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"),
        F.min(price).alias("low"), F.max_by(price, order).alias("close"),
        F.count(F.lit(1)).alias("n_ticks"))


def chunk_of(unit: str, ts: str = "bar_ts") -> Column:
    return F.date_trunc(CHUNK_UNITS.get(unit, "week"), F.col(ts))


def lookback_span(period: int, freq: str) -> tuple[int, str, bool]:
    """(amount, unit, cut_to_dates) of the look-back range ending at ``as_of``.

    The span is wide enough that a later last-``period`` selection finds ``period`` bars despite
    weekends and holidays; the formula is the pipeline's own. Units: d, h, m, y.
    """
    if period < 0:
        raise ValueError("period must be >= 0")
    days = period + math.ceil(period * 2 / 7) + (period // 360 + 1) * 12
    if freq == "d":
        return days, "days", True
    if freq == "h":
        return (math.ceil(period / 6) + 12) * 24, "hours", True
    if freq == "m":
        return days, "minutes", False
    if freq == "y":
        return int(days * 365.25 * 24 * 3600), "seconds", True
    raise ValueError(f"unknown freq {freq!r}; expected d, h, m or y")


def _interval(amount: int, unit: str) -> Column:
    return {
        "days": lambda: F.make_dt_interval(days=F.lit(amount)),
        "hours": lambda: F.make_dt_interval(hours=F.lit(amount)),
        "minutes": lambda: F.make_dt_interval(mins=F.lit(amount)),
        "seconds": lambda: F.make_dt_interval(secs=F.lit(amount)),
    }[unit]()


def lookback_bounds(as_of: Column, period: int, freq: str) -> tuple[Column, Column]:
    """Half-open [start, end) of the look-back; date-cut for d/h/y as the bar source expects."""
    amount, unit, cut = lookback_span(period, freq)
    start = as_of - _interval(amount, unit)
    if cut:
        return (F.to_date(start).cast("timestamp_ntz"), F.to_date(as_of).cast("timestamp_ntz"))
    return start, as_of


def lookback_bars(ticks: DataFrame, as_of: str, period: int, freq: str) -> DataFrame:
    """Bars of ``freq`` in the look-back range before ``as_of`` for every ticker.

    The range is applied to the raw ``ts`` first (pushed to the Parquet scan as a superset: whole
    bars overlapping the range), then exactly to ``bar_ts``.
    """
    unit = {"d": "day", "h": "hour", "m": "minute", "y": "day"}[freq]
    start, end = lookback_bounds(F.lit(as_of).cast("timestamp_ntz"), period, freq)
    pre = ticks.where((F.col("ts") >= F.date_trunc(unit, start)) & (F.col("ts") < end))
    return resample(pre, unit).where((F.col("bar_ts") >= start) & (F.col("bar_ts") < end))


def tail_n(bars: DataFrame, n: int, key: str = "ticker", order: str = "bar_ts") -> DataFrame:
    """Last ``n`` rows per key in ``order`` (fewer when short); rn = 1 is the newest.

    ``row_number() <= n`` is planned as a partial WindowGroupLimit before the shuffle, so at most n
    rows per key leave each map task.
    """
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return bars.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def minmax_fit(bars: DataFrame, key: str = "ticker", value: str = "close") -> DataFrame:
    """Per-series min and max over the whole history (partial aggregation, one row per key)."""
    return bars.groupBy(key).agg(F.min(value).alias("mn"), F.max(value).alias("mx"))


def scale_expr(x: Column, mn: Column, mx: Column) -> Column:
    """(x - mn) / range with a zero range treated as 1, so a flat series scales to 0.0."""
    return (x - mn) / F.when(mx == mn, F.lit(1.0)).otherwise(mx - mn)


def unscale_expr(s: Column, mn: Column, mx: Column) -> Column:
    return s * (mx - mn) + mn


def minmax_series(bars: DataFrame, key: str = "ticker", value: str = "close") -> DataFrame:
    """Whole-history min-max scaling per series; the fit is joined back on the key."""
    fit = minmax_fit(bars, key, value)
    return (bars.join(fit, key)
            .withColumn("scaled", scale_expr(F.col(value), F.col("mn"), F.col("mx"))))
