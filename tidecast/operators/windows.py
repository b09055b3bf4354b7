"""Sliding-window operators over price series (training windows, forecast input, window scaling)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import series
from .bars import chunk_of, minmax_series, scale_expr, tail_n, unscale_expr

SEQ_LEN = 60  # fixed value: sequence length of the forecasting model


def sequence_windows(bars: DataFrame, n: int = SEQ_LEN, unit: str = "hour",
                     value: str = "scaled", block_rows: int = series.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Training windows: for row i, the ``n`` values before it (``seq``) and its own value (``label``).

    A series of m rows gives max(m - n, 0) windows. Values are whole-history min-max scaled per
    series unless ``value`` names another column.
    """
    src = minmax_series(bars) if value == "scaled" and "scaled" not in bars.columns else bars

    def cols(w):
        frame = w.rowsBetween(-n, -1)
        return {"seq": F.collect_list(value).over(frame)}

    out = series.rolling(src, "ticker", "bar_ts", chunk_of(unit), n, cols, block_rows)
    return (out.where(F.size("seq") == n)
            .select("ticker", "bar_ts", "idx", "seq", F.col(value).alias("label")))


def sliding_extremes(bars: DataFrame, n: int, unit: str = "hour", value: str = "close", key: str = "ticker",
                     order: str = "bar_ts", block_rows: int = series.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Every row that has ``n`` rows up to and with it, with their min and max (``mn``, ``mx``) and ``idx``.

    Positions are cut into stretches of ``n``: a window is the end of one stretch and the start of the next, so
    its extremes are those of the running extremes from a stretch's end back to the window's first row, and from
    the next one's start on to its last. Each row is looked at a fixed number of times, whatever ``n``.
    """
    placed = series.with_reach(series.series_index(bars, key, order, chunk_of(unit, order)), n - 1, block_rows=max(block_rows, n))
    placed = placed.withColumn("_part", F.expr(f"idx div {n}")).repartition(key, series.BLOCK)
    part = Window.partitionBy(key, series.BLOCK, "_part")
    on, back = part.orderBy("idx"), part.orderBy(F.col("idx").desc())
    on, back = (w.rowsBetween(Window.unboundedPreceding, Window.currentRow) for w in (on, back))
    ran = placed.withColumns({"_a": F.min(value).over(on), "_b": F.max(value).over(on),
                              "_c": F.min(value).over(back), "_d": F.max(value).over(back)})
    first = Window.partitionBy(key, series.BLOCK).orderBy("idx")
    ran = ran.withColumns({"_c": F.lag("_c", n - 1).over(first), "_d": F.lag("_d", n - 1).over(first)})
    whole = series.drop_context(ran.where(F.col("idx") >= n - 1))
    return whole.withColumns({"mn": F.least("_a", "_c"), "mx": F.greatest("_b", "_d")}).drop("_a", "_b", "_c", "_d", "_part")


def window_minmax(bars: DataFrame, n: int = SEQ_LEN, unit: str = "hour", value: str = "close",
                  block_rows: int = series.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Min-max fitted on each full ``n``-row window ending at a row (that row included)."""
    return sliding_extremes(bars, n, unit, value, block_rows=block_rows).select(
        "ticker", "bar_ts", "idx", F.col(value).alias("close"), "mn", "mx", scale_expr(F.col(value), F.col("mn"), F.col("mx")).alias("scaled"))


def window_sequences(bars: DataFrame, n: int = SEQ_LEN, unit: str = "hour", value: str = "close",
                     block_rows: int = series.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """The ``n`` values ending at each row (inclusive), with the window's own min and max."""

    def cols(w):
        frame = w.rowsBetween(-(n - 1), 0)
        return {"seq": F.collect_list(value).over(frame)}

    out = series.rolling(bars, "ticker", "bar_ts", chunk_of(unit), n - 1, cols, block_rows).where(F.size("seq") == n)
    # the values are at hand in the row, so their extremes are one more look at them
    return out.withColumns({"mn": F.array_min("seq"), "mx": F.array_max("seq")})


def minmax_roundtrip(scaled: DataFrame) -> DataFrame:
    """Inverse of the window scaling; ``restored`` equals ``close`` up to rounding."""
    restored = unscale_expr(F.col("scaled"), F.col("mn"), F.col("mx"))
    return scaled.select("ticker", "bar_ts", "close", "scaled", restored.alias("restored"),
                         (F.abs(restored - F.col("close")) <= 1e-9).alias("exact"))


def forecast_input(bars: DataFrame, n: int = SEQ_LEN, value: str = "close") -> DataFrame:
    """Per ticker, the newest ``n`` values (newest included), oldest first, scaled on themselves.

    Built from a per-ticker top-n, so each group collected is at most n rows.
    """
    last = tail_n(bars, n)
    g = last.groupBy("ticker").agg(
        F.sort_array(F.collect_list(F.struct("bar_ts", value))).alias("pts"),
        F.max("bar_ts").alias("as_of"), F.min(value).alias("mn"), F.max(value).alias("mx"))
    return (g.where(F.size("pts") == n)
            .select("ticker", "as_of", "mn", "mx",
                    F.transform("pts", lambda p: p[value]).alias("seq"))
            .withColumn("seq_scaled",
                        F.transform("seq", lambda x: scale_expr(x, F.col("mn"), F.col("mx")))))
