"""Feature rows: ticker dimension, prediction runs, 64-value rows, shape checks and slicing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans import series
from ..streaming import triggers as TR
from .bars import chunk_of

# fixed values: the ticker -> company dimension of the pipeline.
TICKER_COMPANY = (("AAPL", "Apple"), ("GOOGL", "Google"), ("MSFT", "Microsoft"), ("AMZN", "Amazon"),
                  ("TSLA", "Tesla"), ("NFLX", "Netflix"), ("META", "Meta"), ("^OEX", "S&P 500"))

SEQ_LEN, N_AUX = 60, 4
ROW_WIDTH = SEQ_LEN + N_AUX  # 64 inputs; training rows add the target as a 65th value


def ticker_dim(spark: SparkSession, pairs=TICKER_COMPANY) -> DataFrame:
    return spark.createDataFrame(list(pairs), "ticker STRING, company STRING")


def with_company(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Left join to the ticker dimension; Spark broadcasts it where it measures small."""
    return df.join(dim.select("ticker", "company"), "ticker", "left")


def unmapped_tickers(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Tickers of ``df`` missing from the dimension (the pipeline treats them as an error)."""
    return df.select("ticker").distinct().join(dim.select("ticker"), "ticker", "left_anti")


def runs_for(bars: DataFrame) -> DataFrame:
    """Hourly prediction runs (ticker, NY date, slot, run_ts) for every date a ticker has bars."""
    days = bars.select("ticker", F.to_date(S.ny_local(F.col("bar_ts"))).alias("ny_date")).distinct()
    cal = TR.slot_calendar(days)
    return cal.where(F.col("trigger_type") == TR.HOURLY).select("ticker", "ny_date", "slot",
                                                                "run_ts")


def rolling_values(bars: DataFrame, width: int, value: str = "close", unit: str = "hour",
                   block_rows: int = series.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """The up-to-``width`` values ending at each bar (inclusive), oldest first, as ``vals``."""

    def cols(w):
        return {"vals": F.collect_list(value).over(w.rowsBetween(-(width - 1), 0))}

    return series.rolling(bars, "ticker", "bar_ts", chunk_of(unit), width - 1, cols, block_rows)


def assemble_row(seq, algo, lex, ml, llm):
    """60 closes followed by [forecast, lexicon score, classifier score, reply score]."""
    return F.concat(seq, F.array(algo.cast("double"), lex.cast("double"), ml.cast("double"),
                                 llm.cast("double")))


def check_rows(df: DataFrame, col: str = "features", width: int = ROW_WIDTH) -> DataFrame:
    """Shape check: ``valid`` when the row has ``width`` finite values, ``reason`` when not; values cast
    to float."""
    f = F.col(col)
    fine = F.forall(f, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    reason = (F.when(f.isNull() | (F.size(f) != width), F.lit("wrong_length"))
              .when(~fine, F.lit("missing_value")))
    return df.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull()).withColumn(
        col + "_f32", F.transform(f, lambda x: x.cast("float")))


def split_row(f):
    """(sequence part, auxiliary part, target) of a 65-value training row."""
    return (F.slice(f, 1, SEQ_LEN), F.slice(f, SEQ_LEN + 1, N_AUX),
            F.element_at(f, SEQ_LEN + N_AUX + 1))
