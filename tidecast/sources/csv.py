"""CSV sources and the price-history sink.

Price files hold one series each; the series name is the file's base name up to its first dot, in upper
case. The wide feature file has a header and text columns ``v1..v65``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

HISTORY_DAYS = 3652.5  # fixed value: ten years
DEFAULT_TICKER = "UNKNOWN"
PRICE_SCHEMA = "Date TIMESTAMP_NTZ, Close DOUBLE"


def series_name(path: Column) -> Column:
    """``.../aapl.us.csv`` -> ``AAPL``. Where the file is a folder of parts, as Spark writes it, the folder's
    name counts, without a partition column's name."""
    steps = F.split(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), "/")
    last = F.element_at(steps, -1)
    base = F.when(F.startswith(last, F.lit("part-")), F.element_at(steps, -2)).otherwise(last)
    return F.upper(F.regexp_extract(F.regexp_replace(base, r"^[^=]*=", ""), r"^([^.]*)", 1))


_HEADER = r'(^|,)"?Date"?(,|\r?$)'


def read_prices(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """ticker, ts, price of the price files under ``path``; ``name`` replaces the name from the file.

    Files may hold other columns, in any order, and need not agree: files are read together by their header
    line, which is looked for in one scan. A file without a ``Date`` and a ``Close`` column raises; rows without a
    date or a price go.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    files = lines.select(F.col("_metadata.file_path").alias("file"), F.when(F.col("value").rlike(_HEADER), F.col("value")).alias("header"))
    groups: dict[str, list[str]] = {}
    for r in files.groupBy("file").agg(F.min("header").alias("header")).collect():  # one row a file
        groups.setdefault(r["header"], []).append(r["file"])
    out = None
    for header, paths in sorted(groups.items(), key=lambda x: x[0] or ""):
        raw = spark.read.option("header", True).option("enforceSchema", False).csv(paths)
        if header is None or "Close" not in raw.columns:
            raise ValueError(f"no Date and Close columns in {paths[0]} and {len(paths) - 1} more")
        name_of = F.lit(name.upper()) if name else series_name(F.col("_metadata.file_path"))
        part = raw.select(name_of.alias("ticker"), F.col("Date").try_cast("timestamp_ntz").alias("ts"),
                          F.col("Close").try_cast("double").alias("price")).where("ts is not null and price is not null")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "ticker STRING, ts TIMESTAMP_NTZ, price DOUBLE")


def read_wide(spark: SparkSession, path: str, columns: int = 65) -> DataFrame:
    """The wide feature file as text columns; ``ml.wide_cast`` makes numbers of them."""
    raw = spark.read.option("header", True).csv(path)
    names = [f"v{k}" for k in range(1, columns + 1)]
    missing = [c for c in names if c not in raw.columns]
    if missing:
        raise ValueError(f"wide file lacks columns: {missing[:5]}")
    keep = [c for c in raw.columns if c not in names]
    return raw.select(*keep, *names)


def price_history(prices: DataFrame, as_of: str, ticker: str | None = None) -> DataFrame:
    """The rows of the ten years that end a day before ``as_of``, that instant not included: (ts, price) as ``Date``
    and ``Close``, every other column as it is, and the constant ``Ticker``."""
    end = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(1))
    start = end - F.make_dt_interval(hours=F.lit(int(HISTORY_DAYS * 24)))
    kept = prices.where((F.col("ts") >= start) & (F.col("ts") < end))
    rest = [c for c in prices.columns if c not in ("ts", "price") and c.lower() != "ticker"]
    name = F.upper(F.lit(ticker)) if ticker else F.lit(DEFAULT_TICKER)
    return kept.select(F.col("ts").alias("Date"), F.col("price").alias("Close"), *[F.col(f"`{c}`") for c in rest], name.alias("Ticker"))


def default_name(ticker: str | None = None) -> str:
    return f"{(ticker or DEFAULT_TICKER).upper()}_10_years_data.csv"


def write_price_history(prices: DataFrame, path: str | None, as_of: str, ticker: str | None = None, folder: str | None = None):
    """Write the history as CSV to ``path``, or under its default name in ``folder`` (the shared one, if none is
    given); returns the path. False, and nothing written, when no row lies in the window."""
    rows = price_history(prices, as_of, ticker)
    if rows.isEmpty():
        return False
    path = path or f"{folder or scratch_path(prices.sparkSession, 'history')}/{default_name(ticker)}"
    rows.write.option("header", True).mode("overwrite").csv(path)
    return path
