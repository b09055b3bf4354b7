"""Driver tables and the stand-ins the pipeline reads from them.

The forecasting pipeline needs ticks, daily prices, articles, pages and a clock stream. The test
tables supply each of these under other names; the mapping lives here and nowhere else:

* ticks         <- ``events``    (ticker = event_type, price = value, ordered by ts, event_id)
* daily prices  <- ``orders``    (ticker = o_orderpriority, price = o_totalprice, by o_orderdate, o_orderkey)
* articles      <- ``documents`` (company = source; a publication time derived from doc_id)
* pages         <- ``pages``     (stored HTML)
* keyed store   <- ``orders``    (one write per order, keyed by customer)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Fixed values of the stand-in mapping: articles are spaced this many minutes apart from this origin.
ARTICLE_ORIGIN = "2024-01-01 00:00:00"
ARTICLE_SPACING_MINUTES = 43


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tick stream: ticker, ts (UTC wall time), price, seq (unique tie-break within a ticker)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("ticker"), "ts", F.col("value").alias("price"),
        F.col("event_id").alias("seq"))


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily price observations; many per (ticker, day), ordered within the day by seq."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("seq"))


def published_at(doc_id: Column) -> Column:
    minutes = doc_id.cast("bigint") * ARTICLE_SPACING_MINUTES
    return (F.lit(ARTICLE_ORIGIN).cast("timestamp_ntz")
            + F.make_dt_interval(days=F.floor(minutes / 1440).cast("int"), mins=(minutes % 1440).cast("int")))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article table: doc_id, company, lang, published_at, title (first sentence), url, text."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.col("source").alias("company"), "lang",
        published_at(F.col("doc_id")).alias("published_at"),
        F.regexp_extract("text", r"^[^.\n]*", 0).alias("title"),
        F.concat(F.lit("doc://"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def kv_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of keyed writes: key, value, written_at, seq, ttl_seconds (NULL = no expiry).

    Each order is one write of its customer's key; finished orders carry a JSON value, partly filled ones
    JSON with trailing text, others a plain string, and orders of the 1-URGENT priority are written with a time-to-live.
    """
    o = table(spark, sf_dir, "orders")
    value = F.when(
        F.col("o_orderstatus") == "F",
        F.concat(F.lit('{"orderkey": '), F.col("o_orderkey").cast("string"),
                 F.lit(', "status": "F"}'))
    ).when(F.col("o_orderstatus") == "P", F.concat(
        F.lit('{"orderkey": '), F.col("o_orderkey").cast("string"), F.lit("} trailing"))
    ).otherwise(F.concat(F.lit("raw-"), F.col("o_orderkey").cast("string")))
    ttl = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice").cast("bigint"))
    return o.select(
        F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")).alias("key"),
        value.alias("value"), F.col("o_orderdate").alias("written_at"),
        F.col("o_orderkey").alias("seq"), ttl.alias("ttl_seconds"))
