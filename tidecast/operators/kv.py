"""Keyed store as a table: last-write-wins upsert, lookup, existence, delete and time-to-live.

The store is a log of writes ``(key, value, written_at, seq, ttl_seconds)``; the current state is the
latest write per key. Every operator is an aggregation or a semi/anti/left join on ``key``, so a hot
key is pre-aggregated on the map side and never gathered into one task as a list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

WRITE_COLS = ("key", "value", "written_at", "seq", "ttl_seconds")


def latest_per_key(df: DataFrame, key: str | list[str], ts: str, seq: str) -> DataFrame:
    """One row per key: the row with the greatest (ts, seq). Partial aggregation before shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(ts), F.col(seq))).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")


def with_expiry(writes: DataFrame) -> DataFrame:
    """``expires_at = written_at + ttl_seconds``; NULL when the write has no time-to-live."""
    exp = F.col("written_at") + F.make_dt_interval(secs=F.col("ttl_seconds").cast("decimal(18,6)"))
    return writes.withColumn("expires_at", F.when(F.col("ttl_seconds").isNotNull(), exp))


def upsert(store: DataFrame, writes: DataFrame) -> DataFrame:
    """Apply new writes to a store: union, then the latest write per key wins."""
    cols = list(WRITE_COLS)
    return latest_per_key(store.select(*cols).unionByName(writes.select(*cols)), "key",
                          "written_at", "seq")


def state(writes: DataFrame, as_of: str | None = None) -> DataFrame:
    """Current value per key as of a time: the latest write at or before it, if not expired."""
    w = writes if as_of is None else writes.where(
        F.col("written_at") <= F.lit(as_of).cast("timestamp_ntz"))
    latest = with_expiry(latest_per_key(w.select(*WRITE_COLS), "key", "written_at", "seq"))
    if as_of is None:
        return latest
    return latest.where(F.col("expires_at").isNull()
                        | (F.col("expires_at") > F.lit(as_of).cast("timestamp_ntz")))


def is_json(col) -> F.Column:
    """True when the whole value is one JSON document."""
    return S.strict_json(F.col(col) if isinstance(col, str) else col, "STRING")["ok"]


def lookup(store: DataFrame, keys: DataFrame, json_schema: str | None = None) -> DataFrame:
    """Left join of probe keys to the store; the value is parsed as JSON when asked.

    ``found`` is False and ``value`` NULL for absent keys; a value that is not JSON keeps its raw
    text with ``is_json`` False and NULL parsed fields.
    """
    j = keys.select("key").join(store.select("key", "value"), "key", "left")
    out = j.withColumn("found", F.col("value").isNotNull())
    if json_schema:
        ok = is_json(F.col("value"))
        out = (out.withColumn("is_json", F.coalesce(ok, F.lit(False)))
               .withColumn("parsed", F.when(ok, F.from_json("value", json_schema))))
    return out


def exists(store: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(store.select("key"), "key", "left_semi")


def delete(store: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining store, keys actually removed)."""
    k = keys.select("key")
    return store.join(k, "key", "left_anti"), store.select("key").join(k, "key", "left_semi")
