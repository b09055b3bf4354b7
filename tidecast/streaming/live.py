"""The keyed store with time-to-live as a stream: one value state and one timer for each key.

``transformWithState`` keeps a key's latest write, by (written_at, seq), and a timer at the time it expires. A
write that becomes the latest is emitted as ``set``; when the watermark passes a key's expiry the timer removes
its state and ``expired`` is emitted. Folding the changes in order, which ``current`` does, gives the live keys at
the watermark, and state and timers come back from the checkpoint after a restart.

Defined cases: a null key is no key and is left out; a write older than the key's latest, or equal to it, emits
nothing; a key written again after its expiry is set anew; a write that is already expired at the watermark is set
and expires at once; a null ``ttl_seconds`` never expires, and one of 0 or less expires at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CHANGES = "key STRING, change STRING, value STRING, at_ms BIGINT, seq BIGINT, expires_ms BIGINT"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LiveKeys(StatefulProcessor):
    """Latest write of each key, removed by a timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "value STRING, at_ms BIGINT, seq BIGINT, expires_ms BIGINT")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = max(((r["at_ms"], r["seq"], r["expires_ms"], r["value"]) for r in rows), key=lambda x: x[:2])
        now = self.latest.get() if self.latest.exists() else None
        if now is not None:
            if (now[1], now[2]) >= best[:2]:
                return
            if now[3] is not None:
                self.handle.deleteTimer(now[3])
        at, seq, expires, value = best
        self.latest.update((value, at, seq, expires))
        if expires is not None:
            self.handle.registerTimer(expires)
        yield Row(key=key[0], change="set", value=value, at_ms=at, seq=seq, expires_ms=expires)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = self.latest.get() if self.latest.exists() else None
        if now is not None and now[3] == expiredTimerInfo.getExpiryTimeInMs():
            self.latest.clear()
            yield Row(key=key[0], change="expired", value=None, at_ms=now[1], seq=now[2], expires_ms=now[3])

    def close(self) -> None:
        pass


def _ms(ts):
    return F.unix_millis(ts.cast("timestamp"))


def changes(writes: DataFrame, watermark: str = "0 seconds") -> DataFrame:
    """The changes of a stream of (key, value, written_at, seq, ttl_seconds); ``watermark`` is how late a write may
    come, as a write behind the watermark is dropped."""
    rows = writes.where("key is not null").select(
        "key", "value", "seq", F.col("written_at").cast("timestamp").alias("event_time"), _ms(F.col("written_at")).alias("at_ms"),
        (_ms(F.col("written_at")) + F.col("ttl_seconds") * 1000).alias("expires_ms"))
    return rows.withWatermark("event_time", watermark).groupBy("key").transformWithState(
        statefulProcessor=LiveKeys(), outputStructType=CHANGES, outputMode="Update", timeMode="EventTime")


@contextmanager
def state_store(spark: SparkSession):
    """Value states and timers need the RocksDB state store; a query keeps the one it was started with."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def current(told: DataFrame) -> DataFrame:
    """(key, value, written_at, expires_at) of the keys alive after the changes told."""
    order = F.struct("at_ms", "seq", F.col("change") == "expired")
    last = told.groupBy("key").agg(F.max_by(F.struct("change", "value", "at_ms", "expires_ms"), order).alias("c"))
    time = lambda c: F.timestamp_millis(c).cast("timestamp_ntz")
    return last.where("c.change = 'set'").select("key", "c.value", time("c.at_ms").alias("written_at"), time("c.expires_ms").alias("expires_at"))
