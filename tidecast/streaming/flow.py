"""Structured Streaming forms of the trigger flow and of bar building.

* ``trigger_messages`` - clock stream -> slot match (stream-static join with the 9-row slot table) ->
  first fire per (type, date, slot) with ``dropDuplicatesWithinWatermark`` -> topic + JSON value.
* ``write_messages``   - Kafka sink when servers are given (without the connector that raises), else the topic
  log of ``sources.topics``; both checkpointed in the shared folder, so a restart neither loses nor repeats a
  slot.
* ``route``            - ``foreachBatch`` router: parse, quarantine bad rows, call one handler per topic; what a
  failing handler was given is kept as dead letters and given to it again with the next batch.
* ``stream_bars``      - event-time hourly bars with a watermark, appended when a window closes.
* ``split_late``       - ``foreachBatch`` splitter that sends the rows a watermark would drop to a side table.
* ``rows_dropped``     - how many rows a query's stateful operators have dropped as late, from its progress.

Event time must be TIMESTAMP (not TIMESTAMP_NTZ) for watermarks, so ``ts`` is cast first; the
session time zone is UTC, so the instant is unchanged.
"""

from __future__ import annotations

import os
import traceback
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kvstore import Files
from ..session import scratch_path
from ..sources import topics as TL
from . import triggers as TR

WATERMARK = "10 minutes"


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn("event_time", F.col(ts).cast("timestamp"))


def trigger_messages(spark: SparkSession, clock: DataFrame, ts: str = "ts",
                     watermark: str = WATERMARK) -> DataFrame:
    m = TR.match_slots(spark, event_time(clock, ts), ts).withWatermark("event_time", watermark)
    first = m.dropDuplicatesWithinWatermark(["trigger_type", "ny_date", "hour", "minute"])
    return TR.message(first, ts).select("topic", "value", "ny_date", "hour", "minute",
                                        "trigger_type")


def kafka_available(spark: SparkSession) -> bool:
    try:
        spark._jvm.java.lang.Class.forName(
            "org.apache.spark.sql.kafka010.KafkaSourceProvider")
        return True
    except Exception:  # noqa: BLE001
        return False


def need_kafka(spark: SparkSession) -> None:
    if not kafka_available(spark):
        raise RuntimeError("Kafka servers were given, but the Kafka connector is not on the class path")


def write_messages(msgs: DataFrame, name: str, path: str | None = None,
                   kafka_servers: str | None = None, checkpoint: str | None = None):
    """Start the sink query; returns the StreamingQuery. Exactly-once per slot via checkpointing."""
    spark = msgs.sparkSession
    ckpt = checkpoint or scratch_path(spark, f"streams/{name}/checkpoint")
    out = msgs.select("topic", "value")
    if kafka_servers:
        need_kafka(spark)
        w = (out.writeStream.format("kafka").option("kafka.bootstrap.servers", kafka_servers)
             .option("checkpointLocation", ckpt))
    else:
        target = path or scratch_path(spark, f"streams/{name}/data")
        TL.register(spark)
        w = (out.writeStream.format(TL.FORMAT).option("path", target).option("writer", name)
             .option("checkpointLocation", ckpt))
    return w.outputMode("append").queryName(name)


def read_messages(spark: SparkSession, path: str | None = None, kafka_servers: str | None = None,
                  topics: tuple[str, ...] = tuple(TR.TOPICS.values()), group: str | None = None) -> DataFrame:
    """Two-topic source from the earliest offset: Kafka, or the topic log at ``path``. A ``group`` has its
    offsets told to the log as its batches are done."""
    if kafka_servers:
        need_kafka(spark)
        return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", kafka_servers)
                .option("subscribe", ",".join(topics)).option("startingOffsets", "earliest")
                .load().select("topic", F.col("value").cast("string").alias("value")))
    TL.register(spark)
    stream = spark.readStream.format(TL.FORMAT).option("topics", ",".join(topics))
    if group:
        stream = stream.option("group", group)
    return stream.load(path).select("topic", "value")


Handler = Callable[[DataFrame, int], None]


LETTER = "topic STRING, value STRING, attempts INT, first_batch BIGINT, error STRING"


def dead_letters(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The messages still to be applied after the newest batch (before batch ``before``)."""
    done = [int(n.split("=")[1]) for n in Files(spark, path).names("") if n.startswith("batch_id=")]
    done = [n for n in done if before is None or n < before]
    if not done:
        return spark.createDataFrame([], LETTER)
    return spark.read.schema(LETTER).parquet(os.path.join(path, f"batch_id={max(done)}"))


def route(handlers: dict[str, Handler], quarantine: str, status_log: str | None = None, dead: str | None = None,
          max_attempts: int | None = None):
    """``foreachBatch`` function: ok rows go to their topic's handler, others to ``quarantine``.

    A handler is called with rows and a call number that grows from call to call and is the same when a batch is
    replayed: first with the dead letters of its topic, then with the batch's own rows, so neither can fail the other.
    What a failing call was given becomes (or stays) dead letters in ``dead``, one more attempt counted; after
    ``max_attempts`` they move to the quarantine, with that as their status. Without ``dead`` they go there at once.

    Each batch's outputs are written under ``batch_id=N`` with overwrite, and read only those of earlier
    batches, so a replayed batch replaces its own output instead of adding to it.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        parsed = TR.parse_messages(batch).persist()  # read once for the quarantine and every route
        old = dead_letters(spark, dead, batch_id) if dead else spark.createDataFrame([], LETTER)
        waiting = TR.parse_messages(old).persist()
        fresh = parsed.where("status = 'ok'").withColumns({
            "attempts": F.lit(0), "first_batch": F.lit(batch_id).cast("bigint"), "error": F.lit(None).cast("string")})
        left, results = waiting.where(~F.col("topic").isin(*handlers)), []
        for topic, fn in handlers.items():
            for call, rows in ((2 * batch_id, waiting), (2 * batch_id + 1, fresh)):
                mine = rows.where(F.col("topic") == topic)
                if rows is waiting and mine.isEmpty():
                    continue
                try:
                    fn(mine.drop("attempts", "first_batch", "error"), call)
                    results.append((batch_id, topic, "ok", None))
                except Exception as e:  # noqa: BLE001 - one failed route must not stop the stream
                    error = "".join(traceback.format_exception_only(type(e), e))
                    results.append((batch_id, topic, "failed", error))
                    left = left.unionByName(mine.withColumn("attempts", F.col("attempts") + 1).withColumn("error", F.lit(error)))
        spent = F.lit(True) if not dead else F.col("attempts") >= max_attempts if max_attempts else F.lit(False)
        bad = parsed.where("status <> 'ok'").unionByName(left.where(spent).select(*parsed.drop("status").columns, F.concat(
            F.lit("failed "), "attempts", F.lit(" times")).alias("status")))
        bad.write.mode("overwrite").parquet(os.path.join(quarantine, f"batch_id={batch_id}"))
        if dead:
            left.where(~spent).select("topic", "value", "attempts", "first_batch", "error").write.mode("overwrite").parquet(
                os.path.join(dead, f"batch_id={batch_id}"))
            files = Files(spark, dead)
            for name in files.names(""):  # the version before serves a replay of this batch
                if name.startswith("batch_id=") and int(name.split("=")[1]) < batch_id - 1:
                    files.delete(name)
        parsed.unpersist()
        waiting.unpersist()
        if status_log:
            (spark.createDataFrame(results, "batch_id LONG, topic STRING, status STRING, "
                                            "error STRING")
             .write.mode("overwrite").parquet(os.path.join(status_log, f"batch_id={batch_id}")))

    return run


def stream_bars(ticks: DataFrame, width: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    """Event-time OHLC bars per ticker; a bar is emitted once the watermark passes its end."""
    t = event_time(ticks).withWatermark("event_time", watermark)
    order = F.struct(F.col("event_time"), F.col("seq"))
    g = t.groupBy(F.window("event_time", width).alias("w"), "ticker").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"),
        F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.count(F.lit(1)).alias("n_ticks"))
    return g.select("ticker", F.col("w.start").cast("timestamp_ntz").alias("bar_ts"), "open",
                    "high", "low", "close", "n_ticks")


def split_late(on_time: Handler, late: str, marks: str, closes: Column | None = None, watermark: str = WATERMARK,
               behind: int = 1):
    """``foreachBatch`` function: the rows that a watermark would drop go to the table ``late``, the others to
    ``on_time``, so that none is lost.

    The watermark is Spark's: the newest ``event_time`` of the batches before, less the delay, without those of the
    last ``behind`` batches, as Spark filters late rows by the watermark that the batch before was run with. A row is
    late when its ``closes`` (its event time, or the end of its window) is not after it. The newest time of each
    batch is kept in ``marks``, so a restart goes on with the same watermark and a replayed batch is split alike.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        done = [n for n in Files(spark, marks).names("") if n.startswith("batch_id=") and int(n.split("=")[1]) < batch_id - behind]
        newest = spark.read.schema("newest TIMESTAMP").parquet(*[os.path.join(marks, n) for n in done]).agg(
            F.max("newest")).first()[0] if done else None
        limit = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {watermark}")
        is_late = F.coalesce((F.col("event_time") if closes is None else closes) <= limit, F.lit(False))
        batch.where(is_late).write.mode("overwrite").parquet(os.path.join(late, f"batch_id={batch_id}"))
        on_time(batch.where(~is_late), batch_id)
        batch.agg(F.max("event_time").alias("newest")).write.mode("overwrite").parquet(os.path.join(marks, f"batch_id={batch_id}"))
        batch.unpersist()

    return run


def rows_dropped(query) -> int:
    """Rows that the stateful operators of a query have dropped as late, as far as its progress tells. An aggregation
    drops rows already summed in their task, so this says that rows were lost, and ``split_late`` which."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])
