"""Streaming twins: first fire per slot and hourly bars match their batch forms; routing."""

import os

from pyspark.sql import functions as F

from tidecast.operators import bars as B
from tidecast.operators import kv as KV
from tidecast.sources import tables as T
from tidecast.sources import topics as TL
from tidecast.streaming import flow, live
from tidecast.streaming import triggers as TR

from conftest import SF_SMALL


def _drain(q):
    q.processAllAvailable()
    q.stop()


def test_trigger_stream_fires_once_per_slot(spark, tmp_dir):
    src = os.path.join(tmp_dir, "clock")
    # a clock arrives in time order: one file per time range (late rows would be dropped)
    (T.table(spark, SF_SMALL, "events").select("event_id", "ts").repartitionByRange(3, "ts")
     .sortWithinPartitions("ts").write.parquet(src))
    clock = spark.readStream.schema("event_id LONG, ts TIMESTAMP_NTZ").parquet(src)
    msgs = flow.trigger_messages(spark, clock)
    out = os.path.join(tmp_dir, "msgs")
    q = flow.write_messages(msgs, "triggers_t", path=out,
                            checkpoint=os.path.join(tmp_dir, "ck1")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = spark.read.format("topic_log").load(out)
    parsed = TR.parse_messages(got)
    keys = sorted((r.trigger_type, r.slot_friendly) for r in parsed.where("status = 'ok'").collect())
    batch = TR.message(TR.first_fire(TR.match_slots(spark, T.table(spark, SF_SMALL, "events"))))
    ref = sorted((r.trigger_type, r.slot_friendly) for r in TR.parse_messages(batch).collect())
    assert keys == ref and len(keys) > 0
    # one message for each (type, time of the slot), whatever event time it carries
    slot = F.struct("trigger_type", F.get_json_object("value", "$.scheduled_time_ny_iso"))
    assert parsed.select(slot.alias("s")).distinct().count() == got.count()


def test_stream_bars_match_batch_closed_windows(spark, tmp_dir):
    src = os.path.join(tmp_dir, "ticks")
    T.ticks(spark, SF_SMALL).write.parquet(src)
    ticks = spark.readStream.schema("ticker STRING, ts TIMESTAMP_NTZ, price DOUBLE, seq LONG").parquet(src)
    q = (flow.stream_bars(ticks).writeStream.format("memory").queryName("bars_t")
         .outputMode("append").option("checkpointLocation", os.path.join(tmp_dir, "ck2"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    streamed = spark.table("bars_t")
    batch = B.resample(T.ticks(spark, SF_SMALL), "hour")
    n = streamed.count()
    assert n > 0
    # append mode holds back windows the watermark has not passed, and emits every other one
    newest = T.ticks(spark, SF_SMALL).agg(F.max("ts")).first()[0]
    closed = batch.where(F.expr("bar_ts + INTERVAL 1 HOUR") <= F.lit(newest) - F.expr("INTERVAL 10 MINUTES"))
    assert n == closed.count()
    joined = streamed.join(batch, ["ticker", "bar_ts"])
    assert joined.count() == n
    assert joined.where((streamed.close != batch.close) | (streamed.open != batch.open)).count() == 0


def send(spark, log, rows):
    TL.register(spark)
    spark.createDataFrame(rows, "topic STRING, value STRING").coalesce(1).write.format(TL.FORMAT).mode("append").save(log)


HOURLY = '{"trigger_type": "hourly_prediction", "scheduled_time_ny_friendly": "%s"}'


def test_router_routes_and_quarantines(spark, tmp_dir):
    inbox = os.path.join(tmp_dir, "inbox")
    send(spark, inbox, [
        ("hourly_topic", HOURLY % "09:30 AM"),
        ("hourly_topic", '{"trigger_type": "hourly_prediction", "scheduled_time_ny_iso": "soon"}'),
        ("daily_topic", '{"trigger_type": "daily_train", "scheduled_time_ny_friendly": "08:00 AM"}'),
        ("daily_topic", "{oops"),
    ])
    seen = {}

    def hourly(df, bid):
        seen["hourly"] = df.count()

    def daily(df, bid):
        raise RuntimeError("daily job failed")

    quarantine, status = os.path.join(tmp_dir, "q"), os.path.join(tmp_dir, "s")
    stream = flow.read_messages(spark, path=inbox)
    q = (stream.writeStream.foreachBatch(flow.route({"hourly_topic": hourly, "daily_topic": daily},
                                                    quarantine, status))
         .option("checkpointLocation", os.path.join(tmp_dir, "ck3")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert seen["hourly"] == 1
    # without a place for dead letters, what a handler failed on is quarantined
    assert sorted(r.status for r in spark.read.parquet(quarantine).collect()) == ["bad_json", "bad_slot_time", "failed 1 times"]
    st = {r.topic: r.status for r in spark.read.parquet(status).collect()}
    assert st == {"hourly_topic": "ok", "daily_topic": "failed"}


def test_dead_letters_are_applied_once(spark, tmp_dir):
    """A handler that fails twice, then works: every message is applied once, in spite of a replayed batch."""
    inbox, dead = os.path.join(tmp_dir, "inbox"), os.path.join(tmp_dir, "dead")
    applied, calls = {}, []

    def hourly(df, call):
        calls.append(call)
        if len(calls) <= 2:
            raise RuntimeError("not yet")
        applied[call] = [r.slot_friendly for r in df.collect()]  # keyed by call, as a store would be

    run = flow.route({"hourly_topic": hourly}, os.path.join(tmp_dir, "q"), dead=dead)

    def drain():
        q = (flow.read_messages(spark, path=inbox, group="router").writeStream.foreachBatch(run)
             .option("checkpointLocation", os.path.join(tmp_dir, "ck")).trigger(availableNow=True).start())
        q.awaitTermination(300)
        assert q.exception() is None
        return {(r.value, r.attempts) for r in flow.dead_letters(spark, dead).collect()}

    send(spark, inbox, [("hourly_topic", HOURLY % "a"), ("hourly_topic", HOURLY % "b")])
    assert drain() == {(HOURLY % "a", 1), (HOURLY % "b", 1)}
    send(spark, inbox, [("hourly_topic", HOURLY % "c")])
    assert drain() == {(HOURLY % "a", 2), (HOURLY % "b", 2)}  # the old ones fail again, the new one works
    send(spark, inbox, [("hourly_topic", HOURLY % "d")])
    assert drain() == set()
    told = sorted(x for v in applied.values() for x in v)
    assert told == ["a", "b", "c", "d"] and calls == sorted(calls)
    batch = spark.createDataFrame([("hourly_topic", HOURLY % "d")], "topic STRING, value STRING")
    run(batch, 2)  # a replay of the last batch finds the same dead letters and makes the same calls
    assert sorted(x for v in applied.values() for x in v) == told and flow.dead_letters(spark, dead).count() == 0


def test_letters_that_never_work_end_in_the_quarantine(spark, tmp_dir):
    def hourly(df, call):
        if not df.isEmpty():
            raise RuntimeError("never")

    dead, quarantine = os.path.join(tmp_dir, "dead"), os.path.join(tmp_dir, "q")
    run = flow.route({"hourly_topic": hourly}, quarantine, dead=dead, max_attempts=3)
    batch = lambda rows: spark.createDataFrame(rows, "topic STRING, value STRING")
    run(batch([("hourly_topic", HOURLY % "x")]), 0)
    for k in (1, 2):
        run(batch([]), k)
    assert flow.dead_letters(spark, dead).count() == 0
    assert [(r.value, r.status) for r in spark.read.parquet(quarantine).collect()] == [(HOURLY % "x", "failed 3 times")]


def test_late_rows_are_kept_beside_the_bars(spark, tmp_dir):
    """Bars, and the rows that came after their bar had closed: together they are all rows."""
    src = os.path.join(tmp_dir, "ticks")
    t = T.ticks(spark, SF_SMALL).withColumn("late", F.pmod(F.xxhash64("seq"), F.lit(10)) == 0)
    newest = t.agg(F.max("ts")).first()[0]
    # files by time, every tenth tick arriving at the very end
    for k, part in enumerate((t.where("not late").where(F.dayofmonth("ts") < 15), t.where("not late").where(F.dayofmonth("ts") >= 15), t.where("late"))):
        part.drop("late").coalesce(1).write.mode("append").parquet(os.path.join(src, f"k={k}"))
    schema = "ticker STRING, ts TIMESTAMP_NTZ, price DOUBLE, seq LONG"

    def ticks():
        import glob
        files = os.path.join(tmp_dir, "in")
        os.makedirs(files, exist_ok=True)
        for k in range(3):
            for f in glob.glob(os.path.join(src, f"k={k}", "*.parquet")):
                to = os.path.join(files, f"{k}.parquet")
                if not os.path.exists(to):
                    os.link(f, to)
                    os.utime(to, (1_000_000 + k, 1_000_000 + k))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(files)

    q = (flow.stream_bars(ticks()).writeStream.format("memory").queryName("late_bars").outputMode("append")
         .option("checkpointLocation", os.path.join(tmp_dir, "ck-bars")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    kept = []

    def on_time(df, batch_id):
        kept.append(df.count())

    late = os.path.join(tmp_dir, "late")
    split = flow.split_late(on_time, late, os.path.join(tmp_dir, "marks"),
                            closes=F.date_trunc("hour", "event_time") + F.expr("INTERVAL 1 HOUR"))
    s = (flow.event_time(ticks()).writeStream.foreachBatch(split)
         .option("checkpointLocation", os.path.join(tmp_dir, "ck-late")).trigger(availableNow=True).start())
    s.awaitTermination(300)
    assert s.exception() is None
    side = spark.read.schema(schema).parquet(late)
    assert side.count() > 0 and sum(kept) + side.count() == t.count()
    groups = side.select("ticker", F.date_trunc("hour", "ts")).distinct().count()
    assert groups == flow.rows_dropped(q)  # the operator sees rows summed by window and ticker, and one file was late
    still_open = t.where(F.date_trunc("hour", "ts") + F.expr("INTERVAL 1 HOUR") > F.lit(newest) - F.expr("INTERVAL 10 MINUTES")).count()
    closed = spark.table("late_bars").agg(F.sum("n_ticks")).first()[0]
    assert closed + side.count() + still_open == t.count()


def test_live_keys_match_the_batch_store_over_a_restart(spark, tmp_dir):
    src, out, ck = (os.path.join(tmp_dir, n) for n in ("writes", "changes", "ck"))
    writes = T.kv_writes(spark, SF_SMALL).withColumn("ttl_seconds", F.col("ttl_seconds") * 200)
    cut = F.expr("timestamp_ntz '1996-01-01 00:00:00'")
    schema = "key STRING, value STRING, written_at TIMESTAMP_NTZ, seq LONG, ttl_seconds LONG"

    def drain():
        with live.state_store(spark):
            q = live.changes(spark.readStream.schema(schema).parquet(src)).writeStream.outputMode("update").foreachBatch(
                lambda df, b: df.write.mode("overwrite").parquet(os.path.join(out, f"batch_id={b}")))
            q = q.option("checkpointLocation", ck).trigger(availableNow=True).start()
            q.awaitTermination(300)
            assert q.exception() is None
        return live.current(spark.read.schema(live.CHANGES).parquet(out))

    def want(part):
        as_of = part.agg(F.max("written_at")).first()[0]
        rows = KV.state(part, as_of.isoformat(sep=" ")).select("key", "value", "written_at", "expires_at")
        return sorted(rows.collect(), key=lambda r: r.key)

    first = writes.where(F.col("written_at") < cut)
    first.select(*KV.WRITE_COLS).coalesce(1).write.parquet(src)
    assert sorted(drain().collect(), key=lambda r: r.key) == want(first)
    writes.where(F.col("written_at") >= cut).select(*KV.WRITE_COLS).coalesce(1).write.mode("append").parquet(src)
    got = sorted(drain().collect(), key=lambda r: r.key)  # a new query on the old state
    assert got == want(writes) and len(got) > 0
    told = spark.read.schema(live.CHANGES).parquet(out).where("change = 'expired'")
    assert told.count() > 0 and told.count() == told.select("key", "at_ms", "seq").distinct().count()
