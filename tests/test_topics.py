"""The topic log: two topics in order over restarts, replays, offsets, groups, and rows that no commit names."""

import os

import pytest
from pyspark.sql import functions as F

from tidecast.sources import topics as TL


@pytest.fixture()
def log(spark, tmp_dir):
    TL.register(spark)
    return os.path.join(tmp_dir, "log")


def send(spark, log, rows, parts=1):
    spark.createDataFrame(rows, "topic STRING, value STRING").repartition(parts).write.format(TL.FORMAT).mode("append").save(log)


def table(spark, log, **options):
    return [(r.topic, r.offset, r.value) for r in spark.read.format(TL.FORMAT).options(**options).load(log).collect()]


def drain(spark, log, out, ck, **options):
    q = (spark.readStream.format(TL.FORMAT).options(**options).load(log).writeStream.format("parquet")
         .option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert q.exception() is None
    return sorted((r.topic, r.offset, r.value) for r in spark.read.parquet(out).collect())


def test_batch_round_trip_and_offsets(spark, log):
    assert TL.ends(log) == {} and table(spark, log) == []
    send(spark, log, [("a", "1"), ("b", "x"), ("a", None)])
    send(spark, log, [("a", "3")])
    assert TL.ends(log) == {"a": 3, "b": 1}
    assert sorted(table(spark, log), key=str) == sorted([("a", 0, "1"), ("a", 1, None), ("a", 2, "3"), ("b", 0, "x")], key=str)
    assert table(spark, log, topics="b") == [("b", 0, "x")]
    with pytest.raises(Exception, match="needs a topic"):
        send(spark, log, [(None, "lost")])
    assert TL.ends(log) == {"a": 3, "b": 1}


def test_two_topics_in_order_over_a_restart(spark, log, tmp_dir):
    out, ck = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck")
    want = []
    for batch in range(3):
        rows = [("hourly", f"h{batch}-{i}") for i in range(40)] + [("daily", f"d{batch}-{i}") for i in range(7)]
        send(spark, log, rows, parts=3)
        got = drain(spark, log, out, ck)  # each drain is a new query on the old checkpoint
        want += rows
        assert sorted((t, v) for t, _, v in got) == sorted(want)
        for topic in ("hourly", "daily"):
            assert [o for t, o, _ in got if t == topic] == list(range(sum(t == topic for t, _ in want)))
    assert [(o, v) for t, o, v in got if t == "daily"] == [(o, v) for t, o, v in sorted(table(spark, log)) if t == "daily"]
    assert drain(spark, log, out, ck) == got


def test_stream_sink_appends_a_replayed_batch_once(spark, log, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    schema = "topic STRING, value STRING"

    def run(ck):
        q = (spark.readStream.schema(schema).json(src).writeStream.format(TL.FORMAT).option("writer", "w")
             .option("checkpointLocation", ck).trigger(availableNow=True).start(log))
        q.awaitTermination(300)
        assert q.exception() is None

    spark.createDataFrame([("a", "1"), ("b", "2")], schema).coalesce(1).write.json(src)
    run(os.path.join(tmp_dir, "ck"))
    assert TL.ends(log) == {"a": 1, "b": 1}
    run(os.path.join(tmp_dir, "lost-checkpoint"))  # the same batch number from the same writer
    assert TL.ends(log) == {"a": 1, "b": 1}
    assert len(os.listdir(os.path.join(log, "data"))) == 2
    spark.createDataFrame([("a", "3")], schema).coalesce(1).write.mode("append").json(src)
    run(os.path.join(tmp_dir, "ck"))
    assert sorted(table(spark, log)) == [("a", 0, "1"), ("a", 1, "3"), ("b", 0, "2")]


def test_starting_offsets_limits_and_groups(spark, log, tmp_dir):
    send(spark, log, [("a", str(i)) for i in range(25)])
    path = lambda n: os.path.join(tmp_dir, n)
    assert [v for _, _, v in drain(spark, log, path("o1"), path("c1"), startingOffsets='{"a": 22}')] == ["22", "23", "24"]
    drain(spark, log, path("o2"), path("c2"), startingOffsets="latest", group="g")
    assert spark.read.schema("topic STRING").parquet(path("o2")).count() == 0
    got = drain(spark, log, path("o3"), path("c3"), maxOffsetsPerBatch="10", group="h")
    assert [o for _, o, _ in got] == list(range(10))  # availableNow ends at the offsets it began with
    send(spark, log, [("a", "25"), ("a", "26")])
    got = drain(spark, log, path("o4"), path("c4"), startingOffsets="committed", group="h")
    assert got[0][1] <= 10 and got[-1][1] == 26


def test_files_that_no_commit_names_do_not_exist(spark, log):
    send(spark, log, [("a", "1")])
    writer = TL.BatchWriter({"path": log})
    TL.Log(log).fs.copy_file(*[os.path.join(log, "data", n) for n in (os.listdir(os.path.join(log, "data"))[0], "stray.parquet")])
    assert table(spark, log) == [("a", 0, "1")]
    writer.abort([TL.Written(0, [("a", "data/stray.parquet", 1)]), None])
    assert not os.path.exists(os.path.join(log, "data", "stray.parquet"))


def test_a_range_meets_only_the_files_that_hold_it(spark, log):
    for k in range(5):
        send(spark, log, [("a", f"{k}-{i}") for i in range(10)] + ([("b", str(k))] if k in (0, 3) else []))
    parts = TL.Log(log).parts({"a": 15, "b": 1}, {"a": 31, "b": 2})
    assert [(p.topic, p.offset, p.skip, p.rows) for p in parts] == [
        ("a", 15, 5, 5), ("a", 20, 0, 10), ("a", 30, 0, 1), ("b", 1, 0, 1)]
    assert spark.read.format(TL.FORMAT).load(log).where(F.col("topic") == "a").count() == 50
