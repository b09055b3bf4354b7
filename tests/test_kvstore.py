"""The log-structured keyed store against a dictionary, its write volume, races, replays and vacuum."""

import os
import threading
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidecast.operators import kvstore as KS

ROWS = "key STRING, value STRING, written_at TIMESTAMP_NTZ, seq BIGINT, ttl_seconds BIGINT"
T0 = datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(k, v, T0 + timedelta(seconds=t), s, ttl) for k, v, t, s, ttl in rows], ROWS)


def state(store, **how):
    return {r.key: r.value for r in store.read(**how).collect()}


def folder_bytes(path, version):
    top = os.path.join(path, "data", f"version={version}")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(top) for f in fs if f.endswith(".parquet"))


def test_commits_match_a_dictionary(spark, tmp_dir):
    import random
    rng = random.Random(1)
    store, want, best = KS.KeyedStore(spark, tmp_dir + "/s", buckets=8, turns=4), {}, {}
    for batch in range(11):
        rows = [(f"k{rng.randrange(40)}", f"v{batch}-{i}", rng.randrange(100), batch * 100 + i, None) for i in range(25)]
        rows += [(rows[0][0], "twice", rows[0][2], batch * 100 + 50, None), (None, "no key", 1, 1, None)]
        assert store.commit(frame(spark, rows), batch) == batch + 1
        for k, v, t, s, _ in rows:
            if k is not None and (t, s) > best.get(k, (-1, -1)):
                best[k], want[k] = (t, s), v
        assert state(store) == want
        if batch == 6:
            old = dict(want)
    assert state(store, version=7) == old
    assert state(KS.KeyedStore(spark, tmp_dir + "/s")) == want  # a reader takes the layout from the manifest


def test_a_replayed_batch_changes_nothing(spark, tmp_dir):
    store = KS.KeyedStore(spark, tmp_dir + "/s", buckets=4, turns=2)
    store.commit(frame(spark, [("a", "1", 1, 1, None)]), 0)
    store.commit(frame(spark, [("a", "2", 2, 2, None)]), 1)
    assert store.commit(frame(spark, [("a", "other", 9, 9, None)]), 1) == 2
    assert state(store) == {"a": "2"} and store.versions() == [1, 2]


def test_time_to_live_and_deletion(spark, tmp_dir):
    store = KS.KeyedStore(spark, tmp_dir + "/s", buckets=4, turns=2)
    store.commit(frame(spark, [("a", "1", 0, 1, 10), ("b", "1", 0, 2, None), ("c", "1", 0, 3, None)]))
    assert set(state(store, as_of="2024-01-01 00:00:05")) == {"a", "b", "c"}
    assert set(state(store, as_of="2024-01-01 00:00:10")) == {"b", "c"}
    gone = store.delete(spark.createDataFrame([("b",), ("nobody",), ("b",)], "key STRING"), "2024-01-01 00:00:01")
    assert [r.key for r in gone.collect()] == ["b"] and set(state(store)) == {"a", "c"}
    store.commit(frame(spark, [("b", "back", 5, 9, None)]))
    for _ in range(3):
        store.commit(frame(spark, []))
    assert state(store)["b"] == "back"


def test_a_small_batch_writes_little(spark, tmp_dir):
    n, path = 200_000, tmp_dir + "/s"
    store = KS.KeyedStore(spark, path, buckets=64, turns=32)
    rows = lambda ids, t: ids.select(
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.sha2(F.col("id").cast("string"), 512).alias("value"),
        F.lit(T0 + timedelta(seconds=t)).alias("written_at"), "id").withColumnRenamed("id", "seq").withColumn("ttl_seconds", F.lit(None).cast("long"))
    store.commit(rows(spark.range(n), 0))
    whole = folder_bytes(path, 1)
    for k in range(1, 4):
        store.commit(rows(spark.range(k, n, 100), k))  # one key in a hundred
        assert folder_bytes(path, k + 1) < 0.05 * whole
    assert store.read().count() == n and store.read().where("written_at > timestamp_ntz '2024-01-01 00:00:00'").count() == 3 * n // 100


def test_of_two_writers_both_are_kept(spark, tmp_dir):
    path = tmp_dir + "/s"
    KS.KeyedStore(spark, path, buckets=4, turns=2).commit(frame(spark, [("x", "0", 0, 0, None)]))
    errors = []

    def write(name):
        try:
            KS.KeyedStore(spark, path).commit(frame(spark, [(name, "1", 1, 1, None)]))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in "abc"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and set(state(KS.KeyedStore(spark, path))) == {"x", "a", "b", "c"}
    assert KS.KeyedStore(spark, path).versions() == [1, 2, 3, 4]


def test_a_lost_race_leaves_no_data_and_a_torn_manifest_is_passed_over(spark, tmp_dir, monkeypatch):
    store = KS.KeyedStore(spark, tmp_dir + "/s", buckets=4, turns=2)
    store.commit(frame(spark, [("a", "1", 1, 1, None)]))
    create, lost = KS.Files.create, []

    def first_loses(self, name, text):
        if not lost:
            lost.append(name)
            raise KS.Conflict(name)
        return create(self, name, text)

    monkeypatch.setattr(KS.Files, "create", first_loses)
    assert store.commit(frame(spark, [("b", "1", 1, 1, None)])) == 2
    assert len(store.files.names("data/version=2")) == 1
    monkeypatch.undo()
    store.files.create("manifest/v000000000003.json", '{"version": 3, "bat')
    assert state(store) == {"a": "1", "b": "1"}
    assert store.commit(frame(spark, [("c", "1", 1, 1, None)])) == 4
    for k in range(3):
        store.commit(frame(spark, [(f"d{k}", "1", 1, 1, None)]))
    assert set(state(store)) == {"a", "b", "c", "d0", "d1", "d2"}


def test_vacuum_keeps_what_is_read(spark, tmp_dir):
    store = KS.KeyedStore(spark, tmp_dir + "/s", buckets=4, turns=2)
    for k in range(8):
        store.commit(frame(spark, [(f"k{k}", "v", k, k, None), ("same", f"{k}", k, k, None)]))
    want = state(store)
    assert store.vacuum(keep=2) == [1, 2, 3, 4, 5]
    assert state(store) == want and len(store.versions()) == 2 and len(state(store, version=7)) == 8
    store.commit(frame(spark, [("new", "v", 9, 9, None)]))
    assert state(store) == {**want, "new": "v"}


def test_empty_store(spark, tmp_dir):
    store = KS.KeyedStore(spark, tmp_dir + "/none")
    assert store.read().count() == 0 and store.manifest() is None and store.vacuum() == []
    assert store.delete(spark.createDataFrame([("a",)], "key STRING"), "2024-01-01").count() == 0


