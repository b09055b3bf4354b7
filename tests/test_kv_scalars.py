"""Keyed store semantics, time functions across clock changes, reply parsing, feature checks."""

import math
from datetime import date, datetime

from pyspark.sql import functions as F

from tidecast.functions import scalars as S
from tidecast.operators import features as FE
from tidecast.operators import kv as KV
from tidecast.streaming import triggers as TR

W = "key STRING, value STRING, written_at TIMESTAMP_NTZ, seq LONG, ttl_seconds LONG"


def test_store_overwrite_expiry_delete_and_json(spark):
    writes = spark.createDataFrame([
        ("a", '{"x": 1}', datetime(2024, 1, 1), 1, None),
        ("a", "plain", datetime(2024, 1, 2), 2, None),
        ("b", '{"x": 2}', datetime(2024, 1, 1), 3, 3600),
        ("c", '{"x": 3}', datetime(2024, 1, 1), 4, None),
    ], W)
    live = {r.key: r.value for r in KV.state(writes, "2024-01-01 12:00:00").collect()}
    assert live == {"a": '{"x": 1}', "c": '{"x": 3}'}  # b expired after an hour
    store = KV.state(writes)
    keys = spark.createDataFrame([("a",), ("c",), ("zz",)], "key STRING")
    got = {r.key: r for r in KV.lookup(store, keys, "x INT").collect()}
    assert got["a"].value == "plain" and not got["a"].is_json and got["a"].parsed is None
    assert got["c"].parsed.x == 3 and got["zz"].found is False
    remaining, removed = KV.delete(store, spark.createDataFrame([("a",), ("q",)], "key STRING"))
    assert sorted(r.key for r in remaining.collect()) == ["b", "c"]
    assert [r.key for r in removed.collect()] == ["a"]


def test_parse_score(spark):
    df = spark.createDataFrame([(" 0.5 ",), ("",), ("POSITIVE",), ("1.7",), ("NaN",), (None,)],
                               "r STRING")
    got = [r.s for r in df.select(S.parse_score(F.col("r")).alias("s")).collect()]
    assert got[0] == 0.5 and got[1] is None and got[2] is None and got[3] == 1.7
    assert math.isnan(got[4]) and got[5] is None


def test_slot_calendar_across_clock_change(spark):
    days = spark.createDataFrame([(date(2024, 3, 9),), (date(2024, 3, 11),)], "ny_date DATE")
    cal = TR.slot_calendar(days).where("hour = 9").select("ny_date", "run_ts").collect()
    utc = {r.ny_date: r.run_ts.hour for r in cal}
    assert utc[date(2024, 3, 9)] == 14 and utc[date(2024, 3, 11)] == 13
    iso = spark.createDataFrame([(datetime(2024, 1, 2, 14, 30),), (datetime(2024, 7, 2, 13, 30),)],
                                "ts TIMESTAMP_NTZ").select(S.iso_ny(F.col("ts")).alias("i")).collect()
    assert [r.i for r in iso] == ["2024-01-02T09:30:00-05:00", "2024-07-02T09:30:00-04:00"]


def test_result_key_and_friendly(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 2, 14, 30), "AAPL")], "ts TIMESTAMP_NTZ, t STRING")
    r = df.select(S.result_key(F.col("ts"), S.friendly_time(S.ny_local(F.col("ts"))),
                               F.col("t")).alias("k")).collect()[0].k
    assert r == "2024-01-02_09:30 AM_AAPL"


def test_feature_row_shapes(spark):
    rows = [(list(map(float, range(n))),) for n in (63, 64, 65)] + [([1.0] * 63 + [None],)]
    df = spark.createDataFrame(rows, "features ARRAY<DOUBLE>")
    assert [r.valid for r in FE.check_rows(df).collect()] == [False, True, False, False]


def test_parse_messages_statuses(spark):
    msgs = spark.createDataFrame([
        ("hourly_topic", '{"trigger_type": "hourly_prediction", "scheduled_time_ny_friendly": "09:30 AM"}'),
        ("hourly_topic", "{bad json"),
        ("hourly_topic", '{"other": 1}'),
        ("weird_topic", '{"trigger_type": "daily_train"}'),
    ], "topic STRING, value STRING")
    got = [(r.status, r.slot_friendly) for r in TR.parse_messages(msgs).collect()]
    assert got == [("ok", "09:30 AM"), ("bad_json", "N/A"), ("missing_trigger_type", "N/A"),
                   ("unexpected_topic", "N/A")]
