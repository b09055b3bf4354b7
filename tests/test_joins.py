"""As-of join across empty chunks and exact interval-join bounds."""

from datetime import datetime

from tidecast.operators import joins as J


def test_asof_carries_over_empty_chunks(spark):
    bars = spark.createDataFrame([
        ("a", datetime(2024, 1, 1, 10), 1.0), ("a", datetime(2024, 1, 1, 12), 2.0),
        ("a", datetime(2024, 1, 9, 9), 3.0), ("b", datetime(2024, 1, 5, 9), 9.0),
    ], "ticker STRING, bar_ts TIMESTAMP_NTZ, close DOUBLE")
    runs = spark.createDataFrame([
        ("a", datetime(2024, 1, 1, 11)),   # same day, after the first bar
        ("a", datetime(2024, 1, 1, 12)),   # equal time stamp: strictly earlier bar only
        ("a", datetime(2024, 1, 6, 9)),    # several empty days back
        ("a", datetime(2024, 1, 9, 10)),
        ("b", datetime(2024, 1, 4, 9)),    # before the first bar
    ], "ticker STRING, run_ts TIMESTAMP_NTZ")
    got = sorted((r.ticker, r.run_ts.day, r.run_ts.hour, r.close)
                 for r in J.asof_latest(runs, bars, "ticker", "run_ts", "bar_ts", ["close"]).collect())
    assert got == [("a", 1, 11, 1.0), ("a", 1, 12, 1.0), ("a", 6, 9, 2.0), ("a", 9, 10, 3.0),
                   ("b", 4, 9, None)]


def test_interval_join_half_open(spark):
    runs = spark.createDataFrame([(1, datetime(2024, 1, 2, 14, 30))], "rid INT, run_ts TIMESTAMP_NTZ")
    arts = spark.createDataFrame([
        (1, datetime(2024, 1, 1, 13, 30)),           # t - 25h: inside (inclusive)
        (2, datetime(2024, 1, 1, 14, 29, 59)),       # inside
        (3, datetime(2024, 1, 1, 14, 30)),           # t - 24h: outside (exclusive)
        (4, datetime(2024, 1, 1, 13, 29, 59)),       # before the window
    ], "doc_id INT, published_at TIMESTAMP_NTZ")
    got = sorted(r.doc_id for r in J.interval_join(runs, arts, "run_ts", "published_at", 25, 24)
                 .collect())
    assert got == [1, 2]
