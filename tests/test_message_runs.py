"""Runs that messages ask for: every slot for every ticker, without a join on a constant."""

from pyspark.sql import functions as F

from tidecast.plans import jobs as JB


def test_runs_of_messages_need_no_join(spark):
    bars = spark.createDataFrame([("A", 1), ("A", 2), ("B", 1)], "ticker string, x int")
    say = '{"scheduled_time_ny_iso": "2024-01-%sT10:30:00-05:00"}'
    sent = [(say % "20", "10:30 AM"), (say % "20", "10:30 AM"), (say % "21", "10:30 AM"), ("{}", "N/A")]
    messages = spark.createDataFrame(sent, "value string, slot_friendly string")
    runs = JB.runs_of_messages(messages, bars)
    got = sorted((r.ticker, str(r.ny_date), r.slot, str(r.run_ts)) for r in runs.collect())
    assert got == [(t, f"2024-01-{d}", "10:30 AM", f"2024-01-{d} 15:30:00") for t in "AB" for d in (20, 21)]
    assert dict(runs.dtypes) == {"ticker": "string", "ny_date": "date", "slot": "string", "run_ts": "timestamp_ntz"}
    assert "Join" not in runs._jdf.queryExecution().optimizedPlan().toString()
    assert JB.runs_of_messages(messages.where(F.lit(False)), bars).count() == 0
