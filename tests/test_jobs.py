"""The composed jobs: predictions near the forecast, statuses, registry, and trigger to store."""

import os

import pytest
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import functions as F

from tidecast.operators import features as FE
from tidecast.operators import registry
from tidecast.plans import catalog
from tidecast.plans import jobs as JB
from tidecast.sources import topics as TL
from tidecast.streaming import flow

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("models"))
    dim = FE.ticker_dim(spark, catalog.NEWS_DIM)
    models, metrics = JB.daily_train(spark, SF_SMALL, dim, register=root)
    return dim, models, metrics, root


def test_second_model_is_standardised_and_saved(spark, trained):
    dim, models, metrics, root = trained
    told = {(r.model, r.metric): r.value for r in metrics.collect()}
    assert told["senti", "n"] > 0 and told["senti", "mse"] >= 0
    loaded = JB.load_models(spark, LinearRegressionModel, root)
    assert set(loaded.scaler) == {*JB.FEATS, JB.TARGET}
    for c, (mean, std) in models.scaler.items():
        assert loaded.scaler[c] == pytest.approx((mean or 0.0, std or 0.0))
    out = JB.hourly_predict(spark, SF_SMALL, loaded, dim)
    runs = FE.runs_for(JB.hourly_bars(spark, SF_SMALL)).count()
    rows = out.select("status", "predicted", "algo", "key").toPandas()
    assert len(rows) == runs  # no run vanishes
    assert set(rows.status) <= {"ok", "short_window", "missing_value"}
    ok = rows[rows.status == "ok"]
    gap = (ok.predicted - ok.algo)
    assert abs(gap.mean()) < 0.1 and gap.abs().max() < 1.0
    assert rows[rows.status != "ok"].predicted.isna().all()


def test_trigger_to_store_with_replay_and_restart(spark, tmp_dir):
    dim = FE.ticker_dim(spark, catalog.NEWS_DIM)
    store, inbox = os.path.join(tmp_dir, "store"), os.path.join(tmp_dir, "inbox")
    handlers = JB.handlers(spark, SF_SMALL, dim, lambda: catalog.CLOSED_FORM, store)
    handlers["daily_topic"] = lambda messages, batch: None
    body = ('{"trigger_type": "hourly_prediction", "event_timestamp_utc": "x", "scheduled_time_ny_iso": '
            '"2024-01-%02dT10:30:00-05:00", "scheduled_time_ny_friendly": "10:30 AM"}')

    def send(day):
        TL.register(spark)
        spark.createDataFrame([("hourly_topic", body % day), ("hourly_topic", "junk")],
                              "topic STRING, value STRING").write.format(TL.FORMAT).mode("append").save(inbox)

    def drain():
        q = (flow.read_messages(spark, path=inbox).writeStream
             .foreachBatch(flow.route(handlers, os.path.join(tmp_dir, "bad"), os.path.join(tmp_dir, "log")))
             .option("checkpointLocation", os.path.join(tmp_dir, "ck")).trigger(availableNow=True).start())
        q.awaitTermination(300)

    send(20)
    drain()
    log = spark.read.parquet(os.path.join(tmp_dir, "log"))
    assert {r.status for r in log.collect()} == {"ok"}, log.collect()
    first = {r.key: r.value for r in JB.read_store(spark, store).collect()}
    tickers = JB.hourly_bars(spark, SF_SMALL).select("ticker").distinct().count()
    assert 0 < len(first) <= tickers and all(k.startswith("2024-01-20_10:30 AM_") for k in first)
    # a replayed batch stores nothing twice
    JB.upsert_version(spark, store, JB.read_store(spark, store), 0)
    assert {r.key: r.value for r in JB.read_store(spark, store).collect()} == first
    send(22)
    drain()  # a restart goes on behind the last batch
    second = {r.key: r.value for r in JB.read_store(spark, store).collect()}
    assert first.items() < second.items()
    assert {k[:10] for k in second} == {"2024-01-20", "2024-01-22"}
    assert spark.read.parquet(os.path.join(tmp_dir, "bad")).count() == 2


def test_daily_message_trains_on_a_wide_file_and_registers(spark, tmp_dir):
    """The daily route itself: a message, a wide CSV file with bad cells, and both models in the registry."""
    wide, root = os.path.join(tmp_dir, "wide.csv"), os.path.join(tmp_dir, "models")
    rows = spark.range(300).select(*[((F.col("id") * k) % 100).cast("string").alias(f"v{k}") for k in range(1, 66)])
    rows = rows.withColumn("v7", F.when(F.rand(1) < 0.1, "n/a").otherwise(F.col("v7")))
    rows.coalesce(1).write.option("header", True).csv(wide)
    whole = rows.where("v7 <> 'n/a'").count()
    handlers = JB.handlers(spark, SF_SMALL, FE.ticker_dim(spark, catalog.NEWS_DIM), None, os.path.join(tmp_dir, "store"), root, wide)
    body = '{"trigger_type": "daily_train", "scheduled_time_ny_friendly": "08:00 AM"}'
    run = flow.route(handlers, os.path.join(tmp_dir, "bad"), os.path.join(tmp_dir, "log"))
    run(spark.createDataFrame([("daily_topic", body)], "topic STRING, value STRING"), 0)
    assert {(r.topic, r.status) for r in spark.read.parquet(os.path.join(tmp_dir, "log")).collect()} == {
        ("daily_topic", "ok"), ("hourly_topic", "ok")}
    loaded = JB.load_models(spark, LinearRegressionModel, root)
    assert set(loaded.scaler) == {*JB.FEATS, JB.TARGET} and loaded.senti.numFeatures == 64
    n = registry.latest(spark, "senti", root)["metrics"]["n"]
    assert 0 < n < whole <= 300
