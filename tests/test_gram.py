"""Regressions by key against numpy, singular systems, large values, and the pooled model's error."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.operators import gram as GR
from tidecast.operators import ml as ML
from tidecast.plans import catalog

from conftest import SF_CHECK

SCHEMA = "k STRING, a DOUBLE, b DOUBLE, y DOUBLE, mid DOUBLE"


def test_models_match_numpy(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k, shift in (("x", 0.0), ("y", 1e7), (None, -3.0)):
        for _ in range(200):
            a, b = shift + rng.normal(), shift + rng.normal()
            rows.append((k, float(a), float(b), float(2 * a - b + rng.normal()), shift))
    rows += [("x", None, 1.0, 1.0, 0.0), ("x", 1.0, 1.0, None, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.k: r for r in GR.fit_by(df, "k", ["a", "b"], "y", centre="mid").collect()}
    for k in ("x", "y", None):
        own = np.array([r[1:4] for r in rows if r[0] == k and None not in r[1:]], float)
        mid = own.mean(axis=0)
        w, *_ = np.linalg.lstsq(own[:, :2] - mid[:2], own[:, 2] - mid[2], rcond=None)
        assert got[k].n == 200 and got[k].weights == pytest.approx(w, rel=1e-6)
        predicted = own[:, :2] @ np.array(got[k].weights) + got[k].intercept
        assert got[k].mse == pytest.approx(np.mean((own[:, 2] - mid[2] - (own[:, :2] - mid[:2]) @ w) ** 2), rel=1e-5)
        assert np.mean((own[:, 2] - predicted) ** 2) == pytest.approx(got[k].mse, rel=1e-5)
    out = GR.predict_by(df, GR.fit_by(df, "k", ["a", "b"], "y", centre="mid"), "k", ["a", "b"])
    assert out.count() == len(rows) and out.where("prediction is null").count() == 1


def test_singular_and_missing_systems(spark):
    rows = [("one", 1.0, 2.0, 5.0, 0.0), ("flat", 1.0, 1.0, 3.0, 0.0), ("flat", 1.0, 1.0, 5.0, 0.0), ("none", None, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    models = GR.fit_by(df, "k", ["a", "b"], "y")
    pred = {r.k: r.prediction for r in GR.predict_by(df, models, "k", ["a", "b"]).collect()}
    assert pred["one"] == pytest.approx(5.0) and pred["flat"] == pytest.approx(4.0) and pred["none"] is None
    assert GR.fit_by(df.limit(0), "k", ["a", "b"], "y").count() == 0


def test_own_models_beat_the_pooled_one(spark):
    from pyspark.ml.feature import VectorAssembler
    rows = catalog._lagged(spark, SF_CHECK).where("x3 is not null")
    own = GR.fit_by(rows, "ticker", ["x1", "x2", "x3"], "close", centre="mid").agg(
        (F.sum(F.col("mse") * F.col("n")) / F.sum("n")).alias("e")).first().e
    z = VectorAssembler(inputCols=["x1", "x2", "x3"], outputCol="features").transform(rows).withColumnRenamed("close", "label")
    pooled = {r.metric: r.value for r in ML.evaluate(ML.fit(z).transform(z)).collect()}["mse"]
    assert own < pooled
