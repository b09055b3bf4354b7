"""Wide-table casting, scaling, split, model registry round trip."""

import pytest
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import functions as F

from tidecast.operators import ml as ML
from tidecast.operators import registry


def test_synthetic_generator_multiplies_then_modulo(spark):
    r = ML.synthetic_range(spark, 10).where("id = 7").collect()[0]
    assert r.v2 == 14.0 and r.v65 == float((7 * 65) % 100) and len(r) == 66


def test_wide_cast_bad_cells_and_missing_columns(spark):
    cols = {f"v{i}": "1.5" for i in range(1, 66)}
    bad = dict(cols, v3="abc", v7=None)
    df = spark.createDataFrame([cols, bad])
    out = ML.wide_cast(df).collect()
    assert out[0].v3 == 1.5 and out[1].v3 is None and out[1].v7 is None
    assert ML.drop_incomplete(ML.wide_cast(df)).count() == 1
    with pytest.raises(ValueError):
        ML.wide_cast(df.drop("v10"))


def test_standardize_constant_column_is_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a DOUBLE, b DOUBLE")
    fit = ML.standardize_fit(df, ["a", "b"])
    out = ML.standardize_apply(df, fit).collect()
    assert [r.b for r in out] == [0.0, 0.0, 0.0]
    assert [r.a for r in out] == pytest.approx([-1.0, 0.0, 1.0])


def test_hash_split_is_stable_and_partitions_keys(spark):
    df = spark.range(10000).withColumn("t", ML.is_test(F.col("id")))
    a = df.where("t").count()
    assert 1600 < a < 2400 and df.where("t").count() == a
    assert df.where("t").join(df.where("not t"), "id").count() == 0


def test_registry_latest_wins(spark, tmp_dir):
    df = spark.createDataFrame([(float(i), float(2 * i)) for i in range(20)], "x DOUBLE, label DOUBLE")
    v = ML.assemble(df, ["x"])
    m1 = ML.fit(v)
    registry.save(spark, m1, "demo", {"mse": 1.0}, root=tmp_dir)
    v2 = v.withColumn("label", F.col("label") * 3)
    m2 = ML.fit(v2)
    registry.save(spark, m2, "demo", {"mse": 2.0}, root=tmp_dir)
    latest = registry.latest(spark, "demo", root=tmp_dir)
    assert latest.metrics["mse"] == 2.0
    loaded = registry.load(spark, "demo", LinearRegressionModel, root=tmp_dir)
    assert loaded.coefficients[0] == pytest.approx(m2.coefficients[0])
    with pytest.raises(ValueError):
        registry.latest(spark, "nope", root=tmp_dir)


class Saved:
    """Stands for a model: writes a folder with its name in it."""

    def __init__(self, spark, name):
        self.spark, self.name = spark, name

    def write(self):
        return self

    def overwrite(self):
        return self

    def save(self, path):
        self.spark.createDataFrame([(self.name,)], "name STRING").coalesce(1).write.parquet(path)


def test_replacing_leaves_one_live_version_and_appending_all(spark, tmp_dir):
    for k in range(3):
        registry.save(spark, Saved(spark, f"a{k}"), "kept", {"k": k}, root=tmp_dir)
        registry.save(spark, Saved(spark, f"r{k}"), "only", {"k": k}, root=tmp_dir, replace=True)
    assert [v["metrics"]["k"] for v in registry.live(spark, "kept", tmp_dir)] == [0, 1, 2]
    assert [v["metrics"]["k"] for v in registry.live(spark, "only", tmp_dir)] == [2]
    registry.retire(spark, "kept", 3, tmp_dir)
    assert registry.latest(spark, "kept", tmp_dir).metrics == {"k": 1.0}
    with pytest.raises(ValueError):
        registry.retire(spark, "kept", 3, tmp_dir)
    assert registry.expire(spark, "kept", tmp_dir) == 1 and registry.expire(spark, "only", tmp_dir) == 2
    assert spark.read.parquet(registry.latest(spark, "kept", tmp_dir).path).first().name == "a1"
    assert [v["version"] for v in registry.live(spark, "kept", tmp_dir)] == [1, 2]


def test_of_racing_writers_one_replacement_is_live(spark, tmp_dir):
    import threading
    errors = []

    def write(name, replace):
        try:
            registry.save(spark, Saved(spark, name), "m", root=tmp_dir, replace=replace)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(n, True)) for n in "abcd"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and len(registry.live(spark, "m", tmp_dir)) == 1
    threads = [threading.Thread(target=write, args=(n, False)) for n in "ef"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and len(registry.live(spark, "m", tmp_dir)) == 3
    assert len({v["path"] for v in registry.live(spark, "m", tmp_dir)}) == 3


def test_a_registry_outside_the_checkpoint_folder(spark, tmp_dir):
    spark.conf.set(registry.SETTING, tmp_dir + "/models-of-mine")
    try:
        path = registry.save(spark, Saved(spark, "x"), "m")
        assert path.startswith(tmp_dir + "/models-of-mine") and registry.latest(spark, "m").path == path
    finally:
        spark.conf.unset(registry.SETTING)
