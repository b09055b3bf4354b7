"""Model operators on Spark ML: wide tables, casting, scaling, hash split, fit, predict, evaluate.

Estimators are Spark ML ones (linear regression by default, gradient-boosted trees on request) fitted
on all series at once; nothing is collected to the driver except fitted parameters.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

N_WIDE = 65
WIDE_COLS = [f"v{i}" for i in range(1, N_WIDE + 1)]


def synthetic_wide(ids: DataFrame, id_col: str = "id", n_cols: int = N_WIDE) -> DataFrame:
    """``v_k = float((id * k) % 100)`` for k = 1..n_cols (multiply, then modulo)."""
    return ids.select(F.col(id_col).alias("id"), *[
        ((F.col(id_col) * k) % 100).cast("float").alias(f"v{k}") for k in range(1, n_cols + 1)])


def synthetic_range(spark: SparkSession, n: int = 10_000) -> DataFrame:
    """The same table over ``spark.range(n)`` (used by tests, not by registered queries)."""
    return synthetic_wide(spark.range(n))


def wide_cast(df: DataFrame, cols=WIDE_COLS, keep=("id",)) -> DataFrame:
    """All wide columns as FLOAT in one projection; bad text becomes NULL. Missing columns raise
    (assembly could not run without them)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing[:5]}{'...' if len(missing) > 5 else ''}")
    return df.select(*[k for k in keep if k in df.columns],
                     *[F.col(c).try_cast("float").alias(c) for c in cols])


def drop_incomplete(df: DataFrame, cols=WIDE_COLS) -> DataFrame:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return df.where(cond)


def standardize_fit(df: DataFrame, cols) -> dict[str, tuple[float, float]]:
    """Mean and sample standard deviation per column (2 numbers per column reach the driver).

    One pass: cells become (column, value) pairs that are summed in the task that reads them; the aggregates skip
    NULL cells by themselves. Hundreds of aggregates side by side would outgrow the JVM's limits for one method.
    """
    cols = list(cols)
    cells = df.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in cols])).alias("k", "x"))
    got = {r["k"]: r for r in cells.groupBy("k").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).collect()}
    return {c: (got[i]["m"], got[i]["s"]) if i in got else (None, None) for i, c in enumerate(cols)}


def standardize_apply(df: DataFrame, fit: dict[str, tuple[float, float]],
                      suffix: str = "") -> DataFrame:
    """``(x - mean) / std``; a zero or undefined spread gives 0.0."""
    out = []
    for c, (m, s) in fit.items():
        # NULL stays NULL through the arithmetic; a flat column maps to 0.0 (NULL stays NULL)
        z = (F.col(c) - F.lit(m)) / F.lit(s) if s else F.col(c) * 0.0
        out.append(z.alias(c + suffix))
    keep = [c for c in df.columns if c not in fit or suffix]
    return df.select(*keep, *out)


def scaled_vector(df: DataFrame, fit: dict[str, tuple[float, float]], cols, out: str = "features") -> DataFrame:
    """``out``: the standardised values of ``cols`` as one vector, in one expression, so that the optimiser
    has one column to reason about and not one for each."""
    z = [(F.col(c) - F.lit(fit[c][0])) / F.lit(fit[c][1]) if fit[c][1] else F.col(c) * 0.0 for c in cols]
    return df.withColumn(out, array_to_vector(F.array(*z)))


def is_test(key: Column, folds: int = 5) -> Column:
    """Stable hash split: a fifth of keys (by md5) form the test set; same in any engine."""
    h = F.conv(F.substring(F.md5(key.cast("string")), 1, 7), 16, 10).cast("bigint")
    return (h % folds) == 0


def assemble(df: DataFrame, cols, out: str = "features") -> DataFrame:
    """Vector of the given columns; rows with a NULL cell are skipped."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="skip").transform(df)


def to_vector(df: DataFrame, array_col: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array_col)))


def regressor(kind: str = "linear", features: str = "features", label: str = "label"):
    if kind == "linear":
        return LinearRegression(featuresCol=features, labelCol=label, regParam=1e-3,
                                elasticNetParam=0.0, maxIter=50)
    if kind == "gbt":
        return GBTRegressor(featuresCol=features, labelCol=label, maxIter=20, maxDepth=4, seed=42)
    raise ValueError(f"unknown regressor {kind!r}")


def fit(train: DataFrame, kind: str = "linear", features: str = "features", label: str = "label"):
    return regressor(kind, features, label).fit(train)


def evaluate(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row per metric: mse, rmse, mae and the number of scored rows, from one pass."""
    e = F.col(label) - F.col(prediction)
    one = pred.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.count(e).cast("double").alias("n"))
    return one.withColumn("rmse", F.sqrt("mse")).unpivot(
        [], ["mse", "rmse", "mae", "n"], "metric", "value")


def first_pairs(pred: DataFrame, order: list[str], n: int = 5, label: str = "label",
                prediction: str = "prediction") -> DataFrame:
    """The first ``n`` (prediction, truth) pairs in the given order."""
    return pred.orderBy(*order).limit(n).select(*order, label, prediction)


def first_pairs_by(pred: DataFrame, key: str, order: list[str], n: int = 5, label: str = "label",
                   prediction: str = "prediction") -> DataFrame:
    """The first ``n`` (prediction, truth) pairs of every key, with their rank; partial limits in the tasks."""
    w = Window.partitionBy(key).orderBy(*order)
    return pred.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(key, "rank", *order, label, prediction)


def vector_values(df: DataFrame, vec: str, out: str = "values") -> DataFrame:
    return df.withColumn(out, vector_to_array(F.col(vec)))
