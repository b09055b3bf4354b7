"""Linear regression of each series from one aggregation: its Gram matrix and its product with the target.

For every key the sums of all products of features (with a constant 1) and of features and target are taken in one
grouped aggregation, whose state is (k + 1)(k + 4) / 2 numbers a key and merges in any order, whatever the number of
rows: a hot key is summed in every task that holds rows of it. The normal equations of all keys are then solved
side by side, Arrow batches of keys at a time. Features are taken less a centre that is the same for all rows of a
key, so that large values with small differences (prices) keep their digits.

Defined cases: rows with a NULL in a feature, the centre or the target are left out; a key whose system is singular (fewer rows
than unknowns, or features that depend on each other) gets the solution of least size; a key without a row gets none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RIDGE = 0.0


def _sum(c: Column) -> Column:
    return F.sum(c.cast("double"))


def gram(rows: DataFrame, key: str, features: list[str], target: str, centre: str | None = None) -> DataFrame:
    """(key, n, xx, xy, yy, centre): the sums of products of [1, features] and the target, less the centre."""
    middle = F.col(centre) if centre else F.lit(0.0)
    x = [F.lit(1.0), *[F.col(c) - middle for c in features]]
    y = F.col(target) - middle
    whole = rows.where(F.forall(F.array(*[F.col(c).cast("double") for c in (*features, target, *([centre] if centre else []))]),
                                lambda v: v.isNotNull()))
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    return whole.groupBy(key).agg(
        F.count("*").alias("n"), F.array(*[_sum(x[i] * x[j]) for i, j in pairs]).alias("xx"),
        F.array(*[_sum(a * y) for a in x]).alias("xy"), _sum(y * y).alias("yy"), F.max(middle).alias("centre"))


def _solve_batches(batches, key, ridge):
    for b in batches:
        xx, xy = (np.array(b.column(c).to_pylist(), np.float64) for c in ("xx", "xy"))
        k = xy.shape[1] if len(xy) else 0
        a = np.zeros((len(xy), k, k))
        if k:
            up = np.triu_indices(k)
            a[:, up[0], up[1]] = xx
            a[:, up[1], up[0]] = xx
            a[:, np.arange(1, k), np.arange(1, k)] += ridge
        weights = [np.linalg.lstsq(m, v, rcond=1e-12)[0] for m, v in zip(a, xy)]
        n, yy, c = (np.asarray(b.column(x), np.float64) for x in ("n", "yy", "centre"))
        w = np.array(weights).reshape(len(xy), k)
        error = yy - 2 * (w * xy).sum(axis=1) + np.einsum("ni,nij,nj->n", w, a, w) if k else np.empty(0)
        intercept = w[:, 0] + c * (1 - w[:, 1:].sum(axis=1)) if k else np.empty(0)  # for features and target as they are
        yield pa.RecordBatch.from_arrays(
            [b.column(key), b.column("n"), pa.array(intercept), pa.array([x[1:].tolist() for x in w], pa.list_(pa.float64())),
             pa.array(np.maximum(error, 0) / n)], names=[key, "n", "intercept", "weights", "mse"])


def solve(sums: DataFrame, key: str, ridge: float = RIDGE) -> DataFrame:
    """(key, n, intercept, weights, mse on the rows summed) of every key."""
    schema = T.StructType([sums.schema[key], T.StructField("n", T.LongType()), T.StructField("intercept", T.DoubleType()),
                           T.StructField("weights", T.ArrayType(T.DoubleType())), T.StructField("mse", T.DoubleType())])
    return sums.select(key, "n", "xx", "xy", "yy", "centre").mapInArrow(lambda it: _solve_batches(it, key, ridge), schema)


def fit_by(rows: DataFrame, key: str, features: list[str], target: str, centre: str | None = None, ridge: float = RIDGE) -> DataFrame:
    return solve(gram(rows, key, features, target, centre), key, ridge)


def predict_by(rows: DataFrame, models: DataFrame, key: str, features: list[str], out: str = "prediction") -> DataFrame:
    """Add ``out`` by the key's own model; NULL where there is none, or a feature is NULL."""
    x = F.array(*[F.col(c).cast("double") for c in features])
    dot = F.aggregate(F.arrays_zip(x.alias("x"), F.col("weights").alias("w")), F.lit(0.0), lambda s, p: s + p["x"] * p["w"])
    joined = rows.join(models.select(F.col(key).alias("_key"), "intercept", "weights"), F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.withColumn(out, F.col("intercept") + dot).drop("_key", "intercept", "weights")
