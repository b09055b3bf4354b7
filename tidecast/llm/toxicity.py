"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed single words, neighbouring pairs, and pairs with one word
between. FTRL-proximal keeps for each coordinate the sum of its adjusted gradients and of their squares,
so every coordinate has its own rate and L1 keeps most weights at exactly zero. Training works on a
bounded sample of the labelled rows (``MAX_LABELLED`` ids, smallest id hash first): shards of the sample
are learned side by side, and the coordinates' sums are averaged over the shards after each round. The
weights that are not zero are broadcast; they are at most ``BUCKETS``.

Defined cases: null and empty texts, and texts without a word, have no feature and score as the bias
alone; with nothing to learn from, every score is that of zero weights less than one half; several labels
of an id count as toxic if any is; rows with a null label or id are not learned from; repeated rows
get equal results; added columns replace input columns of the same name; an empty table gives an empty
result. Texts are read whole, a slice of the batch at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket_of, materialise, table
from .kernels import mix64, runs, slices, span_hash

BITS = 20
BUCKETS = 1 << BITS
MAX_LABELLED = 20_000
SHARDS = 4
ROUNDS = 3
EPOCHS = 2
ALPHA, BETA, L1, L2 = 2.0, 1.0, 3.0, 0.0
POSITIVE_WEIGHT = 2.0  # toxic texts are few
START_BIAS = -1.0
SLICE_BYTES = 1_000_000
PART = 1 << 14


def _letters() -> np.ndarray:
    """Lower-cased bytes of words; 0 for the bytes between words."""
    out = np.zeros(256, np.uint8)
    for b in (*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), *range(128, 256)):
        out[b] = b
    for b in range(ord("A"), ord("Z") + 1):
        out[b] = b + 32
    return out


def features(data: list[bytes]):
    """(text, bucket) of the distinct features of each text, in order of text."""
    raw = _letters()[np.frombuffer(b" ".join([*data, b""]), np.uint8)]
    starts, ends = runs(raw != 0)
    words = span_hash(raw, starts, ends, 0x9E3779B97F4A7C15)
    text_of = np.searchsorted(np.cumsum([len(d) + 1 for d in data]), starts, "right")
    found = [(text_of, words)]
    for gap, salt in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        both = text_of[gap:] == text_of[:-gap]
        pair = mix64(words[:-gap] * np.uint64(salt) + words[gap:])
        found.append((text_of[:-gap][both] if len(pair) else text_of[:0], pair[both] if len(pair) else words[:0]))
    key = np.concatenate([t.astype(np.uint64) << np.uint64(BITS) | (h >> np.uint64(64 - BITS)) for t, h in found])
    key = np.unique(key)
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64(BUCKETS - 1)).astype(np.int64)


def _pack(rows: pa.Table) -> pa.Table:
    """One shard of the bounded sample as one row: the examples in a fixed order."""
    order = np.lexsort([np.asarray(rows.column(c)) for c in ("text_hash", "id_hash")])
    rows = rows.take(pa.array(order))
    found = []
    for at, to, data in slices(rows.column("text").to_pylist(), SLICE_BYTES):
        text_of, bucket = features(data)
        found += np.split(bucket.astype("<u4"), np.searchsorted(text_of, np.arange(1, to - at)))
    return pa.table({
        "shard": rows.column("shard").slice(0, 1),
        "toxic": pa.array([rows.column("toxic").to_numpy().astype("<f8").tobytes()], pa.binary()),
        "counts": pa.array([np.array([len(f) for f in found], "<i8").tobytes()], pa.binary()),
        "features": pa.array([np.concatenate(found).tobytes()], pa.binary())})


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def learn(examples, z: np.ndarray, n: np.ndarray, epochs: int = EPOCHS) -> None:
    """Update the coordinates' sums in place from (features, label) pairs, in their order.

    The last coordinate is the bias, which no L1 holds back."""
    for _ in range(epochs):
        for at, label in examples:
            w = weights_of(z[at], n[at])
            bias = START_BIAS - z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -30, 30)))
            g = (p - label) * (POSITIVE_WEIGHT if label else 1.0)
            root = np.sqrt(n[at])
            z[at] += g - (np.sqrt(n[at] + g * g) - root) / ALPHA * w
            n[at] += g * g
            z[-1] += g - (np.sqrt(n[-1] + g * g) - np.sqrt(n[-1])) / ALPHA * (bias - START_BIAS)
            n[-1] += g * g


def _learn_batches(batches, state):
    """Each row is a whole shard; one shard's examples are held at a time."""
    for b in batches:
        for toxic, counts, feats in zip(*(b.column(c) for c in ("toxic", "counts", "features"))):
            cut = np.cumsum(np.frombuffer(counts.as_py(), "<i8"))[:-1]
            found = np.split(np.frombuffer(feats.as_py(), "<u4").astype(np.int64), cut)
            z, n = (x.astype(np.float64) for x in state.value)
            learn(list(zip(found, np.frombuffer(toxic.as_py(), "<f8").tolist())), z, n)
            used = [k for k in range(0, len(z), PART) if n[k:k + PART].any()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k // PART for k in used], pa.int32()),
                 pa.array([z[k:k + PART].astype("<f4").tobytes() for k in used], pa.binary()),
                 pa.array([n[k:k + PART].astype("<f4").tobytes() for k in used], pa.binary())], names=["part", "z", "n"])


def _sum_batches(batches):
    total: dict[int, list] = {}
    for b in batches:
        for part, z, n in zip(*(b.column(c).to_pylist() for c in ("part", "z", "n"))):
            now = total.setdefault(part, [0.0, 0.0])
            now[0] = now[0] + np.frombuffer(z, "<f4").astype(np.float64)
            now[1] = now[1] + np.frombuffer(n, "<f4").astype(np.float64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([v[0].tobytes() for v in total.values()], pa.binary()),
         pa.array([v[1].tobytes() for v in total.values()], pa.binary())], names=["part", "z", "n"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_labelled: int = MAX_LABELLED):
    """(bias, buckets, weights) learned from at most ``max_labelled`` labelled ids."""
    spark = docs.sparkSession
    chosen = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
              .groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("double").alias("toxic"))
              .orderBy(F.xxhash64("__id"), "__id").limit(max_labelled))
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("text")).join(
        F.broadcast(chosen), "__id")  # at most max_labelled ids
    rows = rows.select(F.pmod(F.xxhash64("__id"), F.lit(SHARDS)).cast("int").alias("shard"), "toxic", "text",
                       F.xxhash64("__id").alias("id_hash"), F.xxhash64("text").alias("text_hash"))
    examples = materialise(rows.groupBy("shard").applyInArrow(
        _pack, "shard int, toxic binary, counts binary, features binary"), "toxic-features")
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    n_shards = examples.count()
    for _ in range(ROUNDS if n_shards else 0):
        state = spark.sparkContext.broadcast((z.astype(np.float32), n.astype(np.float32)))
        parts = (examples.select("toxic", "counts", "features").mapInArrow(lambda it: _learn_batches(it, state), "part int, z binary, n binary")
                 .repartition(SHARDS, "part").mapInArrow(_sum_batches, "part int, z binary, n binary"))
        z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
        for r in parts.collect():  # the coordinates' sums: a fixed number of them, whatever the data
            at = slice(r["part"] * PART, r["part"] * PART + PART)
            z[at], n[at] = np.frombuffer(r["z"]) / n_shards, np.frombuffer(r["n"]) / n_shards
        state.destroy()
    w = weights_of(z[:-1], n[:-1])
    kept = np.flatnonzero(w)
    bias = START_BIAS - z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA)
    return float(bias), kept, w[kept].astype(np.float32)


def _score_batches(batches, model, text_name):
    bias, kept, weights = model.value
    dense = np.zeros(BUCKETS, np.float32)
    dense[kept] = weights
    for b in batches:
        out = []
        for at, to, data in slices(b.column(text_name).to_pylist(), SLICE_BYTES):
            text_of, bucket = features(data)
            out.append(bias + np.bincount(text_of, weights=dense[bucket], minlength=to - at))
        score = 1.0 / (1.0 + np.exp(-np.clip(np.concatenate(out), -30, 30))) if out else np.empty(0)
        made = {"score": pa.array(score, pa.float64()), "predicted": pa.array((score >= 0.5).astype(np.int32))}
        keep = [c for c in b.schema.names if c not in made]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *made.values()], names=[*keep, *made])


def score(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from one half on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    keep = [f for f in docs.schema if f.name not in ("score", "predicted")]
    return docs.mapInArrow(lambda it: _score_batches(it, shared, text_col), T.StructType([*keep, *added]))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs.select("doc_id", "text"), labels.where(bucket_of("doc_id", 5) != 0).select("doc_id", "toxic"))
    return score(docs.select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "text"), model).select(
        "doc_id", "held_out", "score", "predicted")
