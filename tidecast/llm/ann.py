"""Approximate nearest neighbours by learned partitions.

Fitting works on a bounded sample (``SAMPLE`` vectors, smallest id hash first): its exact neighbour graph
is made by Spark tasks against the broadcast sample, cut into balanced parts, and a small network learns
to predict a vector's part from how its neighbours are spread. Every vector is then indexed in its most
probable part. A query is sent to its few most probable parts and ranked there exactly. The number of
parts probed is the smallest that reaches ``TARGET_RECALL`` on queries from the sample.

Tables of ``PART_ROWS`` vectors and more are cut into parts, in proportion to their size and at most ``MAX_PARTS``
(what a sample of ``SAMPLE`` vectors can tell apart); ``exact`` searches without parts. ``SHARD_PARTS`` parts make a
shard, and a query is sent once to each shard with the list of its parts there. Shards are read in chunks of about
``CHUNK`` vectors and queries in blocks of ``QUERY_BLOCK``, so a part that holds a third of all vectors is many
tasks' work and no task holds all queries; each returns at most ``k`` rows a query, and the ranks are cut again before
the shuffle.

Nearness is the largest inner product in double precision, summed dimension by dimension, so that equal
vectors tie exactly; ties go to the smaller id.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite
components take no part, nor do rows with a null id; rows that repeat an id count once, with the smallest
of its vectors; fewer candidates than ``k`` give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table

SAMPLE = 8192
GRAPH_NEIGHBOURS = 16
PART_ROWS = 128
MAX_PARTS = 64
SHARD_PARTS = 8
CHUNK = 4096
QUERY_BLOCK = 16384
HIDDEN = 64
EPOCHS = 30
TARGET_RECALL = 0.94
SLACK = 1.1
QUERY_STEP = 20
K = 20


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v): one finite non-zero vector an id, all of one length."""
    v = F.col(f"`{vec_col}`")
    fine = (F.col(f"`{id_col}`").isNotNull() & v.isNotNull()
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(v, lambda x: x != 0))
    rows = vectors.where(fine).groupBy(F.col(f"`{id_col}`").alias("id")).agg(
        F.min(v.cast("array<double>")).alias("v"))
    rows = materialise(rows, "vectors")
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (usual["n"] if usual else 0))


def matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return np.asarray(flat.flatten(), np.float64).reshape(n, -1) if n else np.empty((0, 0))


def _graph_batches(batches, sample, neighbours):
    points = sample.value
    for b in batches:
        at = np.asarray(b.column("at"))
        near = points[at] @ points.T
        near[np.arange(len(at)), at] = -np.inf
        best = np.argpartition(-near, min(neighbours, len(points) - 1) - 1, axis=1)[:, :neighbours]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(best.tolist(), pa.list_(pa.int32()))], names=["at", "near"])


def balanced_parts(points: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 20) -> np.ndarray:
    """Cut the graph into parts of nearly equal size: halve along main directions, then move points to
    the part most of their neighbours are in while it has room."""
    n = len(points)
    part = np.zeros(n, np.int64)
    todo = [(np.arange(n), 0, parts)]
    while todo:
        at, low, count = todo.pop()
        part[at] = low
        if count > 1 and len(at) > 1:
            left = count // 2
            centred = points[at] - points[at].mean(axis=0)
            axis = np.linalg.svd(centred.T @ centred)[0][:, 0]
            order = at[np.argsort(centred @ axis, kind="stable")]
            cut = len(at) * left // count
            todo += [(order[:cut], low, left), (order[cut:], low + left, count - left)]
    room = int(np.ceil(n / parts * SLACK))
    for _ in range(rounds):
        votes = spread(graph, part, parts)
        want = votes.argmax(axis=1)
        gain = votes[np.arange(n), want] - votes[np.arange(n), part]
        moved = 0
        size = np.bincount(part, minlength=parts)
        for x in np.argsort(-gain, kind="stable"):
            if gain[x] <= 0:
                break
            if size[want[x]] < room:
                size[part[x]] -= 1
                size[want[x]] += 1
                part[x] = want[x]
                moved += 1
        if moved < n / 1000:
            break
    return part


def spread(graph: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
    """How many neighbours of each point, itself counted once, are in each part."""
    n = len(part)
    rows = np.repeat(np.arange(n), graph.shape[1])
    votes = np.bincount(rows * parts + part[graph.ravel()], minlength=n * parts).reshape(n, parts).astype(float)
    votes[np.arange(n), part] += 1
    return votes


def part_scores(weights, x: np.ndarray) -> np.ndarray:
    """A score of each part for each vector."""
    w1, b1, w2, b2 = weights
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.maximum(x / np.where(norm > 0, norm, 1) @ w1 + b1, 0) @ w2 + b2


class Router:
    """A network with one hidden layer that gives the probability of each part."""

    def __init__(self, dim: int, parts: int):
        rng = np.random.default_rng(7)
        self.w1, self.b1 = rng.normal(0, np.sqrt(2 / max(dim, 1)), (dim, HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)

    def weights(self) -> tuple[np.ndarray, ...]:
        """Plain arrays, as a broadcast is read by name: the tasks need not have this class."""
        return self.w1, self.b1, self.w2, self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return part_scores(self.weights(), x)

    def fit(self, x: np.ndarray, goal: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01) -> "Router":
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        goal = goal / goal.sum(axis=1, keepdims=True)
        rng = np.random.default_rng(11)
        state = [[p, np.zeros_like(p), np.zeros_like(p)] for p in (self.w1, self.b1, self.w2, self.b2)]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for s in range(0, len(x), 128):
                at = order[s:s + 128]
                hidden = np.maximum(x[at] @ self.w1 + self.b1, 0)
                out = hidden @ self.w2 + self.b2
                p = np.exp(out - out.max(axis=1, keepdims=True))
                d = (p / p.sum(axis=1, keepdims=True) - goal[at]) / len(at)
                dh = (d @ self.w2.T) * (hidden > 0)
                step += 1
                for (value, m, v), g in zip(state, (x[at].T @ dh, dh.sum(0), hidden.T @ d, d.sum(0))):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    value -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        return self


def fit(vectors: DataFrame, k: int = K, sample_size: int = SAMPLE, target: float = TARGET_RECALL,
        part_rows: int = PART_ROWS, exact: bool = False):
    """(router, parts to probe) from at most ``sample_size`` of the (id, v) rows; one part if ``exact``."""
    spark = vectors.sparkSession
    total = vectors.count()
    chosen = vectors.orderBy(F.xxhash64("id"), "id").limit(sample_size).toPandas()  # bounded by sample_size
    parts = int(min(MAX_PARTS, max(1, total // part_rows), max(1, len(chosen) // (2 * k))))
    if exact or parts == 1 or len(chosen) <= k:
        dim = len(chosen["v"].iloc[0]) if len(chosen) else 0
        return Router(dim, 1), 1
    points = np.stack(chosen["v"].to_numpy()).astype(np.float64)
    shared = spark.sparkContext.broadcast(points)
    near = spark.range(len(points)).select(F.col("id").alias("at")).mapInArrow(
        lambda it: _graph_batches(it, shared, max(GRAPH_NEIGHBOURS, k)), "at long, near array<int>").toPandas()
    graph = np.stack(near.sort_values("at")["near"].to_numpy())
    part = balanced_parts(points, graph[:, :GRAPH_NEIGHBOURS], parts)
    router = Router(points.shape[1], parts).fit(points, spread(graph[:, :GRAPH_NEIGHBOURS], part, parts))
    # the sample's own points as queries: how many parts hold their neighbours, by the router's order
    scores = router.scores(points)
    own = scores.argmax(axis=1)
    place = np.argsort(np.argsort(-scores, axis=1, kind="stable"), axis=1)
    rank = place[np.arange(len(points))[:, None], own[graph]]
    probes = next(p for p in range(1, parts + 1) if (rank < p).mean() >= target)
    return router, probes


def _route_batches(batches, weights, probes):
    for b in batches:
        order = np.argsort(-part_scores(weights.value, matrix(b.column("v"))), axis=1, kind="stable")[:, :probes]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(order.tolist(), pa.list_(pa.int32()))],
                                         names=["id", "v", "parts"])


def _rank(queries: pa.Table, found: pa.Table, k: int) -> pa.Table:
    """The ``k`` nearest of one chunk to each of its queries, in the query's parts."""
    out = [[], [], []]
    if queries.num_rows and found.num_rows:
        q, v = matrix(queries.column("id_v")), matrix(found.column("v"))
        qid, vid, part = queries.column("id").to_numpy(), found.column("id").to_numpy(), found.column("part").to_numpy()
        asked = queries.column("parts").to_pylist()
        every = np.unique(part)
        column = np.searchsorted(every, part)
        for s in range(0, len(q), 256):
            rough = q[s:s + 256] @ v.T
            rough[qid[s:s + 256, None] == vid[None, :]] = -np.inf
            probed = np.array([np.isin(every, p) for p in asked[s:s + 256]])
            rough[~probed[:, column]] = -np.inf
            top = min(k, len(vid))
            edge = -np.partition(-rough, top - 1, axis=1)[:, top - 1]
            for r in range(len(rough)):
                least = edge[r] - 1e-9 * max(1.0, abs(edge[r])) if np.isfinite(edge[r]) else -np.inf
                at = np.flatnonzero((rough[r] >= least) & (rough[r] > -np.inf))
                score = np.zeros(len(at))
                for d in range(q.shape[1]):
                    score += q[s + r, d] * v[at, d]
                best = np.lexsort((vid[at], -score))[:k]
                out[0] += [int(qid[s + r])] * len(best)
                out[1] += vid[at[best]].tolist()
                out[2] += score[best].tolist()
    return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()),
                     "score": pa.array(out[2], pa.float64())})


def nearest(vectors: DataFrame, queries: DataFrame, model, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of (id, v) queries among all (id, v) vectors but their own."""
    router, probes = model
    shared = vectors.sparkSession.sparkContext.broadcast(router.weights())  # dim x HIDDEN + HIDDEN x parts numbers
    route = lambda df, n: df.mapInArrow(
        lambda it: _route_batches(it, shared, n), "id long, v array<double>, parts array<int>")
    typed = lambda df: df.select(F.col("id").cast("long").alias("id"), "v")
    shard = lambda part: F.floor(part / SHARD_PARTS).cast("int")
    index = materialise(route(typed(vectors), 1).select("id", "v", F.col("parts")[0].alias("part")).withColumn(
        "shard", shard(F.col("part"))), "ann-index")
    sizes = index.groupBy("shard").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    asked = materialise(route(typed(queries), probes).select("id", F.col("v").alias("id_v"), "parts"), "ann-queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    # sizes has as many rows as there are shards, at most MAX_PARTS / SHARD_PARTS
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    chunked = index.join(F.broadcast(sizes), "shard").select(
        "shard", F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("chunk"), F.explode(every).alias("block"), "id", "v", "part")
    sent = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.array_distinct(F.transform("parts", shard)))).join(F.broadcast(sizes), "shard")
    sent = sent.select("shard", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "block", "id", "id_v", "parts")
    keys = ("shard", "chunk", "block")
    found = sent.groupBy(*keys).cogroup(chunked.groupBy(*keys)).applyInArrow(
        lambda a, b: _rank(a, b, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


SQL = None


def query(spark, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    model = fit(vectors)
    return nearest(vectors, vectors.where(F.col("id") % QUERY_STEP == 0), model)
