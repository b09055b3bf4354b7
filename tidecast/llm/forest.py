"""N-gram Jaccard join with MinHash prefix groups.

A text is the set of its shingles of ``WORDS`` words (a text of fewer words has one shingle, all of them).
Texts with equal sets form one class, with one representative. Each of ``TREES`` trees labels a
representative with a sequence of MinHash values. The prefix that has to agree is fixed in advance: the longest
for which the chance of a pair at the threshold to meet in some tree reaches ``TARGET_RECALL`` (3 values at
0.8); a threshold too low for any raises. Representatives that share such a prefix are compared exactly, by the sizes of
their shingle sets' intersections.

No pairs are emitted. A prefix group is cut into cells of at most two blocks of ``CELL`` members, whatever
its size; a pair belongs to the first tree in which it meets and to one cell there. A cell yields for each
member the number of its verified links, and for each connected part a star of edges, both linear in its
members. Connected groups then come from alternating large-star and small-star steps.

Result: one row per input row with ``text_class`` (smallest id with the same shingle set), ``n_copies``
(rows of that set), ``n_links`` (other classes at the threshold or above) and ``class_id`` (smallest id of
the connected group).

Defined cases: texts without a word (null, empty, blank) link to nothing and are a class of their own row;
a null id ranks after all others and is a class id only where no other id is; repeated rows share a
class; added columns replace input columns of the same name; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup_skewed, materialise, table
from .kernels import mix64, ranges, runs, slices, span_hash, trimmed

WORDS = 5
THRESHOLD = 0.8
TREES = 16
MAX_DEPTH = 4
TARGET_RECALL = 0.9999
CELL = 512
SLICE_BYTES = 1_000_000
COLUMNS_AT_ONCE = 8192
ADDED = ("text_class", "n_copies", "n_links", "class_id")


def prefix_depth(threshold: float, trees: int = TREES, target: float = TARGET_RECALL) -> int:
    """Shorten the prefix until pairs at the threshold meet in some tree with the target chance."""
    depth = MAX_DEPTH
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < target:
        depth -= 1
    if 1 - (1 - threshold ** depth) ** trees < target:
        raise ValueError(f"{trees} trees miss the recall of {target} at threshold {threshold} even at depth 1")
    return depth


def shingles(data: list[bytes], n_words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = np.frombuffer(b" ".join([*data, b""]), np.uint8)
    starts, ends = runs((raw != 32) & ((raw < 9) | (raw > 13)))
    words = span_hash(raw, starts, ends, 0x9E3779B97F4A7C15)
    text_of = np.searchsorted(np.cumsum([len(d) + 1 for d in data]), starts, "right")
    per = np.bincount(text_of, minlength=len(data))
    total = np.full(len(words), 0, np.uint64)
    for k in range(n_words):
        part = np.zeros(len(words), np.uint64)
        part[:len(words) - k] = words[k:]
        inside = np.arange(len(words)) + k < np.cumsum(per)[text_of]
        total = np.where(inside, total * np.uint64(0xC2B2AE3D27D4EB4F) + mix64(part + np.uint64(k + 1)), total)
    total = mix64(total)
    first = np.cumsum(per) - per
    take = np.where(per == 0, 0, np.maximum(per - n_words + 1, 1))
    return [np.unique(x) for x in np.split(total[ranges(first, take)], np.cumsum(take)[:-1])]


def permutations(count: int):
    rng = np.random.default_rng(20240101)
    return (rng.integers(0, 2**32, count, dtype=np.uint64).astype(np.uint32) | np.uint32(1),
            rng.integers(0, 2**32, count, dtype=np.uint64).astype(np.uint32))


def signature(sets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash values of one shingle set, a slice of the set at a time."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 2**32 - 1, np.uint32)
    for k in range(0, len(x), COLUMNS_AT_ONCE):
        out = np.minimum(out, (x[None, k:k + COLUMNS_AT_ONCE] * a[:, None] + b[:, None]).min(axis=1))
    return out


def _sketch_batches(batches, depth, n_words):
    a, b = permutations(TREES * MAX_DEPTH)
    salt = np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0x165667B19E3779F9)
    for batch in batches:
        digests, sizes, keys = [], [], []
        for _, _, data in slices(batch.column("text").to_pylist(), SLICE_BYTES):
            for s in shingles(data, n_words):
                if not len(s):
                    digests.append(None), sizes.append(0), keys.append(None)
                    continue
                labels = signature(s, a, b).reshape(TREES, MAX_DEPTH).astype(np.uint64)
                key = salt
                for level in range(depth):
                    key = mix64(key * np.uint64(0xC2B2AE3D27D4EB4F) + labels[:, level])
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sizes.append(len(s))
                keys.append(key.astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("th"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
             pa.array(keys, pa.binary())], names=["id", "th", "digest", "size", "keys"])


def _shingle_batches(batches, n_words):
    for batch in batches:
        out = []
        for _, _, data in slices(batch.column("text").to_pylist(), SLICE_BYTES):
            out += [s.astype("<u8").tobytes() for s in shingles(data, n_words)]
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(out, pa.binary())],
                                         names=["digest", "shingles"])


def _cells(batches, columns):
    """The rows of each cell; cells stand together, and may run over several batches."""
    held, now = None, None
    for b in batches:
        cell = np.asarray(b.column("cell"))
        cut = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
        data = [b.column(c).to_pylist() for c in columns]
        for s, e in zip(cut[:-1], cut[1:]):
            if e == s:
                continue
            if now is not None and cell[s] != now:
                yield now, held
                held = None
            now = cell[s]
            part = [d[s:e] for d in data]
            held = part if held is None else [x + y for x, y in zip(held, part)]
    if held is not None:
        yield now, held


def owned(keys: np.ndarray, sizes: np.ndarray, sides: np.ndarray, tree: int, threshold: float) -> np.ndarray:
    """Which pairs of a cell are compared here: this is the first tree where they meet, they belong to the
    cell's blocks, and their sizes allow the threshold."""
    n = len(sizes)
    out = np.triu(np.ones((n, n), bool), 1)
    if sides.any():  # a cell of two different blocks compares across them only
        out &= sides[:, None] != sides[None, :]
    out &= np.minimum(sizes[:, None], sizes[None, :]) >= threshold * np.maximum(sizes[:, None], sizes[None, :]) - 1e-9
    for t in range(tree):
        if not out.any():
            break
        out &= keys[:, None, t] != keys[None, :, t]
    return out


def _needed_batches(batches, threshold):
    cells, digests = [], []
    for cell, (digest, size, keys, side, tree) in _cells(batches, ["digest", "size", "keys", "side", "tree"]):
        k = np.frombuffer(b"".join(keys), "<i8").reshape(len(keys), -1)
        pairs = owned(k, np.array(size), np.array(side), tree[0], threshold)
        some = np.flatnonzero(pairs.any(axis=0) | pairs.any(axis=1))
        cells += [cell] * len(some)
        digests += [digest[x] for x in some]
        if len(cells) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(digests, pa.binary())],
                                             names=["cell", "digest"])
            cells, digests = [], []
    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(digests, pa.binary())],
                                     names=["cell", "digest"])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, as products of 0/1 matrices, some columns at a time."""
    n = len(sets)
    if n == 2:
        both = np.intersect1d(sets[0], sets[1], assume_unique=True)
        return np.array([[0, len(both)], [len(both), 0]])
    _, which = np.unique(np.concatenate(sets), return_inverse=True)
    count = np.bincount(which)
    column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[which]
    member = np.repeat(np.arange(n), [len(s) for s in sets])
    out = np.zeros((n, n), np.float32)
    total = int(column.max(initial=-1)) + 1
    order = np.argsort(column, kind="stable")
    column, member = column[order], member[order]
    for k in range(0, total, COLUMNS_AT_ONCE):
        s, e = np.searchsorted(column, [k, k + COLUMNS_AT_ONCE])
        m = np.zeros((n, min(COLUMNS_AT_ONCE, total - k)), np.float32)
        m[member[s:e], column[s:e] - k] = 1
        out += m @ m.T
    return np.rint(out)


def _parts(linked: np.ndarray) -> np.ndarray:
    """For each member the first member of its connected part."""
    label = np.arange(len(linked))
    both = linked | linked.T | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(both, label[None, :], len(label)).min(axis=1)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _verify_batches(batches, threshold):
    """Rows (a, null, links of a) and (a, b, null) for a star of each connected part."""
    a, b, links = [], [], []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()),
                                           pa.array(links, pa.int64())], names=["a", "b", "links"])

    for _, (digest, size, keys, side, tree, sets) in _cells(
            batches, ["digest", "size", "keys", "side", "tree", "shingles"]):
        k = np.frombuffer(b"".join(keys), "<i8").reshape(len(keys), -1)
        size = np.array(size)
        pairs = owned(k, size, np.array(side), tree[0], threshold)
        common = intersections([np.frombuffer(s, "<u8") for s in sets])
        # Jaccard >= t  <=>  common >= t * union
        linked = pairs & (common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9)
        count = linked.sum(axis=0) + linked.sum(axis=1)
        part = _parts(linked) if linked.any() else np.arange(len(size))
        for x in np.flatnonzero(count):
            a.append(digest[x]), b.append(None), links.append(int(count[x]))
            if part[x] != x:
                a.append(digest[x]), b.append(digest[part[x]]), links.append(None)
        if len(a) > 20_000:
            yield batch()
            a, b, links = [], [], []
    yield batch()


def _by_cell(df: DataFrame) -> DataFrame:
    return df.repartition("cell").sortWithinPartitions("cell", "digest")


def connected(edges: DataFrame, name: str = "edges") -> DataFrame:
    """(node, root) for the nodes of (a, b) edges, by alternating large-star and small-star steps.

    A star's centre may have most of the edges: its minimum is combined before the shuffle, and it is
    looked up by ``lookup_skewed``.
    """
    def star(pairs: DataFrame, keep) -> DataFrame:
        total = pairs.count()
        least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn(
            "m", F.least("u", "m"))
        return lookup_skewed(pairs, least, "u", "n", total).select(*keep)

    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    seen = None
    while True:
        both = materialise(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), name)
        large = star(both, [F.when(F.col("v") > F.col("u"), F.col("v")).alias("u"), F.col("m").alias("v")])
        large = materialise(large.where("u is not null and u <> v").distinct(), name)
        pairs = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        pairs = materialise(pairs, name)
        small = star(pairs, [F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")]).select("e.u", "e.v")
        now = materialise(small.where("u <> v").distinct(), name)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def join_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                 n_words: int = WORDS) -> DataFrame:
    """(id, th, first, text_class, n_copies, n_links, class_id): th is the text's hash, and ``first`` tells
    whether the row's (id, th) is the earliest of its connected group."""
    depth = prefix_depth(threshold)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("th"),
                       F.col(f"`{text_col}`").alias("text"))
    sketch = materialise(rows.mapInArrow(lambda it: trimmed(_sketch_batches(it, depth, n_words)),
                                         f"id {kind}, th long, digest binary, size long, keys binary"), "sketches")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "th")
    classes = materialise(sketch.where("digest is not null").groupBy("digest").agg(
        F.min(place).alias("first"), F.count("*").alias("n_copies"), F.max("size").alias("size"),
        F.max("keys").alias("keys")), "classes")

    entries = classes.select("digest", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)),
        lambda t: F.substring(F.col("keys"), t * 8 + 1, F.lit(8)))).alias("tree", "key"))
    groups = entries.groupBy("tree", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = entries.join(groups, ["tree", "key"])
    blocks = F.ceil(F.col("n") / CELL).cast("int")
    met = met.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = met.select(
        F.xxhash64("tree", "key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "tree", "digest",
        # 0 in a cell of one block; 1 and 2 tell the two blocks of the others apart
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"))
    cells = materialise(cells, "cells")

    facts = classes.select("digest", "size", "keys")
    needed = _by_cell(cells.join(facts, "digest")).mapInArrow(
        lambda it: trimmed(_needed_batches(it, threshold)), "cell long, digest binary")
    needed = materialise(needed, "needed")
    wanted = needed.select("digest").distinct().join(classes, "digest").select(
        "digest", F.col("first.id").alias("i"), F.col("first.th").alias("h"))
    texts = rows.join(wanted, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h"))).select("digest", "text")
    sets = texts.mapInArrow(lambda it: trimmed(_shingle_batches(it, n_words)), "digest binary, shingles binary")
    sets = materialise(sets.dropDuplicates(["digest"]), "shingles")
    full = needed.join(cells, ["cell", "digest"]).join(facts, "digest").join(sets, "digest")
    found = materialise(_by_cell(full.select("cell", "digest", "size", "keys", "side", "tree", "shingles")).mapInArrow(
        lambda it: trimmed(_verify_batches(it, threshold)), "a binary, b binary, links long"), "links")

    links = found.where("b is null").groupBy(F.col("a").alias("digest")).agg(F.sum("links").alias("n_links"))
    roots = connected(found.where("b is not null").select("a", "b"))
    linked = links.join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn(
        "root", F.coalesce("root", "digest"))
    linked = materialise(linked.join(classes.select("digest", "first", "n_copies"), "digest"), "linked")
    heads = linked.groupBy("root").agg(F.min("first").alias("head"), F.count("*").alias("n"))
    grouped = lookup_skewed(linked, heads, "root", "n", linked.count()).select("digest", "n_links", "head")
    facts = classes.select("digest", "first", "n_copies").join(grouped, "digest", "left")
    with_facts = lookup_skewed(sketch.select("id", "th", "digest"), facts, "digest", "n_copies", sketch.count())
    head = F.coalesce("head", "first", place)
    return with_facts.select(
        "id", "th", (place == head).alias("first"),
        F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("text_class"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        head["id"].alias("class_id"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, one of each connected group: the earliest by id, then text hash."""
    first = join_similar(docs, id_col, text_col, **options).where("first").select(
        F.col("id").alias("__id"), F.col("th").alias("__h")).distinct()
    same = Window.partitionBy(f"`{id_col}`", "__th").orderBy("__th")
    rows = docs.withColumn("__th", F.xxhash64(f"`{text_col}`")).withColumn("__n", F.row_number().over(same))
    return rows.where("__n = 1").join(
        first, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__h")), "left_semi").select(
        *[F.col(f"`{c}`") for c in docs.columns])


SQL = None


def query(spark, sf_dir: str) -> DataFrame:
    found = join_similar(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "text_class", "n_copies", "n_links", "class_id")
