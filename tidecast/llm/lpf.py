"""Substring dedup with longest-previous-factor arrays over suffix order.

A byte goes if some ``MIN_LEN``-byte string that covers it also starts in a document with a smaller id.

Which suffixes must be sorted together: every window of MIN_LEN bytes picks the leftmost of its k-grams
with the smallest hash, its anchor, so equal windows pick equal anchors. Anchors that stand in one
document only cannot matter. For the others, each run of windows with one anchor becomes a snippet (its
bytes, at most MIN_LEN + the run), the windows being the first suffixes of the snippet. Suffixes of the
snippets of an anchor's bucket are sorted; neighbours that agree in MIN_LEN bytes form runs; in a run a
suffix has an earlier match exactly when the previous or the next smaller document id in suffix order
exists. Only the first MIN_LEN bytes decide, so the arrays are cut there.

No group is ever gathered whole. Texts are packed into blocks of some MB; a block sends each anchor hash
once and each distinct snippet once with its smallest id (copies inside a block with larger ids are
covered by that), so a passage shared by a third of all documents costs one row a block. The blocks are a
table bucketed by block, read again without a shuffle; only hashes, snippets and bit masks move.

Defined cases: a null text counts as empty; a text under MIN_LEN bytes loses nothing; rows with a null id
neither lose bytes nor make others lose any; rows that share an id never match each other; added columns
replace input columns of the same name; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, table
from .kernels import mix64, ranges, runs

MIN_LEN = 50
BLOCK_BYTES = 4_000_000
SLICE_BYTES = 1_000_000
SUFFIXES_AT_ONCE = 400_000
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
        0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
        0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)


MOST_RUN = 31  # windows of one snippet: their mask is a 32-bit number
LENGTHS = (16, 255)  # lengths that can be asked for: an anchor's place in its window is one byte


def gram_words(min_len: int) -> int:
    """8-byte words in an anchor's k-gram."""
    return max(1, min_len // 16)


def _loads(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at every position as one number (``data`` is padded by 8)."""
    return np.ndarray((max(0, len(data) - 8),), "<u8", data, strides=(1,))


def gram_hashes(data: np.ndarray, words: int, at=None) -> np.ndarray:
    """The hash of the k-gram at each position (or at the given ones)."""
    eight = _loads(data)
    total = None
    for w in range(words):
        part = (eight[at + 8 * w] if at is not None else eight[8 * w:len(eight) - 8 * (words - 1 - w)])
        part = part * np.uint64(_ODD[w % 12]) ^ (part >> np.uint64(29 + w % 12))
        total = part if total is None else total * np.uint64(_ODD[(w + 3) % 12]) + part
    return mix64(total)


def anchors(texts: list[bytes], min_len: int):
    """For each text the lengths of its runs of windows with one anchor, and how far into the run's first
    window the anchor stands; both as bytes. Runs tile the text's windows from the first on."""
    words = gram_words(min_len)
    width = min_len - 8 * words + 1
    data = np.frombuffer(b"".join([*texts, bytes(min_len + 16)]), np.uint8)
    key = gram_hashes(data, words) >> np.uint64(32) << np.uint64(32) | np.arange(
        len(data) - 8 * words, dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < width:
        key = np.minimum(key[:len(key) - (width - size)], key[width - size:])
    lengths = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(lengths) - lengths
    counts = np.maximum(lengths - min_len + 1, 0)
    window = ranges(begin, counts)
    pick = (key[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), counts)
    new = np.ones(len(pick), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(pick)))
    if len(size) and size.max() > MOST_RUN:  # a long run is several snippets of one anchor
        cuts = -(-size // MOST_RUN)
        first = ranges(np.zeros(len(size), np.int64), cuts) * MOST_RUN + np.repeat(first, cuts)
    run = np.diff(np.append(first, len(pick))).astype(np.uint8)
    off = (pick[first] - window[first]).astype(np.uint8)
    cut = np.searchsorted(of[first], np.arange(1, len(texts)))
    return [(a.tobytes(), b.tobytes()) for a, b in zip(np.split(run, cut), np.split(off, cut))]


def _block_batches(batches, min_len):
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    size = 0
    for b in batches:
        ids, texts = b.column("id").to_pylist(), b.column("data").to_pylist()
        at = 0
        while at < len(texts):
            to, total = at, 0
            while to < len(texts) and (to == at or total + len(texts[to]) <= SLICE_BYTES):
                total += len(texts[to])
                to += 1
            found = anchors([t if i is not None else b"" for i, t in zip(ids[at:to], texts[at:to])], min_len)
            if size and size + total > BLOCK_BYTES:
                block, size = block + 1, 0
            size += total
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * (to - at), pa.int64()), b.column("row").slice(at, to - at),
                 pa.array(ids[at:to], pa.int64()), pa.array(texts[at:to], pa.binary()),
                 pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())],
                names=["block", "row", "id", "data", "run", "off"])
            at = to


class Block:
    """The anchored runs of a block's texts, in a fixed order."""

    def __init__(self, rows: pa.Table, min_len: int):
        order = np.argsort(rows.column("row").to_numpy(), kind="stable")
        rows = rows.take(pa.array(order))
        self.row = rows.column("row")
        self.id = rows.column("id")
        self.texts = rows.column("data").to_pylist()
        run = [np.frombuffer(x, np.uint8) for x in rows.column("run").to_pylist()]
        off = [np.frombuffer(x, np.uint8) for x in rows.column("off").to_pylist()]
        self.data = np.frombuffer(b"".join([*self.texts, bytes(min_len + 96)]), np.uint8)
        lengths = np.array([len(t) for t in self.texts], np.int64)
        self.begin = np.cumsum(lengths) - lengths
        self.of = np.repeat(np.arange(len(run)), [len(x) for x in run])
        self.run = np.concatenate(run).astype(np.int64) if run else np.empty(0, np.int64)
        self.off = np.concatenate(off).astype(np.int64) if off else np.empty(0, np.int64)
        before = np.cumsum(self.run) - self.run
        n_windows = np.bincount(self.of, weights=self.run, minlength=len(run)).astype(np.int64)
        shift = self.begin - (np.cumsum(n_windows) - n_windows)
        self.lo = before + shift[self.of]
        self.hash = gram_hashes(self.data, gram_words(min_len), self.lo + self.off) if len(self.lo) else \
            np.empty(0, np.uint64)
        ids = self.id.fill_null(0).to_numpy() if len(rows) else np.empty(0, np.int64)
        self.doc = ids[self.of]

    def sent(self, buckets: int):
        """(bucket, hashes) for the distinct anchor hashes, in order."""
        distinct = np.unique(self.hash)
        bucket = (distinct >> np.uint64(32)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[order])) + 1
        return [(int(bucket[x[0]]), distinct[x]) for x in np.split(order, cut) if len(x)]

    def records(self, live: dict[int, bytes], buckets: int, min_len: int):
        """Distinct (hash, snippet) among live anchors: (index of each occurrence, its record, records)."""
        alive = [h[np.unpackbits(np.frombuffer(live[b], np.uint8), count=len(h)).astype(bool)]
                 for b, h in self.sent(buckets) if b in live]
        keep = np.isin(self.hash, np.concatenate(alive)) if alive else np.zeros(len(self.hash), bool)
        order = np.lexsort((self.doc, self.hash))  # an anchor in two documents of the block is live too
        h, d = self.hash[order], self.doc[order]
        two = np.unique(h[1:][(h[1:] == h[:-1]) & (d[1:] != d[:-1])])
        at = np.flatnonzero(keep | np.isin(self.hash, two))
        size = self.run[at] - 1 + min_len
        one, two = snippet_hash(self.data, self.lo[at], size, self.off[at])
        order = np.lexsort((self.doc[at], two, one, self.hash[at]))
        key = np.stack([self.hash[at], one, two])[:, order]
        new = np.ones(len(order), bool)
        new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
        record = np.empty(len(order), np.int64)
        record[order] = np.cumsum(new) - 1
        return at, record, at[order[new]]  # the first of each record has its smallest id


def snippet_hash(data, lo, size, off):
    """Two hashes of each whole snippet together with its anchor's place."""
    eight = _loads(data)
    out = [off.astype(np.uint64) + np.uint64(1), off.astype(np.uint64) * np.uint64(3) + size.astype(np.uint64)]
    for w in range(-(-int(size.max(initial=0)) // 8)):
        left = np.clip(size - 8 * w, 0, 8)
        mask = np.where(left >= 8, np.uint64(2**64 - 1), (np.uint64(1) << (8 * np.minimum(left, 7)).astype(np.uint64)) - np.uint64(1))
        part = eight[np.minimum(lo + 8 * w, len(eight) - 1)] & mask
        mixed = mix64(out[0] * np.uint64(_ODD[w % 12]) + part), mix64(out[1] * np.uint64(_ODD[11 - w % 12]) ^ part)
        out = [np.where(left > 0, new, old) for new, old in zip(mixed, out)]  # whatever the longest here
    return out


def earlier_matches(data: np.ndarray, starts: np.ndarray, ids: np.ndarray, min_len: int) -> np.ndarray:
    """Whether the suffix at each start agrees in ``min_len`` bytes with one of a smaller id.

    Suffixes are sorted by their first ``min_len`` bytes. Where neighbours agree in all of them, the
    longest-previous-factor values reach ``min_len``: the longest earlier match of a suffix lies at the
    previous or the next smaller id in suffix order, and either exists inside the run of agreement if a
    smaller id comes before or after it there.
    """
    eight = np.ndarray((len(data) - 8,), ">u8", data, strides=(1,))
    words = [eight[starts + 8 * w].astype(np.uint64) for w in range(min_len // 8)]
    if min_len % 8:
        words.append(eight[starts + 8 * (min_len // 8)].astype(np.uint64) >> np.uint64(64 - 8 * (min_len % 8)))
    order = np.lexsort(words[::-1])
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = functools_or([w[order[1:]] != w[order[:-1]] for w in words])
    group = np.cumsum(new) - 1
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)[order]
    span = int(rank.max(initial=0)) + 1
    # one running minimum serves all runs: later runs start below every earlier value
    before = np.minimum.accumulate(rank - group * span) + group * span
    back = (group[-1] if len(group) else 0) - group
    after = (np.minimum.accumulate((rank - back * span)[::-1])[::-1]) + back * span
    out = np.empty(len(order), bool)
    out[order] = (before < rank) | (after < rank)
    return out


def functools_or(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def _live(rows: pa.Table) -> pa.Table:
    """Of one bucket: for each block, which of its hashes stand in another block too."""
    blocks, found = rows.column("block").to_pylist(), [np.frombuffer(x, "<u8") for x in rows.column("hashes").to_pylist()]
    every = np.sort(np.concatenate(found))
    shared = np.unique(every[1:][every[1:] == every[:-1]])
    masks = [np.packbits(np.isin(x, shared, assume_unique=True)).tobytes() for x in found]
    some = [k for k, m in enumerate(masks) if any(m)]
    return pa.table({"block": pa.array([blocks[k] for k in some], pa.int64()),
                     "bucket": pa.array([rows.column("bucket")[0].as_py()] * len(some), pa.int32()),
                     "mask": pa.array([masks[k] for k in some], pa.binary())})


def _match(rows: pa.Table, min_len: int) -> pa.Table:
    """Of one bucket: for each block's snippets, the mask of windows that start in a smaller id too."""
    parts = [np.frombuffer(x, "<u8") for x in rows.column("hashes").to_pylist()]
    take = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in rows.column(name).to_pylist()])
    h, ids, run, off = np.concatenate(parts), take("ids", "<i8"), take("run", np.uint8).astype(np.int64), take("off", np.uint8)
    data = np.frombuffer(b"".join([*rows.column("data").to_pylist(), bytes(min_len + 96)]), np.uint8)
    size = run - 1 + min_len
    lo = np.cumsum(size) - size
    one, two = snippet_hash(data, lo, size, off.astype(np.int64))
    order = np.lexsort((ids, two, one, h))
    key = np.stack([h, one, two])[:, order]
    new = np.ones(len(order), bool)
    new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
    kind_of = np.cumsum(new) - 1
    first = order[new]
    full = (np.uint32(1) << run.astype(np.uint32)) - np.uint32(1)
    mask = np.zeros(len(h), np.uint32)
    least = ids[first][kind_of]
    # where the whole snippet stands under a smaller id, all its windows do
    later = ids[order] > least
    mask[order[later]] = full[order[later]]
    # the earliest snippets of each kind are matched with the other kinds of their anchor
    anchor_new = np.ones(len(first), bool)
    anchor_new[1:] = h[first][1:] != h[first][:-1]
    anchor = np.cumsum(anchor_new) - 1
    several = np.bincount(anchor)[anchor] > 1
    reps, anchor = first[several], anchor[several]
    kind_mask = np.zeros(len(first), np.uint32)
    done = np.cumsum(run[reps])
    at = 0
    while at < len(reps):  # whole anchors at a time
        to = int(np.searchsorted(done, (done[at - 1] if at else 0) + SUFFIXES_AT_ONCE))
        to = len(reps) if to >= len(reps) else max(at + 1, to)
        while to < len(reps) and anchor[to] == anchor[to - 1]:
            to += 1
        some = reps[at:to]
        starts = ranges(lo[some], run[some])
        hit = earlier_matches(data, starts, np.repeat(ids[some], run[some]), min_len)
        bit = np.uint32(1) << (starts - np.repeat(lo[some], run[some])).astype(np.uint32)
        kind_mask[np.flatnonzero(several)[at:to]] = np.bitwise_or.reduceat(
            np.where(hit, bit, np.uint32(0)), np.cumsum(run[some]) - run[some])
        at = to
    equal = ~later
    mask[order[equal]] = kind_mask[kind_of[equal]]
    cut = np.cumsum([len(p) for p in parts])[:-1]
    masks = [m.astype("<u4").tobytes() for m in np.split(mask, cut)]
    return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"),
                     "mask": pa.array(masks, pa.binary())})


def _hashes(rows: pa.Table, min_len, buckets) -> pa.Table:
    sent = Block(rows, min_len).sent(buckets)
    return pa.table({"block": pa.array([rows.column("block")[0].as_py()] * len(sent), pa.int64()),
                     "bucket": pa.array([b for b, _ in sent], pa.int32()),
                     "hashes": pa.array([h.astype("<u8").tobytes() for _, h in sent], pa.binary())})


def _by_bucket(block: Block, first, buckets):
    bucket = (block.hash[first] >> np.uint64(32)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    return [x for x in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(x)], bucket


SNIPPETS = ("block long, bucket int, hashes binary, ids binary, run binary, off binary, data binary")


def _snippets(rows: pa.Table, live: pa.Table, min_len, buckets) -> pa.Table:
    out = {c.split()[0]: [] for c in SNIPPETS.split(", ")}
    if rows.num_rows and live.num_rows + rows.num_rows > 1:
        block = Block(rows, min_len)
        masks = dict(zip(live.column("bucket").to_pylist(), live.column("mask").to_pylist()))
        _, _, first = block.records(masks, buckets, min_len)
        groups, bucket = _by_bucket(block, first, buckets)
        for g in groups:
            at = first[g]
            size = block.run[at] - 1 + min_len
            out["block"].append(rows.column("block")[0].as_py())
            out["bucket"].append(int(bucket[g[0]]))
            out["hashes"].append(block.hash[at].astype("<u8").tobytes())
            out["ids"].append(block.doc[at].astype("<i8").tobytes())
            out["run"].append(block.run[at].astype(np.uint8).tobytes())
            out["off"].append(block.off[at].astype(np.uint8).tobytes())
            out["data"].append(block.data[ranges(block.lo[at], size)].tobytes())
    kinds = {"block": pa.int64(), "bucket": pa.int32()}
    return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()})


RESULT = "row long, id long, n_bytes long, spans array<struct<start: int, end: int>>, kept binary"


def _cut(rows: pa.Table, masks: pa.Table, min_len, buckets) -> pa.Table:
    block = Block(rows, min_len)
    by = {0: {}, 1: {}}
    for kind, b, m in zip(*(masks.column(c).to_pylist() for c in ("kind", "bucket", "mask"))):
        by[kind][b] = m
    at, record, first = block.records(by[0], buckets, min_len)
    mask = np.zeros(len(first), np.uint32)
    groups, bucket = _by_bucket(block, first, buckets)
    for g in groups:
        mask[g] = np.frombuffer(by[1][int(bucket[g[0]])], "<u4")
    run = block.run[at]
    full = (np.uint32(1) << run.astype(np.uint32)) - np.uint32(1)
    own = np.where(block.doc[at] > block.doc[first][record], full, mask[record]) if len(at) else mask[:0]
    starts = ranges(block.lo[at], run)
    hit = (np.repeat(own, run) >> (starts - np.repeat(block.lo[at], run)).astype(np.uint32)) & np.uint32(1)
    starts = starts[hit.astype(bool)]
    edge = np.zeros(len(block.data) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + min_len, -1)
    gone = np.cumsum(edge[:-1]) > 0
    out = {"n_bytes": [], "spans": [], "kept": []}
    for text, b in zip(block.texts, block.begin):
        here = gone[b:b + len(text)]
        s, e = runs(here)
        out["n_bytes"].append(len(text))
        out["spans"].append([{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist())])
        out["kept"].append(block.data[b:b + len(text)][~here].tobytes() if len(s) else text)
    return pa.table({"row": block.row, "id": block.id, "n_bytes": pa.array(out["n_bytes"], pa.int64()),
                     "spans": pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                     "kept": pa.array(out["kept"], pa.binary())})


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     min_len: int = MIN_LEN) -> DataFrame:
    """One row per input row: ``id_col``, n_bytes, spans (removed byte ranges) and kept (bytes)."""
    if not LENGTHS[0] <= min_len <= LENGTHS[1]:
        raise ValueError(f"min_len must lie in {LENGTHS}, not {min_len}")
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"llm_blocks_{uuid.uuid4().hex}"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("data"))
    (rows.mapInArrow(lambda it: _block_batches(it, min_len),
                     "block long, row long, id long, data binary, run binary, off binary")
     .write.option("path", new_path(spark, "blocks")).option("compression", "zstd")
     .bucketBy(buckets, "block").saveAsTable(name))
    blocks = spark.table(name)
    # more buckets of anchors than tasks, so that a task holds one of them at a time
    parts = buckets * 4

    hashes = blocks.select("block", "row", "id", "data", "run", "off").groupBy("block").applyInArrow(
        lambda t: _hashes(t, min_len, parts), "block long, bucket int, hashes binary")
    live = hashes.groupBy("bucket").applyInArrow(_live, "block long, bucket int, mask binary")
    live = _kept(live, "live")
    snippets = blocks.groupBy("block").cogroup(live.groupBy("block")).applyInArrow(
        lambda a, b: _snippets(a, b, min_len, parts), SNIPPETS)
    covered = _kept(snippets.groupBy("bucket").applyInArrow(
        lambda t: _match(t, min_len), "block long, bucket int, mask binary"), "covered")
    masks = live.withColumn("kind", F.lit(0)).unionByName(covered.withColumn("kind", F.lit(1)))
    done = blocks.groupBy("block").cogroup(masks.groupBy("block")).applyInArrow(
        lambda a, b: _cut(a, b, min_len, parts), RESULT)
    return done.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_bytes", "spans", "kept")


def _kept(df: DataFrame, name: str) -> DataFrame:
    from .common import materialise
    return materialise(df, name)


SQL = None


def query(spark, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"]))
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))
