"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A text is its words in lower-cased ASCII, one blank between them and a line end behind: the same tokens that the
word counts beside it use. Each byte is eight binary decisions; a decision is made in the context of the bytes
before it, at each depth from 0 to ``DEPTH``, and every context has its Krichevsky-Trofimov estimate. At each
context the tree weighs one half for stopping there and one half for going one byte deeper, and the weights
that training leaves are those of the exact Bayesian mixture over all context trees. The score of a text is the
log10 probability that the trained mixture gives its bytes; ``bits_per_byte`` is its code length.

What training gathers are the counts of all distinct (``DEPTH`` + 1)-grams of bytes, with no hashing or cap, and
of all distinct words, and they grow with the corpus:

1. Tasks pack their texts into chunks of about ``CHUNK_BYTES`` and write them once, compressed. For each chunk the
   distinct grams and words are written as packed rows, one for each group: the grams behind one three-byte
   context, the words of one hash. Such rows are hundreds of times fewer than the words.
2. Packed rows are sorted by group and merged as they stream by, so a task holds one group's distinct items and no
   more; past ``MERGE_CHUNKS`` chunks they are merged in two steps, so that no group is one long stream. The tree is
   climbed in three parts: inside each three-byte context (at most 256 ** 3 grams by the alphabet), from there to
   the one-byte contexts, and from those, 256 rows at most, to the top. The mixture's weights go down the same way.
3. The model's packed rows and the chunks' are sorted into one stream by group, the model's first, so a task
   holds one group's model and answers the chunks' rows one after the other. The answers go back to their chunk,
   where the texts are summed up. No model is broadcast, and no key gathers more than a chunk.

Defined cases: null and empty texts have the end as their only token; with nothing to learn from, every bit
costs one bit and every token of the base 0; a null id is scored like any other; equal rows get equal results; a text
longer than a chunk is a chunk of its own; extra columns are left behind, so none can clash; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket_of, materialise, table

DEPTH = 5
GROUP_DEPTH = 3  # contexts of so many bytes share a packed row
END = b"\n"
CHUNK_BYTES = 16_000_000
SLICE_BYTES = 4_000_000
WORD_GROUPS = 4096
MERGE_CHUNKS = 4096
GRAM, WORD = 0, 1
SUFFIX = np.int64(256 ** (DEPTH + 1 - GROUP_DEPTH))
LOG2, LOG_PI = math.log(2), math.log(math.pi)


# ---- chunks

def _chunk_batches(batches, kind):
    """Texts as chunk rows: ids, whether each is learned from, tokens, bytes, and all bytes, ends before each text."""
    part, made, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

    def row():
        ids, train, tokens, data = zip(*held)
        packed = zstandard.ZstdCompressor(level=3).compress(END * DEPTH + (END * DEPTH).join(data))
        return pa.RecordBatch.from_arrays(
            [pa.array([part + made], pa.int64()), pa.array([list(ids)], pa.list_(kind)), pa.array([list(train)]),
             pa.array([list(tokens)], pa.list_(pa.int32())), pa.array([[len(x) for x in data]], pa.list_(pa.int32())),
             pa.array([packed], pa.binary())], names=["chunk", "ids", "train", "tokens", "sizes", "data"])

    for b in batches:
        for id_, train, text in zip(b.column("id").to_pylist(), b.column("train").to_pylist(), b.column("text")):
            words = text.as_py().lower().split()  # bytes: lower() and split() know ASCII only, its six blanks too
            data = b" ".join(words) + END
            if held and size + len(data) > CHUNK_BYTES:
                yield row()
                made, held, size = made + 1, [], 0
            held.append((id_, train, len(words) + 1, data))
            size += len(data)
    if held:
        yield row()


def chunks(docs: DataFrame, train: Column, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(train, F.lit(False)).alias("train"),
                       F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text"))
    kind = rows.schema["id"].dataType
    arrow = pa.int32() if kind == T.IntegerType() else pa.string() if kind == T.StringType() else pa.int64()
    out = rows.mapInArrow(lambda it: _chunk_batches(it, arrow), (
        f"chunk long, ids array<{kind.simpleString()}>, train array<boolean>, tokens array<int>, sizes array<int>, data binary"))
    return materialise(out, "ctw-chunks")


class Chunk:
    """One chunk's texts, with its distinct grams and words and where they stand."""

    def __init__(self, sizes, tokens, data: bytes):
        self.sizes, self.tokens = np.array(sizes, np.int64), np.array(tokens, np.int64) - 1
        data = zstandard.ZstdDecompressor().decompress(data)
        ends = np.cumsum(self.sizes + DEPTH)
        known: dict[bytes, int] = {}
        self.parts, own, at = [], [], 0
        while at < len(self.sizes):
            begin = int(ends[at] - self.sizes[at]) - DEPTH
            to = max(at + 1, int(np.searchsorted(ends, begin + SLICE_BYTES, "right")))
            piece = data[begin:int(ends[to - 1])]
            inverse, distinct = pd.factorize(self.codes(piece))
            words = np.array([known.setdefault(w, len(known)) for w in piece.split()], np.int32)
            self.parts.append((at, to, inverse.astype(np.int32), words))
            own.append(distinct)
            at = to
        which, every = pd.factorize(np.concatenate(own))  # the slices' grams as one list, and in order
        order = np.argsort(every)
        self.grams, place = every[order], np.empty(len(every), np.int32)
        place[order] = np.arange(len(every), dtype=np.int32)
        cut = np.cumsum([0, *map(len, own)])
        self.parts = [(at, to, place[which[i:j]][inv], words)
                      for (at, to, inv, words), i, j in zip(self.parts, cut[:-1], cut[1:])]
        self.words = list(known)
        group = np.array([zlib.crc32(w) % WORD_GROUPS for w in known], np.int64)
        self.word_order = np.argsort(group, kind="stable")
        self.word_groups = group[self.word_order]

    @staticmethod
    def codes(piece: bytes) -> np.ndarray:
        """The code of each byte but the first DEPTH, with the DEPTH bytes before it: the nearest is the code's
        highest byte, and the byte itself its lowest."""
        padded = np.zeros(len(piece) + 8 - DEPTH, np.uint8)
        padded[:len(piece)] = np.frombuffer(piece, np.uint8)
        eight = np.ndarray((len(piece) - DEPTH,), "<u8", buffer=np.append(padded, np.zeros(DEPTH, np.uint8)), strides=(1,))
        code = eight & np.uint64(256 ** DEPTH - 1)
        code <<= np.uint64(8)
        code |= (eight >> np.uint64(8 * DEPTH)) & np.uint64(255)
        return code.view(np.int64)

    def spans(self, at, to):
        """(first, past-the-last) code of each text of a slice."""
        end = np.cumsum(self.sizes[at:to] + DEPTH) - DEPTH
        return end - self.sizes[at:to], end

    def text_sums(self, by_gram, by_word):
        """For each text the sum over its bytes of a value of their grams, and over its words."""
        grams, words = np.empty(len(self.sizes)), np.empty(len(self.sizes))
        for at, to, which, ids in self.parts:
            edges = np.stack(self.spans(at, to), axis=1).ravel()[:-1]
            grams[at:to] = np.add.reduceat(by_gram[which], edges)[::2]
            run = np.concatenate([[0.0], np.cumsum(by_word[ids])])
            end = np.cumsum(self.tokens[at:to])
            words[at:to] = run[end] - run[end - self.tokens[at:to]]
        return grams, words

    def counts(self, train):
        """How often each gram and each word stands in the texts marked."""
        grams, words = np.zeros(len(self.grams), np.int64), np.zeros(len(self.words), np.int64)
        for at, to, which, ids in self.parts:
            mark = np.zeros(len(which) + 1, np.int8)
            first, end = self.spans(at, to)
            mark[first[train[at:to]]] = 1
            mark[end[train[at:to]]] = -1
            grams += np.bincount(which[np.cumsum(mark[:-1], dtype=np.int8) > 0], minlength=len(grams))
            words += np.bincount(ids[np.repeat(train[at:to], self.tokens[at:to])], minlength=len(words))
        return grams, words


def planes(x: np.ndarray, kind: str) -> bytes:
    """Numbers byte by byte, all first bytes first: the high ones, mostly zero, then compress to nothing."""
    return np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T).tobytes()


def from_planes(b: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def group_cuts(keys: np.ndarray) -> np.ndarray:
    """Where the groups of ascending keys begin, and the end."""
    return np.append(np.flatnonzero(np.diff(keys, prepend=-1)), len(keys))


PACKED = "chunk long, kind int, key int, items binary, counts binary"


def _pack_batches(batches):
    for b in batches:
        for row in range(b.num_rows):
            chunk, train, tokens, sizes, data = (b.column(c)[row].as_py() for c in ("chunk", "train", "tokens", "sizes", "data"))
            held = Chunk(sizes, tokens, data)
            by_gram, by_word = held.counts(np.array(train, bool))
            key = held.grams // SUFFIX
            cuts = group_cuts(key)
            kinds, keys = [GRAM] * (len(cuts) - 1), key[cuts[:-1]].tolist()
            items = [planes(held.grams[i:j] % SUFFIX, "<u4") for i, j in zip(cuts[:-1], cuts[1:])]
            counts = [planes(by_gram[i:j], "<i8") for i, j in zip(cuts[:-1], cuts[1:])]
            cuts = group_cuts(held.word_groups)
            kinds += [WORD] * (len(cuts) - 1)
            keys += held.word_groups[cuts[:-1]].tolist()
            for i, j in zip(cuts[:-1], cuts[1:]):
                some = held.word_order[i:j]
                items.append(b" ".join([held.words[w] for w in some]))
                counts.append(planes(by_word[some], "<i8"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * len(keys), pa.int64()), pa.array(kinds, pa.int32()), pa.array(keys, pa.int32()),
                 pa.array(items, pa.binary()), pa.array(counts, pa.binary())], names=["chunk", "kind", "key", "items", "counts"])


def _merge_batches(batches):
    """A stream of packed rows by (kind, key): each group's rows become one."""
    now, held, waiting = None, {}, []

    def fold():
        """The grams waiting and those held, as one sorted list with its sums."""
        items, which = np.unique(np.concatenate([x[0] for x in waiting]), return_inverse=True)
        waiting[:] = [(items, np.bincount(which, weights=np.concatenate([x[1] for x in waiting])).astype(np.int64))]

    def row():
        if now[0] == GRAM:
            fold()
            return (*now, planes(waiting[0][0], "<u4"), planes(waiting[0][1], "<i8"))
        return (*now, b" ".join(held), planes(np.array(list(held.values()), np.int64), "<i8"))

    out = []

    def batch():
        kind, key, items, counts = zip(*out) if out else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.int32()), pa.array(items, pa.binary()),
                                           pa.array(counts, pa.binary())], names=["kind", "key", "items", "counts"])

    for b in batches:
        for kind, key, items, counts in zip(*(b.column(c).to_pylist() for c in ("kind", "key", "items", "counts"))):
            if now != (kind, key):
                if now is not None:
                    out.append(row())
                now, held, waiting = (kind, key), {}, []
            counts = from_planes(counts, "<i8")
            if kind == GRAM:
                waiting.append((from_planes(items, "<u4"), counts))
                if sum(len(x[0]) for x in waiting[1:]) > 1_000_000 + len(waiting[0][0]):
                    fold()
            else:
                for w, n in zip(items.split(), counts.tolist()):
                    held[w] = held.get(w, 0) + n
        yield batch()
        out.clear()
    if now is not None:
        out.append(row())
    yield batch()


def merged(rows: DataFrame, n_chunks: int) -> DataFrame:
    """(kind, key, items, counts): one row for each group."""
    kind = "kind int, key int, items binary, counts binary"
    if n_chunks > MERGE_CHUNKS:
        rows = rows.withColumn("part", F.pmod("chunk", F.lit(math.ceil(n_chunks / MERGE_CHUNKS))))
        rows = rows.repartition("kind", "key", "part").sortWithinPartitions("kind", "key", "part").drop("part").mapInArrow(_merge_batches, kind)
    return materialise(rows.repartition("kind", "key").sortWithinPartitions("kind", "key").drop("chunk").mapInArrow(_merge_batches, kind), "ctw-counts")


# ---- the tree

def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of numbers of at least one half: Stirling's series from 16 on, reached by recurrence."""
    x = np.asarray(x, np.float64)
    shift, y = np.zeros_like(x), x.copy()
    for _ in range(16):
        low = y < 16
        if not low.any():
            break
        shift[low] += np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def log_kt(n0, n1):
    """The log probability that the estimator gives to n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - LOG_PI


class Level:
    """The binary nodes of the contexts of one depth: key = context * 256 + node, in order."""

    def __init__(self, keys, n0, n1, below=None, leaf=True, weight=None):
        self.keys, self.n0, self.n1, self.leaf, self.up = keys, n0, n1, leaf, None
        if weight is not None:  # made elsewhere
            self.weight = weight
            return
        self.stop = log_kt(n0, n1)
        self.below = below
        self.weight = self.stop if leaf else np.logaddexp(self.stop, below) - LOG2

    def climb(self) -> "Level":
        """The level above; this one learns which of its nodes each of ours hangs from."""
        keys, self.up = np.unique(self.keys >> 16 << 8 | self.keys & 255, return_inverse=True)
        add = lambda x: np.bincount(self.up, weights=x, minlength=len(keys))
        return Level(keys, add(self.n0), add(self.n1), add(self.weight), leaf=False)

    def descend(self, above):
        """The state (probability of 0, of 1, and the weight still open) from that of the nodes above."""
        p0, p1, rest = above
        total = self.n0 + self.n1 + 1
        stay = np.ones(len(self.keys)) if self.leaf else np.exp(self.stop - LOG2 - self.weight)
        go = np.zeros(len(self.keys)) if self.leaf else np.exp(self.below - LOG2 - self.weight)
        return p0 + rest * stay * (self.n0 + 0.5) / total, p1 + rest * stay * (self.n1 + 0.5) / total, rest * go


def leaves(codes: np.ndarray, counts: np.ndarray):
    """(the deepest level, the node of each gram's eight decisions, their bits), from distinct grams."""
    byte, context = codes & 255, codes >> 8
    bit = np.arange(8)[:, None]
    node, ones = (1 << bit) | byte >> (8 - bit), byte >> (7 - bit) & 1
    keys, which = np.unique((context << 8 | node).ravel(), return_inverse=True)
    which = which.reshape(8, -1)
    n1 = np.bincount(which.ravel(), weights=(ones * counts).ravel(), minlength=len(keys))
    n0 = np.bincount(which.ravel(), weights=((1 - ones) * counts).ravel(), minlength=len(keys))
    return Level(keys, n0, n1), which, ones


def climbed(level: Level, steps: int) -> list[Level]:
    out = [level]
    for _ in range(steps):
        out.append(out[-1].climb())
    return out


def gram_logs(levels: list[Level], which, ones, above):
    """log10 probability of each gram's byte; ``above`` is the state over the top level's nodes."""
    state = levels[-1].descend(above)
    for level in levels[-2::-1]:
        state = level.descend([x[level.up] for x in state])
    return np.log10(np.where(ones, state[1][which], state[0][which])).sum(axis=0)


NODES = "nodes binary, n0 binary, n1 binary, weight binary"


def _level_columns(level: Level, cuts):
    """One list entry for each slice of the level's nodes."""
    each = lambda x, kind: pa.array([x[a:b].astype(kind).tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
    return [each(level.keys & 255, "u1"), each(level.n0, "<f8"), each(level.n1, "<f8"), each(level.weight, "<f8")]


def _grams_of(b):
    """(codes, counts, size of each row) of a batch of packed groups."""
    items = [from_planes(x, "<u4").astype(np.int64) for x in b.column("items").to_pylist()]
    size = np.array([len(x) for x in items], np.int64)
    codes = np.repeat(np.asarray(b.column("key")).astype(np.int64), size) * SUFFIX + np.concatenate([*items, np.empty(0, np.int64)])
    counts = np.concatenate([*(from_planes(x, "<i8") for x in b.column("counts").to_pylist()), np.empty(0, np.int64)])
    return codes, counts, size


def _group_batches(batches):
    """The level of GROUP_DEPTH of each packed group."""
    for b in batches:
        codes, counts, _ = _grams_of(b)
        top = climbed(leaves(codes, counts)[0], DEPTH - GROUP_DEPTH)[-1]
        context = top.keys >> 8
        cuts = group_cuts(context)
        yield pa.RecordBatch.from_arrays([pa.array(context[cuts[:-1]].astype(np.int32)), *_level_columns(top, cuts)],
                                         names=["key", "nodes", "n0", "n1", "weight"])


def _level_of(rows: pa.Table, key: str) -> Level:
    """The level that rows of (key, nodes, n0, n1, weight) hold, and the order of its nodes by key."""
    order = np.argsort(np.asarray(rows.column(key)), kind="stable")
    rows = rows.take(pa.array(order))
    column = lambda c, kind: np.frombuffer(b"".join(rows.column(c).to_pylist()), kind)
    size = [len(x) for x in rows.column("nodes").to_pylist()]
    keys = np.repeat(np.asarray(rows.column(key)).astype(np.int64), size) << 8 | column("nodes", "u1").astype(np.int64)
    return Level(keys, column("n0", "<f8"), column("n1", "<f8"), weight=column("weight", "<f8"))


def _top_groups(rows: pa.Table) -> pa.Table:
    """All groups behind one nearest byte, as that byte's level."""
    top = climbed(_level_of(rows, "key"), GROUP_DEPTH - 1)[-1]
    return pa.table([pa.array([int(top.keys[0]) >> 8], pa.int32()), *_level_columns(top, [0, len(top.keys)])],
                    names=["byte", "nodes", "n0", "n1", "weight"])


def _state_groups(rows: pa.Table, root) -> pa.Table:
    """The state above each group's own level, for one nearest byte."""
    levels = climbed(_level_of(rows, "key"), GROUP_DEPTH - 1)
    top = levels[-1]
    state = top.descend([x[top.keys & 255] for x in root])
    for level in levels[-2:0:-1]:
        state = level.descend([x[level.up] for x in state])
    state = [x[levels[0].up] for x in state]
    context = levels[0].keys >> 8
    cuts = group_cuts(context)
    each = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
    return pa.table([pa.array(context[cuts[:-1]].astype(np.int32)), *map(each, state)], names=["key", "p0", "p1", "rest"])


def root_state(tops: list) -> list[np.ndarray]:
    """The state below the empty context, for all 256 nodes, from the levels of the single bytes (256 at most)."""
    state = [np.full(256, 0.25), np.full(256, 0.25), np.full(256, 0.5)]  # a node never met: one half goes deeper
    if tops:
        rows = pa.table({c: [r[c] for r in tops] for c in ("byte", "nodes", "n0", "n1", "weight")})
        top = _level_of(rows, "byte").climb()
        known = top.descend((0.0, 0.0, 1.0))
        for s, x in zip(state, known):
            s[top.keys & 255] = x
    return state


def _model_batches(batches):
    """Packed groups with the state above them -> their grams and log10 probabilities."""
    for b in batches:
        codes, counts, size = _grams_of(b)
        deepest, which, ones = leaves(codes, counts)
        levels = climbed(deepest, DEPTH - GROUP_DEPTH)
        order = np.argsort(np.asarray(b.column("key")), kind="stable")  # levels are in order of key
        state = [np.frombuffer(b"".join(b.column(c).take(pa.array(order)).to_pylist()), "<f8") for c in ("p0", "p1", "rest")]
        logs = gram_logs(levels, which, ones, state)
        cuts = np.concatenate([[0], np.cumsum(size)])
        values = pa.array([logs[i:j].astype("<f8").tobytes() for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("items"), values], names=["key", "items", "values"])


# ---- answers

def _answer_batches(batches):
    """A stream by (kind, key, chunk): the model's row of a group comes first and answers the chunks' rows."""
    held, suffixes, values, known = None, None, None, {}
    for b in batches:
        out = []
        columns = (b.column(c).to_pylist() for c in ("chunk", "kind", "key", "items", "values"))
        for chunk, kind, key, items, given in zip(*columns):
            if chunk < 0:
                held = (kind, key)
                if kind == GRAM:
                    suffixes, values = from_planes(items, "<u4"), np.frombuffer(given, "<f8")
                else:
                    known = dict(zip(items.split(), from_planes(given, "<i8").tolist()))
                continue
            if held != (kind, key):
                raise ValueError(f"no model row for group {kind}, {key}")
            if kind == GRAM:
                got = values[np.searchsorted(suffixes, from_planes(items, "<u4"))].tobytes()
            else:
                got = planes(np.array([known[w] for w in items.split()], np.int64), "<i8")
            out.append((chunk, kind, key, got))
        chunk, kind, key, got = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(kind, pa.int32()), pa.array(key, pa.int32()),
                                          pa.array(got, pa.binary())], names=["chunk", "kind", "key", "values"])


def _score_chunk(rows: pa.Table, answers: pa.Table, total: int, distinct: int, ends: int, out: pa.Schema) -> pa.Table:
    """The texts of one chunk, from its groups' answers."""
    parts = []
    for row in range(rows.num_rows):
        ids, train, tokens, sizes, data = (rows.column(c)[row].as_py() for c in ("ids", "train", "tokens", "sizes", "data"))
        held = Chunk(sizes, tokens, data)
        kinds, keys = (np.asarray(answers.column(c)) for c in ("kind", "key"))
        order, cut = np.lexsort([keys, kinds]), int((kinds == GRAM).sum())
        values = answers.column("values").take(pa.array(order)).to_pylist()
        logs = np.frombuffer(b"".join(values[:cut]), "<f8")
        counts = np.empty(len(held.words), np.int64)
        counts[held.word_order] = np.concatenate([*(from_planes(x, "<i8") for x in values[cut:]), np.empty(0, np.int64)])
        scale = total + 0.5 * (distinct + 1)
        score, base = held.text_sums(logs, np.log10((counts + 0.5) / scale))
        met = held.text_sums(np.zeros(len(logs)), (counts > 0).astype(np.float64))[1].astype(np.int64) + (ends > 0)
        base += math.log10((ends + 0.5) / scale)
        n = len(held.sizes)
        parts.append(pa.table([pa.array(ids, out.field(0).type), pa.array(train), pa.array(tokens, pa.int64()), pa.array(met, pa.int64()),
                               pa.array(np.full(n, total, np.int64)), pa.array(base, pa.float64()), pa.array(score), pa.array(held.sizes),
                               pa.array(-score / math.log10(2) / held.sizes)], schema=out))
    return pa.concat_tables(parts) if parts else out.empty_table()


def _word_sums(batches):
    for b in batches:
        counts = np.concatenate([np.empty(0, np.int64), *(from_planes(x, "<i8") for x in b.column("counts").to_pylist())])
        yield pa.RecordBatch.from_arrays([pa.array([int(counts.sum())]), pa.array([int((counts > 0).sum())])], names=["n", "v"])


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row; ``train``
    marks the rows to learn from."""
    packs = chunks(docs, train, id_col, text_col)
    rows = materialise(packs.select("chunk", "train", "tokens", "sizes", "data").mapInArrow(_pack_batches, PACKED), "ctw-packed")
    counted = merged(rows, packs.count())
    model, seen = counted.where(F.col("kind") == GRAM).drop("kind"), counted.where(F.col("kind") == WORD)

    groups = materialise(model.repartition("key").sortWithinPartitions("key").mapInArrow(_group_batches, f"key int, {NODES}"), "ctw-groups")
    byte = F.floor(F.col("key") / 256 ** (GROUP_DEPTH - 1)).cast("int")
    tops = groups.groupBy(byte.alias("byte")).applyInArrow(_top_groups, f"byte int, {NODES}").collect()  # at most 256 rows
    root = root_state(tops)
    states = groups.groupBy(byte.alias("byte")).applyInArrow(lambda t: _state_groups(t, root), "key int, p0 binary, p1 binary, rest binary")
    logs = model.join(states, "key").mapInArrow(_model_batches, "key int, items binary, values binary")

    ends = packs.select(F.sum(F.size(F.filter("train", lambda x: x)))).first()[0] or 0
    sums = seen.select("counts").mapInArrow(_word_sums, "n long, v long").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    total, distinct = (sums["n"] or 0) + ends, (sums["v"] or 0) + (ends > 0)

    none = F.lit(-1).cast("long").alias("chunk")
    known = logs.select(none, F.lit(GRAM).alias("kind"), "key", "items", "values").unionByName(
        seen.select(none, "kind", "key", "items", F.col("counts").alias("values")))
    asked = rows.select("chunk", "kind", "key", "items", F.lit(None).cast("binary").alias("values"))
    answers = known.unionByName(asked).repartition("kind", "key").sortWithinPartitions("kind", "key", "chunk").mapInArrow(
        _answer_batches, "chunk long, kind int, key int, values binary")
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("train", T.BooleanType()),
        *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")],
        *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")], T.StructField("n_bytes", T.LongType()),
        T.StructField("bits_per_byte", T.DoubleType())])
    kinds = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_(), T.IntegerType(): pa.int32(),
             T.StringType(): pa.string()}
    out = pa.schema([(f.name, kinds[f.dataType]) for f in schema])
    return packs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        lambda a, b: _score_chunk(a, b, total, distinct, ends, out), schema)


HELD_OUT, STEP = 1, 5


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_texts(docs, bucket_of("doc_id", STEP) != HELD_OUT)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
                        "n_bytes", "bits_per_byte")
