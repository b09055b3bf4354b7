"""Periodic runs of words, found by block convolution.

A run is a stretch of words with smallest period q and at least ``max(MIN_WORDS, MIN_TIMES * q)`` words that
cannot be made longer on either side. Periods are searched scale by scale, B = 1, 2, 4, ...: those in
[B, 2B). A run with such a period holds an aligned block of B words in its first 2B - 1 words, and the same
words stand again q further on. So each aligned block is compared with all B places of the window that
follows it: the sums of squared differences of the words' codes are sums of squares less twice a correlation,
which a number-theoretic transform gives exactly. Sums can grow past one prime, so as many primes are used as
it takes for their product to pass the largest possible sum; a sum is then zero only if it is zero modulo each.

A zero at distance d is a seed: the stretch from the block on must repeat for 3d words. Seeds inside a run with
a smaller period are multiples of that period (the theorem of Fine and Wilf) and go; the others are extended on
both sides by binary search over hashes of spans, and every run found is checked word by word (should a hash
have misled, that scale's seeds are extended again without hashes).

Everything stays inside the row. Texts of a batch are laid end to end, so that blocks of many texts are
transformed at once; a block and its window never leave their text.

Defined cases: null and empty texts, and texts without a word, have no run and collapse to an empty text;
a very long text is a slice of its own, whose arrays grow with its words; equal rows get equal results;
added columns replace input columns of the same name; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, table
from .kernels import mix64, ranges

MIN_WORDS, MIN_TIMES = 6, 4
SLICE_WORDS = 100_000
CELLS = 1 << 17  # numbers transformed at once
ADDED = ("n_words", "runs", "collapsed")
# Primes k * 2**m + 1 below 2**31, each with a generator of its units.
PRIMES = ((2013265921, 31), (1811939329, 13), (469762049, 3))


class Transform:
    """Number-theoretic transforms of ``size`` numbers, down the columns of a (size, many) array."""

    def __init__(self, size: int, prime: int, generator: int):
        self.size, self.p = size, np.uint64(prime)
        self.there, self.back = {}, {}
        half = size // 2
        while half:
            root = pow(generator, (prime - 1) // (2 * half), prime)
            for out, r in ((self.there, root), (self.back, pow(root, -1, prime))):
                powers, step = np.ones(1, np.uint64), r
                while len(powers) < half:  # double the table of powers
                    powers = np.concatenate([powers, self.mod(powers * np.uint64(pow(r, len(powers), prime)))])
                out[half] = powers
            half //= 2

    def mod(self, x):
        return x - x // self.p * self.p

    def _once(self, x):
        """Of numbers below 2p: those from p on, less p (the others wrap to something larger)."""
        return np.minimum(x, x - self.p)

    def forward(self, a: np.ndarray) -> np.ndarray:
        many, half = a.shape[1], self.size // 2
        while half:
            v = a.reshape(-1, 2, half * many)
            x, y = v[:, 0], v[:, 1]
            turn = np.repeat(self.there[half], many)
            a = np.stack([self._once(x + y), self.mod((x + (self.p - y)) * turn)], axis=1)
            half //= 2
        return a.reshape(self.size, many)

    def inverse(self, a: np.ndarray) -> np.ndarray:
        """``size`` times the inverse; takes the order that ``forward`` leaves."""
        many, half = a.shape[1], 1
        while half < self.size:
            v = a.reshape(-1, 2, half * many)
            x, y = v[:, 0], self.mod(v[:, 1] * np.repeat(self.back[half], many))
            a = np.stack([self._once(x + y), self._once(x + (self.p - y))], axis=1)
            half *= 2
        return a.reshape(self.size, many)


_TRANSFORMS: dict[tuple, Transform] = {}


def transform(size: int, prime: tuple) -> Transform:
    if (size, prime) not in _TRANSFORMS:
        _TRANSFORMS[size, prime] = Transform(size, *prime)
    return _TRANSFORMS[size, prime]


def primes_for(largest: int) -> tuple:
    product = 1
    for k, (p, _) in enumerate(PRIMES):
        product *= p
        if product > largest:
            return PRIMES[:k + 1]
    raise ValueError(f"differences up to {largest} need more primes")


def zero_differences(codes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """(size, blocks): whether the block at ``at`` stands again ``size + row`` words further on.

    ``codes`` has ``3 * size`` numbers behind every block's first.
    """
    blocks = codes[at + np.arange(size)[:, None]]
    windows = codes[at + np.arange(size, 3 * size)[:, None]]
    windows[-1] = 0  # the window has 2 * size - 1 places
    squares = np.cumsum(np.concatenate([np.zeros((1, len(at)), np.int64), windows * windows]), axis=0)
    sums = (squares[size:2 * size] - squares[:size] + (blocks * blocks).sum(axis=0)).astype(np.uint64)
    turned = np.zeros_like(windows, dtype=np.uint64)
    turned[(-np.arange(size)) % (2 * size)] = blocks
    hit = np.ones((size, len(at)), bool)
    for prime in primes_for(size * int(codes.max(initial=0)) ** 2):
        t = transform(2 * size, prime)
        product = t.inverse(t.mod(t.forward(turned) * t.forward(windows.astype(np.uint64))))[:size]
        hit &= t.mod(t.mod(sums) * np.uint64(2 * size)) == t.mod(product * np.uint64(2))
    return hit


class Spans:
    """Hashes of spans of a sequence, each from one running sum."""

    BASE = 0x9E3779B97F4A7C15  # any odd number

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        powers = np.cumprod(np.full(n, self.BASE, np.uint64))
        self.back = np.cumprod(np.full(n + 1, pow(self.BASE, -1, 2**64), np.uint64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(codes.astype(np.uint64) + np.uint64(1)) * powers)])

    def same(self, a, b, size):
        one, two = ((self.sums[x + size] - self.sums[x]) * self.back[x] for x in (a, b))
        return one == two

    def agree(self, a, b, most, side: int):
        """How far the words behind (side 1) or before (side -1) a and b agree, at most ``most``."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            fine = self.same(a, b, mid) if side > 0 else self.same(a - mid, b - mid, mid)
            low, high = np.where(fine, mid, low), np.where(fine, high, mid - 1)
        return low


def misled(codes, first, last, begin, end, period) -> bool:
    """Whether a stretch, compared word by word, is not periodic or could be longer."""
    size = end - period - begin
    at = ranges(begin, size)
    wrong = (codes[at] != codes[at + np.repeat(period, size)]).any()
    wrong |= ((begin > first) & (codes[begin - 1] == codes[begin - 1 + period])).any()
    return bool(wrong | ((end < last) & (codes[np.minimum(end, len(codes) - 1)] == codes[end - period])).any())


def extended(codes, first, last, seed, period):
    """The stretches that repeat at ``period`` around the seeds, without hashes; empty where a seed is none."""
    begin, end = seed.copy(), seed.copy()
    for k in range(len(seed)):
        lo, hi, d, s = int(first[k]), int(last[k]), int(period[k]), int(seed[k])
        breaks = np.flatnonzero(codes[lo:hi - d] != codes[lo + d:hi]) + lo
        after = np.searchsorted(breaks, s)
        edge = int(breaks[after]) if after < len(breaks) else hi - d
        if edge >= s + 2 * d:
            begin[k], end[k] = breaks[after - 1] + 1 if after else lo, edge + d
    return begin, end


def find(codes: np.ndarray, sizes: np.ndarray):
    """(start, end, period) of the runs, by start and period, of texts laid end to end.

    ``codes`` are the words' numbers, counted within each text from 0; ``sizes`` the texts' numbers of words.
    """
    ends = np.cumsum(sizes)
    starts = ends - sizes
    found = [np.empty((3, 0), np.int64)]
    reach = np.zeros(len(codes) + 1, np.int64)  # the furthest end of the runs that begin at or before a word
    spans = Spans(codes)
    scale = 1
    while len(sizes) and sizes.max() >= max(MIN_WORDS, MIN_TIMES * scale):
        used = np.flatnonzero(sizes >= max(MIN_WORDS, MIN_TIMES * scale))
        count = sizes[used] // scale - 2
        text = np.repeat(used, count)
        at = starts[text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * scale
        step = max(1, CELLS // (2 * scale))
        seeds = []
        for s in range(0, len(at), step):
            zero = zero_differences(codes, at[s:s + step], scale)
            d, which = np.nonzero(zero)
            d, here, of = d + scale, at[s:s + step][which], text[s:s + step][which]
            fits = here + 3 * d <= ends[of]
            d, here, of = d[fits], here[fits], of[fits]
            fresh = reach[here] < here + 3 * d
            d, here, of = d[fresh], here[fresh], of[fresh]
            fine = spans.same(here, here + d, 2 * d)
            seeds.append(np.stack([d[fine], here[fine], of[fine]]))
        d, here, of = np.concatenate(seeds, axis=1)
        begin = here - spans.agree(here, here + d, here - starts[of], -1)
        end = here + d + spans.agree(here, here + d, ends[of] - here - d, 1)
        _, one = np.unique(np.stack([begin, d]), axis=1, return_index=True)
        if len(one) and misled(codes, starts[of[one]], ends[of[one]], begin[one], end[one], d[one]):
            begin, end = extended(codes, starts[of], ends[of], here, d)
        long = end - begin >= np.maximum(MIN_WORDS, MIN_TIMES * d)
        new = np.unique(np.stack([begin[long], end[long], d[long]]), axis=1)
        found.append(new)
        np.maximum.at(reach, new[0], new[1])
        reach = np.maximum.accumulate(reach)
        scale *= 2
    every = np.concatenate(found, axis=1)
    return every[:, np.lexsort([every[2], every[0]])]


def collapse(words: list[str], runs) -> str:
    """The words left when every run keeps its first period only, joined by one space."""
    if not len(runs[0]):
        return " ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[0] + runs[2], 1)
    np.add.at(gone, runs[1], -1)
    return " ".join([words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0)])


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _slices(texts):
    """(first row, past-the-last row, words of each text) of about SLICE_WORDS words."""
    word = re.compile(WORD)
    first, held, size = 0, [], 0
    for row, text in enumerate(texts):
        words = word.findall(text.as_py() or "")
        if held and size + len(words) > SLICE_WORDS:
            yield first, row, held
            first, held, size = row, [], 0
        held.append(words)
        size += len(words)
    if held:
        yield first, first + len(held), held


def _run_batches(batches, text_col):
    for b in batches:
        for first, to, texts in _slices(b.column(text_col)):
            sizes = np.array([len(w) for w in texts], np.int64)
            codes = np.empty(int(sizes.sum()), np.int64)
            done = 0
            for words in texts:
                known: dict[str, int] = {}
                codes[done:done + len(words)] = [known.setdefault(w, len(known)) for w in words]
                done += len(words)
            starts = np.cumsum(sizes) - sizes
            runs = find(codes, sizes)
            cut = np.searchsorted(runs[0], np.append(starts, done))
            short = [collapse(words, np.stack([runs[0, i:j] - s, runs[1, i:j] - s, runs[2, i:j]]))
                     for words, s, i, j in zip(texts, starts, cut[:-1], cut[1:])]
            base = np.repeat(starts, np.diff(cut))
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(runs[0] - base), pa.array(runs[1] - runs[0]), pa.array(runs[2])], fields=list(RUN)))
            part = b.slice(first, to - first)
            keep = [c for c in b.schema.names if c not in ADDED]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(sizes), lists, pa.array(short, pa.string())],
                                             names=[*keep, *ADDED])


def find_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns with ``n_words``, ``runs`` (start, length, period; by start, then period) and
    ``collapsed``, the text in which every run keeps its first period only."""
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    keep = [f for f in docs.schema if f.name not in ADDED]
    return docs.mapInArrow(lambda it: _run_batches(it, text_col), T.StructType([
        *keep, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)),
        T.StructField("collapsed", T.StringType())]))


PLANT_STEP = 10


def planted(docs: DataFrame) -> DataFrame:
    """Every tenth text, by its id's hash, made periodic from one of its words on; a null id leaves it as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    hit = F.col("doc_id").isNotNull() & (h % PLANT_STEP == 0)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    cut = docs.select("doc_id", "text", F.when(hit, words).alias("w"), F.floor(h / PLANT_STEP).alias("g"))
    n = F.size("w")
    cut = cut.withColumn("a", F.when(n > 0, (F.col("g") % F.greatest(n, F.lit(1))).cast("int")))
    cut = cut.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)).cast("int"))
    times = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times))
    made = F.array_join(F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), again), F.lit(1), F.greatest(n, F.lit(0))), " ")
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    found = find_runs(planted(table(spark, sf_dir, "documents")))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda a, x: F.when(
        a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"]), x).otherwise(a))
    line = F.array_join(F.transform("runs", lambda x: F.concat(
        F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(line, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
            "doc_id", "n_runs", "best.start", "best.length", "best.period",
            F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
