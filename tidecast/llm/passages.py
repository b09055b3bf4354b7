"""Passage dedup: runs of ``MIN_RUN`` words that stand in an earlier place go, wherever they begin.

A word goes if a window of MIN_RUN words that covers it has its earliest place, in (doc_id, text hash, position)
order, in an earlier document, or at least MIN_RUN words before in the same one. Words are compared in lower
case and whatever blanks part them; neither lines, sentences nor their lengths matter. A word that goes takes
the blanks behind it along.

Each window picks as its anchor the leftmost of its grams (half a window long) with the smallest hash, so equal
windows pick equal anchors, and only windows whose anchor stands in two places can repeat. The anchors, about
one for 13 words, are sent and counted first; windows are then hashed (128 bits) only where an anchor is live,
and each digest is reduced to its earliest place (with map-side combining). No group is ever gathered.

Defined cases: a text under MIN_RUN words loses nothing; null and empty texts stay; a null doc_id ranks after
all others; rows equal in doc_id and text count as one document and get equal results; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lookup_skewed, materialise
from .kernels import runs, span_hash, trimmed

MIN_RUN = 50
WINDOWS_AT_ONCE = 100_000
_WORD, _GRAM, _ONE, _TWO = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5


def _solid(raw: np.ndarray) -> np.ndarray:
    return (raw != 32) & ((raw < 9) | (raw > 13))


def words_of(text: str):
    """(first byte of each word, hash of its lower case, all bytes)."""
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    low = np.frombuffer(text.lower().encode("utf-8"), np.uint8)  # the blanks, so the words too, are the same
    return runs(_solid(raw))[0], span_hash(low, *runs(_solid(low)), _WORD), raw


def anchors(words: np.ndarray, min_run: int):
    """(hash of each gram, the anchor's position for each window)."""
    size = min_run // 2 + 1
    spread = min_run - size + 1
    at = np.arange(len(words) - size + 1)
    grams = span_hash(words, at, at + size, _GRAM)
    view = np.lib.stride_tricks.sliding_window_view(grams, spread)
    picks = [view[k:k + WINDOWS_AT_ONCE].argmin(axis=1) for k in range(0, len(view), WINDOWS_AT_ONCE)]
    return grams, np.concatenate(picks) + np.arange(len(view))


def live_windows(words: np.ndarray, live, min_run: int):
    """(position, both hashes) of the windows with a live anchor."""
    grams, picks = anchors(words, min_run)
    at = np.flatnonzero(np.isin(grams[picks].view("<i8"), live))
    return at, span_hash(words, at, at + min_run, _ONE), span_hash(words, at, at + min_run, _TWO)


def cut_text(text: str, live, kept, min_run: int) -> str:
    """The text without the words of its windows that have an earlier place; ``kept`` are those that have none."""
    starts, words, raw = words_of(text)
    at, one, _ = live_windows(words, live, min_run)
    stays = np.isin(at, kept)
    first, place = one[stays], at[stays]
    order = np.argsort(first)
    first, place = first[order], place[order]
    if len(first):  # the earliest place is in this text, and too near to be another copy
        near = np.minimum(np.searchsorted(first, one), len(first) - 1)
        stays |= (first[near] == one) & (at - place[near] < min_run)
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, at[~stays], 1)
    np.add.at(gone, at[~stays] + min_run, -1)
    edges = np.append(starts, len(raw))
    parts, done = [], 0
    for s, e in zip(*runs(np.cumsum(gone[:-1]) > 0)):
        parts.append(raw[done:edges[s]].tobytes())
        done = edges[e]
    return b"".join([*parts, raw[done:].tobytes()]).decode("utf-8")


def _long(texts, min_run):
    """(row, word hashes) of the texts that have a window."""
    for row, text in enumerate(texts.to_pylist()):
        if text and len(text) >= 2 * min_run - 1:
            words = words_of(text)[1]
            if len(words) >= min_run:
                yield row, words


def _anchor_batches(batches, min_run):
    for b in batches:
        rows, found, times = [], [], []
        for row, words in _long(b.column("text"), min_run):
            grams, picks = anchors(words, min_run)
            values, count = np.unique(grams[np.unique(picks)], return_counts=True)
            rows.append(np.full(len(values), row)), found.append(values.view("<i8")), times.append(count)
        at, found, times = (pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64())
                            for x in (rows, found, times))
        yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("th").take(at), found, times],
                                         names=["id", "th", "anchor", "m"])


def _window_batches(batches, min_run):
    for b in batches:
        live = b.column("live").to_pylist()
        for row, words in _long(b.column("text"), min_run):
            at, one, two = live_windows(words, live[row], min_run)
            same = pa.array(np.full(len(at), row))
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(same), b.column("th").take(same), pa.array(at.astype(np.int32)),
                 pa.array(one.view("<i8")), pa.array(two.view("<i8"))], names=["id", "th", "at", "one", "two"])


def _cut_batches(batches, text_col, min_run):
    for b in batches:
        out = [text if not live else cut_text(text, live, kept or [], min_run) for text, live, kept in zip(
            *(b.column(c).to_pylist() for c in (text_col, "__live", "__kept")))]
        names = [c for c in b.schema.names if c not in ("__live", "__kept")]
        yield pa.RecordBatch.from_arrays(
            [pa.array(out, pa.string()) if c == text_col else b.column(c) for c in names], names=names)


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_run: int = MIN_RUN) -> DataFrame:
    """All rows and columns, ``text_col`` without the words of its repeated passages."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("th"),
                       F.col(f"`{text_col}`").alias("text"))
    found = materialise(rows.mapInArrow(lambda it: trimmed(_anchor_batches(it, min_run)),
                                        f"id {kind}, th long, anchor long, m long"), "anchors")
    total = found.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    facts = found.groupBy("anchor").agg(F.sum("m").alias("n")).where("n > 1")
    live = materialise(lookup_skewed(found, facts, "anchor", "n", total).where("n is not null").groupBy("id", "th").agg(
        F.collect_set("anchor").alias("live")), "live-anchors")
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["th"] == b["th"])
    windows = rows.join(live, same(rows, live)).select(rows["id"], rows["th"], "text", "live").mapInArrow(
        lambda it: trimmed(_window_batches(it, min_run)), f"id {kind}, th long, at int, one long, two long")
    first = windows.groupBy("one", "two").agg(F.min(F.struct(
        F.col("id").isNull().alias("last"), "id", "th", "at")).alias("f"))
    kept = first.groupBy("f.id", "f.th").agg(F.collect_list("f.at").alias("kept"))
    facts = materialise(live.join(kept, same(live, kept), "left").select(
        live["id"].alias("__id"), live["th"].alias("__h"), F.col("live").alias("__live"),
        F.col("kept").alias("__kept")), "passages")
    joined = docs.withColumn("__th", F.xxhash64(f"`{text_col}`")).join(
        facts, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__h")), "left")
    return joined.drop("__th", "__id", "__h").mapInArrow(
        lambda it: trimmed(_cut_batches(it, text_col, min_run)), T.StructType([docs.schema[c] for c in docs.columns]))
