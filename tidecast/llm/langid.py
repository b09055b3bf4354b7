"""Language identification as inference of a mixture of languages.

Training counts byte trigrams (lower-cased ASCII, other ASCII than letters as one blank) per language over
all training texts, hashed into ``BUCKETS`` buckets; each language's smoothed counts are its trigram
distribution. A text is taken as a mixture of languages: expectation-maximisation finds the proportions
that make its trigrams likeliest. The set of languages is selected by penalised likelihood: languages
leave, the smallest proportion first, while leaving costs less log-likelihood than the penalty that each
language's proportion carries. The prediction is the largest proportion, and the score is that proportion.

Defined cases: a null text, an empty one and one without a letter give ``und`` with score 0; with nothing
to learn from, every text gives ``und``; equal proportions go to the language that sorts first; repeated
rows get equal results; columns named like the added ones are replaced; an empty table gives an empty
result. Texts are read whole, a slice of the batch at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket_of, table
from .kernels import slices

BUCKETS = 1 << 14
PART = 1 << 11
SLICE_BYTES = 1_000_000
EM_STEPS = 12
PENALTY = 1.0  # times the log of the number of trigrams, for each language in the set
SMOOTHING = 0.5


def _byte_map() -> np.ndarray:
    out = np.full(256, 32, np.uint8)
    for b in range(ord("a"), ord("z") + 1):
        out[b] = out[b - 32] = b
    out[128:] = np.arange(128, 256)
    return out


def trigrams(data: list[bytes]):
    """(text of each trigram, its bucket) for all texts laid end to end, two blanks between them."""
    raw = _byte_map()[np.frombuffer(b"  ".join([b"", *data, b""]), np.uint8)].astype(np.uint32)
    code = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:])
    text_of = np.repeat(np.arange(len(data)), [len(d) + 2 for d in data])[:len(code)]
    used = code != 0x202020
    bucket = (code * np.uint32(2654435769)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    return text_of[used], bucket[used].astype(np.int64)


def _count_batches(batches):
    """One row for each language and part of the buckets that a task has met."""
    total: dict[str, np.ndarray] = {}
    for b in batches:
        langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
        for at, to, data in slices(texts, SLICE_BYTES):
            text_of, bucket = trigrams(data)
            own = sorted(set(langs[at:to]))
            code = np.array([own.index(x) for x in langs[at:to]], np.int64)[text_of]
            counts = np.bincount(code * BUCKETS + bucket, minlength=len(own) * BUCKETS).reshape(len(own), BUCKETS)
            for lang, c in zip(own, counts):
                total[lang] = total.get(lang, 0) + c
    rows = [(lang, k, c[k * PART:(k + 1) * PART].astype("<f8").tobytes())
            for lang, c in total.items() for k in range(BUCKETS // PART) if c[k * PART:(k + 1) * PART].any()]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()),
         pa.array([r[2] for r in rows], pa.binary())], names=["lang", "part", "counts"])


def _sum_batches(batches):
    total = {}
    for b in batches:
        for lang, part, counts in zip(*(b.column(c).to_pylist() for c in ("lang", "part", "counts"))):
            total[lang, part] = total.get((lang, part), 0) + np.frombuffer(counts, "<f8")
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int32()),
         pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["lang", "part", "counts"])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang"):
    """(languages, log-probabilities by bucket and language) from all rows with a language.

    The result is a table of BUCKETS numbers a language; the sums are made by Spark, by (language, part).
    """
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where(
        "lang is not null and text is not null")
    schema = "lang string, part int, counts binary"
    # a task's rows of a key are summed before the shuffle; after it a key has one row a task
    counts = rows.mapInArrow(_count_batches, schema).repartition("lang", "part").mapInArrow(_sum_batches, schema)
    found: dict[str, np.ndarray] = {}
    for r in counts.collect():
        found.setdefault(r["lang"], np.zeros(BUCKETS))[r["part"] * PART:(r["part"] + 1) * PART] += np.frombuffer(
            r["counts"], "<f8")
    langs = sorted(found)
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32)
    seen = np.stack([found[x] for x in langs], axis=1) + SMOOTHING
    return langs, np.log(seen / seen.sum(axis=0))


def mixtures(counts: np.ndarray, rows: np.ndarray, text_of: np.ndarray, n_texts: int):
    """Proportions of the languages in each text, after selection.

    ``counts`` and ``rows`` (log-probabilities) are by distinct (text, bucket), ordered by text.
    """
    n_langs = rows.shape[1]
    first = np.searchsorted(text_of, np.arange(n_texts))
    peak = rows.max(axis=1)
    like = np.exp(rows - peak[:, None])
    size = np.add.reduceat(counts, first)

    def climb(start, within):
        share = start * within
        share /= share.sum(axis=1, keepdims=True)
        for _ in range(EM_STEPS):
            each = like * share[text_of]
            total = each.sum(axis=1)
            each *= (counts / total)[:, None]
            share = np.add.reduceat(each, first, axis=0) / size[:, None]
            share = np.maximum(share * within, 1e-12 * within)
            share /= share.sum(axis=1, keepdims=True)
        fit_ = np.log((like * share[text_of]).sum(axis=1))
        return share, np.add.reduceat(counts * fit_, first)

    within = np.ones((n_texts, n_langs))
    best, best_fit = climb(np.full((n_texts, n_langs), 1.0 / n_langs), within)
    best_fit = best_fit - PENALTY * n_langs * np.log(np.maximum(size, 2))
    share = best
    for left in range(n_langs - 1, 0, -1):  # the weakest language leaves; keep the best-scored set of each text
        within = within.copy()
        within[np.arange(n_texts), np.where(within > 0, share, np.inf).argmin(axis=1)] = 0
        share, fit_ = climb(share, within)
        fit_ = fit_ - PENALTY * left * np.log(np.maximum(size, 2))
        better = fit_ >= best_fit
        best = np.where(better[:, None], share, best)
        best_fit = np.where(better, fit_, best_fit)
    return best


def _has_letter(text) -> bool:
    import unicodedata

    if not text:
        return False
    if any("a" <= c <= "z" or "A" <= c <= "Z" for c in text[:64]):
        return True
    return any(unicodedata.category(c)[0] == "L" for c in text)


def _predict_batches(batches, model, text_name):
    for b in batches:
        langs, logs = model.value
        texts = b.column(text_name).to_pylist()
        lang_pred, score, shares = [], [], []
        for at, to, data in slices(texts, SLICE_BYTES):
            n = to - at
            if langs:
                text_of, bucket = trigrams(data)
                cell = np.bincount(text_of * BUCKETS + bucket, minlength=n * BUCKETS) if n * BUCKETS < 4 * len(bucket) else None
                if cell is None:
                    key, counts = np.unique(text_of * BUCKETS + bucket, return_counts=True)
                else:
                    key = np.flatnonzero(cell)
                    counts = cell[key]
                empty = np.setdiff1d(np.arange(n), np.unique(key // BUCKETS))
                if len(empty):  # every text needs one entry; these get no language below
                    key = np.sort(np.concatenate([key, empty * BUCKETS]))
                    counts = np.ones(len(key)) if len(counts) == 0 else np.insert(
                        counts, np.searchsorted(np.delete(key, np.searchsorted(key, empty * BUCKETS)), empty * BUCKETS), 1)
                share = mixtures(counts.astype(float), logs[key % BUCKETS], key // BUCKETS, n)
            for k in range(n):
                if langs and _has_letter(texts[at + k]):
                    top = int(share[k].argmax())
                    lang_pred.append(langs[top])
                    score.append(float(min(1.0, share[k, top])))
                    shares.append({x: float(v) for x, v in zip(langs, share[k]) if v > 1e-6})
                else:
                    lang_pred.append("und")
                    score.append(0.0)
                    shares.append({})
        made = {"lang_pred": pa.array(lang_pred, pa.string()), "score": pa.array(score, pa.float64()),
                "lang_shares": pa.array([list(x.items()) for x in shares], pa.map_(pa.string(), pa.float64()))}
        keep = [c for c in b.schema.names if c not in made]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *made.values()], names=[*keep, *made])


def predict(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``lang_shares`` (language -> proportion)."""
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
             T.StructField("lang_shares", T.MapType(T.StringType(), T.DoubleType()))]
    names = {f.name for f in added}
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers a language
    return docs.mapInArrow(lambda it: _predict_batches(it, shared, text_col),
                           T.StructType([*[f for f in docs.schema if f.name not in names], *added]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = bucket_of("doc_id", 4) == 2
    model = fit(docs.where(~held))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model).select(
        "doc_id", "held_out", "lang_pred", "score")
