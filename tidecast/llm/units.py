"""Substring dedup by unit hashing: lines, cut again at sentence ends, normalised and grouped by digest.

Units tile the text: each runs from its first character to the next unit's first, so the kept units
joined together are the kept text. A unit is compared by its lower-cased words joined by one space.
Units below ``min_words`` words are always kept, as short ones repeat by chance. The earliest unit in
(doc_id, text hash, position) order stays, and the others go, their character offsets in the original
text being returned.

Defined cases: a null text has no units and stays null; an empty text has none and stays empty; a null
doc_id ranks after all others; rows equal in doc_id and text count as one document and get equal results;
columns named like the added ones are replaced; an empty table gives an empty result.

No group is ever gathered: each digest is reduced to its earliest place (with map-side combining), and
the places that stay are sent back to their own documents, so a line that a third of all documents
share costs one row for each task.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .kernels import trimmed

MIN_WORDS = 5
ADDED = ("n_units", "n_removed", "removed_chars", "removed_spans")
# Fixed value: a unit is text up to a line end, or up to sentence marks followed by blanks.
UNIT = r"[^\n.!?]*(?:[.!?]+[^\n.!?\x20\x09\x0B-\x0D]+[^\n.!?]*)*(?:[.!?]+[\x20\x09\x0B-\x0D]*\n?|\n|$)"


def units(text: str, min_words: int):
    """(start, end, digest or None) of each unit; None for a unit too short to be compared."""
    found = []
    for m in re.finditer(UNIT, text):
        start, end = m.span()
        if end > start:
            # the six ASCII blanks only: str.split() alone would also cut at other Unicode blanks
            words = re.findall(r"[^\x20\x09-\x0D]+", m.group().lower())
            key = " ".join(words).encode("utf-8", "surrogatepass") if len(words) >= min_words else None
            found.append((start, end, hashlib.md5(key).digest() if key is not None else None))
    return found


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("__id"), F.xxhash64(f"`{text_col}`").alias("__h"),
                       F.col(f"`{text_col}`").alias("__text"))


def _scan(batches, min_words):
    for b in batches:
        ids, hashes, texts = b.column("__id"), b.column("__h"), b.column("__text")
        out = ([], [], [])
        for row, text in enumerate(texts):
            text = text.as_py()
            if text:
                for k, (_, _, digest) in enumerate(units(text, min_words)):
                    if digest is not None:
                        out[0].append(row), out[1].append(k), out[2].append(digest)
        at = pa.array(out[0], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [ids.take(at), hashes.take(at), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())],
            names=["__id", "__h", "unit", "digest"])


def keepers(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """For each document the positions of its comparable units that are the earliest of their digest."""
    keyed = _keyed(docs, id_col, text_col).where(F.length("__text") > 0)
    kind = docs.schema[id_col].dataType
    found = keyed.mapInArrow(lambda it: trimmed(_scan(it, min_words)), T.StructType([
        T.StructField("__id", kind), T.StructField("__h", T.LongType()),
        T.StructField("unit", T.IntegerType()), T.StructField("digest", T.BinaryType())]))
    first = found.groupBy("digest").agg(F.min(F.struct(
        F.col("__id").isNull().alias("last"), F.col("__id"), F.col("__h"), F.col("unit"))).alias("f"))
    return first.groupBy("f.__id", "f.__h").agg(F.collect_list("f.unit").alias("kept"))


def _apply(batches, text_name, min_words, added):
    for b in batches:
        texts, kept_lists = b.column(text_name), b.column("__kept")
        out, stats, spans = [], [[], [], []], []
        for text, kept in zip(texts.to_pylist(), kept_lists.to_pylist()):
            cut, n = [], 0
            if text:
                stay = set(kept or ())
                tiles = units(text, min_words)
                n = len(tiles)
                cut = [(s, e) for k, (s, e, d) in enumerate(tiles) if d is not None and k not in stay]
                if cut:
                    parts, at = [], 0
                    for s, e in cut:
                        parts.append(text[at:s])
                        at = e
                    text = "".join(parts) + text[at:]
            out.append(text)
            for col, v in zip(stats, (n, len(cut), sum(e - s for s, e in cut))):
                col.append(v)
            spans.append([{"start": s, "end": e} for s, e in cut])
        made = {text_name: pa.array(out, pa.string())}
        made |= {k: pa.array(v, pa.int64()) for k, v in zip(added, stats)}
        made[added[3]] = pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        names = [c for c in b.schema.names if c not in made and c != "__kept"]
        yield pa.RecordBatch.from_arrays(
            [*[b.column(c) for c in names], *made.values()], names=[*names, *made])


def dedup_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns, ``text_col`` without its later repeats, plus counts and removed spans."""
    docs = docs.drop(*ADDED)
    stay = keepers(docs, id_col, text_col, min_words)
    rest = [c for c in docs.columns if c != text_col]
    base = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`"),
                       F.xxhash64(f"`{text_col}`").alias("__hash"))
    joined = base.join(
        stay.select(F.col("__id").alias("__i"), F.col("__h").alias("__j"), F.col("kept").alias("__kept")),
        F.col(f"`{id_col}`").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__j")), "left")
    joined = joined.drop("__i", "__j", "__hash")
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()),
                                     T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*[docs.schema[c] for c in rest], T.StructField(text_col, T.StringType()),
                           *[T.StructField(c, T.LongType()) for c in ADDED[:3]],
                           T.StructField(ADDED[3], span)])
    return joined.mapInArrow(lambda it: trimmed(_apply(it, text_col, min_words, ADDED)), schema)


SQL = rf"""
WITH d AS (SELECT doc_id, text, row_number() OVER () AS rid FROM documents),
s AS (SELECT doc_id, rid, text,
             list_filter(regexp_extract_all(text, '{UNIT}'), lambda x: x <> '') AS us FROM d),
u AS (SELECT doc_id, rid, k, us[k] AS unit, list_sum(list_transform(us[1:k - 1], lambda x: length(x))) AS before,
             regexp_extract_all(lower(us[k]), '[^\x20\x09-\x0D]+') AS ws
      FROM s, unnest(range(1, coalesce(len(us), 0) + 1)) AS t(k)),
r AS (SELECT *, len(ws) >= {MIN_WORDS} AND row_number() OVER (
                  PARTITION BY len(ws) >= {MIN_WORDS}, array_to_string(ws, ' ') ORDER BY doc_id, k) > 1 AS gone FROM u)
SELECT d.doc_id, count(r.rid)::BIGINT AS n_units, count(*) FILTER (gone)::BIGINT AS n_removed,
       coalesce(sum(length(unit)) FILTER (gone), 0)::BIGINT AS removed_chars,
       coalesce(string_agg(coalesce(before, 0)::BIGINT || '-' || (coalesce(before, 0) + length(unit))::BIGINT, ',' ORDER BY k) FILTER (gone), '') AS spans,
       any_value(d.text) IS NULL AS null_text,
       md5(coalesce(string_agg(unit, '' ORDER BY k) FILTER (NOT gone), '')) AS kept_md5
FROM d LEFT JOIN r USING (rid) GROUP BY d.rid, d.doc_id"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.transform("removed_spans", lambda s: F.concat_ws("-", s["start"], s["end"]))
    return dedup_units(docs).select(
        "doc_id", "n_units", "n_removed", "removed_chars", F.concat_ws(",", spans).alias("spans"),
        F.col("text").isNull().alias("null_text"),
        F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("kept_md5"))
