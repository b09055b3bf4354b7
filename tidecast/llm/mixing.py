"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1], straight between evenly spaced knots. Its
integral times the total demand is the source's target in words, and its running integral is the source's
cumulative demand. The documents taken, laid end to end, are the supply: a copy whose middle word lies at
cumulative word c is trained on at the time where the cumulative demand reaches c, found by inverting the
integral. Sorting by that time over ranges gives the training order.

Targets: sources by code point, null last, weigh 1, 2, 3, 1, 2, ... and share the words of all sources;
a target stops at ``max_repeats`` times the source's words, and the excess is shared again by weight.

What is taken: every document as often as the target holds the source whole, and for the rest of the target
one copy more of some. The large documents, those with over a hundredth of the source's words (under a
hundred), come first, by size: one is taken while the words taken stay near the share of the rest that the
documents so far have of the source, and never beyond the rest. The others follow by md5 of the id, each taken
if it fits what is left, so one that does not fit shuts out none behind it. At the end the one document whose
size is nearest to what is left is added if that brings the source nearer to its target.

Defined cases: null and empty texts have size 0 and are taken as often as their neighbours, with 0 words (not at
all in a source without a word); a null source is a source of its own, after all others; rows equal in id and text
are exchangeable, so the multiset of results is fixed; one text may hold nearly all of a source's words; very long
texts are counted where they are scanned; input columns named like the added ones are replaced; an empty table
gives an empty result.

A source may hold most rows: running sums are taken in cells (source, first digits of the md5) and over the
cells' totals, never over a source. Taking what fits is a few rounds of such sums: a round takes the others in
order up to the first that does not fit, and the next goes on with those that are small enough for what is left.
"""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, lookup_skewed, materialise, table

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
LARGE_SHARE = 100
CELL_ROWS = 20_000
# Weights at evenly spaced times, by the source's rank in turn: early sources fade while later ones come up.
SCHEDULES = ((1.6, 0.4), (1.2, 0.8), (0.8, 1.2), (0.4, 1.6))


def word_count(text: Column) -> Column:
    t = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.size(F.filter(F.split(t, " ", -1), lambda w: w != "")).cast("long")


def segments(knots) -> list[tuple[float, float, float, float]]:
    """(time, demand so far, weight, slope) at each piece of a schedule, its integral made 1."""
    n = len(knots) - 1
    total = sum((a + b) / 2 / n for a, b in zip(knots, knots[1:]))
    out, done = [], 0.0
    for k, (a, b) in enumerate(zip(knots, knots[1:])):
        out.append((k / n, done, a / total, (b - a) / total * n))
        done += (a + b) / 2 / n / total
    return out


def invert_demand(share: str, knots) -> str:
    """SQL of the time at which a schedule has given ``share`` of its integral.

    Within a piece the running integral is w t + s t^2 / 2; this root of it loses no digits for small s.
    """
    def root(time, done, weight, slope):
        d = f"({share} - {done!r})" if done else f"{share}"
        at = f"2 * {d} / nullif({weight!r} + sqrt(greatest(0.0, {weight!r} * {weight!r} + 2 * {slope!r} * {d})), 0.0)"
        return f"coalesce({at}, 0.0)" + (f" + {time!r}" if time else "")

    pieces = segments(knots)
    cases = "".join(f"WHEN {share} <= {nxt[1]!r} THEN {root(*own)} " for own, nxt in zip(pieces, pieces[1:]))
    return f"least(1.0, {'CASE ' + cases + 'ELSE ' if cases else ''}{root(*pieces[-1])}{' END' if cases else ''})"


def time_sql(share: str, rank: str, schedules=SCHEDULES) -> str:
    """SQL of the training time, by the source's rank."""
    whens = "".join(f"WHEN {k} THEN {invert_demand(share, s)} " for k, s in enumerate(schedules))
    return f"CASE {rank} % {len(schedules)} {whens}END"


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source from (source, source_size): rank, weight and target.

    Ranks come from range partitions and their counts, and the water level from a few sums, so the
    number of sources is not bounded by one task either.
    """
    spark = sizes.sparkSession
    ranged = materialise(
        sizes.repartitionByRange(F.col("source").isNull(), F.col("source"))
             .withColumn("part", F.spark_partition_id()), "sources")
    counts = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts, run = [], 0
    for part in sorted(counts):
        starts.append((part, run))
        run += counts[part]
    if not starts:
        return ranged.select("source", "source_size", F.lit(0).alias("rank"), F.lit(1.0).alias("weight"),
                             F.lit(0.0).alias("target"))
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in starts for x in pair]), F.col("part"))
    order = Window.partitionBy("part").orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = (ranged.withColumn("rank", F.row_number().over(order) - 1 + offset)
              .withColumn("weight", weight)
              .withColumn("cap", F.col("source_size").cast("double") * max_repeats))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, n_full = 0.0, -1
    while True:  # sources at their cap leave the sharing; each pass is one sum over the sources
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        got = ranked.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("capped"),
                         F.sum(F.when(~full, F.col("weight"))).alias("open"),
                         F.count(F.when(full, 1)).alias("n")).first()
        if got["n"] == n_full or not got["open"]:
            break
        n_full, level = got["n"], max(0.0, total - got["capped"]) / got["open"]
    return ranked.select("source", "source_size", "rank", "weight",
                         F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def file_row(docs: DataFrame) -> Column | None:
    """What tells the rows of a table read straight from files apart, or None."""
    key = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    try:
        docs.select(key)
    except AnalysisException:
        return None
    return key


def _before(rows: DataFrame) -> DataFrame:
    """Add ``before``, the words of the source's rows ahead of a row, by (cell, key, id, text_hash)."""
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy("s", "cell").agg(F.sum("size").alias("cell_size")).select("s", "cell", F.coalesce(
        F.sum("cell_size").over(ahead(Window.partitionBy("s").orderBy("cell"))), F.lit(0)).alias("start")))
    inside = Window.partitionBy("s", "cell").orderBy("key", "id", "text_hash", "row")
    return rows.withColumn("before", F.coalesce(F.sum("size").over(ahead(inside)), F.lit(0))).join(
        starts, ["s", "cell"]).withColumn("before", F.col("before") + F.col("start")).drop("start")


def _with(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Join every row with its source's facts; a source may hold most rows, so the hot few are broadcast."""
    per = rows.groupBy("s").agg(F.count("*").alias("n_rows"))
    return lookup_skewed(rows, facts.join(per, "s"), "s", "n_rows", rows.count()).drop("n_rows")


def _large_picks(rows: DataFrame) -> DataFrame:
    """(row, s, size) of the large documents that are taken in the last, partial pass; under a hundred a source."""
    each = F.struct((-F.col("size")).alias("less"), "key", "id", "text_hash", "row")
    lists = rows.where("large and rest > 0").groupBy("s").agg(
        F.sort_array(F.collect_list(each)).alias("docs"), F.first("rest").alias("rest"), F.first("source_size").alias("total"))
    kind = rows.select(F.array(F.struct("row", "size")).alias("x")).schema["x"].dataType
    start = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("seen"), F.array().cast(kind).alias("picks"))

    def step(state, x):
        size, seen = -x["less"], state["seen"] - x["less"]
        take = (state["a"] + size <= F.col("rest")) & (state["a"] + size / 2 < F.col("rest") * seen / F.col("total"))
        return F.struct(F.when(take, state["a"] + size).otherwise(state["a"]).alias("a"), seen.alias("seen"), F.when(
            take, F.concat(state["picks"], F.array(F.struct(x["row"].alias("row"), size.alias("size"))))).otherwise(state["picks"]).alias("picks"))

    return lists.select("s", F.inline(F.aggregate("docs", start, step)["picks"])).select("row", "s", "size")


def _last_pass(rows: DataFrame) -> DataFrame:
    """(row, s, size) of the documents that are taken once more than the target holds their source whole."""
    picks = materialise(_large_picks(rows), "mix-large")
    rests = materialise(rows.groupBy("s").agg(F.first("rest").alias("rest")), "mix-rests")

    def left(found):
        got = found.groupBy("s").agg(F.sum("size").alias("a"))
        return materialise(rests.join(got, "s", "left").select("s", (F.col("rest") - F.coalesce("a", F.lit(0))).alias("left")), "mix-left")

    open_rows = rows.where("not large and rest > 0").select("s", "cell", "key", "id", "text_hash", "row", "size")
    while True:
        fits = materialise(_with(open_rows, left(picks)).where("size <= left"), "mix-fitting")
        placed = materialise(_before(fits).withColumn("take", F.expr("before + size <= left")), "mix-round")
        if placed.where("take").isEmpty():
            break
        picks = materialise(picks.unionByName(placed.where("take").select("row", "s", "size")), "mix-picks")
        open_rows = placed.where("not take").drop("before", "left", "take")
    unused = rows.where("rest > 0 and size > 0").select("s", "key", "id", "text_hash", "row", "size").join(picks.select("row"), "row", "left_anti")
    nearest = _with(unused, left(picks)).where("left > 0").groupBy("s").agg(F.first("left").alias("left"), F.min(F.struct(
        F.abs(F.col("left") - F.col("size")).alias("miss"), "key", "id", "text_hash", "row", "size")).alias("x"))
    return materialise(picks.unionByName(nearest.where("x.miss < left").select("x.row", "s", "x.size")), "mix-last")


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             max_repeats: int = MAX_REPEATS, weights=WEIGHTS, schedules=SCHEDULES, row: Column | None = None) -> DataFrame:
    """One row per document, without its text: ``row`` (or its place, if none is given), id, size, source, source_size,
    target, copies, taken, and ``positions``, one training time for each copy taken."""
    key = F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary"))
    source = F.col(f"`{source_col}`").cast("string")
    slim = materialise(docs.select(
        (F.monotonically_increasing_id() if row is None else row).alias("row"), F.col(f"`{id_col}`").alias("id"), source.alias("source"),
        F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source)).alias("s"),
        F.xxhash64(f"`{text_col}`").alias("text_hash"),
        word_count(F.col(f"`{text_col}`")).alias("size"), key.alias("key")), "mix-sizes")
    digits = max(2, math.ceil(math.log(max(1, slim.count() / CELL_ROWS), 16)))
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialise(source_targets(sizes, weights, max_repeats), "mix-targets")
    whole = F.coalesce(F.floor(F.expr("target / nullif(source_size, 0)")), F.lit(0))
    targets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = targets.withColumn("s", F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "source"))).drop("source", "weight")
    rows = _with(slim, targets).withColumn("large", F.col("size") * LARGE_SHARE > F.col("source_size"))
    rows = materialise(rows.withColumn("cell", F.when(F.col("large"), F.lit("")).otherwise(F.substring("key", 1, digits))), "mix-rows")

    last = _last_pass(rows).select("row", F.lit(1).alias("last"))
    rows = materialise(_before(rows).withColumnRenamed("before", "ahead").join(last, "row", "left"), "mix-passes")
    ends = _before(rows.where("last = 1").drop("ahead", "last")).select("row", "before")
    rows = rows.join(ends, "row", "left")
    at = F.transform(F.expr("if(whole > 0, sequence(0L, whole - 1), array())"),
                     lambda j: j * F.col("source_size") + F.col("ahead") + F.col("size") / 2)
    end = F.when(F.col("last") == 1, F.array(F.col("whole") * F.col("source_size") + F.col("before") + F.col("size") / 2)).otherwise(
        F.array().cast("array<double>"))
    rows = rows.withColumn("shares", F.transform(F.concat(at, end), lambda x: x / F.expr("nullif(target, 0.0)")))
    rows = rows.withColumn("copies", F.size("shares").cast("long"))
    return rows.select(
        "row", "id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
        F.expr(f"transform(shares, x -> {time_sql('x', 'rank', schedules)})").alias("positions"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The training order: each document as often as it is taken, with ``position``, sorted by it.

    Texts move twice: to their positions, and into order. Rows are told apart by their place in their files; a
    table that is not read from files is written first.
    """
    docs = docs.drop("position")
    row = file_row(docs)
    if row is None:
        docs = materialise(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), F.monotonically_increasing_id().alias("at")),
                           "mix-docs").select("r.*", F.struct(F.lit("").alias("file"), "at").alias("__mix"))
        row = F.col("__mix")
    keep = [F.col(f"`{c}`") for c in docs.columns if c != "__mix"]
    plan = plan_mix(docs, id_col, text_col, source_col, row=row, **options)
    taken = plan.where("copies > 0").select(F.col("row.file").alias("file"), F.col("row.at").alias("at"), "positions")
    marked = docs.select(F.struct(*keep).alias("r"), row["file"].alias("file"), row["at"].alias("at"))
    return (marked.join(taken, ["file", "at"]).select("r", F.explode("positions").alias("position"))
            .repartitionByRange("position").sortWithinPartitions("position", F.col("r")[id_col]).select("r.*", "position"))


SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS key,
       len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
z AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s AS (SELECT source, source_size, row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") - 1 AS rank,
             source_size::DOUBLE * 3 AS cap FROM z),
k AS (SELECT *, (rank % 3 + 1)::DOUBLE AS weight FROM s),
l AS (SELECT 0.0::DOUBLE AS level, 0 AS step
      UNION ALL
      SELECT (SELECT greatest(0.0, (SELECT sum(source_size) FROM k)::DOUBLE
                              - coalesce(sum(cap) FILTER (cap <= l.level * weight), 0.0))
                     / sum(weight) FILTER (cap > l.level * weight) FROM k), step + 1
      FROM l WHERE step < 60 AND l.level IS NOT NULL),
t0 AS (SELECT k.*, least(cap, coalesce((SELECT max(level) FROM l), 0.0) * weight) AS target FROM k),
t1 AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS whole FROM t0),
t AS (SELECT *, target - whole * source_size AS rest FROM t1),
o AS (SELECT d.*, t.source_size, t.target, t.rank, t.whole, t.rest, size * 100 > t.source_size AS large,
             row_number() OVER g AS i, sum(size) OVER (g ROWS UNBOUNDED PRECEDING) AS seen,
             coalesce(sum(size) OVER (h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
      WINDOW g AS (PARTITION BY d.source ORDER BY size * 100 > t.source_size DESC,
                   CASE WHEN size * 100 > t.source_size THEN -size END, key, doc_id),
             h AS (PARTITION BY d.source ORDER BY size * 100 > t.source_size DESC, key, doc_id)),
-- one document after the other: taken if it fits, a large one only while it keeps to the share of those so far
r AS (SELECT source, 0::BIGINT AS i, 0::BIGINT AS a, false AS take FROM t
      UNION ALL
      SELECT source, i, a + CASE WHEN take THEN size ELSE 0 END, take FROM (
        SELECT o.source, o.i, r.a, o.size, o.rest > 0 AND r.a + o.size <= o.rest
               AND (NOT o.large OR r.a + o.size / 2 < o.rest * o.seen / o.source_size) AS take
        FROM r JOIN o ON o.source IS NOT DISTINCT FROM r.source AND o.i = r.i + 1)),
e AS (SELECT o.*, r.take, o.rest - max(r.a) OVER (PARTITION BY o.source) AS remains
      FROM o JOIN r ON o.source IS NOT DISTINCT FROM r.source AND o.i = r.i),
f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY take OR size = 0, abs(remains - size), key, doc_id) = 1
                AND NOT take AND size > 0 AND rest > 0 AND remains > 0 AND abs(remains - size) < remains AS added FROM e),
c AS (SELECT *, coalesce(sum(CASE WHEN take OR added THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY large DESC, key, doc_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
             whole + (take OR added)::BIGINT AS copies FROM f),
m AS (SELECT *, CASE WHEN whole > 0 THEN (ahead + size / 2) / target
                     WHEN copies > 0 THEN (whole * source_size + before + size / 2) / target END AS x FROM c)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken,
       CASE WHEN copies > 0 THEN {time_sql('x', 'rank')} END AS first_time
FROM m"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = plan_mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "copies", "taken",
                                  F.get("positions", F.lit(0)).alias("first_time"))
    return found.repartitionByRange("first_time", "doc_id").sortWithinPartitions("first_time", "doc_id")
