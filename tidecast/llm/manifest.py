"""Merkle manifest of a dataset: leaf, proof and root of every row, from levels kept as hex strings.

A row's leaf is the SHA-256 of its encoded fields. Rows are put in order within their tree (one for each
value of ``group_col``), and every ``ARITY`` consecutive nodes make one parent, until one node, the
subroot, remains; the subroots are the leaves of one last tree, whose top is the root.

An aligned block of ``BLOCK`` nodes is one row that keeps each of its levels as one string of hex digests.
Parents are the hashes of the string's fixed-width substrings; a node's siblings are the substrings before
and behind it within its run. The blocks' tops are the nodes of the next round, in blocks again, until one
block holds the whole tree; proofs then go down the same rounds.

Positions need no sort in one place: rows are range-partitioned by (tree, id, leaf), and a row's position is
its place in the partition plus the counts of the partitions before it. A tree that holds a third of all rows
is many partitions, and a block is 512 nodes whatever the table. Texts are hashed where they are scanned and
never move.

Defined cases: null fields are encoded as ``-``, so null and empty differ; a null id sorts first; rows with one
id follow in order of their leaves, and equal rows are neighbours whose results are exchangeable; null is a tree
of its own, before all others, which go bytewise; very long texts are hashed in place; added columns cannot
clash, as only the result's columns are returned; an empty table gives an empty result and no root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket_of, materialise, table

ARITY = 8
LEVELS = 3  # levels that a block holds
BLOCK = ARITY ** LEVELS
HEX = 64
RUN = ARITY * HEX
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon, and the value."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def parents(level: Column) -> Column:
    """The level above: the hash of each run of a level's string, end to end."""
    last = F.ceil(F.length(level) / RUN).cast("int") - 1
    return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(
        F.substring(level, i * RUN + 1, F.lit(RUN)), 256)), "")


def flanks(level: Column, at: Column) -> Column:
    """What stands before and behind a node in its run."""
    run, own = F.floor(at / ARITY).cast("int") * RUN, at % ARITY
    return F.struct(F.substring(level, run + 1, own * HEX).alias("left"),
                    F.substring(level, run + (own + 1) * HEX + 1, (ARITY - 1 - own) * HEX).alias("right"))


def sibling_hash(path: str | Column) -> Column:
    """The hash of all siblings on the way to the root, left to right, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(leaf: Column, path: str | Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Add ``pos``, the place in ``order`` within ``tree``, from 0, and ``n``, the number of the tree's rows."""
    ranged = materialise(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
                         .withColumn("seq", F.monotonically_increasing_id()), "manifest-order")
    ranged = ranged.withColumn("part", F.shiftright("seq", 33))
    facts = materialise(ranged.groupBy("tree", "part").agg(F.min("seq").alias("first"), F.count("*").alias("here")),
                        "manifest-parts")  # a row for each partition, and for each tree more
    facts = facts.selectExpr("tree", "part", "first", "sum(here) over (partition by tree) as n",
                             "sum(here) over (partition by tree order by part) - here as start")
    return ranged.join(facts, ["tree", "part"]).withColumn("pos", F.col("seq") - F.col("first") + F.col("start")).drop(
        "seq", "part", "first", "start")


def raised(nodes: DataFrame) -> list[DataFrame]:
    """The rounds of blocks over (tree, pos, n, hash, item), lowest first."""
    rounds = []
    while True:
        rows = nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block")).agg(
            F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "hash", "item"))).alias("nodes"))
        rows = rows.select("tree", "block", "n", F.expr("case when n <= 1 then 0 when n <= 8 then 1 when n <= 64 then 2 else 3 end").alias("levels"),
                           F.array_join(F.transform("nodes", lambda x: x["hash"]), "").alias("l0"),
                           F.transform("nodes", lambda x: x["item"]).alias("items"))
        for k in range(1, LEVELS + 1):
            rows = rows.withColumn(f"l{k}", F.when(F.col("levels") >= k, parents(F.col(f"l{k - 1}"))))
        rows = materialise(rows.withColumn("top", F.coalesce("l3", "l2", "l1", "l0")).drop("l3"), "manifest-blocks")
        rounds.append(rows)
        if (rows.agg(F.max("n")).first()[0] or 0) <= BLOCK:
            return rounds
        nodes = rows.where(F.col("n") > BLOCK).select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"),
                                                      F.col("top").alias("hash"), F.col("block").alias("item"))


def tops(rounds: list[DataFrame]) -> DataFrame:
    """(tree, hash) of every tree's one last node."""
    out = [r.where(F.col("n") <= BLOCK).select("tree", F.col("top").alias("hash")) for r in rounds]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def ways(rounds: list[DataFrame], heads: DataFrame) -> DataFrame:
    """(tree, item, hash, subroot, path) of every lowest node; ``heads`` has (tree, subroot, path) of the tops."""
    upper = None
    for k, rows in reversed(list(enumerate(rounds))):
        ready = rows.where(F.col("n") <= BLOCK).join(heads, "tree")
        if upper is not None:
            ready = ready.unionByName(rows.where(F.col("n") > BLOCK).join(
                upper.select("tree", F.col("item").alias("block"), "subroot", "path"), ["tree", "block"]))
        own = lambda i: F.slice(F.array(*[flanks(F.col(f"l{j}"), F.floor(i / ARITY ** j).cast("int"))
                                          for j in range(LEVELS)]), F.lit(1), F.col("levels"))
        each = F.transform("items", lambda x, i: F.struct(
            x.alias("item"), F.substring(F.col("l0"), i * HEX + 1, F.lit(HEX)).alias("hash"), own(i).alias("low")))
        upper = ready.select("tree", "subroot", "path", F.inline(each)).select(
            "tree", "item", "hash", "subroot", F.concat("low", "path").alias("path"))
        if k:
            upper = materialise(upper, "manifest-ways")
    return upper


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields=FIELDS,
             carry: dict[str, Column] | None = None) -> DataFrame:
    """(id_col, leaf, subroot, root, path, and ``carry``, columns computed from each row) of every row."""
    carry = carry or {}
    group = F.col(f"`{group_col}`").cast("string")
    rows = materialise(docs.select(
        F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group)).alias("tree"),
        F.col(f"`{id_col}`").alias("id"), leaf_hash(*[F.col(f"`{c}`") for c in fields]).alias("hash"),
        F.struct(F.col(f"`{id_col}`").alias("id"), *[v.alias(k) for k, v in carry.items()]).alias("item"),
    ).withColumn("row", F.monotonically_increasing_id()), "manifest-leaves")
    low = raised(numbered(rows, "id", "hash", "row"))
    high = raised(numbered(tops(low).select(F.lit("").alias("tree"), F.col("tree").alias("item"), "hash"), "item"))
    end = tops(high).first()  # one row
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    heads = ways(high, tops(high).select("tree", F.col("hash").alias("subroot"), nothing.alias("path"))).select(
        F.col("item").alias("tree"), F.col("hash").alias("subroot"), "path")
    heads = materialise(heads, "manifest-heads")
    return ways(low, heads).select(
        F.col("item.id").alias(id_col), F.col("hash").alias("leaf"), "subroot",
        F.lit(end["hash"] if end else None).cast("string").alias("root"), "path", *[F.col(f"item.{k}") for k in carry])


TAMPER_STEP = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = leaf_hash(*[F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS])
    hit = F.col("doc_id").isNotNull() & (bucket_of("doc_id", TAMPER_STEP) == 0)
    found = manifest(docs.select(*FIELDS), carry={"tampered": F.when(hit, changed)})
    return found.select("doc_id", "leaf", "subroot", "root", sibling_hash("path").alias("proof_sha256"),
                        fold(F.coalesce("tampered", "leaf"), "path").alias("folded_root")).withColumn(
                            "verified", F.col("folded_root") == F.col("root"))


def _crc32(value: str) -> str:
    """SQL of the unsigned crc32 of an ASCII text."""
    step = "xor(a >> 1, 3988292384 * (a & 1))"
    byte = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: {step})"
    codes = f"list_transform(string_split({value}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {byte}), 4294967295)"


def _sql() -> str:
    one = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(one(text if c == "text" else c) for c in FIELDS) + ")"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {leaf('text')} AS leaf,
    CASE WHEN {_crc32('doc_id::VARCHAR')} % {TAMPER_STEP} = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS bad
  FROM documents),
p AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d
      WINDOW w AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf)),
u AS (SELECT lang, 0 AS lvl, pos, n, leaf AS h FROM p UNION ALL
      SELECT lang, lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1
      GROUP BY lang, lvl, pos // 8, n),
s AS (SELECT lang, h AS subroot, lvl AS depth, row_number() OVER (ORDER BY lang COLLATE "binary" NULLS FIRST) - 1 AS pos,
             count(*) OVER () AS n FROM u WHERE n = 1),
v AS (SELECT 0 AS lvl, pos, n, subroot AS h FROM s UNION ALL
      SELECT lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM v WHERE n > 1 GROUP BY lvl, pos // 8, n),
q AS (SELECT p.*, s.subroot, s.depth, s.pos AS spos, row_number() OVER () AS rid FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang),
f AS (SELECT q.rid, u.lvl, u.pos, u.pos < q.pos // (8 ** u.lvl)::BIGINT AS before, u.h FROM q JOIN u
        ON q.lang IS NOT DISTINCT FROM u.lang AND u.n > 1 AND u.pos // 8 = q.pos // (8 ** (u.lvl + 1))::BIGINT
        AND u.pos <> q.pos // (8 ** u.lvl)::BIGINT
      UNION ALL
      SELECT q.rid, q.depth + v.lvl, v.pos, v.pos < q.spos // (8 ** v.lvl)::BIGINT, v.h FROM q JOIN v
        ON v.n > 1 AND v.pos // 8 = q.spos // (8 ** (v.lvl + 1))::BIGINT AND v.pos <> q.spos // (8 ** v.lvl)::BIGINT),
steps AS (SELECT rid, lvl FROM q, unnest(range(0, depth + (SELECT max(lvl) FROM v))) AS t(lvl)),
g AS (SELECT steps.rid, steps.lvl, coalesce(string_agg(h, '' ORDER BY pos) FILTER (before), '') AS l,
             coalesce(string_agg(h, '' ORDER BY pos) FILTER (NOT before), '') AS r
      FROM steps LEFT JOIN f ON steps.rid = f.rid AND steps.lvl = f.lvl GROUP BY steps.rid, steps.lvl),
w AS (SELECT rid, 0 AS lvl, coalesce(bad, leaf) AS h FROM q UNION ALL
      SELECT w.rid, w.lvl + 1, sha256(g.l || w.h || g.r) FROM w JOIN g ON w.rid = g.rid AND w.lvl = g.lvl),
x AS (SELECT rid, sha256(coalesce(string_agg(l || r, '' ORDER BY lvl), '')) AS proof FROM g GROUP BY rid),
y AS (SELECT rid, arg_max(h, lvl) AS folded FROM w GROUP BY rid)
SELECT q.doc_id, q.leaf, q.subroot, (SELECT arg_max(h, lvl) FROM v) AS root, coalesce(x.proof, sha256('')) AS proof_sha256,
       y.folded AS folded_root, y.folded = (SELECT arg_max(h, lvl) FROM v) AS verified
FROM q JOIN y ON q.rid = y.rid LEFT JOIN x ON q.rid = x.rid"""


SQL = _sql()
