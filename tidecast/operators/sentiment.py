"""Text sentiment: lexicon scoring with phrase matching and modifier context, signed-confidence scores.

Lexicon scoring runs inside each row with higher-order array functions: tokens, longest-phrase match,
modifier context and the per-document sums are one projection over the document table, without explode,
shuffle or window, so that a document of any length is scored whole in the task that reads it. A lexicon
given as a table is walked as a trie by equi-joins instead, whatever its size.

Scoring rules (the lexicon names classes; the weights are this package's choice):
* tokens are lower-case ``[a-z]+`` runs; a term is 1 to K tokens; at each position the longest term
  wins, and the next match begins after it; a null text counts as empty;
* ``positive`` = +1, ``negative`` = -1; a modifier in the 3 tokens before a sentiment token multiplies
  it: ``revert`` -1, ``increment`` 2, ``decrement`` 0.5;
* ``compound = s / sqrt(s^2 + 15)``; ``pos/neg/neu`` are the shares of Σ(s+1) over positive tokens,
  Σ(1-s) over negative ones and the count of unscored tokens (the published VADER definitions).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookup import hashed_map, look_up
from ..session import written
from .text import tokens

# fixed values: the shipped term -> class dictionary, in file order.
DEFAULT_LEXICON = (
    ("good", "positive"), ("nice", "positive"), ("awesome", "positive"), ("cool", "positive"),
    ("superb", "positive"), ("bad", "negative"), ("uninspired", "negative"),
    ("expensive", "negative"), ("disappointed", "negative"),
    ("recommend others to avoid", "negative"), ("lack of", "revert"), ("not", "revert"),
    ("too", "increment"), ("very", "increment"), ("sorely", "increment"),
    ("barely", "decrement"), ("little", "decrement"),
)

# fixed values: class weights, context length and normalisation constant.
POLARITY = {"positive": 1.0, "negative": -1.0}
MODIFIER = {"revert": -1.0, "increment": 2.0, "decrement": 0.5}
CONTEXT = 3
FOLD = 256
ALPHA = 15.0

def load_lexicon(spark, path: str) -> DataFrame:
    """Headerless ``term,class`` file."""
    return spark.read.schema("term STRING, cls STRING").csv(path)


def _term(col: Column) -> Column:
    return F.array_join(F.filter(F.split(F.lower(col), r"\s+"), lambda w: w != ""), " ")


def lexicon_pairs(lexicon: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """Lower-cased terms with single blanks (ASCII ones); of equal terms the greatest class counts, as a table has
    no order to go by."""
    out: dict[str, str] = {}
    for term, cls in lexicon:
        words = re.findall(r"[^ \t\n\x0b\f\r]+", (term or "").lower())
        if words and cls:
            out[" ".join(words)] = max(cls, out.get(" ".join(words), cls))
    return list(out.items())


def lexicon_trie(lexicon: DataFrame) -> DataFrame:
    """The lexicon's terms, in the same normal form, as a trie: (node, word, next, n, cls, more).

    A node is named by the words that lead to it, the root by none. ``cls`` is the class of the term that ends with
    this word, if one does, and ``more`` tells whether a longer one goes on.
    """
    t = lexicon.where("cls is not null").select(_term(F.col("term")).alias("term"), "cls").where("term <> ''")
    t = t.groupBy("term").agg(F.max("cls").alias("cls"))
    words = F.split("term", " ")
    path = lambda k: F.array_join(F.slice(words, F.lit(1), k), " ")
    steps = t.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.struct(
        path(k - 1).alias("node"), F.element_at(words, k).alias("word"), path(k).alias("next"), k.alias("n"),
        F.when(k == F.size(words), F.col("cls")).alias("cls"), (k < F.size(words)).alias("more")))).alias("s"))
    return steps.select("s.*").groupBy("node", "word", "next", "n").agg(F.max("cls").alias("cls"), F.max("more").alias("more"))


def _weights(cls: Column, table: dict, default: float) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(cls == k, F.lit(v)).otherwise(out)
    return out


def _ahead(arr: Column, k: int) -> Column:
    """Element i -> arr[i + k] once zipped (the zip pads the shorter arrays with NULL)."""
    return F.slice(arr, k + 1, F.greatest(F.size(arr), F.lit(1)))


HIT_DDL = "struct<pos:int,cls:string,len:int>"
HIT = "struct<pos:int,cls:string,len:int,pol:double,mod:double>"


def _behind(arr: Column, j: int, ddl: str) -> Column:
    """Element i -> arr[i - j] once zipped and trimmed; NULL before the start."""
    return F.concat(F.array_repeat(F.lit(None).cast(ddl), j), arr)


def _hits_in_row(a: DataFrame, keep: list, pairs: list) -> DataFrame:
    """(keep, n_tokens, _h): the longest match at each token, for a lexicon that travels in the plan."""
    t = F.col("_t")
    if not pairs:
        return a.select(*keep, F.size(t).alias("n_tokens"), F.array().cast(f"array<{HIT_DDL}>").alias("_h"))
    k_max = max(len(term.split()) for term, _ in pairs)
    lex = hashed_map(dict(pairs))
    starts = hashed_map({term.split()[0]: "" for term, _ in pairs})
    z = F.arrays_zip(*[(t if k == 1 else _ahead(t, k - 1)).alias(f"w{k}") for k in range(1, k_max + 1)])

    def match(x, i):
        hits = {}
        for k in range(1, k_max + 1):
            gram = F.when(x[f"w{k}"].isNotNull(), F.concat_ws(" ", *[x[f"w{j}"] for j in range(1, k + 1)]))
            hits[k] = look_up(lex, gram)
        cls = F.coalesce(*[hits[k] for k in range(k_max, 0, -1)])
        length = F.lit(0)
        for k in range(1, k_max + 1):
            length = F.when(hits[k].isNotNull(), F.lit(k)).otherwise(length)
        found = F.when(length > 0, F.struct(i.alias("pos"), cls.alias("cls"), length.alias("len")))
        return F.when(look_up(starts, x["w1"]).isNotNull(), found)

    return a.select(*keep, F.size(t).alias("n_tokens"), F.array_compact(F.transform(z, match)).alias("_h"))


GATE_BITS = 1 << 20


def _gate(trie: DataFrame) -> Column:
    """A predicate maker for the words that may begin a term: a table of GATE_BITS bits, whatever the lexicon's
    size. It lets all words through that do, and of the others those that share a bit with one."""
    rows = trie.where("n = 1").select(F.pmod(F.xxhash64("word"), F.lit(GATE_BITS)).alias("h")).selectExpr(
        "h div 64 as k", "shiftleft(1L, int(h % 64)) as bit")
    bits = [0] * (GATE_BITS // 64)
    for r in rows.groupBy("k").agg(F.bit_or("bit").alias("b")).collect():  # at most GATE_BITS / 64 rows
        bits[r["k"]] = r["b"]
    table = F.from_json(F.lit(json.dumps(bits)), "array<bigint>")

    def may_begin(word):
        x = F.pmod(F.xxhash64(word), F.lit(GATE_BITS))
        return F.getbit(F.get(table, (x / 64).cast("int")), (x % 64).cast("int")) == 1

    return may_begin


def _hits_by_trie(a: DataFrame, keep: list, lexicon: DataFrame) -> DataFrame:
    """(keep, n_tokens, _h) for a lexicon table of any size, walked as a trie by equi-joins.

    A gate of fixed size, tested inside the row, keeps tokens that begin no term from becoming rows. The others
    carry the few words after them, and go on level by level while the trie has a node for the next word. Rows are
    told apart by ``keep`` and a hash of their tokens: rows equal in both have equal matches.
    """
    trie = written(lexicon_trie(lexicon), "lexicon-trie")
    longest = trie.agg(F.max("n")).first()[0] or 1  # one number
    t, may_begin = F.col("_t"), _gate(trie)
    # ids may repeat, and a hash join wants no NULL keys
    sized = a.withColumn("n_tokens", F.size(t)).withColumn("_row", F.sha2(F.to_json(F.struct(*keep, "_t")), 256))
    starts = sized.select("_row", F.explode(F.filter(F.transform(
        t, lambda w, i: F.when(may_begin(w), F.struct(i.alias("pos"), F.slice(t, i + 1, longest).alias("words")))),
        lambda x: x.isNotNull())).alias("x")).select("_row", "x.pos", "x.words").distinct()
    walk = written(starts.withColumn("node", F.lit("")), "lexicon-starts")
    found = None
    for k in range(1, longest + 1):
        level = trie.where(F.col("n") == k).drop("n")
        step = walk.withColumn("word", F.get("words", F.lit(k - 1))).join(level, ["node", "word"])
        hits = step.where("cls is not null").select("_row", "pos", F.lit(k).alias("len"), "cls")
        found = hits if found is None else found.unionByName(hits)
        walk = step.where("more").select("_row", "pos", "words", F.col("next").alias("node"))
    best = found.groupBy("_row", "pos").agg(F.max(F.struct("len", "cls")).alias("b"))
    lists = best.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct(
        "pos", F.col("b.cls").alias("cls"), F.col("b.len").alias("len")))).alias("_h"))
    return sized.join(lists, "_row", "left").select(
        *keep, "n_tokens", F.coalesce("_h", F.array().cast(f"array<{HIT_DDL}>")).alias("_h"))


def lexicon_scores(docs: DataFrame, text: str = "text",
                   lexicon: Iterable[tuple[str, str]] | DataFrame = DEFAULT_LEXICON,
                   keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """Per row of ``docs``: n_tokens, score_sum, pos, neg, neu, compound, n_pos, n_neg.

    One pass over the tokens finds the lexicon matches (a map lookup on the first word gates the
    phrase lookups); covering, modifier context and sums then run over the short array of matches
    only. Neighbours are reached by zipping shifted copies, never by indexing from a lambda.
    """
    keep = list(keep)
    toks = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z]+"), "")
    a = docs.select(*keep, toks.alias("_t"))
    if isinstance(lexicon, DataFrame):
        b = _hits_by_trie(a, keep, lexicon)
    else:
        b = _hits_in_row(a, keep, lexicon_pairs(lexicon))

    # leftmost-longest: a match that begins inside the last match taken is dropped, and covers nothing
    def take(acc, x):
        return F.when(x["pos"] >= acc["end"], F.struct(
            (x["pos"] + x["len"]).alias("end"), F.concat(acc["m"], F.array(x)).alias("m"))).otherwise(acc)

    none = F.array().cast(f"array<{HIT_DDL}>")

    def take_block(acc, block):
        # a fold copies what it has taken at each step, so it runs over blocks of fixed length
        part = F.aggregate(block, F.struct(acc["end"].alias("end"), none.alias("m")), take)
        return F.element_at(F.transform(F.array(part), lambda p: F.struct(
            p["end"].alias("end"), F.concat(acc["m"], p["m"]).alias("m"))), 1)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_h") - 1) / FOLD).cast("int")),
                         lambda k: F.slice("_h", k * FOLD + 1, F.lit(FOLD)))
    # matches come in order; only texts with phrases of several words can hold overlapping ones
    taken = F.when(F.exists("_h", lambda x: x["len"] > 1), F.aggregate(
        blocks, F.struct(F.lit(0).alias("end"), none.alias("m")), take_block, lambda acc: acc["m"])).otherwise(F.col("_h"))
    c = b.select(*keep, "n_tokens", F.transform(taken, lambda x: F.struct(
        x["pos"].alias("pos"), x["cls"].alias("cls"), x["len"].alias("len"),
        _weights(x["cls"], POLARITY, 0.0).alias("pol"), _weights(x["cls"], MODIFIER, 1.0).alias("mod"))).alias("_m"))

    # score: polarity x modifiers of matches in the CONTEXT tokens before (non-matches weigh 1)
    m = F.col("_m")
    zs = F.slice(F.arrays_zip(m.alias("c"), *[_behind(m, j, HIT).alias(f"p{j}")
                                               for j in range(1, CONTEXT + 1)]), 1, F.size(m))

    def score(x):
        s = x["c"]["pol"]
        for j in range(1, CONTEXT + 1):
            p = x[f"p{j}"]
            near = p.isNotNull() & (x["c"]["pos"] - p["pos"] <= CONTEXT)
            s = s * F.when(near, p["mod"]).otherwise(F.lit(1.0))
        return s

    d = c.select(*keep, "n_tokens", "_m", F.transform(zs, score).alias("_s"))

    def total(f):
        return F.aggregate("_s", F.lit(0.0), lambda acc, y: acc + f(y))

    s = total(lambda y: y)
    p = total(lambda y: F.when(y > 0, y + 1).otherwise(0.0))
    n = total(lambda y: F.when(y < 0, 1 - y).otherwise(0.0))
    n_pos = F.size(F.filter("_s", lambda y: y > 0))
    n_neg = F.size(F.filter("_s", lambda y: y < 0))
    # tokens inside phrases after the first
    covered = F.aggregate("_m", F.lit(0), lambda acc, x: acc + x["len"] - 1)
    e = d.select(*keep, "n_tokens", s.alias("s"), p.alias("p"), n.alias("n"),
                 n_pos.alias("n_pos"), n_neg.alias("n_neg"), covered.alias("n_cov"))
    z0 = (F.col("n_tokens") - F.col("n_cov") - F.col("n_pos") - F.col("n_neg")).cast("double")
    tot = F.col("p") + F.col("n") + z0

    def share(v):
        return F.when(tot > 0, v / tot).otherwise(F.lit(0.0))

    return e.select(
        *keep, "n_tokens", F.col("s").alias("score_sum"), share(F.col("p")).alias("pos"),
        share(F.col("n")).alias("neg"), share(z0).alias("neu"),
        (F.col("s") / F.sqrt(F.col("s") * F.col("s") + F.lit(ALPHA))).alias("compound"),
        "n_pos", "n_neg")


# ---------------------------------------------------------------- sentence labels and confidences

LABEL_WEIGHT = {"positive": 1.0, "negative": -1.0}  # fixed values: label -> sign


def zip_shortest(a: Column, b: Column, names=("a", "b")) -> Column:
    """Pairs of equal positions, cut to the shorter array (``arrays_zip`` alone pads with NULL)."""
    return F.slice(F.arrays_zip(a.alias(names[0]), b.alias(names[1])), 1,
                   F.least(F.size(a), F.size(b)))


def signed_confidence(annotated: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per key: Σ sign(label) × confidence, its mean over sentences, and unknown-label count.

    ``annotated`` has one row per sentence: key, idx (1-based), label, confidence (text). Unknown
    labels weigh 0 and are counted; confidences that are no number, or too large for DECIMAL(20,6),
    count as sentences with no weight and in ``n_bad_confidence``. Products are summed as decimals, so the
    total does not depend on summation order. ``details`` lists the sentences in order.
    """
    w = F.lit(0.0)
    for lab, v in LABEL_WEIGHT.items():
        w = F.when(F.col("label") == lab, F.lit(v)).otherwise(w)
    conf = F.col("confidence").try_cast("double")
    exact = (w * conf).try_cast("decimal(20,6)")
    contrib = F.coalesce(exact, F.lit(0).cast("decimal(20,6)"))
    g = annotated.groupBy(key).agg(
        F.sum(contrib).cast("double").alias("score"), F.count(F.lit(1)).alias("n_sentences"),
        F.sum(F.when(F.col("label").isin(*LABEL_WEIGHT), 0).otherwise(1)).alias("n_unknown"),
        F.sum(F.when(exact.isNull(), 1).otherwise(0)).alias("n_bad_confidence"),
        F.sort_array(F.collect_list(F.struct("idx", "label", "confidence"))).alias("details"))
    return g.withColumn("normalized_score",
                        F.when(F.col("n_sentences") > 0, F.col("score") / F.col("n_sentences")))
