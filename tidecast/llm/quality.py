"""Quality rules: a threshold table compiled into one Spark projection, with no user functions.

``RULES`` holds (name, metric, low, high, least words). A metric is a SQL expression over the measured
columns; a text fails a rule when the metric lies outside [low, high] and the text has at least the
given number of words. Rejection is the base test (too short, or too many repeated five-word windows)
or any failed rule.

Defined cases: a null text counts as an empty one; an empty text has no words and fails the base test;
a text of fewer than five words has no window; repeated rows each get their own equal result; measured
columns replace input columns of the same name; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, text_or_empty

# The characters counted as symbols and the stop words of the four languages.
SYMBOLS = "#*$%&|<>"
STOP_WORDS = ("the be to of and that have with is in for on "
              "der die das und ist ein eine von zu den mit auch "
              "le la les de des et un une est que pour dans "
              "el los las del en y por con una es para su").split()

RULES = (
    ("word_length", "word_chars / nullif(n_words, 0)", 2.0, 14.0, 10),
    ("symbol_ratio", "n_symbols / nullif(n_words, 0)", 0.0, 0.1, 10),
    ("stop_word_ratio", "n_stop_words / nullif(n_words, 0)", 0.005, 1.0, 100),
    ("duplicate_line_ratio", "n_dup_lines / nullif(n_lines, 0)", 0.0, 0.5, 10),
    ("bullet_line_ratio", "n_bullet_lines / nullif(n_lines, 0)", 0.0, 0.9, 10),
    ("ellipsis_line_ratio", "n_ellipsis_lines / nullif(n_lines, 0)", 0.0, 0.3, 10),
)
BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _tail(a: Column, start: int) -> Column:
    return F.slice(a, F.lit(start), F.greatest(F.size(a), F.lit(1)))


def _starts(x: Column, *marks: str) -> Column:
    return functools.reduce(lambda a, b: a | b, [F.startswith(x, F.lit(m)) for m in marks])


def _ends(x: Column, *marks: str) -> Column:
    return functools.reduce(lambda a, b: a | b, [F.endswith(x, F.lit(m)) for m in marks])


def _covered(starts: Column) -> Column:
    """Positions covered by windows of five that begin at the given ascending starts."""
    gaps = F.zip_with(starts, _tail(starts, 2), lambda a, b: F.least(F.lit(5), F.coalesce(b - a, F.lit(5))))
    return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)


def _windows(words: Column, first: Column, pair) -> Column:
    """One value for each five-word window, built by pairing neighbours: 1 + 1, 2 + 2, 4 + 1."""
    return _let(first, lambda w1: _let(
        F.zip_with(w1, _tail(w1, 2), pair), lambda w2: _let(
            F.zip_with(w2, _tail(w2, 3), pair), lambda w4: F.slice(
                F.zip_with(w4, _tail(w1, 5), pair), F.lit(1), F.greatest(F.size(words) - 4, F.lit(0))))))


def _repeated_words(words: Column) -> Column:
    """Words in five-word windows that occur twice or more, comparing the windows' words themselves."""
    windows = _windows(words, words, lambda a, b: F.concat_ws(" ", a, b))
    # Ordered by hash first: numbers compare faster than texts, which decide only between equal hashes.
    placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(
        F.xxhash64(w).alias("h"), w.alias("w"), i.alias("i"))))
    return _let(placed, lambda p: _let(
        F.sort_array(F.array_distinct(F.flatten(F.zip_with(
            p, _tail(p, 2),
            lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])).otherwise(
                F.array().cast("array<int>")))))),
        _covered))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the measured columns to each row. Everything stays inside the row: no exchange."""
    names = [c for c in docs.columns if c not in MEASURES]
    t = text_or_empty(F.col(f"`{text_col}`"))
    has_word = lambda x: F.length(F.translate(x, BLANKS, "")) > 0
    split = docs.select(
        *[F.col(f"`{c}`") for c in names], t.alias("__t"),
        F.filter(F.split(t, r"[\x20\x09-\x0D]+", -1), lambda w: w != "").alias("__words"),
        F.filter(F.split(t, "\n", -1), has_word).alias("__lines"))
    words, lines, text = F.col("__words"), F.col("__lines"), F.col("__t")
    hashed = split.withColumn("__hashes", _windows(
        words, F.transform(words, lambda w: F.xxhash64(w)), lambda a, b: F.xxhash64(a, b)))
    hashes = F.col("__hashes")
    count = lambda a, test: F.size(F.filter(a, test)).cast("long")
    made = {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        # Distinct hashes prove distinct windows; only other texts pay for comparing the words.
        "n_repeat_words": F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0))
                           .otherwise(_repeated_words(words)).cast("long"),
        "n_stop_words": count(words, lambda w: F.lower(w).isin(STOP_WORDS)),
        "n_bullet_lines": count(lines, lambda x: _starts(F.ltrim(x, F.lit(BLANKS)), "- ", "* ", "• ")),
        "n_ellipsis_lines": count(lines, lambda x: _ends(F.rtrim(x, F.lit(BLANKS)), "...", "…")),
    }
    return hashed.select(*[F.col(f"`{c}`") for c in names], *[v.alias(k) for k, v in made.items()])


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
            "n_stop_words", "n_bullet_lines", "n_ellipsis_lines", "base_failed", "reasons", "kept")


def rule_sql(rules=RULES) -> tuple[str, str, str]:
    """The SQL of base_failed, the failed rules' names joined by commas, and kept."""
    tests = {name: f"n_words >= {least} and ({metric} < {low} or {metric} > {high})"
             for name, metric, low, high, least in rules}
    reasons = "concat_ws(',', " + ", ".join(f"case when {t} then '{n}' end" for n, t in tests.items()) + ")"
    any_rule = " or ".join(f"coalesce({t}, false)" for t in tests.values()) or "false"
    return f"({BASE_FAILED})", reasons, f"not ({BASE_FAILED}) and not ({any_rule})"


def quality_rules(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """Every row with its measures, ``base_failed``, the names of failed rules, and ``kept``."""
    base, reasons, kept = rule_sql(rules)
    return measure(docs, text_col).withColumns({
        "base_failed": F.expr(base), "reasons": F.expr(reasons), "kept": F.expr(kept)})


def _sql() -> str:
    base, reasons, kept = rule_sql()
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)),
                              lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
           FROM documents),
w AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS s FROM d, unnest(range(1, len(ws) - 3)) AS u(i)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM w) WHERE c > 1),
n AS (SELECT rid, sum(least(5, coalesce(nx - i, 5))) AS n FROM (
        SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM r) GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(n.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(ws, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words,
             len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-•*] ')))::BIGINT AS n_bullet_lines,
             len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')))::BIGINT AS n_ellipsis_lines
      FROM d LEFT JOIN n USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       {base} AS base_failed, {kept} AS kept, {reasons} AS reasons FROM m"""


SQL = _sql()


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                      "n_repeat_words", "base_failed", "kept", "reasons")
