"""Article and page text: paragraph extraction from HTML, search, time windows, top-N, concatenation.

Everything is column expressions (regex and higher-order array functions run in the JVM), applied to
whole texts; per-company selections use a window-group limit so no company's rows gather in one task
beyond the N kept.
"""

from __future__ import annotations

import math
from datetime import datetime, timedelta
from html.entities import html5

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lookup import hashed_map, look_up
from ..sources import tables as T

NO_CONTENT = "No readable content found."  # fixed value: text of a page without paragraphs

# Elements whose start or end closes an open paragraph (HTML parsing rules), plus the document ends.
_BLOCK_TAGS = ("p|div|article|aside|section|header|footer|nav|main|h[1-6]|ul|ol|dl|table|form|"
               "blockquote|pre|hr|figure|address|fieldset|body|html")
_DROP = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
_P_OPEN = r"(?i)<p(?:\s[^>]*)?>"
_CUT = r"(?is)</?(?:" + _BLOCK_TAGS + r")\b.*$"

# Named character references that end in a semicolon, all of the standard's, as Python's library lists them.
ENTITIES = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
NAMED = r"^([A-Za-z][A-Za-z0-9]*);"  # what follows & in a named reference
NUMERIC = r"^([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"  # what follows &# in a numeric reference
MAX_CODE = 0x10FFFF


def _reference(piece: Column, names) -> Column:
    """The text after ``&``: a numeric or named reference becomes its characters, anything else stays."""
    rest = F.substring(piece, 2, 1 << 30)
    ref = F.when(F.startswith(piece, F.lit("#")), F.regexp_extract(rest, NUMERIC, 1)).otherwise("")
    hexed = F.lower(F.substring(ref, 1, 1)) == "x"
    n = F.when(hexed, F.conv(F.substring(ref, 2, 6), 16, 10)).otherwise(ref).try_cast("int")
    fine = (ref != "") & n.between(1, MAX_CODE) & ~n.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    named = look_up(names, F.regexp_extract(piece, NAMED, 1))
    return (F.when(F.coalesce(fine, F.lit(False)), F.concat(char, F.regexp_replace(rest, NUMERIC, "")))
            .when(named.isNotNull(), F.concat(named, F.regexp_replace(piece, NAMED, "")))
            .otherwise(F.concat(F.lit("&"), piece)))


def decode_entities(c: Column) -> Column:
    """Character references decoded once, from left to right: ``&amp;lt;`` gives ``&lt;``."""
    names = hashed_map(ENTITIES)
    pieces = F.split(c, "&", -1)
    return F.when(F.instr(c, "&") == 0, c).otherwise(F.concat(F.element_at(pieces, 1), F.array_join(
        F.transform(F.slice(pieces, 2, 1 << 30), lambda p: _reference(p, names)), "")))


def paragraph_texts(html: Column) -> Column:
    """Array of the visible text of each ``p`` element, in document order, blanks removed."""
    body = F.regexp_replace(html, _DROP, "")
    pieces = F.slice(F.split(body, _P_OPEN), 2, 1 << 30)

    def clean(x):
        x = F.regexp_replace(x, _CUT, "")
        x = F.regexp_replace(x, r"<[^>]*>", " ")
        x = decode_entities(x)
        return F.trim(F.regexp_replace(x, r"\s+", " "))

    return F.filter(F.transform(pieces, clean), lambda s: s != "")


def page_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Paragraph text of each page joined with single spaces; the fixed fallback when empty.

    ``status`` is ``error`` for a page that was not fetched (null), ``empty`` for one without paragraph
    text, else ``ok``; only ``ok`` texts are for scoring.
    """
    joined = F.array_join(paragraph_texts(F.col(html)), " ")
    return pages.select(
        "*", F.coalesce(F.nullif(joined, F.lit("")), F.lit(NO_CONTENT)).alias("text"),
        F.when(F.col(html).isNull(), F.lit("error")).when(joined == "", F.lit("empty"))
         .otherwise(F.lit("ok")).alias("status")
    ).drop(html)


def tokens(text: Column) -> Column:
    """Lower-case ASCII word tokens."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda t: t != "")


def query_words(query: str) -> Column:
    return F.array(*[F.lit(w) for w in query.lower().split()])


def relevance(text: Column, query: str) -> Column:
    """Number of tokens of ``text`` equal to a word of ``query``."""
    words = query_words(query)
    return F.size(F.filter(tokens(text), lambda t: F.array_contains(words, t)))


def doc_id_range(start: str | None, end: str | None) -> tuple[int | None, int | None]:
    """Bounds on doc_id implied by a publication-time range (lets the scan skip row groups)."""
    origin = datetime.fromisoformat(T.ARTICLE_ORIGIN)
    step = timedelta(minutes=T.ARTICLE_SPACING_MINUTES)
    lo = None if start is None else max(0, math.ceil((datetime.fromisoformat(start) - origin) / step))
    hi = None if end is None else math.ceil((datetime.fromisoformat(end) - origin) / step)
    return lo, hi


def articles_between(spark, sf_dir: str, start: str | None, end: str | None) -> DataFrame:
    """Articles published in [start, end), with the equivalent doc_id range pushed to the scan."""
    a = T.articles(spark, sf_dir)
    lo, hi = doc_id_range(start, end)
    if lo is not None:
        a = a.where(F.col("doc_id") >= lo)
    if hi is not None:
        a = a.where(F.col("doc_id") < hi)
    if start is not None:
        a = a.where(F.col("published_at") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        a = a.where(F.col("published_at") < F.lit(end).cast("timestamp_ntz"))
    return a


def news_window_bounds(as_of: datetime, hours: int = 1, lag_days: int = 1) -> tuple[str, str]:
    """Default window: one hour ending a day before ``as_of``, cut to whole seconds."""
    end = as_of.replace(microsecond=0) - timedelta(days=lag_days)
    start = end - timedelta(hours=hours)
    return start.isoformat(sep=" "), end.isoformat(sep=" ")


def search(articles: DataFrame, company: str, lang: str = "en", page_size: int = 100) -> DataFrame:
    """``"<company> stock"`` search: matching articles in ``lang`` by relevance, top ``page_size``."""
    q = f"{company} stock"
    scored = (articles.where(F.col("lang") == lang)
              .withColumn("score", relevance(F.col("text"), q))
              .where(F.col("score") > 0))
    return (scored.orderBy(F.col("score").desc(), F.col("doc_id").asc()).limit(page_size)
            .select("doc_id", "title", F.regexp_extract("text", r"^[^\n]*", 0).alias("description"), "url",
                    "score"))


INDEX_BUCKETS = 64


def build_index(articles: DataFrame, path: str, buckets: int = INDEX_BUCKETS) -> str:
    """Write an inverted index of whole articles under ``path``: ``postings`` (term, doc_id, tf), in buckets by term,
    and ``facts`` (doc_id, company, lang, published_at, title, description, url, n_tokens), which hold no text.

    A NULL text has no token. Articles that share an id count as one text. Terms are counted where the text is read,
    so a frequent term costs one row an article.
    """
    spark = articles.sparkSession
    posts = articles.select("doc_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(
        F.count("*").alias("tf")).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    # a bucket is as many files as tasks: no bucket passes through one task, however frequent its terms; files need rows
    # ordered by bucket only, a number, which sorts far faster than terms
    posts.sortWithinPartitions("bucket").write.partitionBy("bucket").parquet(f"{path}/postings")
    articles.select("doc_id", "company", "lang", "published_at", "title", F.regexp_extract("text", r"^[^\n]*", 0).alias("description"),
                    "url", F.coalesce(F.size(tokens(F.col("text"))), F.lit(0)).alias("n_tokens")).write.parquet(f"{path}/facts")
    return path


def search_index(spark, path: str, queries: DataFrame, page_size: int = 100, lang: str | None = None, start: str | None = None,
                 end: str | None = None, buckets: int = INDEX_BUCKETS) -> DataFrame:
    """(query, rank, score, and the facts) of the ``page_size`` best articles of every (query, words) row.

    The score is the number of the article's tokens that are words of the query, ties go to the smaller id. Only the
    buckets of the queries' words are read, and each query's top comes from partial tops of the tasks.
    """
    words = queries.select("query", F.explode(F.array_distinct(tokens(F.col("words")))).alias("term")).distinct()
    words = words.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    # numbers below ``buckets``, for the scan to leave out all others
    read = [r.bucket for r in words.select("bucket").distinct().collect()]
    facts = spark.read.parquet(f"{path}/facts").dropDuplicates(["doc_id"])
    if lang is not None:
        facts = facts.where(F.col("lang") == lang)
    if start is not None:
        facts = facts.where(F.col("published_at") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        facts = facts.where(F.col("published_at") < F.lit(end).cast("timestamp_ntz"))
    kinds = facts.schema["doc_id"].dataType.simpleString()
    posts = spark.read.schema(f"doc_id {kinds}, term STRING, tf BIGINT, bucket INT").parquet(f"{path}/postings")
    posts = posts.where(F.col("bucket").isin(read)).join(words, ["bucket", "term"])
    scored = posts.groupBy("query", "doc_id").agg(F.sum("tf").alias("score"))
    if (lang, start, end) != (None, None, None):
        scored = scored.join(facts.select("doc_id"), "doc_id", "left_semi")
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "doc_id")
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= page_size)
    return top.join(facts, "doc_id").select("query", "rank", "score", *facts.columns)


def top_n_per_company(articles: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` articles per company, newest first (rank 1 = newest)."""
    w = Window.partitionBy("company").orderBy(F.col("published_at").desc(), F.col("doc_id").desc())
    return articles.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def concat_per_group(ranked: DataFrame, group: str = "company") -> DataFrame:
    """Title then text of each article in rank order, no separator, per group.

    Input must already be limited per group (``top_n_per_company``): the list gathered per group
    is bounded by that N.
    """
    g = ranked.groupBy(group).agg(
        F.sort_array(F.collect_list(F.struct("rank", "title", "text"))).alias("arts"))
    return g.select(group, F.size("arts").alias("n_articles"),
                    F.array_join(F.transform("arts", lambda a: F.concat(a["title"], a["text"])),
                                 "").alias("news_text"))
