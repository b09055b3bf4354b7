"""Named queries: each operator run over the driver tables, with its DuckDB twin where SQL can say it.

Every entry is ``name -> (fn(spark, sf_dir) -> DataFrame, sql or None)``. Array results are returned
in long form (one row per element, with its position) so they compare value by value; dates are
returned as ``yyyy-MM-dd`` strings and counts as BIGINT in both engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import states as ST
from . import series
from ..operators import windows as W
from ..session import scratch_path, written
from ..sources import tables as T

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def _fresh(spark, name: str) -> str:
    """A new path for a written table in the shared folder."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql.strip() if sql else None)
        return fn
    return deco


# ---------------------------------------------------------------- SQL building blocks (DuckDB)

def sql_bars(unit: str, name: str = "bars") -> str:
    return f"""{name} AS (
  SELECT event_type AS ticker, date_trunc('{unit}', ts) AS bar_ts,
         arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close, count(*) AS n_ticks
  FROM events GROUP BY 1, 2)"""


SQL_DAILY = """daily AS (
  SELECT o_orderpriority AS ticker, date_trunc('day', o_orderdate) AS bar_ts,
         arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close,
         count(*) AS n_ticks
  FROM orders GROUP BY 1, 2)"""

SQL_SCALE = "(close - mn) / (CASE WHEN mx = mn THEN 1.0 ELSE mx - mn END)"


def _hourly(spark, sf):
    return B.resample(T.ticks(spark, sf), "hour")


def _daily(spark, sf):
    return B.resample(T.daily_prices(spark, sf), "day")


# ---------------------------------------------------------------- bars and series

@query("bars_hourly", f"WITH {sql_bars('hour')} SELECT * FROM bars")
def q_bars_hourly(spark, sf):
    return _hourly(spark, sf)


@query("bars_minute", f"WITH {sql_bars('minute')} SELECT * FROM bars")
def q_bars_minute(spark, sf):
    return B.resample(T.ticks(spark, sf), "minute")


@query("bars_daily", f"WITH {SQL_DAILY} SELECT * FROM daily")
def q_bars_daily(spark, sf):
    return _daily(spark, sf)


def _r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


@query("bars_rollup", " UNION ALL ".join(f"""
SELECT '{u}' AS unit, event_type AS ticker, date_trunc('{u}', ts) AS bar_ts, arg_min(value, (ts, event_id)) AS open,
       max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n_ticks,
       {_r6('avg(value)')} AS mean, {_r6('stddev_samp(value)')} AS std
FROM events GROUP BY 2, 3""" for u in ("hour", "day")))
def q_bars_rollup(spark, sf):
    """Hours and days from stored minute states: a quarter of the ticks comes late, in a second batch."""
    ticks, late = T.ticks(spark, sf), F.pmod(F.xxhash64("seq"), F.lit(4)) == 0
    store = ST.BarStore(spark, _fresh(spark, "bar-states"))
    store.add(ticks.where(~late), 0)
    store.add(ticks.where(late), 1)
    out = None
    for unit, states in store.states("hour", "day").items():
        b = ST.bars_of(states).select(F.lit(unit).alias("unit"), "ticker", "bar_ts", "open", "high", "low", "close", "n_ticks",
                                      _round6(F.col("mean")).alias("mean"), _round6(F.col("std")).alias("std"))
        out = b if out is None else out.unionByName(b)
    return out


LOOKBACK_AS_OF = "2024-01-25 10:00:00"


@query("bars_lookback", f"""
WITH {sql_bars('hour')}
SELECT * FROM bars
WHERE bar_ts >= CAST(CAST(TIMESTAMP '{LOOKBACK_AS_OF}' - INTERVAL 528 HOUR AS DATE) AS TIMESTAMP)
  AND bar_ts < CAST(CAST(TIMESTAMP '{LOOKBACK_AS_OF}' AS DATE) AS TIMESTAMP)""")
def q_bars_lookback(spark, sf):
    return B.lookback_bars(T.ticks(spark, sf), LOOKBACK_AS_OF, 60, "h")


@query("tail_n", f"""
WITH {sql_bars('hour')},
r AS (SELECT ticker, bar_ts, close,
             row_number() OVER (PARTITION BY ticker ORDER BY bar_ts DESC) AS rn FROM bars)
SELECT ticker, bar_ts, close, CAST(rn AS INTEGER) AS rn FROM r WHERE rn <= 60""")
def q_tail_n(spark, sf):
    return B.tail_n(_hourly(spark, sf), 60).select("ticker", "bar_ts", "close", "rn")


@query("minmax_series", f"""
WITH {sql_bars('hour')},
s AS (SELECT ticker, bar_ts, close, min(close) OVER (PARTITION BY ticker) AS mn,
             max(close) OVER (PARTITION BY ticker) AS mx FROM bars)
SELECT ticker, bar_ts, close, mn, mx, {SQL_SCALE} AS scaled FROM s""")
def q_minmax_series(spark, sf):
    return B.minmax_series(_hourly(spark, sf)).select("ticker", "bar_ts", "close", "mn", "mx",
                                                      "scaled")


SQL_WINDOW_MINMAX = f"""
WITH {sql_bars('hour')},
w AS (SELECT ticker, bar_ts, close,
             row_number() OVER (PARTITION BY ticker ORDER BY bar_ts) - 1 AS idx,
             min(close) OVER k AS mn, max(close) OVER k AS mx, count(*) OVER k AS n
      FROM bars
      WINDOW k AS (PARTITION BY ticker ORDER BY bar_ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
s AS (SELECT ticker, bar_ts, idx, close, mn, mx, {SQL_SCALE} AS scaled FROM w WHERE n = 60)"""


@query("window_minmax", SQL_WINDOW_MINMAX + " SELECT * FROM s")
def q_window_minmax(spark, sf):
    return W.window_minmax(_hourly(spark, sf))


@query("minmax_roundtrip", SQL_WINDOW_MINMAX + """
SELECT ticker, bar_ts, close, scaled, scaled * (mx - mn) + mn AS restored,
       abs(scaled * (mx - mn) + mn - close) <= 1e-9 AS exact FROM s""")
def q_minmax_roundtrip(spark, sf):
    return W.minmax_roundtrip(W.window_minmax(_hourly(spark, sf)))


@query("sequence_windows", f"""
WITH {sql_bars('hour')},
s AS (SELECT ticker, bar_ts, close, min(close) OVER (PARTITION BY ticker) AS mn,
             max(close) OVER (PARTITION BY ticker) AS mx FROM bars),
c AS (SELECT ticker, bar_ts, {SQL_SCALE} AS scaled FROM s),
w AS (SELECT ticker, bar_ts, scaled AS label,
             row_number() OVER (PARTITION BY ticker ORDER BY bar_ts) - 1 AS idx,
             list(scaled) OVER (PARTITION BY ticker ORDER BY bar_ts
                                ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS seq FROM c)
SELECT ticker, bar_ts, idx, label, CAST(p - 1 AS INTEGER) AS pos, seq[p] AS v
FROM w, range(1, 61) t(p) WHERE len(seq) = 60""")
def q_sequence_windows(spark, sf):
    sw = W.sequence_windows(_hourly(spark, sf))
    return sw.select("ticker", "bar_ts", "idx", "label", F.posexplode("seq").alias("pos", "v"))


@query("forecast_input", f"""
WITH {sql_bars('hour')},
r AS (SELECT ticker, bar_ts, close,
             row_number() OVER (PARTITION BY ticker ORDER BY bar_ts DESC) AS rn FROM bars),
t AS (SELECT * FROM r WHERE rn <= 60),
g AS (SELECT ticker, max(bar_ts) AS as_of, min(close) AS mn, max(close) AS mx, count(*) AS n
      FROM t GROUP BY ticker)
SELECT t.ticker, g.as_of, CAST(60 - t.rn AS INTEGER) AS pos, t.close AS v,
       (t.close - g.mn) / (CASE WHEN g.mx = g.mn THEN 1.0 ELSE g.mx - g.mn END) AS v_scaled
FROM t JOIN g USING (ticker) WHERE g.n = 60""")
def q_forecast_input(spark, sf):
    fi = W.forecast_input(_hourly(spark, sf))
    return fi.select("ticker", "as_of",
                     F.posexplode(F.arrays_zip("seq", "seq_scaled")).alias("pos", "z")
                     ).select("ticker", "as_of", "pos", F.col("z.seq").alias("v"),
                              F.col("z.seq_scaled").alias("v_scaled"))


# ---------------------------------------------------------------- keyed store

from ..operators import kv as KV  # noqa: E402
from ..operators import kvstore as KS  # noqa: E402
from ..functions import scalars as S  # noqa: E402

SQL_WRITES = """writes AS (
  SELECT 'cust_' || CAST(o_custkey AS VARCHAR) AS key,
         CASE WHEN o_orderstatus = 'F'
              THEN '{"orderkey": ' || CAST(o_orderkey AS VARCHAR) || ', "status": "F"}'
              WHEN o_orderstatus = 'P' THEN '{"orderkey": ' || CAST(o_orderkey AS VARCHAR) || '} trailing'
              ELSE 'raw-' || CAST(o_orderkey AS VARCHAR) END AS value,
         o_orderdate AS written_at, o_orderkey AS seq,
         CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(trunc(o_totalprice) AS BIGINT) END
           AS ttl_seconds
  FROM orders),
store AS (
  SELECT key, value, written_at, seq, ttl_seconds FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY written_at DESC, seq DESC) AS rn
    FROM writes) WHERE rn = 1),
probe AS (SELECT 'cust_' || CAST(c_custkey AS VARCHAR) AS key, c_mktsegment FROM customer)"""

UPSERT_SPLIT = "1998-01-01 00:00:00"
TTL_AS_OF = "2000-01-01 00:00:00"

# the store as of a time: the latest write up to it, gone when its time to live has passed
SQL_LIVE = SQL_WRITES + f""",
live AS (
  SELECT key, value, written_at FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY written_at DESC, seq DESC) AS rn
    FROM writes WHERE written_at <= TIMESTAMP '{TTL_AS_OF}')
  WHERE rn = 1 AND (ttl_seconds IS NULL OR written_at + to_seconds(ttl_seconds) > TIMESTAMP '{TTL_AS_OF}'))"""


def _writes(spark, sf):
    return T.kv_writes(spark, sf)


def _probe(spark, sf):
    return T.table(spark, sf, "customer").select(
        F.concat(F.lit("cust_"), F.col("c_custkey").cast("string")).alias("key"), "c_mktsegment")


@query("kv_upsert_latest", f"""
WITH {SQL_WRITES}
SELECT key, value, written_at, seq, CAST(ttl_seconds AS DOUBLE) AS ttl_seconds FROM store""")
def q_kv_upsert_latest(spark, sf):
    w = _writes(spark, sf)
    cut = F.lit(UPSERT_SPLIT).cast("timestamp_ntz")
    old = KV.latest_per_key(w.where(F.col("written_at") < cut), "key", "written_at", "seq")
    new = KV.upsert(old, w.where(F.col("written_at") >= cut))
    # nullable integers are returned as DOUBLE so both engines hand back the same column type
    return new.withColumn("ttl_seconds", F.col("ttl_seconds").cast("double"))


@query("kv_lookup", f"""
WITH {SQL_LIVE}
SELECT p.key, s.value IS NOT NULL AS found, s.value,
       coalesce(json_valid(s.value), false) AS is_json,
       CASE WHEN json_valid(s.value)
            THEN CAST(CAST(json_extract_string(s.value, '$.orderkey') AS BIGINT) AS DOUBLE)
       END AS orderkey,
       CASE WHEN json_valid(s.value) THEN json_extract_string(s.value, '$.status') END AS status
FROM probe p LEFT JOIN live s USING (key)""")
def q_kv_lookup(spark, sf):
    store = KV.state(_writes(spark, sf), TTL_AS_OF)
    r = KV.lookup(store, _probe(spark, sf), "orderkey BIGINT, status STRING")
    return r.select("key", "found", "value", "is_json",
                    F.col("parsed.orderkey").cast("double").alias("orderkey"),
                    F.col("parsed.status").alias("status"))


@query("kv_exists", f"""
WITH {SQL_LIVE}
SELECT key FROM probe p WHERE EXISTS (SELECT 1 FROM live s WHERE s.key = p.key)""")
def q_kv_exists(spark, sf):
    return KV.exists(KV.state(_writes(spark, sf), TTL_AS_OF), _probe(spark, sf)).select("key")


@query("kv_delete", f"""
WITH {SQL_LIVE},
dels AS (SELECT DISTINCT key FROM probe WHERE c_mktsegment = 'AUTOMOBILE')
SELECT s.key, CASE WHEN d.key IS NULL THEN value END AS value,
       CASE WHEN d.key IS NULL THEN written_at END AS written_at, d.key IS NOT NULL AS removed
FROM live s LEFT JOIN dels d ON d.key = s.key""")
def q_kv_delete(spark, sf):
    dels = _probe(spark, sf).where(F.col("c_mktsegment") == "AUTOMOBILE")
    remaining, removed = KV.delete(KV.state(_writes(spark, sf), TTL_AS_OF), dels)
    return remaining.select("key", "value", "written_at", F.lit(False).alias("removed")).unionByName(
        removed.select("key", F.lit(True).alias("removed")), allowMissingColumns=True)


@query("kv_ttl_live", f"""
WITH {SQL_WRITES},
latest_asof AS (SELECT key, value, written_at, ttl_seconds FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY written_at DESC, seq DESC) AS rn
    FROM writes WHERE written_at <= TIMESTAMP '{TTL_AS_OF}') WHERE rn = 1),
e AS (SELECT key, value, written_at,
             CASE WHEN ttl_seconds IS NOT NULL THEN written_at + to_seconds(ttl_seconds) END
               AS expires_at FROM latest_asof)
SELECT * FROM e WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{TTL_AS_OF}'""")
def q_kv_ttl_live(spark, sf):
    return KV.state(_writes(spark, sf), TTL_AS_OF).select("key", "value", "written_at",
                                                          "expires_at")


@query("kv_store_merge", f"""
WITH {SQL_WRITES}
SELECT key, value, written_at, seq, CAST(ttl_seconds AS DOUBLE) AS ttl_seconds FROM store""")
def q_kv_store_merge(spark, sf):
    """The same state from the stored table: the writes come in five batches, in no order of time."""
    store = KS.KeyedStore(spark, _fresh(spark, "kv-store"), buckets=16, turns=4)
    for k in range(5):
        store.commit(_writes(spark, sf).where(F.pmod(F.xxhash64("seq"), F.lit(5)) == k), k)
    return store.read().select("key", "value", "written_at", "seq", F.col("ttl_seconds").cast("double").alias("ttl_seconds"))


@query("latest_per_key", """
SELECT o_orderpriority AS key, o_orderkey, o_orderdate, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority
                               ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
WHERE rn = 1""")
def q_latest_per_key(spark, sf):
    o = T.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("key"), "o_orderkey",
                                            "o_orderdate", "o_totalprice")
    return KV.latest_per_key(o, "key", "o_orderdate", "o_orderkey")


# ---------------------------------------------------------------- time, keys, JSON, parsing

SQL_NY = "((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')"
SQL_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _events(spark, sf):
    return T.table(spark, sf, "events")


def _k():
    return F.from_json("props", "k BIGINT")["k"]


@query("result_key", f"""
SELECT event_id, strftime({SQL_NY}, '%Y-%m-%d') || '_' || strftime({SQL_NY}, '%I:%M %p') || '_'
       || event_type AS result_key FROM events""")
def q_result_key(spark, sf):
    e = _events(spark, sf)
    return e.select("event_id", S.result_key(F.col("ts"), S.friendly_time(S.ny_local(F.col("ts"))),
                                             F.col("event_type")).alias("result_key"))


@query("slot_format", f"""
WITH m AS (SELECT event_id, ts, {SQL_NY} AS ny, date_diff('minute', ts, {SQL_NY}) AS off FROM events)
SELECT event_id, strftime(ny, '%I:%M %p') AS friendly, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso19,
       strftime(ts, '%Y-%m-%dT%H:%M:%S')
         || CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END
         || 'Z' AS iso_utc,
       strftime(ny, '%Y-%m-%dT%H:%M:%S') || CASE WHEN off < 0 THEN '-' ELSE '+' END
         || lpad(CAST(abs(off) // 60 AS VARCHAR), 2, '0') || ':'
         || lpad(CAST(abs(off) % 60 AS VARCHAR), 2, '0') AS iso_ny
FROM m""")
def q_slot_format(spark, sf):
    ts = F.col("ts")
    return _events(spark, sf).select(
        "event_id", S.friendly_time(S.ny_local(ts)).alias("friendly"), S.iso19(ts).alias("iso19"),
        S.iso_utc_z(ts).alias("iso_utc"), S.iso_ny(ts).alias("iso_ny"))


@query("payload_json", f"""
SELECT event_id, event_type AS company, strftime({SQL_NY}, '%I:%M %p') AS time,
       value AS predicted_stock_algo,
       value + (({SQL_K} - 50) / 50.0) / 10 AS predicted_stock_senti
FROM events""")
def q_payload_json(spark, sf):
    e = _events(spark, sf)
    senti = (_k() - 50) / F.lit(50.0)
    js = F.to_json(S.payload_struct(F.col("event_type"), S.friendly_time(S.ny_local(F.col("ts"))),
                                    F.col("value"), senti))
    return e.select("event_id", F.from_json(js, S.PAYLOAD_SCHEMA).alias("p")).select(
        "event_id", "p.*")


@query("json_props", f"SELECT event_id, {SQL_K} AS k FROM events")
def q_json_props(spark, sf):
    return _events(spark, sf).select("event_id", _k().alias("k"))


@query("json_default", """
SELECT event_id,
       coalesce(json_extract_string(props, '$.scheduled_time_ny_friendly'), 'N/A') AS slot_friendly,
       coalesce(json_extract_string(props, '$.k'), 'N/A') AS k_text
FROM events""")
def q_json_default(spark, sf):
    return _events(spark, sf).select(
        "event_id", S.json_field_or_default(F.col("props"), "scheduled_time_ny_friendly")
        .alias("slot_friendly"), S.json_field_or_default(F.col("props"), "k").alias("k_text"))


def _reply():
    k = F.get_json_object("props", "$.k")
    return (F.when(F.col("event_type") == "error", F.lit(""))
            .when(F.col("event_type") == "signup", F.lit("positive"))
            .when(F.col("event_type") == "view", F.concat(F.lit(" 0."), k, F.lit(" ")))
            .otherwise(F.regexp_extract("props", r'"k":(.*)}', 1)))


@query("parse_score", """
WITH r AS (SELECT event_id,
  CASE event_type WHEN 'error' THEN '' WHEN 'signup' THEN 'positive'
       WHEN 'view' THEN ' 0.' || json_extract_string(props, '$.k') || ' '
       ELSE regexp_extract(props, '"k":(.*)}', 1) END AS reply FROM events),
p AS (SELECT event_id, reply, CASE WHEN upper(trim(reply)) <> ''
                                   THEN TRY_CAST(upper(trim(reply)) AS DOUBLE) END AS score FROM r)
SELECT event_id, reply, score, coalesce(abs(score) > 1, false) AS out_of_range FROM p""")
def q_parse_score(spark, sf):
    r = _events(spark, sf).select("event_id", _reply().alias("reply"))
    s = r.withColumn("score", S.parse_score(F.col("reply")))
    return s.withColumn("out_of_range", F.coalesce(F.abs("score") > 1, F.lit(False)))


@query("blend", f"SELECT event_id, value + (({SQL_K} - 50) / 50.0) / 10 AS blended FROM events")
def q_blend(spark, sf):
    e = _events(spark, sf)
    return e.select("event_id", S.blend(F.col("value"), (_k() - 50) / F.lit(50.0)).alias("blended"))


# ---------------------------------------------------------------- pages and articles

from ..operators import text as X  # noqa: E402

_BLOCK_SQL = X._BLOCK_TAGS


def _sql_entities(x: str) -> str:
    """Numeric references, and those named ones that the test pages can hold: the twin says the rule on its own table."""
    code = ("CASE WHEN lower(p[2]) = 'x' THEN TRY_CAST('0' || regexp_extract(p, '^#([xX][0-9a-fA-F]{1,6});', 1) AS INTEGER) "
            "ELSE TRY_CAST(regexp_extract(p, '^#([0-9]{1,7});', 1) AS INTEGER) END")
    fine = f"coalesce(p[1] = '#' AND {code} BETWEEN 1 AND {X.MAX_CODE} AND NOT {code} BETWEEN 55296 AND 57343, false)"
    names = {"lt": "<", "gt": ">", "quot": '"', "apos": "''", "nbsp": " ", "amp": "&", "mdash": "—", "ndash": "–",
             "hellip": "…", "eacute": "é", "egrave": "è", "copy": "©", "euro": "€"}
    named = " ".join(f"WHEN starts_with(p, '{n};') THEN '{ch}' || p[{len(n) + 2}:]" for n, ch in names.items())
    return (f"list_reduce(list_transform(string_split({x}, '&'), lambda p, i: CASE WHEN i = 1 THEN p "
            f"WHEN {fine} THEN chr({code}) || regexp_replace(p, '^#([0-9]{{1,7}}|[xX][0-9a-fA-F]{{1,6}});', '') "
            f"{named} ELSE '&' || p END), lambda a, b: a || b)")


SQL_PAGE_TEXT = f"""
WITH a AS (SELECT page_id, url, regexp_replace(html,
       '(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>', '', 'g') AS h FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(string_split_regex(h, '(?i)<p(?:\\s[^>]*)?>')[2:],
       lambda x: trim(regexp_replace({_sql_entities(f"regexp_replace(regexp_replace(x, '(?is)</?(?:{_BLOCK_SQL})\\b.*$', '', 'g'), '<[^>]*>', ' ', 'g')")},
       '\\s+', ' ', 'g'))), lambda x: x <> '') AS ps FROM a),
c AS (SELECT page_id, url, array_to_string(ps, ' ') AS j FROM b)
SELECT page_id, url, coalesce(nullif(j, ''), '{X.NO_CONTENT}') AS text,
       CASE WHEN j IS NULL THEN 'error' WHEN j = '' THEN 'empty' ELSE 'ok' END AS status FROM c"""


@query("page_paragraph_text", SQL_PAGE_TEXT)
def q_page_paragraph_text(spark, sf):
    return X.page_text(T.pages(spark, sf))


SQL_ARTICLES = f"""arts AS (
  SELECT doc_id, source AS company, lang,
         TIMESTAMP '{T.ARTICLE_ORIGIN}' + to_minutes(doc_id * {T.ARTICLE_SPACING_MINUTES})
           AS published_at,
         regexp_extract(text, '^[^.\\n]*', 0) AS title,
         'doc://' || source || '/' || CAST(doc_id AS VARCHAR) AS url, text
  FROM documents)"""

SEARCH_COMPANY = "the"
SEARCH_START, SEARCH_END = "2024-01-01 00:00:00", "2024-02-01 00:00:00"


@query("news_search", f"""
WITH {SQL_ARTICLES},
s AS (SELECT doc_id, title, regexp_extract(text, '^[^\\n]*', 0) AS description, url,
             CAST(len(list_filter(list_filter(string_split_regex(lower(text), '[^a-z]+'),
                                              lambda t: t <> ''),
                                  lambda t: t IN ('{SEARCH_COMPANY}', 'stock'))) AS INTEGER) AS score
      FROM arts WHERE lang = 'en' AND published_at >= TIMESTAMP '{SEARCH_START}'
        AND published_at < TIMESTAMP '{SEARCH_END}')
SELECT * FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 100""")
def q_news_search(spark, sf):
    return X.search(X.articles_between(spark, sf, SEARCH_START, SEARCH_END), SEARCH_COMPANY)


# Stand-in companies for the search over all of them: their names are words of the test texts.
SEARCH_COMPANIES = ("the", "and", "le", "der", "que", "with", "of", "la casa", "absent name")


@query("news_search_all", f"""
WITH {SQL_ARTICLES}, names(company) AS (VALUES {", ".join(f"('{c}')" for c in SEARCH_COMPANIES)}),
q AS (SELECT DISTINCT company AS query, unnest(string_split(company || ' stock', ' ')) AS term FROM names),
tok AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM arts
        WHERE published_at >= TIMESTAMP '{SEARCH_START}' AND published_at < TIMESTAMP '{SEARCH_END}'),
s AS (SELECT query, doc_id, count(*) AS score FROM tok JOIN q USING (term) GROUP BY 1, 2),
r AS (SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query AS company, CAST(rank AS INTEGER) AS rank, doc_id, score, title, regexp_extract(text, '^[^\n]*', 0) AS description, url
FROM r JOIN arts USING (doc_id) WHERE rank <= 100""")
def q_news_search_all(spark, sf):
    """All companies' searches in one plan over an inverted index, which is made here and holds every article."""
    index = X.build_index(T.articles(spark, sf), _fresh(spark, "news-index"))
    queries = spark.createDataFrame([(c, f"{c} stock") for c in SEARCH_COMPANIES], "query STRING, words STRING")
    found = X.search_index(spark, index, queries, page_size=100, start=SEARCH_START, end=SEARCH_END)
    return found.select(F.col("query").alias("company"), "rank", "doc_id", "score", "title", "description", "url")


NEWS_AS_OF = "2024-01-20 12:00:00"


@query("news_window", f"""
WITH {SQL_ARTICLES}
SELECT doc_id, company, published_at, title FROM arts
WHERE published_at >= TIMESTAMP '{NEWS_AS_OF}' - INTERVAL 25 HOUR
  AND published_at < TIMESTAMP '{NEWS_AS_OF}' - INTERVAL 24 HOUR""")
def q_news_window(spark, sf):
    from datetime import datetime
    start, end = X.news_window_bounds(datetime.fromisoformat(NEWS_AS_OF))
    return X.articles_between(spark, sf, start, end).select("doc_id", "company", "published_at",
                                                            "title")


SQL_TOP_N = f"""{SQL_ARTICLES},
ranked AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY company ORDER BY published_at DESC, doc_id DESC) AS rank
  FROM arts) WHERE rank <= 10)"""


@query("news_top_n", f"""
WITH {SQL_TOP_N}
SELECT company, doc_id, CAST(rank AS INTEGER) AS rank, title, url FROM ranked""")
def q_news_top_n(spark, sf):
    return X.top_n_per_company(T.articles(spark, sf), 10).select("company", "doc_id", "rank",
                                                                 "title", "url")


@query("news_text_concat", f"""
WITH {SQL_TOP_N},
c AS (SELECT company, CAST(count(*) AS INTEGER) AS n_articles,
             string_agg(title || text, '' ORDER BY rank) AS t FROM ranked GROUP BY company)
SELECT company, n_articles, md5(t) AS text_md5, CAST(length(t) AS INTEGER) AS n_chars FROM c""")
def q_news_text_concat(spark, sf):
    c = X.concat_per_group(X.top_n_per_company(T.articles(spark, sf), 10))
    return c.select("company", "n_articles", F.md5("news_text").alias("text_md5"),
                    F.length("news_text").alias("n_chars"))


# ---------------------------------------------------------------- sentiment

from ..operators import sentiment as SN  # noqa: E402

# Stand-in lexicon of tokens frequent in the test documents (the shipped dictionary has no hit in
# them); it has 1-, 2-, 3- and 4-word terms so phrase matching and covering are exercised.
PROBE_LEXICON = (
    ("with", "positive"), ("by", "positive"), ("for", "positive"), ("the", "positive"),
    ("from", "negative"), ("was", "negative"), ("at", "negative"), ("the the the the", "negative"),
    ("this", "revert"), ("of the", "revert"), ("are", "increment"), ("the the the", "increment"),
    ("as", "decrement"), ("in the", "positive"), ("the of the", "negative"),
)


def _sql_values(pairs) -> str:
    return ", ".join(f"('{t}', '{c}')" for t, c in pairs)


SQL_LEXICON = f"""
WITH lex(term, cls) AS (VALUES {_sql_values(PROBE_LEXICON)}),
d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), lambda t: t <> '') AS toks
      FROM documents),
tok AS (SELECT doc_id, unnest(range(len(toks))) AS pos, unnest(toks) AS w FROM d),
g AS (SELECT doc_id, pos, w,
             w || ' ' || lead(w, 1) OVER o AS w2,
             w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS w3,
             w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o AS w4
      FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
m AS (SELECT g.doc_id, g.pos, coalesce(l4.cls, l3.cls, l2.cls, l1.cls) AS cls,
             CASE WHEN l4.cls IS NOT NULL THEN 4 WHEN l3.cls IS NOT NULL THEN 3
                  WHEN l2.cls IS NOT NULL THEN 2 WHEN l1.cls IS NOT NULL THEN 1 ELSE 0 END AS len
      FROM g LEFT JOIN lex l1 ON l1.term = g.w LEFT JOIN lex l2 ON l2.term = g.w2
             LEFT JOIN lex l3 ON l3.term = g.w3 LEFT JOIN lex l4 ON l4.term = g.w4),
h AS (SELECT doc_id, list({{'p': pos, 'l': len}} ORDER BY pos) AS hs FROM m WHERE len > 0 GROUP BY doc_id),
-- walk over the hits: take one when it begins at or after the end of the last one taken
k AS (SELECT doc_id, list_reduce(hs, lambda acc, x: CASE WHEN x.p >= acc[-1].p + acc[-1].l
                                                         THEN acc || [x] ELSE acc END,
                                 [{{'p': CAST(-1 AS BIGINT), 'l': 1}}])[2:] AS taken FROM h),
tk AS (SELECT doc_id, unnest(taken).p AS p, unnest(taken).l AS l FROM k),
inner_ AS (SELECT DISTINCT doc_id, p + o AS pos FROM tk, range(1, 4) t(o) WHERE o < l),
c AS (SELECT m.doc_id, m.pos, CASE WHEN tk.p IS NOT NULL THEN m.cls END AS cls, i.pos IS NOT NULL AS cov
      FROM m LEFT JOIN tk ON tk.doc_id = m.doc_id AND tk.p = m.pos
             LEFT JOIN inner_ i ON i.doc_id = m.doc_id AND i.pos = m.pos),
f AS (SELECT doc_id, pos, cov,
             CASE WHEN cov THEN 0.0 WHEN cls = 'positive' THEN 1.0 WHEN cls = 'negative' THEN -1.0
                  ELSE 0.0 END AS pol,
             CASE WHEN cov THEN 1.0 WHEN cls = 'revert' THEN -1.0 WHEN cls = 'increment' THEN 2.0
                  WHEN cls = 'decrement' THEN 0.5 ELSE 1.0 END AS md FROM c),
x AS (SELECT doc_id, cov, CAST(pol AS DOUBLE) * coalesce(lag(md, 1) OVER o, 1.0)
             * coalesce(lag(md, 2) OVER o, 1.0) * coalesce(lag(md, 3) OVER o, 1.0) AS sc
      FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
a AS (SELECT doc_id, count(*) AS n_tokens, sum(sc) AS s,
             sum(CASE WHEN sc > 0 THEN sc + 1 ELSE 0 END) AS p,
             sum(CASE WHEN sc < 0 THEN 1 - sc ELSE 0 END) AS n,
             CAST(sum(CASE WHEN sc = 0 AND NOT cov THEN 1 ELSE 0 END) AS DOUBLE) AS z,
             count(*) FILTER (WHERE sc > 0) AS n_pos, count(*) FILTER (WHERE sc < 0) AS n_neg
      FROM x GROUP BY doc_id),
r AS (SELECT d.doc_id, CAST(coalesce(a.n_tokens, 0) AS INTEGER) AS n_tokens,
             CAST(coalesce(a.s, 0) AS DOUBLE) AS s, CAST(coalesce(a.p, 0) AS DOUBLE) AS p,
             CAST(coalesce(a.n, 0) AS DOUBLE) AS n, coalesce(a.z, 0) AS z,
             CAST(coalesce(a.n_pos, 0) AS INTEGER) AS n_pos,
             CAST(coalesce(a.n_neg, 0) AS INTEGER) AS n_neg
      FROM d LEFT JOIN a USING (doc_id))
SELECT doc_id, n_tokens, s AS score_sum,
       CASE WHEN p + n + z > 0 THEN p / (p + n + z) ELSE 0.0 END AS pos,
       CASE WHEN p + n + z > 0 THEN n / (p + n + z) ELSE 0.0 END AS neg,
       CASE WHEN p + n + z > 0 THEN z / (p + n + z) ELSE 0.0 END AS neu,
       s / sqrt(s * s + 15.0) AS compound, n_pos, n_neg
FROM r"""


@query("lexicon_sentiment", SQL_LEXICON)
def q_lexicon_sentiment(spark, sf):
    return SN.lexicon_scores(T.table(spark, sf, "documents"), "text", PROBE_LEXICON)


SQL_LEXICON_TWICE = (SQL_LEXICON.replace("FROM documents),", "FROM src),")
                     .replace("WITH lex", "WITH src AS (SELECT doc_id * 2 AS doc_id, text FROM documents UNION ALL SELECT "
                              "doc_id * 2 + 1, regexp_extract(text, '^[^\\n]*', 0) FROM documents), lex")
                     .replace("SELECT doc_id, n_tokens, s AS", "SELECT doc_id // 2 AS doc_id, n_tokens, s AS"))


@query("lexicon_table_sentiment", SQL_LEXICON_TWICE)
def q_lexicon_table_sentiment(spark, sf):
    """Scores with the lexicon as a table, of untidy terms, over whole texts and first lines under the same ids."""
    untidy = [(f"  {t.upper()} ".replace(" ", "  \t"), c) for t, c in PROBE_LEXICON]
    lexicon = spark.createDataFrame(untidy + [("the", "negative"), (" ", "positive"), ("and", None)], "term STRING, cls STRING")
    docs = T.table(spark, sf, "documents").select("doc_id", "text")
    lines = docs.withColumn("text", F.regexp_extract("text", r"^[^\n]*", 0))
    return SN.lexicon_scores(docs.unionByName(lines), "text", lexicon)


def _annotations(spark, sf):
    """Per sentence of each document: a label from its line, a confidence text from its sentence."""
    d = T.table(spark, sf, "documents")
    labels = F.transform(F.split("text", "\n"), lambda s: F.when(F.length(s) > 120, "positive")
                         .when(F.length(s) < 40, "negative").otherwise("neutral"))
    confs = F.transform(F.split("text", r"[.!?] "), lambda s: F.when(F.length(s) > 900, "n/a")
                        .otherwise(F.concat(F.lit("0."), F.lpad(F.length(s).cast("string"), 3, "0"))))
    z = SN.zip_shortest(labels, confs, ("label", "confidence"))
    return d.select("doc_id", F.posexplode(z).alias("pos", "a")).select(
        "doc_id", (F.col("pos") + 1).alias("idx"), "a.label", "a.confidence")


SQL_ANNOTATIONS = """ann AS (
  SELECT doc_id, idx, labels[idx] AS label, confs[idx] AS confidence FROM (
    SELECT doc_id, labels, confs,
           unnest(range(1, least(len(labels), len(confs)) + 1)) AS idx FROM (
      SELECT doc_id,
             list_transform(string_split(text, chr(10)), lambda s: CASE WHEN length(s) > 120
               THEN 'positive' WHEN length(s) < 40 THEN 'negative' ELSE 'neutral' END) AS labels,
             list_transform(string_split_regex(text, '[.!?] '), lambda s: CASE WHEN length(s) > 900
               THEN 'n/a' ELSE '0.' || lpad(CAST(length(s) AS VARCHAR), 3, '0') END) AS confs
      FROM documents)))"""


@query("zip_shortest", f"""
WITH {SQL_ANNOTATIONS}
SELECT doc_id, CAST(idx AS INTEGER) AS idx, label, confidence FROM ann""")
def q_zip_shortest(spark, sf):
    return _annotations(spark, sf)


@query("signed_confidence", f"""
WITH {SQL_ANNOTATIONS},
g AS (SELECT doc_id,
             CAST(sum(coalesce(TRY_CAST((CASE label WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0
                  ELSE 0.0 END) * TRY_CAST(confidence AS DOUBLE) AS DECIMAL(20, 6)), 0)) AS DOUBLE)
               AS score,
             count(*) FILTER (TRY_CAST((CASE label WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0
                  ELSE 0.0 END) * TRY_CAST(confidence AS DOUBLE) AS DECIMAL(20, 6)) IS NULL) AS n_bad_confidence,
             string_agg(idx || ':' || label || ':' || confidence, ';' ORDER BY idx) AS details,
             count(*) AS n_sentences,
             CAST(sum(CASE WHEN label IN ('positive', 'negative') THEN 0 ELSE 1 END) AS BIGINT)
               AS n_unknown
      FROM ann GROUP BY doc_id)
SELECT *, score / n_sentences AS normalized_score FROM g""")
def q_signed_confidence(spark, sf):
    line = F.transform("details", lambda d: F.concat_ws(":", d["idx"], d["label"], d["confidence"]))
    return SN.signed_confidence(_annotations(spark, sf)).withColumn("details", F.concat_ws(";", line))


# ---------------------------------------------------------------- dimension, runs, time alignment

from ..operators import features as FE  # noqa: E402
from ..operators import joins as J  # noqa: E402
from ..streaming import triggers as TR  # noqa: E402

# Stand-in ticker dimension for the test tables (event types play tickers; two stay unmapped).
PROBE_DIM = (("click", "Click Corp"), ("view", "View Inc"), ("purchase", "Purchase Ltd"))

SQL_SLOTS = "slots(hour, minute, trigger_type) AS (VALUES " + ", ".join(
    f"({h}, {m}, '{t}')" for h, m, t in TR.slot_rows()) + ")"
SQL_DAYS = f"""bounds AS (SELECT min(CAST({SQL_NY} AS DATE)) AS a, max(CAST({SQL_NY} AS DATE)) AS z
                FROM events),
days AS (SELECT CAST(unnest(range(a, z + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS ny_date
         FROM bounds)"""
SQL_SLOT_NY = "make_timestamp(year(ny_date), month(ny_date), day(ny_date), hour, minute, 0)"
SQL_CAL = f"""{SQL_SLOTS}, {SQL_DAYS},
cal AS (SELECT ny_date, hour, minute, trigger_type, strftime({SQL_SLOT_NY}, '%I:%M %p') AS slot,
               ({SQL_SLOT_NY} AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS run_ts
        FROM days, slots)"""


def _calendar(spark, sf):
    return TR.slot_calendar(TR.date_range(_events(spark, sf), "ts"))


@query("ticker_lookup", f"""
WITH dim(ticker, company) AS (VALUES {_sql_values(PROBE_DIM)})
SELECT e.event_id, e.event_type AS ticker, d.company FROM events e LEFT JOIN dim d
  ON d.ticker = e.event_type""")
def q_ticker_lookup(spark, sf):
    e = _events(spark, sf).select("event_id", F.col("event_type").alias("ticker"))
    return FE.with_company(e, FE.ticker_dim(spark, PROBE_DIM))


@query("ticker_unmapped", f"""
WITH dim(ticker, company) AS (VALUES {_sql_values(PROBE_DIM)})
SELECT DISTINCT event_type AS ticker FROM events e
WHERE NOT EXISTS (SELECT 1 FROM dim d WHERE d.ticker = e.event_type)""")
def q_ticker_unmapped(spark, sf):
    e = _events(spark, sf).select(F.col("event_type").alias("ticker"))
    return FE.unmapped_tickers(e, FE.ticker_dim(spark, PROBE_DIM))


@query("slot_calendar", f"""
WITH {SQL_CAL}
SELECT strftime(ny_date, '%Y-%m-%d') AS ny_date, slot, trigger_type, run_ts FROM cal""")
def q_slot_calendar(spark, sf):
    return _calendar(spark, sf).select(F.date_format("ny_date", "yyyy-MM-dd").alias("ny_date"),
                                       "slot", "trigger_type", "run_ts")


# Stand-in ticker -> company mapping joining the test tables' tickers to article sources.
NEWS_DIM = (("click", "src0"), ("view", "src1"), ("purchase", "src2"), ("error", "src3"),
            ("signup", "src4"))


@query("run_news_interval", f"""
WITH {SQL_CAL}, {SQL_ARTICLES}, dim(ticker, company) AS (VALUES {_sql_values(NEWS_DIM)}),
runs AS (SELECT ticker, company, run_ts, slot FROM cal, dim WHERE trigger_type = 'hourly_prediction')
SELECT r.ticker, r.run_ts, r.slot, a.doc_id, a.company, a.published_at
FROM runs r JOIN arts a ON a.company = r.company AND a.published_at >= r.run_ts - INTERVAL 25 HOUR
                       AND a.published_at < r.run_ts - INTERVAL 24 HOUR""")
def q_run_news_interval(spark, sf):
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("ticker"), F.lit(c).alias("company"))
                                for t, c in NEWS_DIM]))
    runs = (_calendar(spark, sf).where(F.col("trigger_type") == TR.HOURLY)
            .select("run_ts", "slot", pairs.alias("d")).select("run_ts", "slot", "d.ticker", "d.company"))
    arts = T.articles(spark, sf).select("doc_id", "company", "published_at")
    return J.interval_join(runs, arts, "run_ts", "published_at", 25, 24, keys=["company"])


@query("run_asof_bar", f"""
WITH {sql_bars('hour')}, {SQL_SLOTS},
tdays AS (SELECT DISTINCT ticker, CAST((bar_ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York'
                                       AS DATE) AS ny_date FROM bars),
runs AS (SELECT ticker, ny_date, strftime({SQL_SLOT_NY}, '%I:%M %p') AS slot,
                ({SQL_SLOT_NY} AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS run_ts
         FROM tdays, slots WHERE trigger_type = 'hourly_prediction')
SELECT r.ticker, strftime(r.ny_date, '%Y-%m-%d') AS ny_date, r.slot, r.run_ts, b.bar_ts, b.close
FROM runs r ASOF LEFT JOIN bars b ON r.ticker = b.ticker AND r.run_ts > b.bar_ts""")
def q_run_asof_bar(spark, sf):
    bars = _hourly(spark, sf)
    runs = FE.runs_for(bars)
    out = J.asof_latest(runs, bars, "ticker", "run_ts", "bar_ts", ["close"])
    return out.select("ticker", F.date_format("ny_date", "yyyy-MM-dd").alias("ny_date"), "slot",
                      "run_ts", "bar_ts", "close")


@query("trigger_match", f"""
WITH {SQL_SLOTS}
SELECT e.event_id, strftime(CAST({SQL_NY} AS DATE), '%Y-%m-%d') AS ny_date,
       CAST(hour({SQL_NY}) AS INTEGER) AS hour, CAST(minute({SQL_NY}) AS INTEGER) AS minute,
       s.trigger_type
FROM events e JOIN slots s ON s.hour = hour({SQL_NY}) AND s.minute = minute({SQL_NY})""")
def q_trigger_match(spark, sf):
    m = TR.match_slots(spark, _events(spark, sf))
    return m.select("event_id", F.date_format("ny_date", "yyyy-MM-dd").alias("ny_date"), "hour",
                    "minute", "trigger_type")


SQL_FIRST = f"""{SQL_SLOTS},
m AS (SELECT e.event_id, e.ts, CAST({SQL_NY} AS DATE) AS ny_date, s.hour, s.minute, s.trigger_type
      FROM events e JOIN slots s ON s.hour = hour({SQL_NY}) AND s.minute = minute({SQL_NY})),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ny_date, hour, minute
                                                  ORDER BY ts, event_id) AS rn FROM m)
      WHERE rn = 1)"""


@query("trigger_first_fire", f"""
WITH {SQL_FIRST}
SELECT strftime(ny_date, '%Y-%m-%d') AS ny_date, CAST(hour AS INTEGER) AS hour,
       CAST(minute AS INTEGER) AS minute, trigger_type, event_id, ts FROM f""")
def q_trigger_first_fire(spark, sf):
    f = TR.first_fire(TR.match_slots(spark, _events(spark, sf)))
    return f.select(F.date_format("ny_date", "yyyy-MM-dd").alias("ny_date"), "hour", "minute",
                    "trigger_type", "event_id", "ts")


SQL_MSG = f"""{SQL_FIRST},
g AS (SELECT *, {SQL_SLOT_NY} AS slot_ny,
             ({SQL_SLOT_NY} AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS slot_utc FROM f),
o AS (SELECT *, date_diff('minute', slot_utc, slot_ny) AS off FROM g),
msg AS (SELECT CASE WHEN trigger_type = 'hourly_prediction' THEN 'hourly_topic'
                    ELSE 'daily_topic' END AS topic, event_id,
        to_json({{'trigger_type': trigger_type,
                 'event_timestamp_utc': strftime(ts, '%Y-%m-%dT%H:%M:%S')
                   || CASE WHEN strftime(ts, '%f') = '000000' THEN ''
                           ELSE '.' || strftime(ts, '%f') END || 'Z',
                 'scheduled_time_ny_iso': strftime(slot_ny, '%Y-%m-%dT%H:%M:%S')
                   || CASE WHEN off < 0 THEN '-' ELSE '+' END
                   || lpad(CAST(abs(off) // 60 AS VARCHAR), 2, '0') || ':'
                   || lpad(CAST(abs(off) % 60 AS VARCHAR), 2, '0'),
                 'scheduled_time_ny_friendly': strftime(slot_ny, '%I:%M %p')}}) AS value
        FROM o)"""


def _messages(spark, sf):
    return TR.message(TR.first_fire(TR.match_slots(spark, _events(spark, sf))))


@query("trigger_message", f"WITH {SQL_MSG} SELECT topic, CAST(value AS VARCHAR) AS value FROM msg")
def q_trigger_message(spark, sf):
    return _messages(spark, sf).select("topic", "value")


@query("message_parse", f"""
WITH {SQL_MSG},
inbox AS (SELECT topic, CAST(value AS VARCHAR) AS value FROM msg
          UNION ALL SELECT 'hourly_topic', props FROM events WHERE event_type <> 'error'
          UNION ALL SELECT topic, CAST(value AS VARCHAR) || ' xx' FROM msg
          UNION ALL SELECT topic, regexp_replace(CAST(value AS VARCHAR), '"scheduled_time_ny_iso":"20', '"scheduled_time_ny_iso":"soon 20') FROM msg
          UNION ALL SELECT 'other_topic', 'not json ' || props FROM events WHERE event_type = 'error'),
v AS (SELECT topic, value, coalesce(json_valid(value), false) AS ok FROM inbox),
x AS (SELECT topic, value, ok,
             CASE WHEN ok THEN json_extract_string(value, '$.trigger_type') END AS trigger_type,
             CASE WHEN ok THEN json_extract_string(value, '$.scheduled_time_ny_friendly') END AS f
      FROM v)
SELECT topic, value, trigger_type, coalesce(f, 'N/A') AS slot_friendly,
       CASE WHEN NOT ok THEN 'bad_json'
            WHEN trigger_type IS NULL THEN 'missing_trigger_type'
            WHEN topic NOT IN ('hourly_topic', 'daily_topic') THEN 'unexpected_topic'
            WHEN json_extract_string(value, '$.scheduled_time_ny_iso') IS NOT NULL
                 AND TRY_CAST(json_extract_string(value, '$.scheduled_time_ny_iso') AS TIMESTAMPTZ) IS NULL THEN 'bad_slot_time'
            ELSE 'ok' END AS status
FROM x""")
def q_message_parse(spark, sf):
    e = _events(spark, sf)
    inbox = (_messages(spark, sf).select("topic", "value")
             .unionByName(e.where(F.col("event_type") != "error")
                          .select(F.lit("hourly_topic").alias("topic"), F.col("props").alias("value")))
             .unionByName(_messages(spark, sf).select("topic", F.concat("value", F.lit(" xx")).alias("value")))
             .unionByName(_messages(spark, sf).select("topic", F.replace("value", F.lit('"scheduled_time_ny_iso":"20'), F.lit(
                 '"scheduled_time_ny_iso":"soon 20')).alias("value")))
             .unionByName(e.where(F.col("event_type") == "error")
                          .select(F.lit("other_topic").alias("topic"),
                                  F.concat(F.lit("not json "), "props").alias("value"))))
    return TR.parse_messages(inbox)


# ---------------------------------------------------------------- feature rows

SQL_ROLL = f"""{sql_bars('hour')},
r AS (SELECT ticker, bar_ts, close, high, low, n_ticks,
             list(close) OVER (PARTITION BY ticker ORDER BY bar_ts
                               ROWS BETWEEN {{w}} PRECEDING AND CURRENT ROW) AS vals FROM bars)"""


@query("feature_row", f"""
WITH {SQL_ROLL.format(w=59)},
f AS (SELECT ticker, bar_ts, list_concat(vals, [close, high, low, CAST(n_ticks AS DOUBLE)]) AS fv
      FROM r WHERE len(vals) = 60)
SELECT ticker, bar_ts, CAST(p - 1 AS INTEGER) AS pos, fv[p] AS v FROM f, range(1, 65) t(p)""")
def q_feature_row(spark, sf):
    r = FE.rolling_values(_hourly(spark, sf), FE.SEQ_LEN).where(F.size("vals") == FE.SEQ_LEN)
    f = r.select("ticker", "bar_ts", FE.assemble_row(F.col("vals"), F.col("close"), F.col("high"),
                                                     F.col("low"), F.col("n_ticks")).alias("fv"))
    return f.select("ticker", "bar_ts", F.posexplode("fv").alias("pos", "v"))


@query("feature_row_valid", f"""
WITH {SQL_ROLL.format(w=63)}
SELECT ticker, bar_ts, CAST(len(vals) AS INTEGER) AS n_values, len(vals) = 64 AS valid FROM r""")
def q_feature_row_valid(spark, sf):
    r = FE.rolling_values(_hourly(spark, sf), FE.ROW_WIDTH)
    c = FE.check_rows(r, "vals")
    return c.select("ticker", "bar_ts", F.size("vals").alias("n_values"), "valid")


@query("feature_split", f"""
WITH {SQL_ROLL.format(w=64)}
SELECT ticker, bar_ts, vals[1] AS seq_first, vals[60] AS seq_last, CAST(len(vals[1:60]) AS INTEGER)
       AS seq_len, vals[61] AS aux1, vals[62] AS aux2, vals[63] AS aux3, vals[64] AS aux4,
       vals[65] AS target
FROM r WHERE len(vals) = 65""")
def q_feature_split(spark, sf):
    r = FE.rolling_values(_hourly(spark, sf), FE.ROW_WIDTH + 1).where(
        F.size("vals") == FE.ROW_WIDTH + 1)
    seq, aux, target = FE.split_row(F.col("vals"))
    return r.select("ticker", "bar_ts", F.element_at(seq, 1).alias("seq_first"),
                    F.element_at(seq, -1).alias("seq_last"), F.size(seq).alias("seq_len"),
                    *[F.element_at(aux, i).alias(f"aux{i}") for i in range(1, 5)],
                    target.alias("target"))


# ---------------------------------------------------------------- unions, counts, samples, errors

@query("union_tickers", f"""
WITH {sql_bars('hour')}, {SQL_DAILY}
SELECT ticker, bar_ts, close, 'events' AS source FROM bars
UNION ALL SELECT ticker, bar_ts, close, 'orders' AS source FROM daily""")
def q_union_tickers(spark, sf):
    h = _hourly(spark, sf).select("ticker", "bar_ts", "close", F.lit("events").alias("source"))
    d = _daily(spark, sf).select("ticker", "bar_ts", "close", F.lit("orders").alias("source"))
    return h.unionByName(d)


@query("source_counts", f"""
WITH {sql_bars('hour')},
c AS (SELECT 'ticks' AS source, count(*) AS n_rows FROM events
      UNION ALL SELECT 'daily_prices', count(*) FROM orders
      UNION ALL SELECT 'articles', count(*) FROM documents
      UNION ALL SELECT 'pages', count(*) FROM pages
      UNION ALL SELECT 'hourly_bars', count(*) FROM bars)
SELECT source, n_rows, n_rows = 0 AS is_empty FROM c""")
def q_source_counts(spark, sf):
    parts = {"ticks": T.ticks(spark, sf), "daily_prices": T.daily_prices(spark, sf),
             "articles": T.table(spark, sf, "documents"), "pages": T.pages(spark, sf),
             "hourly_bars": _hourly(spark, sf)}
    out = None
    for name, df in parts.items():
        c = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("source"), "n_rows")
        out = c if out is None else out.unionByName(c)
    return out.withColumn("is_empty", F.col("n_rows") == 0)


@query("sample_head", f"""
WITH {SQL_DAILY} SELECT * FROM daily ORDER BY bar_ts, ticker LIMIT 5""")
def q_sample_head(spark, sf):
    return _daily(spark, sf).orderBy("bar_ts", "ticker").limit(5)


@query("mse_naive", f"""
WITH {sql_bars('hour')},
p AS (SELECT ticker, close, lag(close) OVER (PARTITION BY ticker ORDER BY bar_ts) AS prev FROM bars)
SELECT ticker, count(*) AS n, round(avg((close - prev) * (close - prev)), 6) AS mse
FROM p WHERE prev IS NOT NULL GROUP BY ticker""")
def q_mse_naive(spark, sf):
    def cols(w):
        return {"prev": F.lag("close", 1).over(w)}
    p = series.rolling(_hourly(spark, sf), "ticker", "bar_ts", B.chunk_of("hour"), 1, cols)
    return (p.where(F.col("prev").isNotNull()).groupBy("ticker")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.round(F.avg((F.col("close") - F.col("prev")) ** 2), 6).alias("mse")))


# ---------------------------------------------------------------- model operators

from pyspark.ml.functions import array_to_vector, vector_to_array  # noqa: E402
from pyspark.ml.regression import LinearRegressionModel  # noqa: E402

from ..operators import classifier as CL  # noqa: E402
from ..operators import gram as GR  # noqa: E402
from ..operators import ml as ML  # noqa: E402
from . import jobs as JB  # noqa: E402

SQL_WIDE = "wide AS (SELECT o_orderkey AS id, " + ", ".join(
    f"CAST((o_orderkey * {k}) % 100 AS FLOAT) AS v{k}" for k in range(1, 66)) + " FROM orders)"
SQL_WIDE_TEXT = "wtext AS (SELECT o_orderkey AS id, " + ", ".join(
    [f"CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST((o_orderkey * 3) % 100 AS VARCHAR) END AS v3"
     if k == 3 else f"CAST((o_orderkey * {k}) % 100 AS VARCHAR) AS v{k}" for k in range(1, 65)]
    + ["CASE WHEN o_orderstatus = 'P' THEN 'n/a' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT)"
       " AS VARCHAR) END AS v65"]) + " FROM orders)"
SQL_WIDE_CAST = "wcast AS (SELECT id, " + ", ".join(
    f"TRY_CAST(v{k} AS FLOAT) AS v{k}" for k in range(1, 66)) + " FROM wtext)"


def _wide(spark, sf):
    return ML.synthetic_wide(T.table(spark, sf, "orders"), "o_orderkey")


def _wide_text(spark, sf):
    o = T.table(spark, sf, "orders")
    cols = []
    for k in range(1, 65):
        v = ((F.col("o_orderkey") * k) % 100).cast("string")
        if k == 3:
            v = F.when(F.col("o_orderstatus") != "O", v)
        cols.append(v.alias(f"v{k}"))
    v65 = F.when(F.col("o_orderstatus") == "P", F.lit("n/a")).otherwise(
        F.floor("o_totalprice").cast("bigint").cast("string"))
    return o.select(F.col("o_orderkey").alias("id"), *cols, v65.alias("v65"))


@query("synthetic_wide", f"WITH {SQL_WIDE} SELECT * FROM wide")
def q_synthetic_wide(spark, sf):
    return _wide(spark, sf)


@query("wide_cast", f"WITH {SQL_WIDE_TEXT}, {SQL_WIDE_CAST} SELECT * FROM wcast")
def q_wide_cast(spark, sf):
    return ML.wide_cast(_wide_text(spark, sf))


@query("wide_dropna", f"""WITH {SQL_WIDE_TEXT}, {SQL_WIDE_CAST}
SELECT * FROM wcast WHERE """ + " AND ".join(f"v{k} IS NOT NULL" for k in range(1, 66)))
def q_wide_dropna(spark, sf):
    return ML.drop_incomplete(ML.wide_cast(_wide_text(spark, sf)))


def _round6(c):
    """Six decimals by plain double arithmetic (the same operations in both engines; Spark's
    round() on doubles goes through BigDecimal and is an order of magnitude slower)."""
    return F.floor(c * 1e6 + 0.5) / 1e6


@query("standardize_columns", f"WITH {SQL_WIDE} SELECT id, " + ", ".join(
    f"floor((v{k} - avg(v{k}) OVER ()) / stddev_samp(v{k}) OVER () * 1e6 + 0.5) / 1e6 AS z{k}"
    for k in range(1, 66)) + " FROM wide")
def q_standardize_columns(spark, sf):
    w = _wide(spark, sf)
    fit = ML.standardize_fit(w, ML.WIDE_COLS)
    z = ML.standardize_apply(w, fit, suffix="_z")
    return z.select("id", *[_round6(F.col(f"v{k}_z")).alias(f"z{k}") for k in range(1, 66)])


@query("scaler_rollup", f"""
WITH {SQL_WIDE}, cells AS (SELECT unnest(range(1, 66)) AS k, unnest([{", ".join(f"CAST(v{k} AS DOUBLE)" for k in range(1, 66))}]) AS x FROM wide)
SELECT 'v' || k AS name, count(x) AS n, {_r6('avg(x)')} AS mean, {_r6('stddev_samp(x)')} AS std FROM cells GROUP BY k""")
def q_scaler_rollup(spark, sf):
    """The scaler from stored moments, one state for each column and year of orders."""
    o = T.table(spark, sf, "orders")
    wide = ML.synthetic_wide(o, "o_orderkey").join(o.select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year")), "id")
    cells = wide.select("year", F.posexplode(F.array(*[F.col(c).cast("double") for c in ML.WIDE_COLS])).alias("k", "x"))
    states = written(cells.groupBy("k", "year").agg(*[c.alias(n) for n, c in ST.moments("x").items()]), "scaler-states")
    m = ST.merge_moments(states, ["k"], "year")
    return m.select(F.concat(F.lit("v"), (F.col("k") + 1).cast("string")).alias("name"), "n", _round6(F.col("mean")).alias("mean"),
                    _round6(ST.spread(F.col("n"), F.col("m2"))).alias("std"))


@query("train_test_split", """
SELECT o_orderkey, (CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 7) AS BIGINT) % 5) = 0
       AS is_test FROM orders""")
def q_train_test_split(spark, sf):
    o = T.table(spark, sf, "orders")
    return o.select("o_orderkey", ML.is_test(F.col("o_orderkey")).alias("is_test"))


@query("assemble", f"""
WITH {SQL_WIDE}, a AS (SELECT id, [{", ".join(f"CAST(v{k} AS DOUBLE)" for k in range(1, 66))}] AS f
                       FROM wide)
SELECT id, CAST(len(f) AS INTEGER) AS n_features, f[1] AS f_first, f[65] AS f_last,
       list_reduce(f, lambda x, y: x + y) AS f_sum FROM a""")
def q_assemble(spark, sf):
    a = ML.assemble(_wide(spark, sf), ML.WIDE_COLS)
    f = vector_to_array(F.col("features"))
    return a.select("id", F.size(f).alias("n_features"), F.element_at(f, 1).alias("f_first"),
                    F.element_at(f, -1).alias("f_last"),
                    F.aggregate(f, F.lit(0.0), lambda acc, x: acc + x).alias("f_sum"))


def _split_windows(spark, sf):
    sw = W.sequence_windows(_hourly(spark, sf)).withColumn("features", array_to_vector("seq"))
    # the windows feed the fit and the scores: written once
    return written(sw.withColumn("is_test", ML.is_test(F.concat_ws("|", "ticker", F.col("bar_ts").cast("string")))), "split-windows")


@query("forecast_regression")
def q_forecast_regression(spark, sf):
    sw = _split_windows(spark, sf)
    model = ML.fit(sw.where(~F.col("is_test")))
    return model.transform(sw.where("is_test")).select("ticker", "bar_ts", "label", "prediction")


@query("evaluate")
def q_evaluate(spark, sf):
    sw = _split_windows(spark, sf)
    model = ML.fit(sw.where(~F.col("is_test")))
    return ML.evaluate(model.transform(sw.where("is_test")))


LAGS = 3


def _lagged(spark, sf):
    """Bars with the three closes before them, and the ticker's mean close as the centre."""
    bars = _hourly(spark, sf)
    lags = series.rolling(bars, "ticker", "bar_ts", B.chunk_of("hour"), LAGS, lambda w: {
        f"x{k}": F.lag("close", k).over(w) for k in range(1, LAGS + 1)})
    return lags.join(bars.groupBy("ticker").agg(F.avg("close").alias("mid")), "ticker").select(
        "ticker", "bar_ts", "close", "x1", "x2", "x3", "mid")


# Normal equations of three lags about their means, solved by Cramer's rule.
SQL_BY_TICKER = f"""
WITH {sql_bars('hour')},
l AS (SELECT ticker, close AS y, lag(close, 1) OVER w AS a, lag(close, 2) OVER w AS b, lag(close, 3) OVER w AS c FROM bars
      WINDOW w AS (PARTITION BY ticker ORDER BY bar_ts)),
m AS (SELECT *, y - avg(y) OVER p AS dy, a - avg(a) OVER p AS da, b - avg(b) OVER p AS db, c - avg(c) OVER p AS dc,
             avg(y) OVER p AS my, avg(a) OVER p AS ma, avg(b) OVER p AS mb, avg(c) OVER p AS mc
      FROM l WHERE c IS NOT NULL WINDOW p AS (PARTITION BY ticker)),
s AS (SELECT ticker, count(*) AS n, any_value(my) AS my, any_value(ma) AS ma, any_value(mb) AS mb, any_value(mc) AS mc,
             sum(da * da) AS aa, sum(da * db) AS ab, sum(da * dc) AS ac, sum(db * db) AS bb, sum(db * dc) AS bc, sum(dc * dc) AS cc,
             sum(da * dy) AS ay, sum(db * dy) AS by_, sum(dc * dy) AS cy FROM m GROUP BY ticker),
d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det,
             ay * (bb * cc - bc * bc) - ab * (by_ * cc - bc * cy) + ac * (by_ * bc - bb * cy) AS d1,
             aa * (by_ * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - by_ * ac) AS d2,
             aa * (bb * cy - by_ * bc) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - bb * ac) AS d3 FROM s),
w AS (SELECT ticker, n, d1 / det AS w1, d2 / det AS w2, d3 / det AS w3, my, ma, mb, mc FROM d)"""


@query("forecast_by_ticker", SQL_BY_TICKER + f"""
SELECT ticker, n, {_r6('my - w1 * ma - w2 * mb - w3 * mc')} AS intercept, {_r6('w1')} AS w1, {_r6('w2')} AS w2, {_r6('w3')} AS w3 FROM w""")
def q_forecast_by_ticker(spark, sf):
    """One model for each ticker, all solved from their sums of products."""
    m = GR.fit_by(_lagged(spark, sf), "ticker", ["x1", "x2", "x3"], "close", centre="mid")
    return m.select("ticker", "n", _round6(F.col("intercept")).alias("intercept"),
                    *[_round6(F.get("weights", F.lit(k))).alias(f"w{k + 1}") for k in range(LAGS)])


@query("forecast_by_ticker_pairs", SQL_BY_TICKER + f""",
r AS (SELECT ticker, bar_ts, close, lag(close, 1) OVER w AS a, lag(close, 2) OVER w AS b, lag(close, 3) OVER w AS c,
             row_number() OVER (PARTITION BY ticker ORDER BY bar_ts) AS i FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY bar_ts))
SELECT r.ticker, bar_ts, CAST(i - {LAGS} AS INTEGER) AS rank, close AS truth,
       {_r6('my - w1 * ma - w2 * mb - w3 * mc + w1 * a + w2 * b + w3 * c')} AS prediction
FROM r JOIN w USING (ticker) WHERE i BETWEEN {LAGS + 1} AND {LAGS + 5}""")
def q_forecast_by_ticker_pairs(spark, sf):
    """The first five (prediction, truth) pairs of every ticker."""
    rows = written(_lagged(spark, sf), "lagged")
    models = GR.fit_by(rows, "ticker", ["x1", "x2", "x3"], "close", centre="mid")
    pred = GR.predict_by(rows.where("x3 is not null"), models, "ticker", ["x1", "x2", "x3"])
    return ML.first_pairs_by(pred, "ticker", ["bar_ts"], 5, "close").select(
        "ticker", "bar_ts", "rank", F.col("close").alias("truth"), _round6(F.col("prediction")).alias("prediction"))


_TRAINED: dict[tuple[str, str], str] = {}  # (application, tables) -> registry folder


def _trained(spark, sf):
    """(models, metrics, the second model's rows) of these tables: trained and registered once in an application,
    loaded by every later query."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TRAINED:
        root = _fresh(spark, "models")
        _, metrics = JB.daily_train(spark, sf, FE.ticker_dim(spark, NEWS_DIM), register=root, rows_path=f"{root}/rows")
        metrics.write.parquet(f"{root}/metrics")
        _TRAINED[key] = root
    root = _TRAINED[key]
    return JB.load_models(spark, LinearRegressionModel, root), spark.read.parquet(f"{root}/metrics"), spark.read.parquet(f"{root}/rows")


@query("daily_training")
def q_daily_training(spark, sf):
    return _trained(spark, sf)[1]


@query("senti_regression")
def q_senti_regression(spark, sf):
    models, _, wide = _trained(spark, sf)
    z = ML.scaled_vector(wide, models.scaler, JB.FEATS)
    return models.senti.transform(z).select("ticker", "run_ts", F.col("v65").alias("target"), "prediction")


@query("predict_rows")
def q_predict_rows(spark, sf):
    models, _, wide = _trained(spark, sf)
    z = ML.scaled_vector(wide.drop(JB.TARGET), models.scaler, JB.FEATS)
    return models.senti.transform(z).select("ticker", "run_ts", "prediction")


@query("hourly_predictions")
def q_hourly_predictions(spark, sf):
    return JB.hourly_predict(spark, sf, _trained(spark, sf)[0], FE.ticker_dim(spark, NEWS_DIM))


SQL_NEWS_SCORE = f"""
WITH {SQL_CAL}, arts AS (SELECT doc_id, source AS company,
  TIMESTAMP '{T.ARTICLE_ORIGIN}' + to_minutes(doc_id * {T.ARTICLE_SPACING_MINUTES}) AS published_at FROM documents),
{sql_bars('hour')}, dim(ticker, company) AS (VALUES {_sql_values(NEWS_DIM)}),
src AS (SELECT page_id AS doc_id, text FROM ({SQL_PAGE_TEXT}) WHERE status = 'ok'),
scored AS (SELECT doc_id, compound FROM ({SQL_LEXICON.replace("FROM documents),", "FROM src),")})),
days_of AS (SELECT DISTINCT ticker, CAST((bar_ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS ny_date FROM bars),
runs AS (SELECT d.ticker, e.run_ts, t.company FROM days_of d JOIN cal e USING (ny_date) JOIN dim t USING (ticker)
         WHERE e.trigger_type = 'hourly_prediction'),
near AS (SELECT r.ticker, r.run_ts, z.compound, row_number() OVER (PARTITION BY r.ticker, r.run_ts
           ORDER BY o.published_at DESC, o.doc_id DESC) AS i
         FROM runs r JOIN arts o ON o.company = r.company AND o.published_at >= r.run_ts - INTERVAL 25 HOUR
           AND o.published_at < r.run_ts - INTERVAL 24 HOUR JOIN scored z USING (doc_id))
SELECT ticker, run_ts, count(*) AS n_articles, {_r6('avg(compound)')} AS lex_score FROM near WHERE i <= 2 GROUP BY 1, 2"""


@query("hourly_news_score", SQL_NEWS_SCORE)
def q_hourly_news_score(spark, sf):
    """The hourly run's news score: page texts of the window's newest articles, pages that failed left out."""
    pages = X.page_text(T.pages(spark, sf)).select(F.col("page_id").alias("doc_id"), "text", "status")
    runs = FE.runs_for(JB.hourly_bars(spark, sf))
    out = JB.news_scores(spark, sf, runs, FE.ticker_dim(spark, NEWS_DIM), per_run=2, lexicon=PROBE_LEXICON, lang=None, pages=pages)
    return out.select("ticker", "run_ts", "n_articles", _round6(F.col("lex_score")).alias("lex_score"))


class LastValue:
    """A forecaster in closed form: the last value of the window comes again."""

    def transform(self, df):
        return df.withColumn("prediction", F.element_at(vector_to_array("features"), FE.SEQ_LEN))


class FixedWeights:
    """A second model in closed form: fixed weights on the forecast and the news score."""

    def transform(self, df):
        f = vector_to_array("features")
        return df.withColumn("prediction", F.element_at(f, 61) / 1000 + F.element_at(f, 62) / 4).drop("features")


CLOSED_FORM = JB.Models(LastValue(), FixedWeights(), {f"v{k}": (0.0, 1.0) for k in range(1, 65)})


@query("hourly_store", f"""
WITH {SQL_CAL}, {SQL_ARTICLES}, {sql_bars('hour')},
dim(ticker, company) AS (VALUES {_sql_values(NEWS_DIM)}),
days_of AS (SELECT DISTINCT ticker, CAST((bar_ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS ny_date
            FROM bars),
runs AS (SELECT d.ticker, c.slot, c.run_ts, m.company FROM days_of d JOIN cal c USING (ny_date)
         LEFT JOIN dim m USING (ticker) WHERE c.trigger_type = 'hourly_prediction'),
win AS (SELECT ticker, bar_ts, close, count(*) OVER (PARTITION BY ticker ORDER BY bar_ts ROWS 59 PRECEDING) AS n FROM bars),
matched AS (SELECT r.*, w.close, coalesce(w.n, 0) AS n FROM runs r ASOF LEFT JOIN win w
         ON r.ticker = w.ticker AND r.run_ts > w.bar_ts),
news AS (SELECT r.ticker, r.run_ts, count(*) / 10 AS score FROM runs r JOIN arts a ON a.company = r.company
           AND a.published_at >= r.run_ts - INTERVAL 25 HOUR AND a.published_at < r.run_ts - INTERVAL 24 HOUR
         GROUP BY 1, 2),
p AS (SELECT x.ticker, x.run_ts, x.slot, n = 60 AS fine, close,
             close / 1000 + coalesce(score, 0) / 4 AS senti FROM matched x LEFT JOIN news USING (ticker, run_ts))
SELECT ticker, run_ts, slot, CASE WHEN fine THEN 'ok' ELSE 'short_window' END AS status,
       CASE WHEN fine THEN floor(close * 1e6 + 0.5) / 1e6 END AS algo,
       CASE WHEN fine THEN floor(senti * 1e6 + 0.5) / 1e6 END AS senti_out,
       CASE WHEN fine THEN floor((close + senti / 10) * 1e6 + 0.5) / 1e6 END AS predicted,
       CASE WHEN fine THEN strftime((run_ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d')
                           || '_' || slot || '_' || ticker END AS key
FROM p""")
def q_hourly_store(spark, sf):
    """The whole hourly chain, through the store, with models in closed form."""
    dim = FE.ticker_dim(spark, NEWS_DIM)
    runs = FE.runs_for(JB.hourly_bars(spark, sf))
    arts = T.articles(spark, sf).select("company", "doc_id", "published_at")
    with_dim = FE.with_company(runs.select("ticker", "run_ts"), dim)
    scores = J.interval_join(with_dim, arts, "run_ts", "published_at", 25, 24, keys=["company"]).groupBy(
        "ticker", "run_ts").agg((F.count("*") / 10).alias("lex_score"))
    done = JB.hourly_predict(spark, sf, CLOSED_FORM, dim, runs, scores)
    store = JB.store_results(None, done)
    out = done.join(store.select("key", F.col("value").alias("stored")), "key", "left")
    return out.select("ticker", "run_ts", "slot", F.when(
        (F.col("status") == "ok") & (F.col("stored") != F.col("value")), "not_stored").otherwise(
            F.col("status")).alias("status"), *[_round6(F.col(c)).alias(c) for c in ("algo", "senti_out", "predicted")], "key")


@query("run_feature_row", f"""
WITH news AS (SELECT * FROM ({SQL_NEWS_SCORE})), {SQL_CAL}, {sql_bars('hour')},
days_of AS (SELECT DISTINCT ticker, CAST((bar_ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS ny_date FROM bars),
runs AS (SELECT d.ticker, e.run_ts FROM days_of d JOIN cal e USING (ny_date) WHERE e.trigger_type = 'hourly_prediction'),
win AS (SELECT ticker, bar_ts, list(close) OVER (PARTITION BY ticker ORDER BY bar_ts ROWS 59 PRECEDING) AS vals FROM bars),
matched AS (SELECT r.ticker, r.run_ts, w.vals FROM runs r ASOF JOIN win w ON r.ticker = w.ticker AND r.run_ts > w.bar_ts),
f AS (SELECT m.ticker, m.run_ts, list_concat(vals, [vals[60], coalesce(n.lex_score, 0.0), 0.0, 0.0]) AS fv
      FROM matched m LEFT JOIN news n USING (ticker, run_ts) WHERE len(vals) = 60)
SELECT ticker, run_ts, CAST(p - 1 AS INTEGER) AS pos, {_r6('fv[p]')} AS v FROM f, range(1, 65) t(p)""")
def q_run_feature_row(spark, sf):
    """The 64 values of every run that can be scored: 60 closes, and four scores joined on (ticker, run)."""
    bars, dim = JB.hourly_bars(spark, sf), FE.ticker_dim(spark, NEWS_DIM)
    runs = FE.runs_for(bars)
    pages = X.page_text(T.pages(spark, sf)).select(F.col("page_id").alias("doc_id"), "text", "status")
    scores = JB.news_scores(spark, sf, runs, dim, per_run=2, lexicon=PROBE_LEXICON, lang=None, pages=pages)
    rows = JB.forecast(CLOSED_FORM.forecaster, written(JB.run_windows(bars, runs), "run-windows"))
    rows = written(JB.feature_rows(rows, scores.withColumn("lex_score", _round6(F.col("lex_score")))).select(
        "ticker", "run_ts", "features", "valid"), "run-features")
    return rows.where("valid").select("ticker", "run_ts", F.posexplode("features").alias("pos", "v")).withColumn("v", _round6(F.col("v")))


@query("sentence_classifier")
def q_sentence_classifier(spark, sf):
    docs = T.table(spark, sf, "documents")
    model = CL.fit(docs, T.table(spark, sf, "labels"))
    return SN.signed_confidence(CL.annotate(model, docs)).drop("details")


# ---------------------------------------------------------------- CSV sources and sink

from ..sources import csv as CSV  # noqa: E402

HISTORY_AS_OF = "2001-08-01 00:00:00"


@query("price_csv_scan", """
SELECT upper(replace(o_orderpriority, ' ', '_')) AS ticker, o_orderdate AS ts, o_totalprice AS price FROM orders""")
def q_price_csv_scan(spark, sf):
    """Daily prices written as CSV, one folder per series, their columns in another order and number for some of
    them, and read back with names from the paths."""
    path = _fresh(spark, "price-csv")
    name = F.lower(F.replace("ticker", F.lit(" "), F.lit("_")))
    rows = T.daily_prices(spark, sf).select(F.col("ts").alias("Date"), F.col("price").alias("Close"), F.lit(1).alias("Volume"),
                                            F.concat(name, F.lit(".daily.csv")).alias("file"))
    urgent = F.col("file").rlike("^[12]")
    rows.where(~urgent).write.option("header", True).partitionBy("file").csv(path)
    rows.where(urgent).select("Volume", "Close", F.lit("a, b").alias("Note"), "Date", "file").write.mode("append").option(
        "header", True).partitionBy("file").csv(path)
    return CSV.read_prices(spark, path)


@query("wide_csv_scan", f"WITH {SQL_WIDE_TEXT}, {SQL_WIDE_CAST} SELECT * FROM wcast")
def q_wide_csv_scan(spark, sf):
    path = _fresh(spark, "wide-csv")
    _wide_text(spark, sf).write.option("header", True).csv(path)
    return ML.wide_cast(CSV.read_wide(spark, path).withColumn("id", F.col("id").cast("bigint")))


@query("price_csv_sink", f"""
SELECT o_orderdate AS "Date", o_totalprice AS "Close", o_orderkey AS "Volume", 'AAPL' AS "Ticker" FROM orders
WHERE o_orderdate >= TIMESTAMP '{HISTORY_AS_OF}' - INTERVAL 87684 HOUR AND o_orderdate < TIMESTAMP '{HISTORY_AS_OF}' - INTERVAL 24 HOUR""")
def q_price_csv_sink(spark, sf):
    """Ten years that end a day before, without their last instant, under the default name, all columns kept."""
    folder = _fresh(spark, "history-csv")
    prices = T.daily_prices(spark, sf).select("ts", "price", F.col("seq").alias("Volume"))
    path = CSV.write_price_history(prices, None, HISTORY_AS_OF, "aapl", folder)
    return spark.read.option("header", True).schema(
        "Date TIMESTAMP_NTZ, Close DOUBLE, Volume BIGINT, Ticker STRING").csv(path)
