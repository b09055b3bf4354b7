"""Column functions: New York time parts and formats, result keys, JSON, reply parsing, blending.

All built from ``pyspark.sql.functions``; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NY_TZ = "America/New_York"  # fixed value: market time zone of slots and result keys


def ny_local(ts_utc: Column) -> Column:
    """UTC wall time (TIMESTAMP_NTZ) -> New York wall time (TIMESTAMP_NTZ)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(NY_TZ), ts_utc)


def utc_from_ny(ts_ny: Column) -> Column:
    return F.convert_timezone(F.lit(NY_TZ), F.lit("UTC"), ts_ny)


def friendly_time(ts: Column) -> Column:
    """``09:30 AM`` style (12-hour clock, zero padded)."""
    return F.date_format(ts, "hh:mm a")


def iso19(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def iso_utc_z(ts_utc: Column) -> Column:
    """ISO text with microseconds when non-zero, then ``Z``."""
    frac = F.date_format(ts_utc, "SSSSSS")
    return F.concat(iso19(ts_utc), F.when(frac == "000000", F.lit("")).otherwise(
        F.concat(F.lit("."), frac)), F.lit("Z"))


def utc_offset_text(ts_utc: Column, ts_local: Column) -> Column:
    """``-05:00`` style offset of local wall time against UTC."""
    mins = F.timestamp_diff("MINUTE", ts_utc, ts_local)
    a = F.abs(mins)
    return F.concat(F.when(mins < 0, F.lit("-")).otherwise(F.lit("+")),
                    F.lpad((a / 60).cast("int").cast("string"), 2, "0"), F.lit(":"),
                    F.lpad((a % 60).cast("string"), 2, "0"))


def iso_ny(ts_utc: Column) -> Column:
    """ISO text of the New York wall time with its true offset, e.g. 2024-01-02T09:30:00-05:00."""
    loc = ny_local(ts_utc)
    return F.concat(iso19(loc), utc_offset_text(ts_utc, loc))


def result_key(ts_utc: Column, slot: Column, ticker: Column) -> Column:
    """``<NY date>_<slot>_<ticker>``; NULL parts become empty so the shape stays fixed."""
    d = F.date_format(ny_local(ts_utc), "yyyy-MM-dd")
    return F.concat_ws("_", F.coalesce(d, F.lit("")), F.coalesce(slot, F.lit("")),
                       F.coalesce(ticker, F.lit("")))


_END = "end_of_value"


def strict_json(js: Column, schema: str) -> Column:
    """``struct<v, ok>``: the parsed value, and whether the whole text is one JSON document.

    The parser alone stops after the first document and accepts what trails it. Here the text is a field
    of a wrapper that ends in a mark; anything trailing the document keeps the mark from being read.
    """
    wrapped = F.concat(F.lit('{"v":'), js, F.lit(f',"{_END}":1}}'))
    p = F.from_json(wrapped, f"v {schema}, {_END} INT")
    balanced = F.coalesce(F.from_json(F.concat(F.lit("["), js, F.lit("]")), "array<string>").isNotNull()
                          & (F.length(F.trim(js)) > 0), F.lit(False))
    return F.struct(p["v"].alias("v"), (F.coalesce(p[_END] == 1, F.lit(False)) & balanced).alias("ok"))


def json_field_or_default(js: Column, field: str, default: str = "N/A") -> Column:
    return F.coalesce(F.get_json_object(js, f"$.{field}"), F.lit(default))


def parse_score(reply: Column) -> Column:
    """Reply text -> number: trimmed and upper-cased, NULL when empty or not a number."""
    t = F.upper(F.trim(reply))
    return F.when(t != "", t.try_cast("double"))


def blend(algo: Column, senti: Column) -> Column:
    """Final prediction: the sequence forecast plus a tenth of the sentiment-model output."""
    return algo + senti / 10


def payload_struct(company: Column, time_text: Column, algo: Column, senti: Column) -> Column:
    return F.struct(company.alias("company"), time_text.alias("time"),
                    algo.alias("predicted_stock_algo"),
                    blend(algo, senti).alias("predicted_stock_senti"))


# fixed values: the fields of a stored result.
PAYLOAD_SCHEMA = ("company STRING, time STRING, predicted_stock_algo DOUBLE, "
                  "predicted_stock_senti DOUBLE")
