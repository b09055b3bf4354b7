"""Trigger calendar and messages: slots in New York time, matching, first fire per slot, JSON messages.

Batch forms of the trigger flow; ``streaming.flow`` runs the same steps on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

# fixed values: the schedule. Eight hourly prediction slots and one daily training slot, New York
# time, every calendar day; and the topic of each trigger type.
HOURLY_SLOTS = ((9, 30), (10, 30), (11, 30), (12, 30), (13, 30), (14, 30), (15, 30), (16, 30))
DAILY_SLOT = (8, 0)
HOURLY, DAILY = "hourly_prediction", "daily_train"
TOPICS = {HOURLY: "hourly_topic", DAILY: "daily_topic"}

# fixed values: the fields of a message.
MESSAGE_SCHEMA = ("trigger_type STRING, event_timestamp_utc STRING, scheduled_time_ny_iso STRING, "
                  "scheduled_time_ny_friendly STRING")


def slot_rows() -> list[tuple[int, int, str]]:
    return [(h, m, HOURLY) for h, m in HOURLY_SLOTS] + [(DAILY_SLOT[0], DAILY_SLOT[1], DAILY)]


def slots_array() -> Column:
    """The nine slots as a literal array of structs (a fixed, 9-element value)."""
    return F.array(*[F.struct(F.lit(h).alias("hour"), F.lit(m).alias("minute"),
                              F.lit(t).alias("trigger_type")) for h, m, t in slot_rows()])


def slot_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(slot_rows(), "hour INT, minute INT, trigger_type STRING")


def slot_calendar(days: DataFrame, date_col: str = "ny_date") -> DataFrame:
    """Every slot of every New York date in ``days`` with its UTC time (clock changes included)."""
    x = days.select("*", F.explode(slots_array()).alias("_s")).select("*", "_s.*").drop("_s")
    ny = F.make_timestamp_ntz(F.year(date_col), F.month(date_col), F.dayofmonth(date_col),
                              F.col("hour"), F.col("minute"), F.lit(0))
    return (x.withColumn("slot_ny", ny)
            .withColumn("run_ts", S.utc_from_ny(F.col("slot_ny")))
            .withColumn("slot", S.friendly_time(F.col("slot_ny"))))


def date_range(df: DataFrame, ts: str) -> DataFrame:
    """One row per New York date from the first to the last time stamp of ``df``."""
    b = df.agg(F.min(S.ny_local(F.col(ts))).alias("a"), F.max(S.ny_local(F.col(ts))).alias("b"))
    return b.select(F.explode(F.sequence(F.to_date("a"), F.to_date("b"))).alias("ny_date"))


def with_ny_parts(df: DataFrame, ts: str = "ts") -> DataFrame:
    loc = S.ny_local(F.col(ts))
    return (df.withColumn("ny_ts", loc).withColumn("ny_date", F.to_date(loc))
            .withColumn("hour", F.hour(loc)).withColumn("minute", F.minute(loc)))


def match_slots(spark: SparkSession, clock: DataFrame, ts: str = "ts") -> DataFrame:
    """Clock rows whose New York hour and minute equal a slot's (join with the 9-row slot table)."""
    return with_ny_parts(clock, ts).join(F.broadcast(slot_table(spark)), ["hour", "minute"])


def first_fire(matched: DataFrame, ts: str = "ts", seq: str = "event_id") -> DataFrame:
    """One row per (date, slot): the earliest clock row (by ts, then seq). Partial aggregation."""
    first = F.min_by(F.struct(F.col(seq).alias("seq"), F.col(ts).alias("ts")),
                     F.struct(F.col(ts), F.col(seq)))
    return (matched.groupBy("ny_date", "hour", "minute", "trigger_type").agg(first.alias("f"))
            .select("ny_date", "hour", "minute", "trigger_type", F.col("f.seq").alias(seq),
                    F.col("f.ts").alias(ts)))


def message(fired: DataFrame, ts: str = "ts") -> DataFrame:
    """Topic and JSON value of each trigger; the slot time carries New York's true offset."""
    slot_ny = F.make_timestamp_ntz(F.year("ny_date"), F.month("ny_date"), F.dayofmonth("ny_date"),
                                   F.col("hour"), F.col("minute"), F.lit(0))
    slot_utc = S.utc_from_ny(slot_ny)
    body = F.struct(
        F.col("trigger_type").alias("trigger_type"),
        S.iso_utc_z(F.col(ts)).alias("event_timestamp_utc"),
        F.concat(S.iso19(slot_ny), S.utc_offset_text(slot_utc, slot_ny)).alias(
            "scheduled_time_ny_iso"),
        S.friendly_time(slot_ny).alias("scheduled_time_ny_friendly"))
    topic = F.when(F.col("trigger_type") == HOURLY, F.lit(TOPICS[HOURLY])).otherwise(
        F.lit(TOPICS[DAILY]))
    return fired.select(topic.alias("topic"), F.to_json(body).alias("value"), *[
        c for c in fired.columns if c not in ("topic", "value")])


def slot_time(value: Column) -> Column:
    """The slot's instant that a message names; NULL if it names none, or one that is no time."""
    return F.try_to_timestamp(F.get_json_object(value, "$.scheduled_time_ny_iso"))


def parse_messages(msgs: DataFrame, value: str = "value") -> DataFrame:
    """Decode messages; ``status`` says ok / bad_json / missing_trigger_type / unexpected_topic / bad_slot_time
    (a slot time that is given but is no time)."""
    text = F.col(value).cast("string")
    m = msgs.withColumn("_p", S.strict_json(text, f"struct<{MESSAGE_SCHEMA}>")).withColumn("_m", F.col("_p.v"))
    status = (F.when(~F.col("_p.ok"), F.lit("bad_json"))
              .when(F.col("_m.trigger_type").isNull(), F.lit("missing_trigger_type"))
              .when(~F.col("topic").isin(*TOPICS.values()), F.lit("unexpected_topic"))
              .when(F.col("_m.scheduled_time_ny_iso").isNotNull() & slot_time(text).isNull(), F.lit("bad_slot_time"))
              .otherwise(F.lit("ok")))
    return m.select(
        "*", F.col("_m.trigger_type").alias("trigger_type"),
        F.coalesce("_m.scheduled_time_ny_friendly", F.lit("N/A")).alias("slot_friendly"),
        status.alias("status")).drop("_m", "_p")
