"""Meeting-time relations derived from the event, embedding and conversation tables.

Each second of event time is a millisecond of meeting time; ``*_SQL`` are the
same relations as DuckDB common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_US = 1704067200000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with session_id, source and meeting time ``p``."""
    rows = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return rows.select(
        F.expr("user_id DIV 50").alias("session_id"), F.when(F.col("user_id") % 2 == 0, "mic").otherwise("system").alias("source"),
        F.floor((us - EPOCH_US) / 1000000).alias("p"), "event_id", "user_id", "event_type", "value", "ts",
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    return events(spark, sf_dir).select("session_id", "source", F.col("event_id").alias("word_id"), p.alias("start_ms"), (p + 80 + F.col("event_id") * 37 % 400).alias("end_ms"), F.col("event_type").alias("text"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    return events(spark, sf_dir).where("event_id % 4 = 0").select("session_id", "source", F.col("event_id").alias("seg_id"), p.alias("start_ms"), (p + 500 + F.floor("value") * 20).alias("end_ms"), (F.col("user_id") % 4).cast("int").alias("cluster"))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    return events(spark, sf_dir).where("event_id % 97 = 0").select("session_id", "source", F.col("event_id").alias("ordinal"), p.alias("start_ms"), (p + 4000).alias("end_ms"), F.concat(F.lit("P_"), "event_type").alias("speaker"), (F.col("event_id") % 2 == 1).alias("inferred"))


def kept_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    return events(spark, sf_dir).where("event_id % 211 = 0").select("session_id", "source", F.col("event_id").alias("range_id"), F.greatest(p - 1000, F.lit(0)).alias("start_ms"), (p + 3000).alias("end_ms"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a turn of a group: three turns of two seconds, the second without a name."""
    p = F.col("p")
    groups = events(spark, sf_dir).where("event_id % 211 = 0").select("session_id", "source", F.col("event_id").alias("group_id"), p.alias("start_ms"), (p + 6000).alias("end_ms"), "event_type")
    return groups.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(
        "session_id", "source", "group_id", "start_ms", "end_ms", "turn", (F.col("start_ms") + F.col("turn") * 2000).alias("turn_ms"), F.when(F.col("turn") != 1, F.concat("event_type", F.lit("_"), "turn")).alias("speaker"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-millisecond frames of a track with their level."""
    return events(spark, sf_dir).groupBy("session_id", "source", F.expr("p DIV 10").alias("frame")).agg(F.max(F.col("value") / 1000).alias("rms"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voice samples: a person for each label, seven sessions."""
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("person"), "label").alias("name"), F.col("vec_id").alias("sample_no"), (F.col("vec_id") % 7).cast("int").alias("session"), F.col("embedding").cast("array<double>").alias("v"))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", F.when(F.col("role") == "user", "mic").otherwise("system").alias("source"), F.col("role").alias("speaker"), "text")


EVENTS_SQL = f"""ev AS (SELECT user_id // 50 AS session_id, CASE WHEN user_id % 2 = 0 THEN 'mic' ELSE 'system' END AS source,
  (epoch_us(ts) - {EPOCH_US}) // 1000000 AS p, event_id, user_id, event_type, value, ts FROM events)"""
WORDS_SQL = "words AS (SELECT session_id, source, event_id AS word_id, p AS start_ms, p + 80 + event_id * 37 % 400 AS end_ms, event_type AS text FROM ev)"
SEGMENTS_SQL = "segments AS (SELECT session_id, source, event_id AS seg_id, p AS start_ms, p + 500 + CAST(floor(value) AS BIGINT) * 20 AS end_ms, CAST(user_id % 4 AS INTEGER) AS cluster FROM ev WHERE event_id % 4 = 0)"
CORRECTIONS_SQL = "corrections AS (SELECT session_id, source, event_id AS ordinal, p AS start_ms, p + 4000 AS end_ms, 'P_' || event_type AS speaker, event_id % 2 = 1 AS inferred FROM ev WHERE event_id % 97 = 0)"
KEPT_SQL = "kept AS (SELECT session_id, source, event_id AS range_id, greatest(p - 1000, 0) AS start_ms, p + 3000 AS end_ms FROM ev WHERE event_id % 211 = 0)"
TURNS_SQL = "turns AS (SELECT session_id, source, event_id AS group_id, p AS start_ms, p + 6000 AS end_ms, t AS turn, p + t * 2000 AS turn_ms, CASE WHEN t <> 1 THEN event_type || '_' || t END AS speaker FROM ev, (VALUES (0), (1), (2)) x(t) WHERE event_id % 211 = 0)"
FRAMES_SQL = "frames AS (SELECT session_id, source, p // 10 AS frame, max(value / 1000) AS rms FROM ev GROUP BY ALL)"
SAMPLES_SQL = "samples AS (SELECT 'person' || label AS name, vec_id AS sample_no, CAST(vec_id % 7 AS INTEGER) AS session, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
UTTERANCES_SQL = "utt AS (SELECT conv_id AS session_id, turn, CASE WHEN role = 'user' THEN 'mic' ELSE 'system' END AS source, role AS speaker, text FROM conversations)"


def sql(*relations: str, body: str) -> str:
    """A query over the named relations; a body that starts with a comma adds its own."""
    return f"WITH {', '.join([EVENTS_SQL, *relations])}\n{body}"
