"""Driver tables as operator inputs: deduplicated, with whole milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.common import millis, once, table

HOUR_MS = 3_600_000


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with text and both times: ids, s, e (ms), h (hour), speaker (NULL if blank), text (trimmed)."""
    t = table(spark, sf_dir, "segments")
    rows = t.select(
        "segment_id", "job_id", "chunk_index", "seg_index", millis(F.col("start_sec")).alias("s"), millis(F.col("end_sec")).alias("e"),
        F.nullif(F.trim("speaker"), F.lit("")).alias("speaker"), F.trim("text").alias("text"),
    )
    return once(rows.where("s IS NOT NULL AND e IS NOT NULL AND text <> ''"), "segment_id").withColumn("h", F.floor(F.col("s") / HOUR_MS))


SPEECH_SQL = """
speech AS (SELECT DISTINCT segment_id, job_id, chunk_index, seg_index, greatest(CAST(round(start_sec * 1000) AS BIGINT), 0) AS s,
  greatest(CAST(round(end_sec * 1000) AS BIGINT), 0) AS e, nullif(trim(speaker), '') AS speaker, trim(text) AS text
  FROM segments WHERE start_sec IS NOT NULL AND end_sec IS NOT NULL AND trim(text) <> '')
"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest snapshot of every job."""
    t = table(spark, sf_dir, "jobs")
    keep = [c for c in t.columns if c != "job_id"]
    return t.groupBy("job_id").agg(F.max_by(F.struct(*keep), F.struct("updated_at", "status", F.coalesce("settings", F.lit("")))).alias("x")).select("job_id", "x.*")


JOBS_SQL = """
latest AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC, status DESC, coalesce(settings, '') DESC) AS r FROM jobs) WHERE r = 1)
"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editorial blocks once each."""
    return once(table(spark, sf_dir, "editorial_blocks").drop("ingested_at"), "block_id")


BLOCKS_SQL = "blocks AS (SELECT DISTINCT block_id, job_id, block_index, planner_id, text FROM editorial_blocks)"
