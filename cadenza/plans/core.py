"""The core's queries: (spark, sf_dir) -> DataFrame, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.common import table
from cadenza.operators import intervals
from cadenza.plans import records, reference  # noqa: F401

#: A longer stretch without speech is a break between sessions, not a gap.
LONGEST_GAP_MS = 1_800_000


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous periods and gaps of the segments of each job and the silences of each medium."""
    def side(kind: str, name: str, key: str) -> DataFrame:
        df = table(spark, sf_dir, name)
        return intervals.interval_rows(df, [F.lit(kind), df[key]], df["start_sec"], df["end_sec"])

    both = side("segment", "segments", "job_id").unionByName(side("silence", "silences", "media_id"))
    out = intervals.periods_and_gaps(both, longest_gap_ms=LONGEST_GAP_MS)
    return out.select(F.col("e0").alias("kind"), F.col("e1").alias("entity_id"), "piece", "start_ms", "end_ms")


P1_SQL = """
WITH x AS (
  SELECT 'segment' AS kind, job_id AS entity_id, greatest(CAST(round(start_sec * 1000) AS BIGINT), 0) AS s, greatest(CAST(round(end_sec * 1000) AS BIGINT), 0) AS e
  FROM segments WHERE start_sec IS NOT NULL AND end_sec IS NOT NULL AND job_id IS NOT NULL
  UNION ALL
  SELECT 'silence', media_id, greatest(CAST(round(start_sec * 1000) AS BIGINT), 0), greatest(CAST(round(end_sec * 1000) AS BIGINT), 0)
  FROM silences WHERE start_sec IS NOT NULL AND end_sec IS NOT NULL AND media_id IS NOT NULL),
y AS (SELECT *, max(e) OVER (PARTITION BY kind, entity_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM x WHERE e > s),
z AS (SELECT *, sum(CASE WHEN seen IS NULL OR s > seen THEN 1 ELSE 0 END) OVER (PARTITION BY kind, entity_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM y),
p AS (SELECT kind, entity_id, min(s) AS s, max(e) AS e FROM z GROUP BY kind, entity_id, island),
g AS (SELECT *, lag(e) OVER (PARTITION BY kind, entity_id ORDER BY s) AS before FROM p)
SELECT kind, entity_id, 'period' AS piece, s AS start_ms, e AS end_ms FROM g
UNION ALL SELECT kind, entity_id, 'gap', before, s FROM g WHERE s - before <= 1800000
"""

QUERIES = {"p1_found": p1_found} | reference.QUERIES  # those of ``records`` are registered there too
SQL = {"p1_found": P1_SQL} | reference.SQL
