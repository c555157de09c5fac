"""Gaps and islands over intervals, without ever gathering one entity into one task.

Rows are spread by ``(entity, time bucket)``. A bucket keeps at most one row for each start
millisecond, so its size is bounded by the bucket length and not by the number of rows. What one
bucket must know of the earlier ones (the running maximum end, the start of the open period) is
computed over one summary row a bucket and joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.common import millis

#: Length of a time bucket in milliseconds.
BUCKET_MS = 1_800_000


def interval_rows(df: DataFrame, entity: Sequence[Column], start: Column, end: Column) -> DataFrame:
    """Project to ``e0.. , s, e`` in milliseconds and drop what is no interval.

    Bounds below zero count as zero. A row with a NULL or non-finite bound, an end not after the
    start, or a NULL entity is no interval. Other columns of ``df`` are not touched, whatever
    their names.
    """
    names = [f"e{i}" for i in range(len(entity))]
    out = df.select(*[c.alias(n) for c, n in zip(entity, names)], millis(start).alias("s"), millis(end).alias("e"))
    keep = F.col("e") > F.col("s")
    for n in names:
        keep = keep & F.col(n).isNotNull()
    return out.where(keep)


def merge_periods(intervals: DataFrame, *, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Periods of each entity with the gap before them.

    Input: columns ``e0..`` (entity), ``s``, ``e`` as made by :func:`interval_rows`. Output: the
    entity columns, ``start_ms``, ``end_ms`` of each maximal union of overlapping or touching
    intervals and ``gap_start_ms``, the end of the period before it (NULL for the first).
    Repeated and tied rows change nothing; an empty input gives an empty result.
    """
    ent = [c for c in intervals.columns if c not in ("s", "e")]
    key = [*ent, "b"]
    rows = (
        intervals.withColumn("b", F.floor(F.col("s") / F.lit(bucket_ms)))
        .groupBy(*key, "s").agg(F.max("e").alias("e"))  # one row a start; combined before the shuffle
        .repartition(*[F.col(k) for k in key])
    )
    inside = Window.partitionBy(*key).orderBy("s")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    islands = (
        rows.withColumn("seen", F.max("e").over(before))
        .withColumn("fresh", (F.col("seen").isNull() | (F.col("s") > F.col("seen"))).cast("int"))
        .withColumn("island", F.sum("fresh").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*key, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    )
    earlier = Window.partitionBy(*ent).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        islands.groupBy(*key).agg(F.max("e").alias("top"), F.max("s").alias("last"))
        .withColumn("carry", F.max("top").over(earlier))
        .withColumn("opened", F.when(F.col("carry").isNull() | (F.col("last") > F.col("carry")), F.col("last")))
        .withColumn("open", F.max("opened").over(earlier))
        .select(*key, "carry", "open")
    )
    # Islands of one bucket are disjoint and ordered, so each one's predecessor is the row before it.
    linked = (
        islands.withColumn("inner", F.max("e").over(Window.partitionBy(*key).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)))
        .join(summary, key)
        .withColumn("prev", F.greatest("carry", "inner"))
        .withColumn("first", F.col("prev").isNull() | (F.col("s") > F.col("prev")))
        .withColumn("latest", F.max(F.when(F.col("first"), F.col("s"))).over(Window.partitionBy(*key).orderBy("s").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("period", F.coalesce("latest", "open"))
    )
    return linked.groupBy(*ent, F.col("period").alias("start_ms")).agg(
        F.max("e").alias("end_ms"), F.max(F.when(F.col("first"), F.col("prev"))).alias("gap_start_ms")
    )


def periods_and_gaps(intervals: DataFrame, *, longest_gap_ms: int, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Rows ``piece, start_ms, end_ms``: every period, and every gap of at most ``longest_gap_ms``."""
    periods = merge_periods(intervals, bucket_ms=bucket_ms)
    ent = [c for c in periods.columns if c not in ("start_ms", "end_ms", "gap_start_ms")]
    period = F.struct(F.lit("period").alias("piece"), F.col("start_ms"), F.col("end_ms"))
    gap = F.struct(F.lit("gap").alias("piece"), F.col("gap_start_ms").alias("start_ms"), F.col("start_ms").alias("end_ms"))
    listed = F.col("gap_start_ms").isNotNull() & (F.col("start_ms") - F.col("gap_start_ms") <= longest_gap_ms)
    return periods.select(*ent, F.explode(F.when(listed, F.array(period, gap)).otherwise(F.array(period))).alias("x")).select(*ent, "x.*")
