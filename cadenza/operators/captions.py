"""Rolling captions: repeated words of neighbouring cues, and short cues merged into phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import folds
from cadenza.functions import text as T
from cadenza.operators import sequence

#: Slack between cues that roll on, and between cues that are merged; most characters of a merged cue.
ROLLS_MS, MERGES_MS, MOST_CHARS = 250, 1_250, 180


def rolling_overlap(previous: Column, current: Column) -> Column:
    """Words of ``current`` that repeat the end of ``previous``: the longest match by case-folded word keys."""
    keys = lambda c: F.transform(T.words(c), T.word_key)
    return folds.overlap(keys(previous), keys(current))


def without_rolling(cues: DataFrame, keys: list[str], bucket: str, order: list[str]) -> DataFrame:
    """Cues without the words that the cue before them already showed: adds ``repeated`` and ``fresh_text``.

    Compared is the raw cue before, of the same speaker (NULL equals NULL) and at most 0.25 s away;
    ``fresh_text`` is NULL when nothing is left. Input columns: start_ms, end_ms, speaker, text.
    """
    rows = sequence.with_previous(cues, keys, bucket, order, F.struct("end_ms", "speaker", "text"), name="prev")
    near = F.col("prev").isNotNull() & F.col("prev.speaker").eqNullSafe(F.col("speaker")) & (F.col("start_ms") <= F.col("prev.end_ms") + ROLLS_MS)
    n = F.when(near, rolling_overlap(F.col("prev.text"), F.col("text"))).otherwise(0)
    rest = F.when(F.col("repeated") > 0, F.array_join(F.slice(T.words(F.col("text")), F.col("repeated") + 1, F.greatest(F.lit(0), F.size(T.words(F.col("text"))) - F.col("repeated"))), " ")).otherwise(F.col("text"))
    return rows.withColumn("repeated", n.cast("int")).withColumn("fresh_text", F.nullif(rest, F.lit(""))).drop("prev")


def merged(cues: DataFrame, keys: list[str], bucket: str, order: list[str]) -> DataFrame:
    """keys, start_ms, end_ms, speaker, text, cues: incremental cues joined up to 180 characters.

    A change of speaker or a pause over 1.25 s behind everything before it always breaks, so the fold
    runs within such stretches and not over a whole transcript.
    """
    top = sequence.running_max(cues, keys, bucket, order, F.col("end_ms"), name="top", include=False)
    prev = sequence.with_previous(top, keys, bucket, order, F.struct("speaker"), name="prev")
    fresh = F.col("prev").isNull() | ~F.col("prev.speaker").eqNullSafe(F.col("speaker")) | (F.col("start_ms") > F.col("top") + MERGES_MS)
    marked = sequence.islands(prev, keys, bucket, order, fresh)
    item = F.struct(*order, F.col("start_ms").alias("a"), F.col("end_ms").alias("z"), F.col("text").alias("t"))
    groups = marked.groupBy(*keys, "island").agg(F.first("speaker").alias("speaker"), F.sort_array(F.collect_list(item)).alias("x"))
    out = "array<struct<a:bigint,z:bigint,t:string,n:int>>"

    def add(acc: Column, c: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.trim(F.concat(last["t"], F.lit(" "), c["t"]))
        fits = (F.size(acc) > 0) & (c["a"] <= last["z"] + MERGES_MS) & (F.length(joined) <= MOST_CHARS)
        grown = F.struct(last["a"].alias("a"), F.greatest(last["z"], c["z"]).alias("z"), joined.alias("t"), (last["n"] + 1).alias("n"))
        alone = F.struct(c["a"].alias("a"), c["z"].alias("z"), c["t"].alias("t"), F.lit(1).alias("n"))
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(alone))).cast(out)

    folded = F.aggregate("x", F.array().cast(out), lambda acc, c: F.when(F.size(acc) == 0, F.array(F.struct(c["a"].alias("a"), c["z"].alias("z"), c["t"].alias("t"), F.lit(1).alias("n"))).cast(out)).otherwise(add(acc, c)))
    return groups.select(*keys, "speaker", F.inline(folded)).select(*keys, F.col("a").alias("start_ms"), F.col("z").alias("end_ms"), "speaker", F.col("t").alias("text"), F.col("n").alias("cues"))


def normalized(cues: DataFrame, keys: list[str], bucket: str, order: list[str]) -> DataFrame:
    """keys, start_ms, end_ms, speaker, text, cues: cues without repeated words, merged only in files (``keys``) where some cue repeats the one before."""
    rows = without_rolling(cues, keys, bucket, order)
    rolling = rows.where("repeated > 0").select(*keys).distinct()
    fresh = rows.where("fresh_text IS NOT NULL").drop("text").withColumnRenamed("fresh_text", "text")
    alone = fresh.join(rolling, keys, "left_anti").select(*keys, "start_ms", "end_ms", "speaker", "text", F.lit(1).alias("cues"))
    return merged(fresh.join(rolling, keys, "left_semi"), keys, bucket, order).unionByName(alone)
