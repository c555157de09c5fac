"""Chunk plans along silences, nearest silences, clipped and shifted segments."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.common import millis

#: Time bucket of range joins in milliseconds.
BUCKET_MS = 60_000
TOLERANCE = 1e-6


def silence_log(log: Column, duration: Column) -> Column:
    """Array of (start, end) from a detector's log: starts and ends pair by position, an open last one ends at ``duration``."""
    number = lambda word: F.transform(F.regexp_extract_all(log, F.lit(rf"silence_{word}:\s*(\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))
    starts, ends = number("start"), number("end")
    pairs = F.transform(starts, lambda s, i: F.struct(s.alias("start"), F.when(i < F.size(ends), F.get(ends, i)).when(i == F.size(starts) - 1, duration).alias("end")))
    return F.filter(pairs, lambda p: p["end"] > p["start"])


def nearest(points: DataFrame, spans: DataFrame, *, on: str) -> DataFrame:
    """Each point with the span whose middle is nearest within its window; ties go to the longer, then the earlier span.

    ``points``: ``on``, id columns, at_ms, window_ms. ``spans``: ``on``, s, e. A range join turned
    into an equi-join on time buckets, so that no side is broadcast or crossed. Points without a span
    in their window are left out.
    """
    middle = F.floor((F.col("s") + F.col("e")) / 2)
    right = spans.where(F.col("e") > F.col("s")).select(on, "s", "e", F.floor(middle / BUCKET_MS).alias("tb"))
    low, high = F.floor((F.col("at_ms") - F.col("window_ms")) / BUCKET_MS), F.floor((F.col("at_ms") + F.col("window_ms")) / BUCKET_MS)
    left = points.withColumn("tb", F.explode(F.sequence(low, high)))
    twice = F.abs(F.col("s") + F.col("e") - 2 * F.col("at_ms"))
    near = left.join(right, [on, "tb"]).where(twice <= 2 * F.col("window_ms"))
    ids = [c for c in points.columns]
    return near.groupBy(*ids).agg(F.min(F.struct(twice.alias("twice"), (F.col("s") - F.col("e")).alias("shortness"), "s", "e")).alias("x")).select(*ids, F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.col("x.twice").alias("twice_distance"))


def plan(duration: float, silences: list[tuple[float, float]], *, target: float = 600.0, window: float = 30.0, overlap: float = 2.0, least: float = 15.0) -> list[tuple[int, float, float, float, str]]:
    """(index, start, end, overlap_before, boundary) of one medium; ``silences`` merged and in order.

    A cut goes to the silence whose middle is nearest to the ideal end (longer, then earlier on a
    tie), else hard at the ideal end with the overlap carried over.
    """
    middles = [(s + e) / 2 for s, e in silences]
    out: list[tuple[int, float, float, float, str]] = []
    start, before = 0.0, 0.0
    while duration - start > target + TOLERANCE:
        ideal = start + target
        if duration - ideal < least:
            break
        low, high = max(start + least, ideal - window), min(duration - least, ideal + window)
        inside = range(bisect_left(middles, low - TOLERANCE), bisect_right(middles, high + TOLERANCE))
        if inside:
            k = min(inside, key=lambda i: (abs(middles[i] - ideal), silences[i][0] - silences[i][1], silences[i][0]))
            end, then, kind = middles[k], middles[k], "silence"
        else:
            end, then, kind = ideal, ideal - overlap, "hard"
        out.append((len(out), start, end, before, kind))
        start, before = then, end - then
    out.append((len(out), start, duration, before, "end"))
    return out


def plans(media: DataFrame) -> DataFrame:
    """media_id, chunk_index, start_sec, end_sec, overlap_before, boundary for rows of media.

    ``media``: media_id, duration, target_duration, search_window, overlap, min_duration, silences
    (array of structs start, end: merged, in order). A medium without a positive duration has no plan.
    One medium's silences are bounded by its length, not by the size of the table.
    """
    names = ["media_id", "chunk_index", "start_sec", "end_sec", "overlap_before", "boundary"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for m in pdf.itertuples(index=False):
                spans = [(x["start"], x["end"]) for x in (m.silences if m.silences is not None else [])]
                rows += [(m.media_id, *c) for c in plan(m.duration, spans, target=m.target_duration, window=m.search_window, overlap=m.overlap, least=m.min_duration)]
            yield pd.DataFrame(rows, columns=names)

    return media.where("duration > 0").mapInPandas(run, "media_id string, chunk_index int, start_sec double, end_sec double, overlap_before double, boundary string")


def clipped_words(words: Column, chunk_s: Column, clip_s: Column, clip_e: Column) -> Column:
    """Words (start_sec, end_sec of the source) of a clipped segment with clip_s and clip_e (ms within the chunk); those that do not last are dropped."""
    def clip(w: Column) -> Column:
        start = F.least(F.greatest(millis(w["start_sec"]) - chunk_s, clip_s), clip_e)
        return w.withField("clip_s", start).withField("clip_e", F.least(F.greatest(millis(w["end_sec"]) - chunk_s, start), clip_e))

    timed = F.filter(words, lambda w: w["start_sec"].isNotNull() & w["end_sec"].isNotNull())
    return F.filter(F.transform(timed, clip), lambda w: w["clip_e"] > w["clip_s"])


def shifted_words(words: Column, offset: Column | float) -> Column:
    """Words (start_sec, end_sec) moved by ``offset`` seconds; NULL if one would begin before 0."""
    by = offset if isinstance(offset, Column) else F.lit(offset)
    moved = F.transform(words, lambda w: w.withField("start_sec", w["start_sec"] + by).withField("end_sec", w["end_sec"] + by))
    return F.when(~F.exists(moved, lambda w: F.coalesce(w["start_sec"] < 0, F.lit(False))), moved)


def shifted(rows: DataFrame, offset: Column, *, start: str = "start_sec", end: str = "end_sec", words: str = "words", duration: str | None = None) -> DataFrame:
    """Segments moved by ``offset`` seconds with their words and, if given, the transcript's duration; rows that would begin before 0 have NULL times."""
    good = F.col(start) + offset >= 0
    out = rows.withColumn("_by", offset).withColumn("_good", good)
    moved = {c: F.when(F.col("_good"), F.col(c) + F.col("_by")) for c in (start, end)} | {words: F.when(F.col("_good"), shifted_words(F.col(words), F.col("_by")))}
    if duration:
        moved[duration] = F.coalesce(duration, F.lit(0.0)) + F.col("_by")
    return out.withColumns(moved).drop("_by", "_good")


def clipped(segments: DataFrame) -> DataFrame:
    """Segments within their chunk, on the chunk's own time line and back on the source's.

    Input: s, e (source ms), chunk_s, chunk_e. Adds clip_s, clip_e (within the chunk) and drops what
    does not last or has no text.
    """
    length = F.col("chunk_e") - F.col("chunk_s")
    inside = lambda c: F.least(F.greatest(c - F.col("chunk_s"), F.lit(0)), length)
    return segments.withColumn("clip_s", inside(F.col("s"))).withColumn("clip_e", inside(F.col("e"))).where((F.col("clip_e") > F.col("clip_s")) & (F.trim("text") != ""))


def contained_words(segments: DataFrame, words: DataFrame, *, keys: list[str]) -> DataFrame:
    """segment_id, n_words of each segment: words of the same ``keys`` that lie within it, 0 if none.

    ``segments``: keys, segment_id, s, e; ``words``: keys, ws, we (ms). Segments are spread over the
    time buckets they touch and joined with the words that begin there.
    """
    left = segments.withColumn("tb", F.explode(F.sequence(F.floor(F.col("s") / BUCKET_MS), F.floor(F.col("e") / BUCKET_MS))))
    right = words.withColumn("tb", F.floor(F.col("ws") / BUCKET_MS))
    hit = left.join(right, [*keys, "tb"]).where((F.col("ws") >= F.col("s")) & (F.col("we") <= F.col("e")))
    counts = hit.groupBy("segment_id").agg(F.count("*").alias("n_words"))
    return segments.select("segment_id").join(counts, "segment_id", "left").select("segment_id", F.coalesce("n_words", F.lit(0)).alias("n_words"))


#: Slack of containment on either side in seconds.
CONTAINS = 1e-4


def words_of_segments(segments: DataFrame, words: DataFrame, *, keys: list[str]) -> DataFrame:
    """segment_id, words: of each segment the words of the same ``keys`` that lie within it, in their order; an empty array if none.

    ``segments``: keys, segment_id, start, end; ``words``: keys, position, start, end, text (seconds).
    Both sides meet in time buckets, so no segment is compared with words far from it.
    """
    at = lambda c: F.floor(c * 1000 / BUCKET_MS)
    left = segments.withColumn("tb", F.explode(F.sequence(at(F.col("start") - CONTAINS), at(F.greatest("start", "end") + CONTAINS))))
    right = words.select(*keys, F.struct("position", "start", "end", "text").alias("w"), at(F.col("start")).alias("tb"))
    hit = left.join(right, [*keys, "tb"]).where((F.col("w.start") >= F.col("start") - CONTAINS) & (F.col("w.end") <= F.col("end") + CONTAINS))
    found = hit.groupBy("segment_id").agg(F.sort_array(F.collect_list("w")).alias("words"))
    kind = dict(found.dtypes)["words"]
    return segments.select("segment_id").distinct().join(found, "segment_id", "left").select("segment_id", F.coalesce("words", F.array().cast(kind)).alias("words"))
