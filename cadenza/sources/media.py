"""Probe records, subtitle candidates and model responses as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import languages
from cadenza.functions import text as T
from cadenza.functions.sources import codec_kind

PROBE = "format struct<duration:string,format_name:string>, streams array<struct<index:int,codec_type:string,codec_name:string,duration:string,disposition:struct<`default`:int>,tags:struct<language:string,title:string>>>"
RESPONSE = "language string, text string, segments array<struct<start:double,end:double,speaker:string,text:string>>"


def probes(media: DataFrame, *, key: str, json: str) -> DataFrame:
    """key, duration, audio, video, streams (subtitle streams) of probe records.

    The duration is the container's, else the longest stream's; a record without a positive one, and
    one that is no JSON, is left out.
    """
    p = media.select(key, F.from_json(F.col(json), PROBE).alias("p"))
    own = F.array_max(F.transform("p.streams", lambda s: s["duration"].try_cast("double")))
    duration = F.coalesce(F.col("p.format.duration").try_cast("double"), own)
    kind = lambda k: F.size(F.filter("p.streams", lambda s: s["codec_type"] == k))
    subtitles = F.transform(
        F.filter("p.streams", lambda s: s["codec_type"] == "subtitle"),
        lambda s: F.struct(s["index"].alias("index"), F.lower(s["codec_name"]).alias("codec"), codec_kind(s["codec_name"]).alias("kind"), s["tags"]["language"].alias("language"), (F.coalesce(s["disposition"]["default"], F.lit(0)) == 1).alias("is_default")),
    )
    return p.select(key, duration.alias("duration"), kind("audio").alias("audio"), kind("video").alias("video"), subtitles.alias("streams")).where("duration > 0")


def ranked_streams(streams: DataFrame, requested: Column) -> DataFrame:
    """Compatible streams with ``rank_key``, to be taken in its order.

    Without a request the default stream comes first, then unlabelled ones; with one, the language does.
    """
    rank, other = languages.rank(F.col("language"), requested), (~F.col("is_default")).cast("int")
    asked = F.coalesce(requested, F.lit("")) != ""
    key = F.when(asked, F.struct(rank.alias("a"), other.alias("b"), F.col("index").alias("c"))).otherwise(F.struct(other.alias("a"), rank.alias("b"), F.col("index").alias("c")))
    return streams.where(languages.compatible(F.col("language"), requested)).withColumn("rank_key", key)


def sidecar_language(name: Column, stem: Column) -> Column:
    """The first language tag among the dot-parts behind the stem: two letters with or without a region, or a known three-letter code."""
    parts = F.split(F.regexp_replace(F.substr(name, F.length(stem) + 1), r"\.[^.]*$", ""), r"\.")
    known = F.array(*[F.lit(a) for a in languages.ALIASES])
    return F.get(F.filter(parts, lambda p: p.rlike(r"^[A-Za-z]{2}(?:[-_][A-Za-z0-9]{2,8})*$") | F.array_contains(known, F.lower(p))), 0)


def sidecars(media: DataFrame, files: DataFrame, requested: Column) -> DataFrame:
    """media name, file, language, rank_key: subtitle files beside a medium (same folder and stem), by language, VTT first, name.

    ``media``: folder, media; ``files``: folder, file.
    """
    stem = T.stem_of(F.col("media"))
    both = media.join(files.where(F.lower("file").rlike(r"\.(srt|vtt)$")), "folder").withColumn("stem", stem)
    own = both.where(F.col("file").startswith(F.concat("stem", F.lit(".")))).withColumn("language", sidecar_language(F.col("file"), F.col("stem")))
    key = F.struct(languages.rank(F.col("language"), requested).alias("a"), (~F.lower("file").endswith(".vtt")).cast("int").alias("b"), F.col("file").alias("c"))
    return own.where(languages.compatible(F.col("language"), requested)).select("folder", "media", "file", "language", key.alias("rank_key"))


def first_usable(candidates: DataFrame, *, key: str, priority: str, keep: list[str]) -> DataFrame:
    """Of each key's candidates with text the one of least priority (sidecar, stream, and so on)."""
    usable = candidates.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return usable.groupBy(key).agg(F.min_by(F.struct(*keep), F.struct(priority, *keep)).alias("x")).select(key, "x.*")


def select_language(available: Column, requested: Column) -> Column:
    """The tag of an array that fits a request best (exact, else the same base; then by name), NULL if none does; without a request the first.

    'live_chat' is no language.
    """
    tags = F.filter(available, lambda t: F.lower(t) != "live_chat")
    ranked = F.array_min(F.transform(tags, lambda t: F.struct(languages.rank(t, requested).alias("rank"), t.alias("tag"))))
    return F.when(F.coalesce(requested, F.lit("")) == "", F.get(tags, F.lit(0))).when(ranked["rank"] <= 1, ranked["tag"])


CAPTIONS = "title string, language string, original_language string, audio_language string, subtitles map<string,string>, automatic_captions map<string,string>"


def caption_choices(rows: DataFrame, *, key: str, json: str, requested: Column, allow_automatic: bool = True) -> DataFrame:
    """key, priority, automatic, language: the captions to be tried for each address, best first.

    Manual captions come before automatic ones. Without a request the medium's own language is
    asked for, and if that isn't there either the first one taken. No row if nothing fits.
    """
    m = F.from_json(F.col(json), CAPTIONS)
    given = F.nullif(requested, F.lit(""))
    own = F.coalesce(*[F.nullif(F.col(f"m.{c}"), F.lit("")) for c in ("language", "original_language", "audio_language")])

    def chosen(kind: str) -> Column:
        tags = F.coalesce(F.map_keys(f"m.{kind}"), F.array().cast("array<string>"))
        hinted = F.when(own.isNotNull(), select_language(tags, own))
        return F.when(F.col("given").isNotNull(), select_language(tags, F.col("given"))).otherwise(F.coalesce(hinted, select_language(tags, F.lit(None).cast("string"))))

    kinds = [("subtitles", False), ("automatic_captions", True)][: 2 if allow_automatic else 1]
    found = F.array(*[F.struct(F.lit(k).alias("priority"), F.lit(auto).alias("automatic"), chosen(name).alias("language")) for k, (name, auto) in enumerate(kinds)])
    return rows.select(key, m.alias("m"), given.alias("given")).select(key, F.inline(found)).where("language IS NOT NULL")


def candidates(files: DataFrame, streams: DataFrame, *, key: str) -> DataFrame:
    """key, priority, origin, name, language, rank_key, kind: subtitle files, then text, picture and unknown streams of every medium.

    ``files``: key, file, language, rank_key; ``streams``: key, index, kind, language, rank_key.
    Those of one kind are to be taken in the order of ``rank_key``.
    """
    place = lambda df: F.row_number().over(Window.partitionBy(key).orderBy("rank_key")) - 1
    a = files.select(key, F.lit(0).alias("priority"), F.lit("sidecar").alias("origin"), F.col("file").alias("name"), "language", place(files).alias("position"), F.lit("text").alias("kind"))
    order = F.when(F.col("kind") == "text", 1).when(F.col("kind") == "image", 2).otherwise(3)
    b = streams.select(key, order.alias("priority"), F.lit("stream").alias("origin"), F.col("index").cast("string").alias("name"), "language", place(streams).alias("position"), "kind")
    return a.unionByName(b)


def outcomes(found: DataFrame, texts: DataFrame, *, key: str) -> DataFrame:
    """key, outcome, origin, name, language: the first candidate of text kind that says something, 'image' if only pictures are left, else 'none'.

    ``found``: the result of :func:`candidates`; ``texts``: key, origin, name, text, NULL where a
    candidate can't be read.
    """
    read = found.join(texts.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(key, "origin", "name", F.lit(True).alias("says")), [key, "origin", "name"], "left")
    usable = F.col("says") & (F.col("kind") == "text")
    best = read.groupBy(key).agg(F.min(F.when(usable, F.struct("priority", "position", "origin", "name", "language"))).alias("x"), F.coalesce(F.max(F.col("kind") == "image"), F.lit(False)).alias("image"))
    return best.select(key, F.when(F.col("x").isNotNull(), "text").when(F.col("image"), "image").otherwise("none").alias("outcome"), "x.origin", "x.name", "x.language")


#: Words of an estimated unit, and its least duration in seconds.
UNIT_WORDS, LEAST_DURATION = 28, 0.001


def estimated(rows: DataFrame, *, key: str, text: str, duration: str) -> DataFrame:
    """key, unit, weight, start, end, text: units of at most 28 words of text without times, which share its duration by their words.

    Sentences and lines end a unit. A text without words has none.
    """
    w = Window.partitionBy(key).orderBy("sentence", "piece")
    parts = rows.select(key, F.greatest(F.coalesce(F.col(duration).cast("double"), F.lit(0.0)), F.lit(LEAST_DURATION)).alias("_d"), F.posexplode(F.split(T.strip(F.col(text)), rf"(?<=[.!?…])\s+|\n+")).alias("sentence", "s"))
    cut_ = lambda w_: F.transform(F.sequence(F.lit(0), F.floor((F.size(w_) - 1) / UNIT_WORDS).cast("int")), lambda i: F.slice(w_, i * UNIT_WORDS + 1, F.lit(UNIT_WORDS)))
    units = parts.withColumn("w", T.words(F.col("s"))).where(F.size("w") > 0).select(key, "_d", "sentence", F.posexplode(cut_(F.col("w"))).alias("piece", "u"))
    sums = units.select(key, "_d", "u", F.size("u").alias("weight"), (F.row_number().over(w) - 1).alias("unit"), F.sum(F.size("u")).over(w).alias("upto"), F.sum(F.size("u")).over(Window.partitionBy(key)).alias("total"))
    last = F.col("upto") == F.col("total")
    return sums.select(key, "unit", "weight", (F.col("_d") * (F.col("upto") - F.col("weight")) / F.col("total")).alias("start"), F.when(last, F.col("_d")).otherwise(F.col("_d") * F.col("upto") / F.col("total")).alias("end"), F.array_join("u", " ").alias("text"))


def transcribed(rows: DataFrame, *, key: str, json: str, duration: str) -> DataFrame:
    """key, seg_index, start, end, speaker, text, kind of model responses: their segments ('provider'), or the units of their text ('estimated') where there are none."""
    r = F.from_json(F.col(json), RESPONSE)
    bare = rows.where(F.coalesce(F.size(r["segments"]), F.lit(0)) < 1).select(key, F.col(duration).alias("_d"), r["text"].alias("_t")).where(F.trim("_t") != "")
    timed = responses(rows.where(F.size(r["segments"]) > 0), key=key, json=json, duration=duration).withColumn("kind", F.lit("provider"))
    made = estimated(bare, key=key, text="_t", duration="_d").select(key, F.col("unit").alias("seg_index"), "start", "end", F.lit(None).cast("string").alias("speaker"), "text", F.lit("estimated").alias("kind"))
    return timed.unionByName(made)


def responses(rows: DataFrame, *, key: str, json: str, duration: str) -> DataFrame:
    """key, seg_index, start, end, speaker, text of model responses with segments.

    Starts never go back within a response, a missing one is the one before; ends lie between the
    start and the duration. Blank segments, and records that are no JSON, give no rows.
    """
    r = rows.select(key, F.col(duration).alias("_d"), F.posexplode(F.from_json(F.col(json), RESPONSE)["segments"]).alias("seg_index", "s")).where(F.trim(F.coalesce("s.text", F.lit(""))) != "")
    # A response is one chunk's: its window is bounded by the chunk.
    w = Window.partitionBy(key).orderBy("seg_index").rowsBetween(Window.unboundedPreceding, 0)
    start = F.greatest(F.lit(0.0), F.coalesce(F.max("s.start").over(w), F.lit(0.0)))
    return r.withColumn("start", start).select(key, "seg_index", "start", F.greatest("start", F.least(F.coalesce("s.end", "start"), "_d")).alias("end"), F.nullif(F.trim("s.speaker"), F.lit("")).alias("speaker"), F.trim("s.text").alias("text"))
