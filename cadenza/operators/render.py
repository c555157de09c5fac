"""Transcripts as cue and line rows; a file is a job's rows in order, so no task gathers a job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators import paragraphs, sequence

# Words of a Markdown transcript, endings of result names, and formats in the order in which one is the main result.
TITLE, SOURCE, ORIGINAL, IMPROVED = "Transcrição", "Fonte", " — transcrição", " — texto melhorado"
PREFERRED = ["docx", "md", "txt", "srt", "vtt"]


def lasting(rows: DataFrame) -> DataFrame:
    """Segments with text that last."""
    return rows.where((F.trim("text") != "") & (F.col("e") > F.col("s")))


def _seconds(c: str) -> Column:
    return F.col(c) / F.lit(1000.0)


def srt(rows: DataFrame, keys: list[str], bucket: str, order: list[str]) -> DataFrame:
    """keys, cue, text: numbered SRT cues of segments that last."""
    cues = sequence.numbered(lasting(rows), keys, bucket, order, name="cue")
    times = F.concat(T.timestamp(_seconds("s"), separator=","), F.lit(" --> "), T.timestamp(_seconds("e"), separator=","))
    who = F.coalesce(F.concat("speaker", F.lit(": ")), F.lit(""))
    return cues.select(*keys, "cue", F.concat(F.col("cue").cast("string"), F.lit("\n"), times, F.lit("\n"), who, F.col("text")).alias("text"))


def vtt(rows: DataFrame, keys: list[str], bucket: str, order: list[str]) -> DataFrame:
    """keys, cue, text: WebVTT cues with voice tags; cue 0 is the header."""
    cues = sequence.numbered(lasting(rows), keys, bucket, order, name="cue")
    times = F.concat(T.timestamp(_seconds("s")), F.lit(" --> "), T.timestamp(_seconds("e")))
    body = F.coalesce(F.concat(F.lit("<v "), F.col("speaker"), F.lit(">"), F.col("text"), F.lit("</v>")), F.col("text"))
    head = rows.select(*keys).distinct().select(*keys, F.lit(0).cast("bigint").alias("cue"), F.lit("WEBVTT").alias("text"))
    return cues.select(*keys, "cue", F.concat(times, F.lit("\n"), body).alias("text")).unionByName(head)


def timed_txt(rows: DataFrame, keys: list[str], bucket: str, order: list[str]) -> DataFrame:
    """keys, line, text: one '[HH:MM:SS] Speaker: text' line a segment, those that do not last too."""
    lines = sequence.numbered(rows, keys, bucket, order, name="line")
    who = F.coalesce(F.concat(F.lit(" "), F.col("speaker"), F.lit(":")), F.lit(""))
    return lines.select(*keys, "line", F.concat(F.lit("["), T.timestamp(_seconds("s"), millis=False), F.lit("]"), who, F.lit(" "), F.col("text")).alias("text"))


def markdown(rows: DataFrame, keys: list[str], bucket: str, order: list[str]) -> DataFrame:
    """keys, line, text: one bullet with its timestamp a segment."""
    lines = sequence.numbered(rows, keys, bucket, order, name="line")
    who = F.coalesce(F.concat(F.lit(" **"), F.col("speaker"), F.lit(":**")), F.lit(""))
    return lines.select(*keys, "line", F.rtrim(F.concat(F.lit("- `"), T.timestamp(_seconds("s"), millis=False), F.lit("`"), who, F.lit(" "), F.col("text"))).alias("text"))


def markdown_heads(titles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line 0, text: what stands before the bullets of :func:`markdown`; ``titles`` has title and source, blank ones count as absent."""
    title = F.coalesce(F.nullif(T.strip(F.col("title")), F.lit("")), F.lit(TITLE))
    source = F.when(F.col("source") != "", F.concat(F.lit(f"\n\n{SOURCE}: `"), F.col("source"), F.lit("`"))).otherwise("")
    return titles.select(*keys, F.lit(0).cast("bigint").alias("line"), F.concat(F.lit("# "), title, source, F.lit(f"\n\n## {TITLE}\n")).alias("text"))


def untimed_txt(rows: DataFrame, keys: list[str], bucket: str, order: list[str], *, speakers: bool = True) -> DataFrame:
    """keys, line, text: readable paragraphs, each with its speaker's name; a blank line stands between them."""
    found = paragraphs.natural_paragraphs(lasting(rows), keys, bucket, order)
    lines = sequence.numbered(found.withColumn("_b", F.floor(F.col("head") / 1000)), keys, "_b", ["head", "part"], name="line")
    who = F.coalesce(F.concat("speaker", F.lit(": ")), F.lit("")) if speakers else F.lit("")
    return lines.select(*keys, "line", F.concat(who, F.col("text")).alias("text"))


def plain_text(rows: DataFrame, keys: list[str], bucket: str, order: list[str]) -> DataFrame:
    """keys, part, text: all texts joined by spaces, a part a bucket; a transcript without rows is empty."""
    parts = rows.groupBy(*keys, F.col(bucket).alias("part")).agg(F.sort_array(F.collect_list(F.struct(*order, "text"))).alias("x"))
    return parts.select(*keys, "part", F.array_join("x.text", " ").alias("text"))


def improved_text(text: Column) -> Column:
    """Revised text as a file holds it: line ends as LF, none outside but one at the end; empty if blank; NULL for NULL."""
    clean = T.strip(F.regexp_replace(text, "\r\n?", "\n"))
    return F.when(clean != "", F.concat(clean, F.lit("\n"))).otherwise(clean)


#: What renders a format: (rows, keys, bucket, order) -> rows of the file in order.
WRITERS: dict[str, Callable[..., DataFrame]] = {"txt": untimed_txt, "srt": srt, "vtt": vtt, "md": markdown}


def exported(rows: DataFrame, keys: list[str], bucket: str, order: list[str], *, path: str = "", format: str | None = None, timestamps: bool = False) -> DataFrame:
    """Rows of a file in the given format, or else in that of the path's suffix; ValueError if there is none of that name.

    Word files need a package of their own: their paragraphs are those of 'txt'.
    """
    name = (format or path.rpartition(".")[2]).lower().lstrip(".")
    if name not in WRITERS:
        raise ValueError(f"no such format: {name!r}")
    return (timed_txt if name == "txt" and timestamps else WRITERS[name])(rows, keys, bucket, order)


def manifest(results: DataFrame, keys: list[str]) -> DataFrame:
    """keys, position, output_group, format, file of every file that a result has.

    ``results``: keys, stem, formats (array), improve. An improved result has a revised text beside
    each docx and txt, and the names of these tell which is which; srt and vtt are captions.
    """
    f = F.col("format")
    texts = f.isin("docx", "txt") & F.col("improve")
    name = lambda ending: F.concat(F.col("stem"), ending, F.lit("."), f)
    own = F.struct(F.when(f.isin("srt", "vtt"), "captions").otherwise("original").alias("output_group"), name(F.when(texts, ORIGINAL).otherwise("")).alias("file"))
    more = F.struct(F.lit("improved").alias("output_group"), name(F.lit(IMPROVED)).alias("file"))
    rows = results.select(*keys, "stem", F.coalesce("improve", F.lit(False)).alias("improve"), F.posexplode(F.array_distinct("formats")).alias("position", "format"))
    return rows.select(*keys, "position", "format", F.explode(F.when(texts, F.array(own, more)).otherwise(F.array(own))).alias("x")).select(*keys, "position", "x.output_group", "format", "x.file")


def primary(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, file: the main one of a result's files (see :func:`manifest`), a revised text before any other."""
    order = F.array_position(F.array(*[F.lit(x) for x in PREFERRED]), F.col("format"))
    return files.where(order > 0).groupBy(*keys).agg(F.min_by("file", F.struct(F.col("output_group") != "improved", order, "position", "file")).alias("file"))


def free_names(wanted: DataFrame, *, stem: str, order: str, existing: DataFrame | None = None) -> DataFrame:
    """``wanted`` with ``name``: the first free of 'stem', 'stem (2)', 'stem (3)' .. in the given order.

    Not free are the names in ``existing`` (column name) and, but for its own first row, every stem that
    is wanted, so that no name is given twice. A NULL stem has no name.
    """
    from pyspark.sql import Window

    stems = wanted.where(F.col(stem).isNotNull()).select(F.col(stem).alias("name")).distinct()
    taken = stems.select("name", F.lit(False).alias("there"))
    if existing is not None:
        taken = taken.unionByName(existing.select("name", F.lit(True).alias("there"))).groupBy("name").agg(F.max("there").alias("there"))
    form = r"(?s)^(.*) \(([1-9]\d{0,8})\)$"
    suffixed = taken.where(F.col("name").rlike(form)).select(F.regexp_extract("name", form, 1).alias("_stem"), F.regexp_extract("name", form, 2).cast("int").alias("k")).where("k >= 2")
    blocked = suffixed.groupBy("_stem").agg(F.sort_array(F.collect_set("k")).alias("_blocked"))
    gone = taken.where("there").select(F.col("name").alias("_stem"), F.lit(1).alias("_gone"))
    info = stems.withColumnRenamed("name", "_stem").join(blocked, "_stem", "left").join(gone, "_stem", "left")
    n = F.row_number().over(Window.partitionBy(stem).orderBy(order)) + F.coalesce("_gone", F.lit(0))
    number = F.aggregate(F.coalesce("_blocked", F.array().cast("array<int>")), F.col("_n"), lambda k, b: F.when(b <= k, k + 1).otherwise(k))
    name = F.when(F.col("_n") == 1, F.col(stem)).otherwise(F.concat(F.col(stem), F.lit(" ("), number.cast("string"), F.lit(")")))
    return wanted.join(info, F.col(stem) == F.col("_stem"), "left").withColumn("_n", n).withColumn("name", name).drop("_n", "_stem", "_blocked", "_gone")
