"""The subpackage's queries: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.common import table
from cadenza.llm import language, leakage, mixing, mojibake, packing, pairs, splitting, turns
from cadenza.llm.sql import SQL  # noqa: F401


def p2_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of every editorial block (or part of a block over the capacity) of each job, and its fill."""
    sizes = table(spark, sf_dir, "editorial_blocks").select("job_id", "block_index", "block_id", "planner_id", F.length("text").alias("chars")).dropDuplicates(["block_id"])
    rows = sizes.join(table(spark, sf_dir, "planners").select("planner_id", "max_chars"), "planner_id", "left")
    out = packing.pack(rows, group="job_id", item="block_index", size="chars", capacity="max_chars")
    return out.withColumn("fill", F.round("fill", 6))


def p2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block's characters over its containers, its parts, and whether any of these containers is over its capacity."""
    g = p2_containers(spark, sf_dir).where("chars IS NOT NULL").groupBy("job_id", "block_index", "capacity")
    return g.agg(F.sum("chars").alias("chars"), F.count("*").alias("parts"), F.max(F.col("container_chars") > F.col("capacity")).alias("over"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective responses with their kind of defect."""
    models = language.fit(spark, sf_dir)
    return pairs.defects(table(spark, sf_dir, "editorial_requests"), table(spark, sf_dir, "editorial_responses"), models)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last segment of every speaker turn."""
    return turns.turn_bounds(table(spark, sf_dir, "segments")).select("job_id", "first_segment_id", "last_segment_id")


def p4_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker turns with their cleaned text."""
    return turns.turn_texts(table(spark, sf_dir, "segments"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main language of wrongly labelled transcripts (segment_id -1), and segments in another language."""
    models = language.fit(spark, sf_dir)
    main, counts = language.transcript_languages(table(spark, sf_dir, "segments"), models)
    wrong = language.wrong_labels(table(spark, sf_dir, "transcripts"), main)
    other = language.mixed_segments(counts, main, models)
    return wrong.select("job_id", F.lit(-1).cast("bigint").alias("segment_id"), F.col("main").alias("language")).unionByName(other.select("job_id", "segment_id", "language")).distinct()


def p6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every transcript, and of every segment in another language than its transcript."""
    models = language.fit(spark, sf_dir)
    main, counts = language.transcript_languages(table(spark, sf_dir, "segments"), models)
    labels = table(spark, sf_dir, "transcripts").select("job_id").distinct()
    whole = labels.join(main, "job_id", "left").select("job_id", F.lit(-1).cast("bigint").alias("segment_id"), F.col("main").alias("language"), F.round("confidence", 4).alias("confidence"))
    other = language.mixed_segments(counts, main, models)
    return whole.unionByName(other.select("job_id", "segment_id", "language", F.round("confidence", 4).alias("confidence")))


def p8_mix(spark: SparkSession, sf_dir: str, *, tokenizers: str = mixing.TOKENIZERS) -> DataFrame:
    """Documents of every mix with their copies."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), folder=tokenizers)


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token shares that every mix reaches."""
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.mix(table(spark, sf_dir, "documents"), targets), targets)


def p8_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each target of a mix whether every document is listed once and used no more often than allowed."""
    targets = table(spark, sf_dir, "mix_targets").select("mix_id", mixing.domain(F.col("source")).alias("source"), "max_repeats").where("source IS NOT NULL")
    used = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).groupBy("mix_id", "source", "doc_id").agg(F.count("*").alias("rows"), F.sum("copies").alias("copies"))
    top = used.groupBy("mix_id", "source").agg(F.max("rows").alias("rows"), F.max("copies").alias("copies"))
    both = targets.join(top, ["mix_id", "source"], "full")
    return both.select("mix_id", "source", "max_repeats", (F.coalesce("rows", F.lit(0)) > 1).alias("twice"), (F.coalesce("copies", F.lit(0)) > F.coalesce("max_repeats", F.lit(0))).alias("over"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with text that was decoded with the wrong encoding."""
    return mojibake.find(table(spark, sf_dir, "documents"))[0]


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged documents with their text restored."""
    return mojibake.restore(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least 13 consecutive words of a test item."""
    leaks = leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return leaks.where(F.col("run") >= leakage.LEAST).select("doc_id", "item_id").distinct()


def p7_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment score and longest exact run of every document and item with a rare seed in common."""
    leaks = leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return leaks.select("doc_id", "item_id", F.round("score", 4).alias("score"), F.col("run").cast("bigint").alias("run"))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every editorial block within its planner's limit."""
    return splitting.pieces(table(spark, sf_dir, "editorial_blocks"), splitting.limits_of(table(spark, sf_dir, "planners")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that had to be split."""
    return p5_pieces(spark, sf_dir).where(F.col("pieces") > 1).select("block_id").distinct()


QUERIES = {
    f.__name__: f
    for f in (p2_containers, p2_coverage, p3_found, p4_found, p4_turns, p5_found, p5_pieces, p6_found, p6_languages, p7_found, p7_alignments, p8_mix, p8_shares, p8_caps, p9_found, p9_restored)
}
