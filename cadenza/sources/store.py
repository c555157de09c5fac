"""Jobs and results as JSON: codecs, scans that skip what is damaged, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Column that holds a record that could not be read.
CORRUPT = "_corrupt"


def to_json_rows(df: DataFrame, key: str, *, name: str = "json") -> DataFrame:
    """key and one JSON object a row; NULL fields are kept, so that reading gives back the same row."""
    return df.select(key, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def from_json_rows(rows: DataFrame, schema: StructType, *, json: str = "json") -> tuple[DataFrame, DataFrame]:
    """(rows that are objects of ``schema``, rows that are not)."""
    tagged = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    parsed = rows.withColumn("_x", F.from_json(json, tagged, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    bad = F.col("_x").isNull() | F.col(f"_x.{CORRUPT}").isNotNull()
    return parsed.where(~bad).select("_x.*").drop(CORRUPT), parsed.where(bad).drop("_x")


def scan(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Records of JSON files below ``path``; damaged ones are skipped, columns that the schema lacks are ignored."""
    tagged = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    rows = spark.read.schema(tagged).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("recursiveFileLookup", True).json(path)
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def reconcile(chunks: DataFrame, results: DataFrame, *, key: str = "job_id", index: str = "chunk_index") -> DataFrame:
    """key, completed (indices with a result, in order), pending, progress of every job.

    Results of chunks that a job does not have count for nothing; a job without chunks is complete.
    """
    there = results.select(key, index).distinct().withColumn("done", F.lit(1))
    both = chunks.select(key, index).distinct().join(there, [key, index], "left").groupBy(key)
    out = both.agg(F.array_sort(F.collect_set(F.when(F.col("done") == 1, F.col(index)))).alias("completed"), F.array_sort(F.collect_set(F.when(F.col("done").isNull(), F.col(index)))).alias("pending"))
    n = F.size("completed") + F.size("pending")
    return out.withColumn("progress", F.when(n == 0, F.lit(1.0)).otherwise(F.size("completed") / n))


def with_result(completed: Column, errors: Column, index: Column) -> tuple[Column, Column]:
    """(completed, errors) once chunk ``index`` has its result: among the completed, in order, and without an error."""
    return F.array_sort(F.array_union(completed, F.array(index))), F.map_filter(errors, lambda k, _: k != index)


def consistent(chunks: Column, completed: Column, errors: Column) -> Column:
    """Whether the completed chunks and those with errors (a map by index) are all among a job's chunks."""
    return (F.size(F.array_except(completed, chunks)) == 0) & (F.size(F.array_except(F.map_keys(errors), chunks)) == 0)


def outputs(groups: Column) -> Column:
    """All paths of a map of output groups: original, captions, improved, each in its own order."""
    return F.flatten(F.array(*[F.coalesce(F.try_element_at(groups, F.lit(k)), F.array().cast("array<string>")) for k in ("original", "captions", "improved")]))


def manifests(spark: SparkSession, path: str, schema: StructType, *, key: str = "job_id") -> DataFrame:
    """Records of the job folders below ``path``, one JSON file each, whose ``key`` is the name of their folder.

    Damaged records and those of another job are left out. Listings order them by updated_at and
    created_at, the newest first.
    """
    tagged = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    rows = spark.read.schema(tagged).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.where(F.col(CORRUPT).isNull() & (F.col(key) == F.try_url_decode(folder))).drop(CORRUPT)


def completed_results(results: DataFrame, jobs: DataFrame, *, key: str = "job_id", index: str = "chunk_index") -> DataFrame:
    """Results of the chunks that their job (with ``completed``, an array) has completed; read them in order of ``index``."""
    done = jobs.select(key, F.explode("completed").alias(index)).distinct()
    return results.join(done, [key, index], "left_semi")


def status(chunks: DataFrame, results: DataFrame, damaged: DataFrame, *, key: str = "job_id", index: str = "chunk_index") -> DataFrame:
    """:func:`reconcile` with ``status``: 'corrupt' if a result of the job can't be read, else 'running' with all chunks there, else 'open'."""
    bad = damaged.select(key).distinct().withColumn("_bad", F.lit(True))
    out = reconcile(chunks, results, key=key, index=index).join(bad, key, "left")
    return out.withColumn("status", F.when(F.col("_bad"), "corrupt").when((F.size("pending") == 0) & (F.size("completed") > 0), "running").otherwise("open")).drop("_bad")


def applied(events: DataFrame, *, key: str = "job_id", index: str = "chunk_index") -> DataFrame:
    """key, completed, errors of every job after its events (at, kind, message), of which a chunk's last one counts.

    'saved' adds the chunk to the completed ones and clears its error; 'failed' notes the message.
    Repeated events change nothing; a job is never complete by its events alone.
    """
    last = events.where(F.col("kind").isin("saved", "failed")).groupBy(key, index).agg(F.max_by(F.struct("kind", "message"), F.struct("at", "kind", "message")).alias("x"))
    saved = F.array_sort(F.collect_list(F.when(F.col("x.kind") == "saved", F.col(index))))
    failed = F.map_from_entries(F.collect_list(F.when(F.col("x.kind") == "failed", F.struct(F.col(index), F.coalesce("x.message", F.lit(""))))))
    return last.groupBy(key).agg(saved.alias("completed"), failed.alias("errors"))


def saved_outputs(metadata: DataFrame, *, key: str = "job_id") -> DataFrame:
    """key, outputs, groups: the files of a result by group, or if there are none its flat list, all of it original.

    ``metadata``: key, output_groups (map of arrays), output_paths (array).
    """
    none = F.array().cast("array<string>")
    names = ("improved", "original", "captions")
    group = lambda k: F.coalesce(F.try_element_at("output_groups", F.lit(k)), none)
    flat = outputs(F.coalesce("output_groups", F.create_map().cast("map<string,array<string>>")))
    paths = F.coalesce("output_paths", none)
    of = lambda one: F.create_map(*[x for k in names for x in (F.lit(k), one(k))])
    return metadata.select(
        key, F.when(F.size(flat) > 0, flat).otherwise(paths).alias("outputs"),
        F.when(F.size(flat) > 0, of(group)).otherwise(of(lambda k: paths if k == "original" else none)).alias("groups"),
    )


#: Digits of a block's digest.
BLOCK_ID = r"^[0-9a-f]{20}$"


def editorial_results(results: DataFrame) -> DataFrame:
    """Results whose block_id is a digest; others can't be those of a block."""
    return results.where(F.col("block_id").rlike(BLOCK_ID))
