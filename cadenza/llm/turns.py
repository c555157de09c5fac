"""Clean speaker turns from transcript segments.

Segments are spread by ``(job, hour)``, so that a job with a third of all rows is many small groups.
Within an hour, neighbouring segments of one speaker become a run; the speaker and the run that an
hour takes over from those before it are computed over one summary row an hour.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cadenza.common import cut
from cadenza.llm import rosters, speech

BUCKET_MS = 3_600_000
KEY = ["job_id", "b"]
ORDER = ["s", "chunk_index", "seg_index", "segment_id"]


def spoken(segments: DataFrame, *, keep_text: bool = False) -> DataFrame:
    """Segments with speech and a start: job_id, b, s, chunk_index, seg_index, segment_id, key[, said].

    Left out: NULL or non-finite start, and texts of nothing but timestamps, sound annotations,
    hesitations and a label (NULL and blank texts too), and segments of no job. ``key`` is the label of the column or else
    of the text, NULL if there is neither. NULL chunk or segment numbers sort first.
    """
    def parts(key: Column, said: Column) -> Column:
        return F.struct(key.alias("key"), *([speech.without_hesitations(said).alias("said")] if keep_text else []))

    def taken_apart(bare: Column) -> Column:
        both = F.coalesce(speech.label_key(F.col("speaker")), speech.label_key(speech.label_of(bare)))
        return speech.let(speech.speech_of(bare), lambda said: F.when(~speech.only_hesitation(said), parts(both, said)))

    text = F.col("text")
    plain = F.when(~speech.only_hesitation(text), parts(speech.label_key(F.col("speaker")), text))
    body = F.when(speech.marked(text), speech.let(speech.without_times(text), taken_apart)).otherwise(plain)
    at = F.col("start_sec")
    return (
        segments.where(F.col("job_id").isNotNull() & at.isNotNull() & ~F.isnan(at) & (F.abs(at) < 9e12) & F.col("text").isNotNull())
        # An array of one or none, so that its parts are computed once; a filter behind them would compute them twice.
        .select("job_id", F.round(at * 1000).cast("bigint").alias("s"), "chunk_index", "seg_index", "segment_id", F.inline(F.array_compact(F.array(body))))
        .withColumn("b", F.floor(F.col("s") / BUCKET_MS))
        .select("job_id", "b", "s", "chunk_index", "seg_index", "segment_id", "key", *(["said"] if keep_text else []))
    )


def _composed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = [(job, rosters.block(name)) for job, labels in zip(pdf["job_id"], pdf["labels"]) for _, _, name in rosters.compositions(rosters.orphans({x["key"]: int(x["n"]) for x in labels}))]
        yield pd.DataFrame(out, columns=["job_id", "block"])


def _resolved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for job, labels, known in zip(pdf["job_id"], pdf["labels"], pdf["known"]):
            out += [(job, key, who) for key, who in rosters.resolve({x["key"]: int(x["n"]) for x in labels}, list(known) if known is not None else ()).items()]
        yield pd.DataFrame(out, columns=["job_id", "key", "who"])


def _spelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(block, key, name) for block, x in zip(pdf["block"], pdf["x"]) for key, name in rosters.spellings({e["key"]: int(e["n"]) for e in x}).items()]
        yield pd.DataFrame(rows, columns=["block", "key", "name"])


@F.pandas_udf(StringType())
def _block(name: pd.Series) -> pd.Series:
    return name.map(rosters.block)


def roster(labels: DataFrame) -> DataFrame:
    """block, key, name: every full name of any transcript with the spelling that most transcripts use; ``labels``: job_id, key, n.

    Only names that sound alike are compared. A person is whoever bears a name: however many people
    share a surname, and however their names are misspelt elsewhere, each full name is one entry.
    """
    full = (F.size(F.split("key", " ")) > 1) & ~F.col("key").rlike(r"\.|(^| )\S( |$)")
    names = labels.where(full).groupBy("key").agg(F.count("*").alias("n")).withColumn("block", _block("key"))
    return names.groupBy("block").agg(F.collect_list(F.struct("key", "n")).alias("x")).mapInPandas(_spelled, "block string, key string, name string")


def name_table(rows: DataFrame) -> DataFrame:
    """job_id, key, who: for each label that is another spelling, the name it stands for.

    A label is resolved among the names of its own transcript first. Labels that none of them
    explains are put together in pairs ('A. Silva' and 'Ana' would be 'Ana Silva'); pairs whose name
    the roster of all transcripts holds, in whatever spelling, mean that person. Names are then given
    in the roster's spelling. Only labels and their counts are gathered, never segments.
    """
    labels = cut(rows.where(F.col("key").isNotNull() & ~F.col("key").startswith("#")).groupBy("job_id", "key").agg(F.count("*").alias("n")))
    people = cut(roster(labels))
    grouped = labels.groupBy("job_id").agg(F.collect_list(F.struct("key", "n")).alias("labels"))
    found = grouped.mapInPandas(_composed, "job_id string, block string").distinct().join(people.select("block", "name").distinct(), "block")
    known = found.groupBy("job_id").agg(F.array_sort(F.collect_set("name")).alias("known"))
    resolved = grouped.join(known, "job_id", "left").mapInPandas(_resolved, "job_id string, key string, who string")
    spelled = people.where("key <> name").select(F.col("key").alias("who"), "name")
    return resolved.join(spelled, "who", "left").select("job_id", "key", F.coalesce("name", "who").alias("who")).where("who <> key")


def renamed(rows: DataFrame) -> DataFrame:
    """job_id, b, names: for each hour a map of its labels to the names they stand for, where these differ."""
    there = rows.where("key IS NOT NULL").select(*KEY, "key").distinct()
    return there.join(name_table(rows), ["job_id", "key"]).groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("key", "who"))).alias("names"))


def _numbered(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows once each, with the speaker ``heard`` in them (NULL if none was named in the hour so far) and the ``run`` of one speaker they belong to."""
    one = rows.repartition(*KEY).dropDuplicates([*KEY, *ORDER]).join(names, KEY, "left")
    w = Window.partitionBy(*KEY).orderBy(*ORDER)
    filled = one.withColumn("heard", F.last(F.coalesce(F.try_element_at("names", F.col("key")), "key"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("names", "key")
    changed = F.lag(F.lit(1)).over(w).isNull() | ~F.col("heard").eqNullSafe(F.lag("heard").over(w))
    return filled.withColumn("new", changed.cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def runs(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Runs of one speaker within each hour, and for each the run of the job that it belongs to.

    Returns job_id, b, run, who, head, tail (ordering keys of its first and last segment) and
    ``turn``, the ordering key of the first segment of the whole turn.
    """
    key, order = KEY, F.struct(*ORDER)
    local = cut(_numbered(rows, names).groupBy(*key, "run").agg(F.first("heard").alias("heard"), F.min(order).alias("head"), F.max(order).alias("tail")))
    named = F.col("heard").isNotNull()
    by_hour = local.groupBy(*key).agg(
        F.min_by(F.when(named, F.col("heard")), F.when(named, F.col("run"))).alias("first_who"),
        F.max_by(F.when(named, F.col("heard")), F.when(named, F.col("run"))).alias("last_who"),
        F.max(F.when(named, F.col("head"))).alias("last_head"),
        F.count(F.when(named, 1)).alias("named"),
        F.min("head").alias("start"),
    )
    earlier = Window.partitionBy("job_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        by_hour.withColumn("carry", F.last("last_who", ignorenulls=True).over(earlier))
        .withColumn("begun", F.count(F.lit(1)).over(earlier) > 0)
        .withColumn(
            "opened",
            F.when(F.col("named") > 1, F.col("last_head"))
            .when((F.col("named") == 1) & ~F.col("first_who").eqNullSafe(F.col("carry")), F.col("last_head"))
            .when((F.col("named") == 0) & ~F.col("begun"), F.col("start")),
        )
        .withColumn("open", F.max("opened").over(earlier))
        .select(*key, "carry", "begun", "first_who", "open")
    )
    both = local.join(carried, key)
    first_named = F.col("heard").isNotNull() & (F.col("run") == F.min(F.when(F.col("heard").isNotNull(), F.col("run"))).over(Window.partitionBy(*key)))
    goes_on = (F.col("heard").isNull() & F.col("begun")) | (first_named & F.col("heard").eqNullSafe(F.col("carry")))
    return both.withColumn("turn", F.when(goes_on, F.col("open")).otherwise(F.col("head"))).select(
        *key, "run", F.coalesce("heard", "carry").alias("who"), "head", "tail", "turn"
    )


def turn_bounds(segments: DataFrame) -> DataFrame:
    """job_id, speaker, first_segment_id, last_segment_id, start_ms of each turn, in no order.

    Unlabelled segments go on with the speaker before them; those before a job's first label, and a
    job without labels, have one unnamed speaker (NULL). Neither pauses nor chunk ends break a turn.
    Ties in time are ordered by chunk, segment number and id; re-delivered rows count once.
    """
    rows = cut(spoken(segments))
    return (
        runs(rows, renamed(rows))
        .groupBy("job_id", "turn").agg(F.max("tail").alias("tail"), F.first("who").alias("speaker"))
        .select("job_id", "speaker", F.col("turn.segment_id").alias("first_segment_id"), F.col("tail.segment_id").alias("last_segment_id"), F.col("turn.s").alias("start_ms"))
    )


def turn_texts(segments: DataFrame) -> DataFrame:
    """Turns with their cleaned text: job_id, turn_index, part, parts, speaker, start_ms, segments, text.

    A turn that goes on over full hours has a part an hour, in order, so that no task and no cell
    holds more than an hour's speech; its whole text is that of its parts, joined by spaces. Turn
    numbers count from 0 in order of start. Turns are found over ids alone; the texts are moved once,
    to their hour, where they are joined with its turns.
    """
    rows = cut(spoken(segments, keep_text=True))
    names = cut(renamed(rows))
    bounds = cut(runs(rows.drop("said"), names))
    heads = bounds.where(F.col("turn") == F.col("head")).select("job_id", "b", "turn")
    before = heads.groupBy("job_id", "b").agg(F.count("*").alias("n")).select(
        "job_id", "b", F.coalesce(F.sum("n").over(Window.partitionBy("job_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    )
    number = (F.row_number().over(Window.partitionBy(*KEY).orderBy("turn")) - 1 + F.col("base")).cast("bigint")
    numbers = heads.join(before, KEY).select("job_id", "turn", number.alias("turn_index"))
    in_turn = Window.partitionBy("job_id", "turn_index")
    stretches = (
        bounds.join(numbers, ["job_id", "turn"]).groupBy(*KEY, "turn_index").agg(F.collect_list("run").alias("runs"), F.max("who").alias("who"), F.first("turn.s").alias("start_ms"))
        .withColumn("part", F.row_number().over(in_turn.orderBy("b")) - 1).withColumn("parts", F.count("*").over(in_turn).cast("int"))
    )
    at = F.struct("run", "turn_index", "part", "parts", F.col("who").alias("speaker"), "start_ms")
    turns = stretches.withColumn("run", F.explode("runs")).groupBy(*KEY).agg(F.sort_array(F.collect_list(at)).alias("turns"))  # the k-th is that of run k
    placed = _numbered(rows, names).join(turns, KEY).select(*KEY, F.element_at("turns", F.col("run").cast("int")).alias("at"), F.struct(*ORDER, "said").alias("x"))
    said = placed.groupBy(*KEY, F.col("at.turn_index").alias("turn_index")).agg(F.first("at").alias("at"), F.sort_array(F.collect_list("x")).alias("x"))
    return said.select("job_id", "turn_index", "at.part", "at.parts", "at.speaker", "at.start_ms", F.size("x").cast("bigint").alias("segments"), F.array_join("x.said", " ").alias("text"))
