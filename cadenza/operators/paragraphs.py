"""Speaker runs, readable paragraphs and blocks of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.common import cut
from cadenza.functions import folds
from cadenza.functions import text as T
from cadenza.operators import sequence

#: Pause that ends a paragraph (ms); soft and hard length; a tail under ``SHORT`` goes back if the whole stays within ``HARD + SHORT``.
PAUSE_MS, SOFT, HARD, SHORT = 2_000, 900, 1_600, 300
#: Version that goes into a block's digest.
CONTRACT = "1"


def speaker_runs(rows: DataFrame, keys: list[str], bucket: str, order: list[str]) -> DataFrame:
    """keys, run (ordering key of its first row), part, speaker, segments, text of runs of one speaker (NULL equals NULL).

    A run has a part for every ``bucket`` it goes through, in the order of ``part``, so that no task and
    no cell holds more than one bucket of it. The first part begins with the speaker's name, if any;
    a run's text is that of its parts joined by spaces, and a blank line stands between runs.
    """
    ordered = [bucket, *order]
    prev = sequence.with_previous(rows, keys, bucket, order, F.struct("speaker"), name="prev")
    marked = sequence.islands(prev, keys, bucket, ordered, F.col("prev").isNull() | ~F.col("prev.speaker").eqNullSafe(F.col("speaker")), name="run")
    parts = marked.groupBy(*keys, bucket, "run").agg(F.first("speaker").alias("speaker"), F.count("*").alias("segments"), F.sort_array(F.collect_list(F.struct(*order, "text"))).alias("x"))
    name = F.when((F.col(bucket) == F.col(f"run.{bucket}")) & F.col("speaker").isNotNull(), F.concat("speaker", F.lit(": "))).otherwise("")
    return parts.select(*keys, "run", F.col(bucket).alias("part"), "speaker", "segments", F.concat(name, F.array_join(F.transform("x", lambda s: s["text"]), " ")).alias("text"))


def _of_stretch(text: Column) -> Column:
    """Paragraphs of one stretch of speech; a short last one goes back if there is room."""

    def packed(s: Column) -> Column:
        return T.let(folds.paragraph_of(F.transform(s, F.length), SOFT, HARD), lambda of: F.transform(
            F.sequence(F.lit(0), F.element_at(of, -1)), lambda k: F.array_join(F.filter(s, lambda _, i: F.get(of, i) == k), " ")
        ))

    def settled(p: Column) -> Column:
        last, before = F.element_at(p, -1), F.try_element_at(p, F.lit(-2))
        back = (F.size(p) > 1) & (F.length(last) < SHORT) & (F.length(before) + 1 + F.length(last) <= HARD + SHORT)
        return F.when(back, F.concat(F.slice(p, F.lit(1), F.size(p) - 2), F.array(F.concat_ws(" ", before, last)))).otherwise(p)

    return T.let(T.sentences(text), lambda s: F.when(F.size(s) > 0, T.let(packed(s), settled)).otherwise(F.array().cast("array<string>")))


def _heads(lengths: Column) -> Column:
    """For a row of stretches (at, n, size) that begins with one that stays: the stretch at whose last paragraph each one ends up, and that paragraph's number.

    ``size`` is the length of a stretch's last paragraph; those behind the first have only one, a short one.
    """
    out = "array<struct<at:bigint,head:bigint,k:int>>"
    first = F.element_at(lengths, 1)
    start = F.struct(first["size"].alias("size"), first["at"].alias("head"), (first["n"] - 1).alias("k"), F.array(F.struct(first["at"].alias("at"), first["at"].alias("head"), (first["n"] - 1).alias("k"))).cast(out).alias("done"))

    def add(acc: Column, x: Column) -> Column:
        joins = acc["size"] + 1 + x["size"] <= HARD + SHORT
        head, k = F.when(joins, acc["head"]).otherwise(x["at"]), F.when(joins, acc["k"]).otherwise(0)
        return F.struct(F.when(joins, acc["size"] + 1 + x["size"]).otherwise(x["size"]).alias("size"), head.alias("head"), k.alias("k"), F.concat(acc["done"], F.array(F.struct(x["at"].alias("at"), head.alias("head"), k.alias("k")))).cast(out).alias("done"))

    return F.aggregate(F.slice(lengths, F.lit(2), F.size(lengths)), start, add, lambda acc: acc["done"])


def natural_paragraphs(rows: DataFrame, keys: list[str], bucket: str, order: list[str]) -> DataFrame:
    """keys, head, part, speaker, text: paragraphs broken at speaker changes, pauses and lengths.

    ``rows``: segments that last and have text, with s, e, speaker, text. A pause, measured from the
    end of the row before, and a change of speaker end a stretch; each stretch is packed by sentences.
    ``head`` is the number, within its keys, of the stretch that a paragraph begins in, ``part`` its
    number there. A stretch of one short paragraph joins the one before if that is the same speaker's
    and has room; which one that is depends on lengths alone. So a task holds one stretch of
    uninterrupted speech, or the lengths of consecutive short ones, never a whole run.
    """
    ordered = [bucket, *order]
    said_rows = rows.where(T.strip(F.col("text")) != "")
    prev = sequence.with_previous(said_rows, keys, bucket, order, F.struct("speaker", "e"), name="prev")
    turn = F.col("prev").isNull() | ~F.col("prev.speaker").eqNullSafe(F.col("speaker"))
    tagged = prev.withColumn("turn", turn).withColumn("pause", turn | (F.col("s") - F.col("prev.e") >= PAUSE_MS))
    marked = sequence.islands(tagged, keys, bucket, ordered, F.col("pause"), name="stretch")
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*ordered, F.trim("text").alias("text")))), lambda x: x["text"]), " ")
    stretches = marked.groupBy(*keys, "stretch").agg(F.first("speaker").alias("speaker"), F.max("turn").alias("turn"), said.alias("text"))
    # The first row of a stretch begins it, so its bucket is the stretch's.
    written = cut(stretches.select(*keys, F.col(f"stretch.{bucket}").alias("b"), "stretch", "speaker", "turn", _of_stretch(F.col("text")).alias("p")))
    packed = sequence.numbered(written, keys, "b", ["stretch"], name="at")
    stays = F.col("turn") | (F.size("p") > 1) | (F.length(F.element_at("p", -1)) >= SHORT)
    chain = sequence.islands(packed.select(*keys, "b", "at", F.size("p").alias("n"), F.length(F.element_at("p", -1)).alias("size"), stays.alias("stays")), keys, "b", ["at"], F.col("stays"), name="chain")
    heads = chain.groupBy(*keys, "chain").agg(F.sort_array(F.collect_list(F.struct("at", "n", "size"))).alias("x")).select(*keys, F.inline(_heads(F.col("x"))))
    placed = packed.join(heads, [*keys, "at"]).select(*keys, "at", "head", "k", "speaker", F.posexplode("p").alias("i", "text"))
    part = F.when(F.col("at") == F.col("head"), F.col("i")).otherwise(F.col("k")).alias("part")
    whole = placed.groupBy(*keys, "head", part).agg(F.first("speaker").alias("speaker"), F.sort_array(F.collect_list(F.struct("at", "text"))).alias("x"))
    return whole.select(*keys, "head", "part", "speaker", F.array_join(F.transform("x", lambda x: x["text"]), " ").alias("text"))


def blocks(text: Column, limit: int = 12_000) -> Column:
    """Array of block texts within ``limit`` characters: paragraphs, else sentences, else words, packed greedily."""
    if limit < 500:
        raise ValueError("a block of under 500 characters is too small")
    units = F.flatten(F.transform(folds.paragraphs(text), lambda p: folds.split_unit(p, limit)))
    return folds.pack(units, limit, "\n\n")


def block_id(index: Column, text: Column, contract: str = CONTRACT) -> Column:
    """First 20 hex digits of the SHA-256 of contract, index and text, NUL between them."""
    return F.substring(F.sha2(F.concat(F.lit(contract), F.lit("\0"), index.cast("string"), F.lit("\0"), text), 256), 1, 20)


def assemble_results(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """job_id, n_blocks, missing, unknown, state, text of every job with blocks or accepted answers.

    ``blocks`` has job_id, block_index and block_id, ``answers`` job_id, block_id, text, received_at
    and response_id. The first answer to a block that isn't blank is accepted. ``state`` is 'order' if
    a job's indices aren't 0, 1, ... without gaps or repeats, else 'incomplete' if an id stands twice,
    a block has no accepted answer (``missing``) or an accepted answer no block (``unknown``), else
    'assembled'; only then is ``text`` not NULL: the answers in block order, a blank line between
    them. Only such jobs' texts are gathered, each into its one result row.
    """
    clean = T.strip(F.regexp_replace("text", r"\r\n?", "\n"))
    first = F.struct(F.col("received_at").isNull(), "received_at", "response_id", clean.alias("text"))
    accepted = answers.where("job_id IS NOT NULL").where(clean != "").groupBy("job_id", "block_id").agg(F.min(first).alias("x")).select("job_id", "block_id", F.col("x.text").alias("text"))
    plan = blocks.where("job_id IS NOT NULL").select("job_id", "block_index", "block_id", F.lit(1).alias("planned")).distinct()
    both = plan.join(accepted, ["job_id", "block_id"], "full")
    n = F.count("planned")
    ordered = F.coalesce((F.min("block_index") == 0) & (F.max("block_index") == n - 1) & (F.countDistinct("block_index") == n), n == 0)
    sums = both.groupBy("job_id").agg(
        n.alias("n_blocks"), F.count(F.when(F.col("text").isNull(), 1)).alias("missing"), F.count(F.when(F.col("planned").isNull(), 1)).alias("unknown"),
        ordered.alias("ordered"), (F.countDistinct("block_id", "planned") == n).alias("once"),
    )
    state = F.when(~F.col("ordered"), "order").when(~F.col("once") | (F.col("missing") > 0) | (F.col("unknown") > 0), "incomplete").otherwise("assembled")
    sums = sums.select("job_id", "n_blocks", "missing", "unknown", state.alias("state"))
    whole = both.join(sums.where("state = 'assembled'").select("job_id"), "job_id", "left_semi").groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("block_index", "text"))).alias("x"))
    return sums.join(whole.select("job_id", F.array_join("x.text", "\n\n").alias("text")), "job_id", "left")
