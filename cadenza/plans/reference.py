"""Queries over the transcript operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.common import millis, once, table
from cadenza.functions import folds, languages
from cadenza.functions import sources as S
from cadenza.functions import text as T
from cadenza.operators import assembly, captions, chunks, intervals, paragraphs, render, search, sequence
from cadenza.plans import views
from cadenza.plans.views import BLOCKS_SQL, JOBS_SQL, SPEECH_SQL
from cadenza.sources import media, store, subtitles
from cadenza.streaming import progress

ORDER = ["s", "chunk_index", "seg_index", "segment_id"]
ORDER_SQL = "PARTITION BY job_id ORDER BY s, chunk_index, seg_index, segment_id"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# Intervals and chunks ------------------------------------------------------------------------


MERGED_SQL = f"""
{JOBS_SQL}, m AS (SELECT media_id, CAST(round(max(duration) * 1000) AS BIGINT) AS most FROM latest WHERE duration > 0 GROUP BY media_id),
x AS (SELECT media_id, least(greatest(CAST(round(start_sec * 1000) AS BIGINT), 0), coalesce(most, 9e15)) AS s, least(greatest(CAST(round(end_sec * 1000) AS BIGINT), 0), coalesce(most, 9e15)) AS e FROM silences LEFT JOIN m USING (media_id)
  WHERE start_sec IS NOT NULL AND end_sec IS NOT NULL AND media_id IS NOT NULL),
y AS (SELECT *, max(e) OVER (PARTITION BY media_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM x WHERE e > s),
z AS (SELECT *, sum(CASE WHEN seen IS NULL OR s > seen THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM y),
merged AS (SELECT media_id, CAST(min(s) AS BIGINT) AS start_ms, CAST(max(e) AS BIGINT) AS end_ms FROM z GROUP BY media_id, island)
"""


@query(f"WITH {MERGED_SQL} SELECT *, end_ms - start_ms AS length_ms, start_ms + end_ms AS twice_midpoint FROM merged")
def ivl01_merge_silences(spark: SparkSession, d: str) -> DataFrame:
    """Merged silences of each medium, within its duration where that is known, with length and midpoint."""
    most = views.jobs(spark, d).where("duration > 0").groupBy("media_id").agg(F.max("duration").alias("most"))
    t = table(spark, d, "silences").select("media_id", "start_sec", "end_sec").join(most, "media_id", "left")
    inside = lambda c: F.least(c, F.coalesce("most", c))
    timed = t.where("start_sec IS NOT NULL AND end_sec IS NOT NULL")
    p = intervals.merge_periods(intervals.interval_rows(timed, [F.col("media_id")], inside(F.col("start_sec")), inside(F.col("end_sec"))))
    return p.select(F.col("e0").alias("media_id"), "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("length_ms"), (F.col("end_ms") + F.col("start_ms")).alias("twice_midpoint"))


@query(f"""
WITH RECURSIVE {MERGED_SQL},
p AS (SELECT media_id, duration, target_duration AS target, search_window AS win, overlap, min_duration AS least_ FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY duration DESC, planner_id DESC) AS r FROM latest WHERE duration > 0) JOIN planners USING (planner_id) WHERE r = 1),
q AS (SELECT media_id, list(struct_pack(m := (start_ms / 1000.0 + end_ms / 1000.0) / 2, a := start_ms / 1000.0, z := end_ms / 1000.0)) AS silences FROM merged GROUP BY media_id),
f AS (
  SELECT media_id, -1 AS chunk_index, CAST(0 AS DOUBLE) AS start_sec, CAST(0 AS DOUBLE) AS end_sec, CAST(0 AS DOUBLE) AS overlap_before, '' AS boundary, CAST(0 AS DOUBLE) AS here, CAST(0 AS DOUBLE) AS carry FROM p
  UNION ALL
  SELECT media_id, chunk_index + 1, here, CASE WHEN last THEN duration WHEN hit IS NOT NULL THEN hit.m ELSE here + target END, carry, CASE WHEN last THEN 'end' WHEN hit IS NOT NULL THEN 'silence' ELSE 'hard' END,
    CASE WHEN hit IS NOT NULL THEN hit.m ELSE here + target - overlap END, CASE WHEN hit IS NOT NULL THEN 0 ELSE here + target - (here + target - overlap) END FROM (
    SELECT f.media_id, f.chunk_index, f.here, f.carry, p.*, duration - here <= target + 1e-6 OR duration - (here + target) < least_ AS last,
      list_sort(list_transform(list_filter(silences, lambda x: x.m >= greatest(here + least_, here + target - win) - 1e-6 AND x.m <= least(duration - least_, here + target + win) + 1e-6), lambda x: struct_pack(far := abs(x.m - (here + target)), short := x.a - x.z, a := x.a, m := x.m)))[1] AS hit
    FROM f JOIN p USING (media_id) LEFT JOIN q USING (media_id) WHERE f.boundary <> 'end'))
SELECT media_id, chunk_index, start_sec, end_sec, overlap_before, boundary FROM f WHERE chunk_index >= 0
""")
def ivl02_chunk_plan(spark: SparkSession, d: str) -> DataFrame:
    """Chunk plan of every job's medium along its merged silences, by its planner's parameters."""
    silent = ivl01_merge_silences(spark, d).groupBy("media_id").agg(
        F.sort_array(F.collect_list(F.struct((F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end")))).alias("silences")
    )
    media = views.jobs(spark, d).where("duration > 0").groupBy("media_id").agg(F.max_by(F.struct("duration", "planner_id"), F.struct("duration", "planner_id")).alias("x")).select("media_id", "x.*")
    return chunks.plans(media.join(F.broadcast(table(spark, d, "planners")), "planner_id").join(silent, "media_id", "left").select("media_id", "duration", "target_duration", "search_window", "overlap", "min_duration", "silences"))


@query(f"""
WITH {JOBS_SQL},
p AS (SELECT DISTINCT c.job_id, c.chunk_index, j.media_id, CAST(round(c.start_sec * 1000) AS BIGINT) + CAST(round(p.target_duration * 1000) AS BIGINT) AS at_ms, CAST(round(p.search_window * 1000) AS BIGINT) AS window_ms
  FROM chunks c JOIN latest j USING (job_id) JOIN planners p USING (planner_id)),
s AS (SELECT DISTINCT media_id, greatest(CAST(round(start_sec * 1000) AS BIGINT), 0) AS s, greatest(CAST(round(end_sec * 1000) AS BIGINT), 0) AS e FROM silences WHERE start_sec IS NOT NULL AND end_sec IS NOT NULL),
r AS (SELECT p.*, s.s, s.e, abs(s.s + s.e - 2 * at_ms) AS twice_distance, row_number() OVER (PARTITION BY job_id, chunk_index, at_ms, window_ms ORDER BY abs(s.s + s.e - 2 * at_ms), s.s - s.e, s.s) AS k
  FROM p JOIN s USING (media_id) WHERE s.e > s.s AND abs(s.s + s.e - 2 * at_ms) <= 2 * window_ms)
SELECT job_id, chunk_index, media_id, at_ms, window_ms, s, e, twice_distance FROM r WHERE k = 1
""")
def jn10_nearest_silence(spark: SparkSession, d: str) -> DataFrame:
    """The silence nearest to each chunk's ideal end within the search window."""
    p = F.broadcast(table(spark, d, "planners").select("planner_id", "target_duration", "search_window"))
    points = (
        table(spark, d, "chunks").join(views.jobs(spark, d).select("job_id", "media_id", "planner_id"), "job_id").join(p, "planner_id")
        .select("job_id", "chunk_index", "media_id", (F.round(F.col("start_sec") * 1000) + F.round(F.col("target_duration") * 1000)).cast("bigint").alias("at_ms"), F.round(F.col("search_window") * 1000).cast("bigint").alias("window_ms"))
        .distinct()
    )
    t = table(spark, d, "silences")
    spans = t.select("media_id", millis(F.col("start_sec")).alias("s"), millis(F.col("end_sec")).alias("e"))
    return chunks.nearest(points, spans, on="media_id")


CHUNK_SQL = "c AS (SELECT DISTINCT job_id, chunk_index, CAST(round(start_sec * 1000) AS BIGINT) AS chunk_s, CAST(round(end_sec * 1000) AS BIGINT) AS chunk_e, CAST(round(overlap_before * 1000) AS BIGINT) AS overlap_ms FROM chunks)"


def _chunked(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("job_id", "chunk_index", *[F.round(F.col(a) * 1000).cast("bigint").alias(b) for a, b in (("start_sec", "chunk_s"), ("end_sec", "chunk_e"), ("overlap_before", "overlap_ms"))]).distinct()
    return views.speech(spark, d).join(c, ["job_id", "chunk_index"])


@query(f"""
WITH {SPEECH_SQL}, {CHUNK_SQL},
x AS (SELECT segment_id, chunk_s, least(greatest(s - chunk_s, 0), chunk_e - chunk_s) AS clip_s, least(greatest(e - chunk_s, 0), chunk_e - chunk_s) AS clip_e FROM speech JOIN c USING (job_id, chunk_index))
SELECT segment_id, clip_s, clip_e, clip_s + chunk_s AS start_ms, clip_e + chunk_s AS end_ms FROM x WHERE clip_e > clip_s
""")
def prj02_clip_shift(spark: SparkSession, d: str) -> DataFrame:
    """Segments clipped to their chunk and shifted back to the source's time line."""
    rows = chunks.clipped(_chunked(spark, d))
    return rows.select("segment_id", "clip_s", "clip_e", (F.col("clip_s") + F.col("chunk_s")).alias("start_ms"), (F.col("clip_e") + F.col("chunk_s")).alias("end_ms"))


@query(f"""
WITH {SPEECH_SQL},
w AS (SELECT DISTINCT segment_id, job_id, chunk_index, CAST(round(x.start_sec * 1000) AS BIGINT) AS ws, CAST(round(x.end_sec * 1000) AS BIGINT) AS we, i
  FROM (SELECT segment_id, job_id, chunk_index, unnest(words) AS x, generate_subscripts(words, 1) AS i FROM segments WHERE words IS NOT NULL))
SELECT s.segment_id, count(w.ws) AS n_words FROM speech s LEFT JOIN w ON w.job_id = s.job_id AND w.chunk_index = s.chunk_index AND w.ws >= s.s AND w.we <= s.e GROUP BY s.segment_id
""")
def jn02_words_in_segments(spark: SparkSession, d: str) -> DataFrame:
    """Words of a chunk that lie within each of its segments."""
    seg = views.speech(spark, d).select("job_id", "chunk_index", "segment_id", "s", "e")
    flat = once(table(spark, d, "segments").select("segment_id", "job_id", "chunk_index", "words"), "segment_id").select("job_id", "chunk_index", F.inline("words"))
    words = flat.select("job_id", "chunk_index", F.round(F.col("start_sec") * 1000).cast("bigint").alias("ws"), F.round(F.col("end_sec") * 1000).cast("bigint").alias("we"))
    return chunks.contained_words(seg.where("e >= s"), words, keys=["job_id", "chunk_index"]).unionByName(seg.where("e < s").select("segment_id", F.lit(0).cast("bigint").alias("n_words")))


@query(f"""
WITH {SPEECH_SQL} SELECT segment_id, max(s) OVER (PARTITION BY job_id ORDER BY chunk_index, seg_index, segment_id ROWS UNBOUNDED PRECEDING) AS start_ms,
 greatest(max(s) OVER (PARTITION BY job_id ORDER BY chunk_index, seg_index, segment_id ROWS UNBOUNDED PRECEDING), e) AS end_ms FROM speech
""")
def win03_monotone_start(spark: SparkSession, d: str) -> DataFrame:
    """Starts that never go back in order of arrival, ends not before them."""
    rows = sequence.running_max(views.speech(spark, d), ["job_id"], "chunk_index", ["chunk_index", "seg_index", "segment_id"], F.col("s"), name="start_ms")
    return rows.select("segment_id", "start_ms", F.greatest("start_ms", "e").alias("end_ms"))


UNITS_SQL = """
u AS (SELECT k, length, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (SELECT k, length, string_split(regexp_replace(regexp_replace(text, '([.!?…])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)) AS x FROM timed)),
w AS (SELECT k, length, i, list_filter(string_split_regex(s, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}]+'), lambda y: y <> '') AS w FROM u),
p AS (SELECT k, length, i, j, list_slice(w, 28 * j + 1, 28 * j + 28) AS x FROM w, unnest(range(0, CAST(ceil(len(w) / 28.0) AS BIGINT))) AS r(j)),
q AS (SELECT *, len(x) AS weight, row_number() OVER (PARTITION BY k ORDER BY i, j) - 1 AS unit, CAST(sum(len(x)) OVER (PARTITION BY k ORDER BY i, j) AS BIGINT) AS upto, CAST(sum(len(x)) OVER (PARTITION BY k) AS BIGINT) AS total FROM p)
SELECT {k}, CAST(unit AS INT) AS unit, CAST(weight AS INT) AS weight, length * (upto - weight) / total AS start_sec, CASE WHEN upto = total THEN length ELSE length * upto / total END AS end_sec, array_to_string(x, ' ') AS text FROM q
"""


@query(f"WITH {BLOCKS_SQL}, timed AS (SELECT block_id AS k, CAST(target_duration AS DOUBLE) AS length, text FROM blocks JOIN planners USING (planner_id)), {UNITS_SQL.format(k='k AS block_id')}")
def win04_estimated_times(spark: SparkSession, d: str) -> DataFrame:
    """Times estimated for text without any: units of at most 28 words share the duration by their words."""
    rows = views.blocks(spark, d).join(table(spark, d, "planners").select("planner_id", "target_duration"), "planner_id")
    out = media.estimated(rows, key="block_id", text="text", duration="target_duration")
    return out.select("block_id", "unit", "weight", F.col("start").alias("start_sec"), F.col("end").alias("end_sec"), "text")


@query(f"""
WITH {BLOCKS_SQL} SELECT block_id, right(lag(text) OVER (PARTITION BY job_id ORDER BY block_index, block_id), 800) AS context FROM blocks
""")
def win05_context(spark: SparkSession, d: str) -> DataFrame:
    """The last 800 characters of the block before each block."""
    rows = views.blocks(spark, d).withColumn("b", F.floor(F.col("block_index") / 1000))
    return sequence.with_previous(rows, ["job_id"], "b", ["block_index", "block_id"], F.right("text", F.lit(800)), name="context").select("block_id", "context")


@query(f"""
WITH {BLOCKS_SQL} SELECT block_id, nullif(right(coalesce(string_agg(text, ' ' ORDER BY block_index, block_id) OVER (PARTITION BY job_id ORDER BY block_index, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), 3000), '') AS context FROM blocks
""")
def jn12_prefix_context(spark: SparkSession, d: str) -> DataFrame:
    """The last 3 000 characters of all blocks before each block."""
    rows = views.blocks(spark, d).withColumn("b", F.floor(F.col("block_index") / 32))
    return sequence.text_before(rows, ["job_id"], "b", ["block_index", "block_id"], "text", most=3_000).select("block_id", "context")


@query("""
WITH q AS (SELECT DISTINCT request_id, block_id, sent_at FROM editorial_requests)
SELECT request_id, row_number() OVER (PARTITION BY block_id ORDER BY sent_at, request_id) AS number, 'editorial:' || block_id || ':' || row_number() OVER (PARTITION BY block_id ORDER BY sent_at, request_id) AS attempt FROM q
""")
def win01_attempt_number(spark: SparkSession, d: str) -> DataFrame:
    """Number and identity of each request among those of its block."""
    from pyspark.sql import Window

    rows = table(spark, d, "editorial_requests").select("request_id", "block_id", "sent_at").distinct()
    n = F.row_number().over(Window.partitionBy("block_id").orderBy("sent_at", "request_id")).cast("bigint")
    return rows.select("request_id", n.alias("number"), F.concat(F.lit("editorial:"), F.col("block_id"), F.lit(":"), n.cast("string")).alias("attempt"))


@query(r"""
WITH b AS (SELECT doc_id, unnest(x) AS raw, generate_subscripts(x, 1) - 1 AS position FROM (SELECT doc_id, string_split_regex(text, '\n\s*\n') AS x FROM documents WHERE file_format = 'md'))
SELECT doc_id, CAST(position AS INT) AS position, length(trim(raw, ' ' || chr(10))) AS chars, regexp_matches(trim(raw, ' ' || chr(10)), '^#{1,6}\s') AS heading FROM b WHERE trim(raw, ' ' || chr(10)) <> ''
""")
def fn22_markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of every Markdown document and whether they are headings."""
    docs = table(spark, d, "documents").where(F.col("file_format") == "md").select("doc_id", "text")
    return search.markdown_blocks(docs, key="doc_id", markdown="text").select("doc_id", "position", F.length("block").cast("bigint").alias("chars"), "heading")


# Joins and completeness ----------------------------------------------------------------------


@query(f"""
WITH {BLOCKS_SQL}, q AS (SELECT DISTINCT request_id, block_id FROM editorial_requests), r AS (SELECT DISTINCT request_id FROM editorial_responses)
SELECT 'block' AS kind, block_id AS id FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.block_id = b.block_id)
UNION ALL SELECT 'request', CAST(request_id AS VARCHAR) FROM q WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.request_id = q.request_id)
""")
def jn06_pending_units(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that were never sent, and requests without an answer."""
    asked = table(spark, d, "editorial_requests").select("request_id", "block_id").distinct()
    unsent = views.blocks(spark, d).join(asked, "block_id", "left_anti").select(F.lit("block").alias("kind"), F.col("block_id").alias("id"))
    open_ = asked.join(table(spark, d, "editorial_responses"), "request_id", "left_anti").select(F.lit("request").alias("kind"), F.col("request_id").cast("string").alias("id"))
    return unsent.unionByName(open_)


@query("""
WITH c AS (SELECT DISTINCT job_id, chunk_index FROM chunks), t AS (SELECT DISTINCT job_id, chunk_index, 1 AS there FROM segments)
SELECT job_id, count(*) AS n_chunks, min(chunk_index) = 0 AND max(chunk_index) = count(*) - 1 AS contiguous, count(*) - count(there) AS missing
FROM c LEFT JOIN t USING (job_id, chunk_index) GROUP BY job_id
""")
def jn09_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Jobs whose chunk numbers are contiguous from 0, and chunks without any result."""
    c = table(spark, d, "chunks").select("job_id", "chunk_index").distinct()
    t = table(spark, d, "segments").select("job_id", "chunk_index").distinct().withColumn("there", F.lit(1))
    both = c.join(t, ["job_id", "chunk_index"], "left").groupBy("job_id")
    return both.agg(
        F.count("*").alias("n_chunks"), ((F.min("chunk_index") == 0) & (F.max("chunk_index") == F.count("*") - 1)).alias("contiguous"), (F.count("*") - F.count("there")).alias("missing")
    )


@query(f"WITH {JOBS_SQL} SELECT job_id, media_id, provider, model, status, epoch_us(updated_at) AS updated_us FROM latest")
def job02_latest_state(spark: SparkSession, d: str) -> DataFrame:
    """Latest snapshot of every job."""
    t = table(spark, d, "jobs")
    keep = ["media_id", "provider", "model", "status", "updated_at"]
    out = progress.latest(t.withColumn("_s", F.coalesce("settings", F.lit(""))), "job_id", ["updated_at", "status", "_s"], keep)
    return out.select("job_id", "media_id", "provider", "model", "status", F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated_us"))


@query(f"""
WITH {SPEECH_SQL}, a AS (SELECT job_id, max(e) AS last_ms, count(*) AS n FROM speech GROUP BY job_id),
t AS (SELECT DISTINCT job_id, language, duration FROM transcripts)
SELECT job_id, language, coalesce(last_ms, 0) AS last_ms, coalesce(n, 0) AS n_segments, coalesce(CAST(round(duration * 1000) AS BIGINT), last_ms, 0) >= coalesce(last_ms, 0) AS covered FROM t LEFT JOIN a USING (job_id)
""")
def agg04_durations(spark: SparkSession, d: str) -> DataFrame:
    """End of speech of each transcript (0 without any) and whether its duration covers it."""
    a = views.speech(spark, d).groupBy("job_id").agg(F.max("e").alias("last_ms"), F.count("*").alias("n"))
    t = table(spark, d, "transcripts").select("job_id", "language", "duration").distinct().join(a, "job_id", "left")
    last = F.coalesce("last_ms", F.lit(0))
    return t.select("job_id", "language", last.alias("last_ms"), F.coalesce("n", F.lit(0)).alias("n_segments"), (F.coalesce(F.round(F.col("duration") * 1000).cast("bigint"), "last_ms", F.lit(0)) >= last).alias("covered"))


# Search and ranking --------------------------------------------------------------------------

FOLD_SQL = "replace(lower(strip_accents({0})), 'ß', 'ss')"


@query(f"""
WITH {JOBS_SQL} SELECT job_id, source_name, status, row_number() OVER (ORDER BY updated_at DESC, created_at DESC, job_id) AS position FROM latest
WHERE contains({FOLD_SQL.format("concat_ws(' ', source_name, provider, model)")}, 'mp') AND status = 'completed'
""")
def hist01_list_filter(spark: SparkSession, d: str) -> DataFrame:
    """Jobs of one state whose name, provider or model holds a text, newest first."""
    from pyspark.sql import Window

    rows = views.jobs(spark, d).where(F.col("status") == "completed").where(search.matches([F.col("source_name"), F.col("provider"), F.col("model")], "MP"))
    # A listing has one order over all its rows: positions are given over ranges of it, not in one task.
    keyed = rows.select("job_id", "source_name", "status", "updated_at", "created_at", F.lit(0).alias("all"), F.date_trunc("hour", F.col("updated_at").cast("timestamp")).alias("u"))
    before = keyed.groupBy("u").agg(F.count("*").alias("n")).select("u", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("u")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    n = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("updated_at"), F.desc("created_at"), "job_id"))
    return keyed.join(before, "u").select("job_id", "source_name", "status", (n + F.col("base")).cast("bigint").alias("position"))


@query(f"SELECT doc_id, title FROM documents WHERE contains({FOLD_SQL.format('text')}, 'previsao') AND contains({FOLD_SQL.format('text')}, 'estacao') ORDER BY doc_id LIMIT 24")
def search01_terms(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold every term, without case and accents, the first 24."""
    return search.search(table(spark, d, "documents").select("doc_id", "title", "text"), "PREVISÃO estação", text=F.col("text"), order="doc_id").select("doc_id", "title")


ALIAS_SQL = "CASE " + " ".join(f"WHEN b = '{a}' THEN '{c}'" for a, c in languages.ALIASES.items()) + " ELSE b END"
RANK_SQL = f"""
n AS (SELECT DISTINCT lang AS tag, lower(replace(trim(lang), '_', '-')) AS t FROM documents),
m AS (SELECT tag, t, split_part(t, '-', 1) AS b, regexp_extract(t, '^[^-]*-(.+)$', 1) AS r FROM n),
k AS (SELECT tag, CASE WHEN t IS NULL OR t IN ('', 'und', 'unknown', 'zxx') THEN NULL WHEN r <> '' THEN ({ALIAS_SQL}) || '-' || r ELSE {ALIAS_SQL} END AS norm FROM m),
ranked AS (SELECT tag, norm, CASE WHEN norm IS NULL THEN 3 WHEN norm = 'pt-br' THEN 0 WHEN split_part(norm, '-', 1) = 'pt' THEN 1 ELSE 4 END AS rank, coalesce(split_part(norm, '-', 1) = 'pt', true) AS compatible FROM k)
"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    tag, asked = F.col("tag"), F.lit("pt_BR")
    return table(spark, d, "documents").select(F.col("lang").alias("tag")).distinct().select("tag", languages.normal(tag).alias("norm"), languages.rank(tag, asked).alias("rank"), languages.compatible(tag, asked).alias("compatible"))


@query(f"WITH {RANK_SQL} SELECT * FROM ranked")
def rank01_language(spark: SparkSession, d: str) -> DataFrame:
    """Normal form, rank and compatibility of every language tag against a requested one."""
    return _ranked(spark, d)


@query(f"""
WITH {RANK_SQL} SELECT job_id, lang, doc_id FROM (SELECT job_id, lang, doc_id, row_number() OVER (PARTITION BY job_id ORDER BY rank, coalesce(lang, ''), doc_id) AS k
FROM documents LEFT JOIN ranked ON tag IS NOT DISTINCT FROM lang WHERE job_id IS NOT NULL AND rank <= 1) WHERE k = 1
""")
def rank02_select_top1(spark: SparkSession, d: str) -> DataFrame:
    """For each job the document whose language fits a request best, none if only others are there."""
    rows = table(spark, d, "documents").where("job_id IS NOT NULL").select("job_id", "lang", "doc_id", languages.rank(F.col("lang"), F.lit("pt-BR")).alias("rank")).where("rank <= 1")
    return search.best(rows, "job_id", [F.col("rank"), F.coalesce("lang", F.lit("")), F.col("doc_id")], ["lang", "doc_id"])


# Captions, runs, paragraphs, blocks ----------------------------------------------------------


@query(f"""
WITH {SPEECH_SQL}, p AS (SELECT *, lag(speaker) OVER w AS ps, row_number() OVER w AS n FROM speech WINDOW w AS ({ORDER_SQL})),
r AS (SELECT *, sum(CASE WHEN n = 1 OR ps IS DISTINCT FROM speaker THEN 1 ELSE 0 END) OVER ({ORDER_SQL} ROWS UNBOUNDED PRECEDING) AS run FROM p),
x AS (SELECT *, s // 3600000 AS part, min(n) OVER (PARTITION BY job_id, run) = n AS first, first_value(segment_id) OVER (PARTITION BY job_id, run ORDER BY n) AS first_id FROM r)
SELECT job_id, first_id, part, any_value(speaker) AS speaker, count(*) AS segments, CASE WHEN bool_or(first) THEN coalesce(any_value(speaker) || ': ', '') ELSE '' END || string_agg(text, ' ' ORDER BY n) AS text FROM x GROUP BY job_id, run, first_id, part
""")
def par01_speaker_runs(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive segments of one speaker as one text."""
    out = paragraphs.speaker_runs(views.speech(spark, d), ["job_id"], "h", ORDER)
    return out.select("job_id", F.col("run.segment_id").alias("first_id"), "part", "speaker", "segments", "text")


PARAGRAPHS_SQL = """
WITH RECURSIVE {speech}, p AS (SELECT *, lag(struct_pack(w := speaker, z := e)) OVER ({order}) AS v FROM speech WHERE e > s),
g AS (SELECT *, v IS NULL OR v.w IS DISTINCT FROM speaker AS turn, sum(CASE WHEN v IS NULL OR v.w IS DISTINCT FROM speaker OR s - v.z >= 2000 THEN 1 ELSE 0 END) OVER ({order} ROWS UNBOUNDED PRECEDING) AS st FROM p),
t AS (SELECT job_id, st, any_value(speaker) AS speaker, bool_or(turn) AS turn, string_agg(text, ' ' ORDER BY s, chunk_index, seg_index, segment_id) AS text FROM g GROUP BY job_id, st),
c AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(text, '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS x FROM t),
u AS (SELECT job_id, speaker, turn, st, i = 1 AS opens, i = len(x) AS closes, x[i] AS said, row_number() OVER (PARTITION BY job_id ORDER BY st, i) AS k FROM c, unnest(range(1, len(x) + 1)) AS r(i)),
f AS (
  SELECT job_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS done, '' AS open, CAST(NULL AS VARCHAR) AS last, CAST(NULL AS VARCHAR) AS speaker, CAST([] AS VARCHAR[]) AS gone FROM u GROUP BY job_id
  UNION ALL
  SELECT job_id, k, 0, CASE WHEN closes THEN '' ELSE body END, CASE WHEN NOT closes THEN upto WHEN back THEN upto || ' ' || body ELSE body END, speaker, list_concat(shut, CASE WHEN closes AND NOT back AND upto IS NOT NULL THEN [{own}upto] ELSE [] END) FROM (
    SELECT *, closes AND length(body) < 300 AND upto IS NOT NULL AND length(upto) + 1 + length(body) <= 1900 AS back FROM (
      SELECT job_id, k, closes, speaker, CASE WHEN full_ OR open = '' THEN said ELSE open || ' ' || said END AS body, CASE WHEN full_ THEN open WHEN fresh THEN NULL ELSE last END AS upto, list_concat(CASE WHEN fresh AND last IS NOT NULL THEN [{was}last] ELSE [] END, CASE WHEN full_ AND last IS NOT NULL THEN [{own}last] ELSE [] END) AS shut FROM (
        SELECT u.*, f.open, f.last, f.speaker AS was, u.turn AND u.opens AS fresh, length(f.open) >= 900 AND length(f.open) + 1 + length(u.said) > 1600 AS full_ FROM f JOIN u ON u.job_id = f.job_id AND u.k = f.k + 1)))),
e AS (SELECT job_id, k, gone FROM f UNION ALL SELECT job_id, k + 1, [{own}last] FROM f WHERE last IS NOT NULL AND k = (SELECT max(k) FROM u WHERE u.job_id = f.job_id))
SELECT job_id, n AS {n}, text FROM (SELECT job_id, text, row_number() OVER (PARTITION BY job_id ORDER BY k, j) AS n FROM (SELECT job_id, k, unnest(gone) AS text, generate_subscripts(gone, 1) AS j FROM e))
"""


@query(PARAGRAPHS_SQL.format(speech=SPEECH_SQL, order=ORDER_SQL, own="", was="", n="paragraph"))
def par02_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Readable paragraphs of every job."""
    out = paragraphs.natural_paragraphs(render.lasting(views.speech(spark, d)), ["job_id"], "h", ORDER)
    return sequence.numbered(out.withColumn("b", F.floor(F.col("head") / 1000)), ["job_id"], "b", ["head", "part"], name="paragraph").select("job_id", "paragraph", "text")


def _packed_sql(units: str, cut: str, most: int, a: str, x: str) -> str:
    """SQL of greedy packing: units joined by spaces within ``most`` characters, one beyond it cut by itself; parts with chr(1) between them."""
    open_ = f"string_split({a}, chr(1))[-1]"
    return (
        f"list_reduce(list_prepend('', {units}), lambda {a}, {x}: CASE WHEN length({x}) > {most} THEN {a} || CASE WHEN {open_} = '' THEN '' ELSE chr(1) END || {cut} || chr(1)"
        f" WHEN {open_} = '' THEN {a} || {x} WHEN length({open_}) + 1 + length({x}) <= {most} THEN {a} || ' ' || {x} ELSE {a} || chr(1) || {x} END)"
    )


_SPACE_SQL = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}]"
_SLICES_SQL = "array_to_string(list_transform(range(0, CAST(ceil(length(w) / 600.0) AS BIGINT)), lambda i: substr(w, i * 600 + 1, 600)), chr(1))"
_WORDS_SQL = lambda x: _packed_sql(f"list_filter(string_split_regex({x}, '{_SPACE_SQL}+'), lambda v: v <> '')", _SLICES_SQL, 600, "aw", "w")
_SENTENCES_SQL = f"list_filter(list_transform(string_split(regexp_replace(p, '([.!?…]){_SPACE_SQL}+', '\\1' || chr(2), 'g'), chr(2)), lambda q: regexp_replace(q, '^{_SPACE_SQL}+|{_SPACE_SQL}+$', '', 'g')), lambda q: q <> '')"


@query(f"""
WITH d AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n{{2,}}'), lambda p: regexp_replace(p, '^{_SPACE_SQL}+|{_SPACE_SQL}+$', '', 'g')), lambda p: p <> '') AS ps FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, i, ps[i] AS p FROM d, unnest(range(1, len(ps) + 1)) AS r(i)),
s AS (SELECT doc_id, i, p, CASE WHEN length(p) > 600 THEN {_SENTENCES_SQL} END AS ss FROM p),
u AS (SELECT doc_id, i, CASE WHEN ss IS NULL THEN p WHEN len(ss) <= 1 THEN {_WORDS_SQL('p')} ELSE {_packed_sql('ss', _WORDS_SQL('x'), 600, 'asn', 'x')} END AS t FROM s),
l AS (SELECT doc_id, flatten(list(list_filter(string_split(t, chr(1)), lambda y: y <> '') ORDER BY i)) AS units FROM u GROUP BY doc_id),
b AS (SELECT doc_id, string_split(list_reduce(units, lambda a, y: CASE WHEN length(string_split(a, chr(1))[-1]) + 2 + length(y) <= 600 THEN a || chr(10) || chr(10) || y ELSE a || chr(1) || y END), chr(1)) AS bs FROM l)
SELECT doc_id, CAST(k - 1 AS INT) AS block_index, left(sha256('1' || chr(0) || CAST(k - 1 AS VARCHAR) || chr(0) || bs[k]), 20) AS block_id, CAST(length(bs[k]) AS INT) AS chars FROM b, unnest(range(1, len(bs) + 1)) AS r(k)
""")
def pck01_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of at most 600 characters of every document, with their digest."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(paragraphs.blocks(F.col("text"), 600)).alias("block_index", "text"))
    return rows.select("doc_id", "block_index", paragraphs.block_id(F.col("block_index"), F.col("text")).alias("block_id"), F.length("text").alias("chars"))


@query(f"""
WITH {BLOCKS_SQL}, r AS (SELECT DISTINCT q.block_id, 1 AS done FROM editorial_requests q JOIN editorial_responses a USING (request_id) WHERE trim(coalesce(a.text, '')) <> '')
SELECT job_id, count(*) AS n_blocks, count(*) - count(done) AS missing, CAST(sum(length(text)) + 2 * (count(*) - 1) AS BIGINT) AS chars FROM blocks LEFT JOIN r USING (block_id) GROUP BY job_id
""")
def pck04_reassemble(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of each job, those without an accepted answer, and the length of the joined text."""
    given = table(spark, d, "editorial_responses").where(F.trim(F.coalesce("text", F.lit(""))) != "").select("request_id")
    done = table(spark, d, "editorial_requests").select("request_id", "block_id").join(given, "request_id", "left_semi").select("block_id", F.lit(1).alias("done")).distinct()
    g = views.blocks(spark, d).join(done, "block_id", "left").groupBy("job_id")
    return g.agg(F.count("*").alias("n_blocks"), (F.count("*") - F.count("done")).alias("missing"), (F.sum(F.length("text")) + 2 * (F.count("*") - 1)).alias("chars"))


@query(r"""
WITH b AS (SELECT DISTINCT job_id, block_index, block_id FROM editorial_blocks WHERE job_id IS NOT NULL),
t AS (SELECT q.job_id, q.block_id, a.received_at, a.response_id, regexp_replace(regexp_replace(a.text, '\r\n?', chr(10), 'g'), '^[\s\x0b\x1c-\x1f\x{85}\x{a0}]+|[\s\x0b\x1c-\x1f\x{85}\x{a0}]+$', '', 'g') AS text
  FROM editorial_requests q JOIN editorial_responses a USING (request_id) WHERE q.job_id IS NOT NULL),
k AS (SELECT job_id, block_id, text FROM (SELECT *, row_number() OVER (PARTITION BY job_id, block_id ORDER BY received_at NULLS LAST, response_id, text) AS n FROM t WHERE text <> '') WHERE n = 1),
j AS (SELECT job_id, count(*) AS n_blocks, count(k.text IS NULL OR NULL) AS missing, coalesce(min(block_index) = 0 AND max(block_index) = count(*) - 1 AND count(DISTINCT block_index) = count(*), FALSE) AS ordered,
  count(DISTINCT block_id) = count(*) AS once, string_agg(k.text, chr(10) || chr(10) ORDER BY block_index) AS text FROM b LEFT JOIN k USING (job_id, block_id) GROUP BY job_id),
u AS (SELECT job_id, count(*) AS unknown FROM k ANTI JOIN b USING (job_id, block_id) GROUP BY job_id),
s AS (SELECT job_id, coalesce(n_blocks, 0) AS n_blocks, coalesce(missing, 0) AS missing, coalesce(unknown, 0) AS unknown, text,
  CASE WHEN NOT ordered THEN 'order' WHEN NOT once OR missing > 0 OR unknown > 0 THEN 'incomplete' ELSE 'assembled' END AS state FROM j FULL JOIN u USING (job_id))
SELECT job_id, n_blocks, missing, unknown, state, CASE WHEN state = 'assembled' THEN text END AS text, CASE WHEN state = 'assembled' THEN length(text) END AS chars FROM s
""")
def pck04_assembled(spark: SparkSession, d: str) -> DataFrame:
    """Each job's accepted answers joined in block order, or why they can't be."""
    asked = table(spark, d, "editorial_requests").select("request_id", "job_id", "block_id").distinct()
    answers = table(spark, d, "editorial_responses").select("request_id", "response_id", "text", "received_at").join(asked, "request_id")
    out = paragraphs.assemble_results(table(spark, d, "editorial_blocks"), answers)
    return out.select("job_id", "n_blocks", "missing", "unknown", "state", "text", F.length("text").cast("bigint").alias("chars"))


TOKENS_SQL = "regexp_extract_all(" + FOLD_SQL + ", '[\\p{{L}}\\p{{N}}_]+(?:[’''\\-][\\p{{L}}\\p{{N}}_]+)*')"


@query(f"WITH {SPEECH_SQL} SELECT segment_id, len({TOKENS_SQL.format('text')}) AS n_tokens, array_to_string({TOKENS_SQL.format('text')}, ' ') AS tokens FROM speech")
def asm01_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Folded tokens of every segment."""
    rows = views.speech(spark, d).select("segment_id", T.fold(F.col("text")).alias("t"))
    return rows.select("segment_id", assembly.tokens(F.col("t")).alias("x")).select("segment_id", F.size("x").cast("bigint").alias("n_tokens"), F.array_join("x", " ").alias("tokens"))


@query(f"""
WITH {SPEECH_SQL}, t AS (SELECT segment_id, job_id, s, chunk_index, seg_index, {TOKENS_SQL.format('text')} AS x FROM speech),
p AS (SELECT segment_id, x, list_slice(lag(x) OVER ({ORDER_SQL}), -80, -1) AS y FROM t),
k AS (SELECT segment_id, x, coalesce(list_max(list_filter(range(1, least(len(x), len(y), 80) + 1), lambda n: list_slice(y, len(y) - n + 1, len(y)) = list_slice(x, 1, n))), 0) AS n FROM p)
SELECT segment_id, CAST(CASE WHEN n < 2 AND n <> len(x) THEN 0 ELSE n END AS INT) AS repeated FROM k
""")
def asm03_overlap_trim(spark: SparkSession, d: str) -> DataFrame:
    """Tokens at the start of each segment that repeat the end of the one before."""
    rows = views.speech(spark, d).withColumn("t", T.fold(F.col("text"))).withColumn("x", assembly.tokens(F.col("t"))).drop("t", "text")
    both = sequence.with_previous(rows, ["job_id"], "h", ORDER, F.col("x"), name="y")
    n = assembly.repeated_words(F.coalesce("y", F.array().cast("array<string>")), F.col("x"))
    return both.select("segment_id", n.cast("int").alias("repeated"))


FOLDED_SQL = "list_transform(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+(?:[’''\\-][\\p{{L}}\\p{{N}}_]+)*'), lambda w: replace(lower(strip_accents(w)), 'ß', 'ss'))"


@query(rf"""
WITH RECURSIVE {SPEECH_SQL}, {CHUNK_SQL},
w AS (SELECT segment_id, words FROM segments GROUP BY ALL),
a AS (SELECT s.job_id, s.chunk_index, s.seg_index, s.segment_id, s.speaker, s.text, overlap_ms, chunk_s, chunk_s + least(greatest(s - chunk_s, 0), chunk_e - chunk_s) AS s, chunk_s + least(greatest(e - chunk_s, 0), chunk_e - chunk_s) AS e, w.words
  FROM speech s JOIN c USING (job_id, chunk_index) JOIN w USING (segment_id)),
b AS (SELECT *, list_filter(list_transform(list_filter(words, lambda x: x.start_sec IS NOT NULL AND x.end_sec IS NOT NULL), lambda x: least(greatest(greatest(CAST(round(x.end_sec * 1000) AS BIGINT), 0), least(greatest(greatest(CAST(round(x.start_sec * 1000) AS BIGINT), 0), s), e)), e)
   * CASE WHEN least(greatest(greatest(CAST(round(x.end_sec * 1000) AS BIGINT), 0), least(greatest(greatest(CAST(round(x.start_sec * 1000) AS BIGINT), 0), s), e)), e) > least(greatest(greatest(CAST(round(x.start_sec * 1000) AS BIGINT), 0), s), e) THEN 1 ELSE NULL END), lambda x: x IS NOT NULL) AS word_ends FROM a WHERE e > s),
n AS (SELECT *, {FOLDED_SQL.format('text')} AS own, row_number() OVER (PARTITION BY job_id ORDER BY chunk_index, seg_index, segment_id) AS k FROM b),
f AS (
  SELECT job_id, CAST(0 AS BIGINT) AS k, '' AS said, CAST(NULL AS INTEGER) AS chunk_index, CAST(NULL AS INTEGER) AS seg_index, CAST(NULL AS BIGINT) AS segment_id, CAST(NULL AS DOUBLE) AS start_ms, CAST(NULL AS DOUBLE) AS end_ms, CAST(NULL AS VARCHAR) AS speaker, CAST(NULL AS VARCHAR) AS text, 0 AS removed, false AS kept FROM n GROUP BY job_id
  UNION ALL
  SELECT job_id, k, CASE WHEN kept THEN right(trim(said || ' ' || rest), 2000) ELSE said END, chunk_index, seg_index, segment_id, start_ms, e, speaker, rest, removed, kept FROM (
    SELECT *, removed = 0 OR (rest <> '' AND e > start_ms) AS kept FROM (
      SELECT *, CASE WHEN removed = 0 THEN CAST(s AS DOUBLE) WHEN removed < len(word_ends) THEN greatest(CAST(s AS DOUBLE), CAST(word_ends[removed] AS DOUBLE)) ELSE s + (e - s) * least(CAST(1 AS DOUBLE), CAST(removed AS DOUBLE) / greatest(1, len(own))) END AS start_ms,
        CASE WHEN removed = 0 THEN text WHEN removed >= len(own) THEN '' ELSE regexp_replace(regexp_replace(text, '^(?:[^\p{{L}}\p{{N}}_]*[\p{{L}}\p{{N}}_]+(?:[’''\-][\p{{L}}\p{{N}}_]+)*){{' || removed || '}}', ''), '^[ \t\r\n,.;:!?—–-]+', '') END AS rest FROM (
        SELECT *, CASE WHEN m < 2 AND m <> len(own) THEN 0 ELSE m END AS removed FROM (
          SELECT n.*, f.said, CASE WHEN f.said <> '' AND n.overlap_ms > 0 AND n.s <= n.chunk_s + n.overlap_ms + 1000
            THEN coalesce(list_max(list_filter(range(1, least(len(own), 80) + 1), lambda i: list_slice(list_slice({FOLDED_SQL.format('f.said')}, -80, -1), -i, -1) = list_slice(own, 1, i))), 0) ELSE 0 END AS m
          FROM f JOIN n ON n.job_id = f.job_id AND n.k = f.k + 1))))
)
SELECT job_id, chunk_index, seg_index, segment_id, start_ms, end_ms, speaker, text, CAST(removed AS INT) AS removed FROM f WHERE kept
""")
def asm05_assemble(spark: SparkSession, d: str) -> DataFrame:
    """Every job's chunks on one time line, repeated starts trimmed in the overlaps."""
    rows = chunks.clipped(_chunked(spark, d))
    words = once(table(spark, d, "segments").select("segment_id", "words"), "segment_id")
    ends = F.transform(chunks.clipped_words(F.col("words"), F.col("chunk_s"), F.col("clip_s"), F.col("clip_e")), lambda w: w["clip_e"] + F.col("chunk_s"))
    base = rows.join(words, "segment_id", "left")
    return assembly.assemble(base.select(
        "job_id", "chunk_index", "seg_index", "segment_id", (F.col("clip_s") + F.col("chunk_s")).alias("s"), (F.col("clip_e") + F.col("chunk_s")).alias("e"), "speaker", "text", ends.alias("word_ends"), "chunk_s", "overlap_ms",
    ))


@query(f"""
WITH {SPEECH_SQL}, {CHUNK_SQL}, t AS (SELECT job_id, min(language) AS language FROM transcripts WHERE language <> '' GROUP BY job_id),
k AS (SELECT job_id, chunk_index, max(chunk_e) AS chunk_e FROM c GROUP BY ALL), g AS (SELECT DISTINCT s.job_id, s.chunk_index, 1 AS there FROM speech s JOIN c USING (job_id, chunk_index) WHERE least(greatest(e - chunk_s, 0), chunk_e - chunk_s) > least(greatest(s - chunk_s, 0), chunk_e - chunk_s))
SELECT job_id, count(*) AS n_chunks, min(chunk_index) = 0 AND max(chunk_index) = count(*) - 1 AS contiguous, count(*) - count(there) AS missing, any_value(language) AS language, max(chunk_e) AS duration_ms
FROM k LEFT JOIN g USING (job_id, chunk_index) LEFT JOIN t USING (job_id) GROUP BY job_id
""")
def asm05_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Completeness, language and duration of every assembled transcript."""
    c = table(spark, d, "chunks").select("job_id", "chunk_index", F.round(F.col("end_sec") * 1000).cast("bigint").alias("chunk_e")).groupBy("job_id", "chunk_index").agg(F.max("chunk_e").alias("chunk_e"))
    # The tables name a language a job, not a chunk: it stands for that of the first chunk.
    named = table(spark, d, "transcripts").where("language <> ''").groupBy("job_id").agg(F.min("language").alias("language")).withColumn("chunk_index", F.lit(0))
    return assembly.transcripts(c, chunks.clipped(_chunked(spark, d)), named).drop("n_segments")


KEYS_SQL = "list_transform(list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> ''), lambda w: regexp_replace(lower(w), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+', '', 'g'))"


@query(f"""
WITH {SPEECH_SQL}, p AS (SELECT segment_id, text, s, speaker, lag(struct_pack(t := text, z := e, w := speaker)) OVER ({ORDER_SQL}) AS v FROM speech),
k AS (SELECT segment_id, {KEYS_SQL.format('text')} AS x, CASE WHEN v IS NOT NULL AND v.w IS NOT DISTINCT FROM speaker AND s <= v.z + 250 THEN {KEYS_SQL.format('v.t')} ELSE [] END AS y FROM p)
SELECT segment_id, CAST(coalesce(list_max(list_filter(range(1, least(len(x), len(y)) + 1), lambda n: list_slice(y, len(y) - n + 1, len(y)) = list_slice(x, 1, n))), 0) AS INT) AS repeated FROM k
""")
def cap01_rolling_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Words of each cue that the cue before it already showed."""
    cues = views.speech(spark, d).select("job_id", "h", *ORDER, F.col("s").alias("start_ms"), F.col("e").alias("end_ms"), "speaker", "text")
    return captions.without_rolling(cues, ["job_id"], "h", ORDER).select("segment_id", "repeated")


FRESH_SQL = f"""
{SPEECH_SQL}, p AS (SELECT *, lag(struct_pack(t := text, z := e, w := speaker)) OVER ({ORDER_SQL}) AS v FROM speech WHERE e > s),
o AS (SELECT *, {KEYS_SQL.format('text')} AS x, CASE WHEN v IS NOT NULL AND v.w IS NOT DISTINCT FROM speaker AND s <= v.z + 250 THEN {KEYS_SQL.format('v.t')} ELSE [] END AS y FROM p),
r AS (SELECT *, coalesce(list_max(list_filter(range(1, least(len(x), len(y)) + 1), lambda n: list_slice(y, len(y) - n + 1, len(y)) = list_slice(x, 1, n))), 0) AS n FROM o),
fresh AS (SELECT *, bool_or(n > 0) OVER (PARTITION BY job_id) AS rolling, CASE WHEN n = 0 THEN text ELSE array_to_string(list_slice(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''), n + 1, len(x)), ' ') END AS said FROM r)
"""
MERGE_SQL = """
k AS (SELECT job_id, s, e, speaker, {text} AS text, {merges} AS merges, row_number() OVER ({order}) AS k FROM {rows}),
f AS (
  SELECT job_id, k, s, e, speaker, text, 1 AS cues, CAST(1 AS BIGINT) AS g FROM k WHERE k = 1
  UNION ALL
  SELECT job_id, k, CASE WHEN fits THEN a ELSE s END, CASE WHEN fits THEN greatest(z, e) ELSE e END, speaker, CASE WHEN fits THEN trim(t || ' ' || text) ELSE text END, CASE WHEN fits THEN c + 1 ELSE 1 END, CASE WHEN fits THEN g ELSE g + 1 END FROM (
    SELECT k.*, f.s AS a, f.e AS z, f.text AS t, f.cues AS c, f.g, k.merges AND k.speaker IS NOT DISTINCT FROM f.speaker AND k.s <= f.e + 1250 AND length(trim(f.text || ' ' || k.text)) <= 180 AS fits FROM f JOIN k ON k.job_id = f.job_id AND k.k = f.k + 1))
SELECT job_id, s AS start_ms, e AS end_ms, speaker, text, cues FROM (SELECT *, row_number() OVER (PARTITION BY job_id, g ORDER BY k DESC) AS last FROM f) WHERE last = 1
"""


@query("WITH RECURSIVE " + FRESH_SQL + ", " + MERGE_SQL.format(text="said", merges="rolling", order=ORDER_SQL, rows="fresh WHERE said <> ''"))
def cap02_normalized(spark: SparkSession, d: str) -> DataFrame:
    """Cues without the words that the one before already showed, merged where a job's cues roll at all."""
    cues = render.lasting(views.speech(spark, d)).select("job_id", "h", *ORDER, F.col("s").alias("start_ms"), F.col("e").alias("end_ms"), "speaker", "text")
    return captions.normalized(cues, ["job_id"], "h", ORDER)


@query(f"WITH RECURSIVE {SPEECH_SQL}, " + MERGE_SQL.format(text="text", merges="true", order=ORDER_SQL, rows="speech WHERE e > s"))
def cap03_merge_cues(spark: SparkSession, d: str) -> DataFrame:
    """Short cues merged into phrases of at most 180 characters."""
    cues = render.lasting(views.speech(spark, d)).select("job_id", "h", *ORDER, F.col("s").alias("start_ms"), F.col("e").alias("end_ms"), "speaker", "text")
    return captions.merged(cues, ["job_id"], "h", ORDER)


# Sources and sinks ---------------------------------------------------------------------------


@query("""
WITH b AS (SELECT doc_id, unnest(string_split_regex(replace(text, chr(13) || chr(10), chr(10)), '\\n[ \\t]*\\n')) AS raw FROM documents WHERE file_format = 'srt'),
t AS (SELECT doc_id, raw, regexp_extract(raw, '(\\d{2}):(\\d{2}):(\\d{2}),(\\d{3}) --> (\\d{2}):(\\d{2}):(\\d{2}),(\\d{3})', ['h','m','s','f','hh','mm','ss','ff']) AS x FROM b WHERE regexp_matches(raw, '(?m)^\\d{2}:\\d{2}:\\d{2},\\d{3} --> \\d{2}:\\d{2}:\\d{2},\\d{3}$')),
c AS (SELECT doc_id, CAST(x.h AS BIGINT) * 3600000 + CAST(x.m AS BIGINT) * 60000 + CAST(x.s AS BIGINT) * 1000 + CAST(x.f AS BIGINT) AS start_ms, CAST(x.hh AS BIGINT) * 3600000 + CAST(x.mm AS BIGINT) * 60000 + CAST(x.ss AS BIGINT) * 1000 + CAST(x.ff AS BIGINT) AS end_ms FROM t)
SELECT doc_id, count(*) AS cues, min(start_ms) AS first_ms, max(end_ms) AS last_ms, sum(end_ms - start_ms)::BIGINT AS shown_ms FROM c WHERE end_ms > start_ms GROUP BY doc_id
""")
def src03_parse_cues(spark: SparkSession, d: str) -> DataFrame:
    """Cues of every exported SRT text: how many, from when to when, and for how long."""
    docs = table(spark, d, "documents").where(F.col("file_format") == "srt").select("doc_id", "text")
    found = subtitles.cues(docs, key="doc_id", content="text")
    return found.groupBy("doc_id").agg(F.count("*").alias("cues"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("shown_ms"))


def _formats() -> Column:
    return F.from_json("settings", "formats array<string>")["formats"]


@query(f"""
WITH {JOBS_SQL}, s AS (SELECT job_id, json_extract_string(settings, '$.include_timestamps') AS v, CAST(json_extract(settings, '$.formats') AS VARCHAR[]) AS f FROM latest)
SELECT job_id, array_to_string(f, ',') AS formats, v IS NOT NULL AND lower(trim(v)) NOT IN ('', '0', 'false', 'no', 'off') AS timestamps FROM s
""")
def src16_settings_json(spark: SparkSession, d: str) -> DataFrame:
    """Typed settings of every job, flags read tolerantly."""
    flag = F.get_json_object("settings", "$.include_timestamps")
    return views.jobs(spark, d).select("job_id", F.array_join(_formats(), ",").alias("formats"), F.coalesce(~F.lower(F.trim(flag)).isin("", "0", "false", "no", "off"), F.lit(False)).alias("timestamps"))


@query(f"""
WITH {JOBS_SQL}, s AS (SELECT job_id, CAST(json_extract(settings, '$.formats') AS VARCHAR[]) AS f FROM latest WHERE settings IS NOT NULL)
SELECT job_id, array_to_string(list_sort(list_distinct(f)), ',') AS distinct_formats, array_to_string(list_sort(list_filter(list_distinct(f), lambda x: NOT list_contains(['txt', 'docx', 'srt', 'vtt'], x))), ',') AS unsupported,
 list_has_any(f, ['docx', 'txt']) AS can_improve FROM s
""")
def set01_array_ops(spark: SparkSession, d: str) -> DataFrame:
    """Distinct, unsupported and improvable formats of every job."""
    f = F.col("f")
    rows = views.jobs(spark, d).where("settings IS NOT NULL").select("job_id", _formats().alias("f"))
    known = F.array(*[F.lit(x) for x in ("txt", "docx", "srt", "vtt")])
    return rows.select(
        "job_id", F.array_join(F.array_sort(F.array_distinct(f)), ",").alias("distinct_formats"), F.array_join(F.array_sort(F.array_except(f, known)), ",").alias("unsupported"),
        F.arrays_overlap(f, F.array(F.lit("docx"), F.lit("txt"))).alias("can_improve"),
    )


CLOCK = "printf('%02d:%02d:%02d', {0} // 3600000, ({0} // 60000) % 60, ({0} // 1000) % 60)"
FULL = CLOCK + " || '{1}' || printf('%03d', {0} % 1000)"


@query(f"WITH {SPEECH_SQL} SELECT segment_id, {FULL.format('s', ',')} AS srt, {FULL.format('e', '.')} AS vtt, {CLOCK.format('s')} AS plain FROM speech")
def fn02_timestamps(spark: SparkSession, d: str) -> DataFrame:
    """Times of every segment as the three formats write them."""
    s, e = F.col("s") / F.lit(1000.0), F.col("e") / F.lit(1000.0)
    return views.speech(spark, d).select("segment_id", T.timestamp(s, separator=",").alias("srt"), T.timestamp(e).alias("vtt"), T.timestamp(s, millis=False).alias("plain"))


@query(f"""
WITH m AS (SELECT doc_id, title, text FROM documents WHERE file_format = 'md'), p AS (SELECT doc_id, title, trim(regexp_replace(regexp_replace(regexp_replace(text, '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '[#*`>\\[\\]()]', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM m)
SELECT doc_id, length(plain) AS chars, CASE WHEN length(plain) > 132 THEN rtrim(left(plain, 132)) || '…' ELSE plain END AS preview,
 coalesce(nullif(trim(regexp_replace(regexp_replace({FOLD_SQL.format("coalesce(title, '')")}, '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '[\\s_]+', '-', 'g'), '-'), ''), 'inicio') AS anchor FROM p
""")
def fn13_plain_text(spark: SparkSession, d: str) -> DataFrame:
    """Plain text preview and anchor of every Markdown document."""
    rows = table(spark, d, "documents").where(F.col("file_format") == "md").select("doc_id", T.plain_markdown(F.col("text")).alias("plain"), T.fold(F.coalesce("title", F.lit(""))).alias("t"))
    return rows.select("doc_id", F.length("plain").cast("bigint").alias("chars"), search.preview(F.col("plain")).alias("preview"), T.slug(F.col("t")).alias("anchor"))


@query(f"""
WITH {JOBS_SQL} SELECT job_id, regexp_replace(source_name, '^(.+)\\.[^.]*$', '\\1') AS stem,
 left(coalesce(nullif(trim(regexp_replace(regexp_replace(source_name, '^(.+)\\.[^.]*$', '\\1'), '[<>:"/\\\\|?*]+', '-', 'g'), ' .-'), ''), 'transcricao'), 120) AS safe FROM latest
""")
def fn15_names(spark: SparkSession, d: str) -> DataFrame:
    """File name stems of every job's source."""
    stem = T.stem_of(F.col("source_name"))
    return views.jobs(spark, d).select("job_id", stem.alias("stem"), T.safe_stem(stem).alias("safe"))


@query(f"""
WITH {JOBS_SQL}, s AS (SELECT job_id, regexp_replace(source_name, '^(.+)\\.[^.]*$', '\\1') AS stem FROM latest),
r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY job_id) AS n, count(*) OVER (PARTITION BY stem) AS size FROM s), b AS (SELECT DISTINCT stem FROM s),
free AS (SELECT stem, k, row_number() OVER (PARTITION BY stem ORDER BY k) + 1 AS n FROM (SELECT DISTINCT stem, unnest(range(2, size + (SELECT count(*) FROM b) + 2)) AS k FROM r) c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.stem = c.stem || ' (' || c.k || ')'))
SELECT job_id, r.stem, CASE WHEN r.n = 1 THEN r.stem ELSE r.stem || ' (' || k || ')' END AS name FROM r LEFT JOIN free USING (stem, n)
""")
def snk09_free_name(spark: SparkSession, d: str) -> DataFrame:
    """The first free result name of every job."""
    return render.free_names(views.jobs(spark, d).select("job_id", T.stem_of(F.col("source_name")).alias("stem")), stem="stem", order="job_id")


@query(f"""
WITH {SPEECH_SQL}, n AS (SELECT *, row_number() OVER ({ORDER_SQL}) AS cue FROM speech WHERE e > s)
SELECT job_id, cue, cue || chr(10) || {FULL.format('s', ',')} || ' --> ' || {FULL.format('e', ',')} || chr(10) || coalesce(speaker || ': ', '') || text AS text FROM n
""")
def snk02_srt(spark: SparkSession, d: str) -> DataFrame:
    """SRT cues of every job."""
    return render.srt(views.speech(spark, d), ["job_id"], "h", ORDER)


@query(f"""
WITH {SPEECH_SQL}, n AS (SELECT *, row_number() OVER ({ORDER_SQL}) AS cue FROM speech WHERE e > s)
SELECT job_id, cue, {FULL.format('s', '.')} || ' --> ' || {FULL.format('e', '.')} || chr(10) || coalesce('<v ' || speaker || '>' || text || '</v>', text) AS text FROM n
UNION ALL SELECT DISTINCT job_id, 0, 'WEBVTT' FROM speech
""")
def snk03_vtt(spark: SparkSession, d: str) -> DataFrame:
    """WebVTT cues of every job."""
    return render.vtt(views.speech(spark, d), ["job_id"], "h", ORDER)


@query(f"""
WITH {SPEECH_SQL} SELECT job_id, row_number() OVER ({ORDER_SQL}) AS line, '[' || {CLOCK.format('s')} || ']' || coalesce(' ' || speaker || ':', '') || ' ' || text AS text FROM speech
""")
def snk01_txt(spark: SparkSession, d: str) -> DataFrame:
    """Timed text lines of every job."""
    return render.timed_txt(views.speech(spark, d), ["job_id"], "h", ORDER)


@query(f"""
WITH {SPEECH_SQL} SELECT job_id, row_number() OVER ({ORDER_SQL}) AS line, '- `' || {CLOCK.format('s')} || '`' || coalesce(' **' || speaker || ':**', '') || ' ' || text AS text FROM speech
""")
def snk04_md(spark: SparkSession, d: str) -> DataFrame:
    """Markdown bullets of every job."""
    return render.markdown(views.speech(spark, d), ["job_id"], "h", ORDER)


@query("""
WITH s AS (SELECT DISTINCT segment_id, start_sec, end_sec, text, confidence FROM segments)
SELECT segment_id, CASE WHEN start_sec IS NULL OR end_sec IS NULL THEN 'no time' WHEN start_sec < 0 OR end_sec < 0 THEN 'negative time' WHEN end_sec < start_sec THEN 'reversed'
 WHEN trim(coalesce(text, '')) = '' THEN 'no text' WHEN confidence < 0 OR confidence > 1 THEN 'confidence' END AS reason FROM s
WHERE start_sec IS NULL OR end_sec IS NULL OR start_sec < 0 OR end_sec < 0 OR end_sec < start_sec OR trim(coalesce(text, '')) = '' OR confidence < 0 OR confidence > 1
""")
def val01_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Segments that break an invariant, with the first reason."""
    s, e, c = F.col("start_sec"), F.col("end_sec"), F.col("confidence")
    reason = (
        F.when(s.isNull() | e.isNull(), "no time").when((s < 0) | (e < 0), "negative time").when(e < s, "reversed")
        .when(F.trim(F.coalesce("text", F.lit(""))) == "", "no text").when((c < 0) | (c > 1), "confidence")
    )
    return once(table(spark, d, "segments"), "segment_id").select("segment_id", reason.alias("reason")).where("reason IS NOT NULL")


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS window_us, count(*) AS n FROM events GROUP BY ALL")
def stm01_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events of each kind in each hour, as the stream form counts them."""
    out = progress.counted(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts")
    return out.select("event_type", F.unix_micros("window_start").alias("window_us"), "n")


@query("""
WITH c AS (SELECT DISTINCT job_id, chunk_index FROM chunks), r AS (SELECT DISTINCT job_id, chunk_index, 1 AS done FROM segments WHERE trim(coalesce(text, '')) <> ''),
j AS (SELECT job_id, list_sort(list(chunk_index) FILTER (done = 1)) AS y, list_sort(list(chunk_index) FILTER (done IS NULL)) AS n FROM c LEFT JOIN r USING (job_id, chunk_index) GROUP BY job_id)
SELECT job_id, coalesce(array_to_string(y, ','), '') AS completed, coalesce(array_to_string(n, ','), '') AS pending FROM j
""")
def set04_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each job with and without a result that says something."""
    said = table(spark, d, "segments").where(F.trim(F.coalesce("text", F.lit(""))) != "")
    out = store.reconcile(table(spark, d, "chunks"), said)
    return out.select("job_id", F.array_join("completed", ",").alias("completed"), F.array_join("pending", ",").alias("pending"))


@query(f"WITH {SPEECH_SQL} SELECT segment_id, job_id, chunk_index, seg_index, s, e, speaker, text FROM speech")
def snk12_json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Segments written as JSON objects and read again."""
    rows = views.speech(spark, d).drop("h")
    return store.from_json_rows(store.to_json_rows(rows, "segment_id"), rows.schema)[0]


@query(f"""
WITH {SPEECH_SQL}, {CHUNK_SQL}, x AS (SELECT job_id, chunk_index, seg_index, segment_id, s - chunk_s AS a, e - chunk_s AS z, chunk_e - chunk_s AS n, speaker, text FROM speech JOIN c USING (job_id, chunk_index)),
m AS (SELECT *, greatest(0, max(a) OVER (PARTITION BY job_id, chunk_index ORDER BY seg_index, segment_id ROWS UNBOUNDED PRECEDING)) AS start_ms FROM x)
SELECT segment_id, start_ms, greatest(start_ms, least(z, n)) AS end_ms, speaker, text FROM m
""")
def src17_model_responses(spark: SparkSession, d: str) -> DataFrame:
    """Segments of structured model responses, one response a chunk, with starts that never go back."""
    rows = _chunked(spark, d)
    part = F.struct("seg_index", "segment_id", ((F.col("s") - F.col("chunk_s")) / 1000.0).alias("start"), ((F.col("e") - F.col("chunk_s")) / 1000.0).alias("end"), "speaker", "text")
    one = rows.groupBy("job_id", "chunk_index", "chunk_s", "chunk_e").agg(F.sort_array(F.collect_list(part)).alias("x"))
    sent = one.select(F.struct("job_id", "chunk_index").alias("k"), ((F.col("chunk_e") - F.col("chunk_s")) / 1000.0).alias("duration"), F.to_json(F.struct(F.col("x").alias("segments"))).alias("json"), F.transform("x", lambda y: y["segment_id"]).alias("ids"))
    got = media.responses(sent, key="k", json="json", duration="duration").join(sent.select("k", "ids"), "k")
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    return got.select(F.get("ids", F.col("seg_index")).alias("segment_id"), ms("start").alias("start_ms"), ms("end").alias("end_ms"), "speaker", "text")


@query("""
SELECT DISTINCT media_id, 'https://u@files.example:8080/' || media_id || '/' || source_name || '?k=1#x' AS source, source_name AS name,
 'https://files.example:8080/' || media_id || '/' || source_name AS label, regexp_full_match(media_id, '[A-Za-z0-9][A-Za-z0-9._-]{0,127}') AS safe FROM jobs
""")
def fn16_source_labels(spark: SparkSession, d: str) -> DataFrame:
    """Display name and credential-free label of every source's address."""
    rows = table(spark, d, "jobs").select("media_id", F.concat(F.lit("https://u@files.example:8080/"), "media_id", F.lit("/"), "source_name", F.lit("?k=1#x")).alias("source")).distinct()
    return rows.select("media_id", "source", S.display_name(F.col("source")).alias("name"), S.safe_label(F.col("source")).alias("label"), S.safe_id(F.col("media_id")).alias("safe"))


@query("""
SELECT DISTINCT response_id, CASE WHEN input_tokens >= 0 THEN input_tokens END AS input_tokens, CASE WHEN output_tokens >= 0 THEN output_tokens END AS output_tokens,
 CASE WHEN input_tokens >= 0 THEN input_tokens END + CASE WHEN output_tokens >= 0 THEN output_tokens END AS total_tokens FROM editorial_responses
""")
def fn10_usage_counts(spark: SparkSession, d: str) -> DataFrame:
    """Token counts read back from usage records under alternative names; missing and negative ones are NULL."""
    t = table(spark, d, "editorial_responses").select("response_id", F.to_json(F.struct(F.col("input_tokens").alias("prompt_tokens"), F.col("output_tokens").alias("outputTokens"))).alias("u")).distinct()
    i, o = S.count_of(F.col("u"), "$.input_tokens", "$.prompt_tokens"), S.count_of(F.col("u"), "$.output_tokens", "$.outputTokens")
    return t.select("response_id", i.alias("input_tokens"), o.alias("output_tokens"), (i + o).alias("total_tokens"))
