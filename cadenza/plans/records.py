"""More queries over transcripts, captions, help texts and stores, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.common import once, table
from cadenza.functions import sources as S
from cadenza.functions import text as T
from cadenza.operators import chunks, render, search
from cadenza.plans import views
from cadenza.plans.reference import ALIAS_SQL, CHUNK_SQL, ORDER, ORDER_SQL, PARAGRAPHS_SQL, UNITS_SQL, _chunked, query
from cadenza.plans.views import JOBS_SQL, SPEECH_SQL
from cadenza.sources import media, store


@query(PARAGRAPHS_SQL.format(speech=SPEECH_SQL, order=ORDER_SQL, own="coalesce(speaker || ': ', '') || ", was="coalesce(was || ': ', '') || ", n="line"))
def snk01_untimed(spark: SparkSession, d: str) -> DataFrame:
    """Untimed text of every job: paragraphs with their speaker."""
    return render.exported(views.speech(spark, d), ["job_id"], "h", ORDER, path="result.txt")


@query(f"WITH {SPEECH_SQL} SELECT job_id, s // 3600000 AS part, string_agg(text, ' ' ORDER BY s, chunk_index, seg_index, segment_id) AS text FROM speech GROUP BY job_id, s // 3600000")
def prj04_text(spark: SparkSession, d: str) -> DataFrame:
    """All text of every job in order, a part an hour."""
    return render.plain_text(views.speech(spark, d), ["job_id"], "h", ORDER)


@query(r"""
SELECT DISTINCT response_id, CASE WHEN t <> '' THEN t || chr(10) ELSE t END AS text FROM (SELECT response_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '^[\s\x0b\x1c-\x1f\x{85}\x{a0}]+|[\s\x0b\x1c-\x1f\x{85}\x{a0}]+$', '', 'g') AS t FROM editorial_responses)
""")
def snk06_improved(spark: SparkSession, d: str) -> DataFrame:
    """Revised texts as their files hold them."""
    return table(spark, d, "editorial_responses").select("response_id", render.improved_text(F.col("text")).alias("text")).distinct()


HEAD_SQL = "'# ' || coalesce(nullif(trim(source_name), ''), 'Transcrição') || coalesce(chr(10) || chr(10) || 'Fonte: `' || nullif(media_id, '') || '`', '') || chr(10) || chr(10) || '## Transcrição' || chr(10)"


@query(f"WITH {JOBS_SQL} SELECT job_id, CAST(0 AS BIGINT) AS line, {HEAD_SQL} AS text FROM latest")
def snk04_heads(spark: SparkSession, d: str) -> DataFrame:
    """What stands before the bullets of every job's Markdown transcript."""
    return render.markdown_heads(views.jobs(spark, d).select("job_id", F.col("source_name").alias("title"), F.col("media_id").alias("source")), ["job_id"])


FILES_SQL = f"""
{JOBS_SQL}, f AS (SELECT job_id, regexp_replace(source_name, '^(.+)\\.[^.]*$', '\\1') AS stem, coalesce(provider = 'aurora', false) AS improve, CAST(json_extract(settings, '$.formats') AS VARCHAR[]) AS formats FROM latest WHERE settings IS NOT NULL),
x AS (SELECT job_id, stem, improve, unnest(formats) AS format, generate_subscripts(formats, 1) - 1 AS position FROM f),
y AS (SELECT job_id, stem, improve, format, CAST(min(position) AS INT) AS position FROM x GROUP BY ALL),
files AS (SELECT job_id, position, CASE WHEN format IN ('srt', 'vtt') THEN 'captions' ELSE 'original' END AS output_group, format, stem || CASE WHEN improve AND format IN ('docx', 'txt') THEN ' — transcrição' ELSE '' END || '.' || format AS file FROM y
  UNION ALL SELECT job_id, position, 'improved', format, stem || ' — texto melhorado.' || format FROM y WHERE improve AND format IN ('docx', 'txt'))
"""


def _files(spark: SparkSession, d: str) -> DataFrame:
    jobs = views.jobs(spark, d).where("settings IS NOT NULL")
    return render.manifest(jobs.select("job_id", T.stem_of(F.col("source_name")).alias("stem"), F.from_json("settings", "formats array<string>")["formats"].alias("formats"), (F.col("provider") == "aurora").alias("improve")), ["job_id"])


@query(f"WITH {FILES_SQL} SELECT * FROM files")
def snk08_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Files of every job's result by group; one provider stands for the wish to revise."""
    return _files(spark, d)


@query(f"""
WITH {FILES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY output_group <> 'improved', list_position(['docx', 'md', 'txt', 'srt', 'vtt'], format), position) AS n FROM files WHERE format IN ('docx', 'md', 'txt', 'srt', 'vtt'))
SELECT job_id, file FROM r WHERE n = 1
""")
def rnk06_primary(spark: SparkSession, d: str) -> DataFrame:
    """The main file of every job's result."""
    return render.primary(_files(spark, d), ["job_id"])


@query(f"""
WITH {SPEECH_SQL}, {CHUNK_SQL}, timed AS (SELECT job_id || '/' || chunk_index AS k, (any_value(chunk_e) - any_value(chunk_s)) / 1000.0 AS length, string_agg(text, chr(10) ORDER BY seg_index, segment_id) AS text FROM speech JOIN c USING (job_id, chunk_index) GROUP BY job_id, chunk_index),
{UNITS_SQL.format(k="k AS chunk")}
""")
def src16_text_responses(spark: SparkSession, d: str) -> DataFrame:
    """Model responses of every chunk that hold text only, as units with estimated times."""
    one = _chunked(spark, d).groupBy("job_id", "chunk_index", "chunk_s", "chunk_e").agg(F.sort_array(F.collect_list(F.struct("seg_index", "segment_id", "text"))).alias("x"))
    sent = one.select(F.concat_ws("/", "job_id", F.col("chunk_index").cast("string")).alias("chunk"), ((F.col("chunk_e") - F.col("chunk_s")) / 1000.0).alias("d"), F.to_json(F.struct(F.array_join("x.text", "\n").alias("text"))).alias("json"))
    got = media.transcribed(sent, key="chunk", json="json", duration="d")
    return got.select("chunk", F.col("seg_index").alias("unit"), F.size(T.words(F.col("text"))).alias("weight"), F.col("start").alias("start_sec"), F.col("end").alias("end_sec"), "text")


@query("""
WITH s AS (SELECT DISTINCT segment_id, job_id, chunk_index, start_sec, end_sec FROM segments WHERE start_sec >= 0 AND end_sec >= start_sec),
w AS (SELECT job_id, chunk_index, segment_id * 1000 + i AS position, x.start_sec AS a, x.end_sec AS z, x.text AS t FROM (SELECT DISTINCT segment_id, job_id, chunk_index, unnest(words) AS x, generate_subscripts(words, 1) - 1 AS i FROM segments WHERE words IS NOT NULL))
SELECT s.segment_id, count(w.t) AS n_words, coalesce(string_agg(w.t, ' ' ORDER BY w.position), '') AS words FROM s LEFT JOIN w ON w.job_id = s.job_id AND w.chunk_index = s.chunk_index AND w.a >= s.start_sec - 1e-4 AND w.z <= s.end_sec + 1e-4 GROUP BY s.segment_id
""")
def jn02_word_arrays(spark: SparkSession, d: str) -> DataFrame:
    """The words of a chunk that lie within each of its segments, in order."""
    t = once(table(spark, d, "segments").select("segment_id", "job_id", "chunk_index", "start_sec", "end_sec", "words"), "segment_id")
    seg = t.where("start_sec >= 0 AND end_sec >= start_sec").select("segment_id", "job_id", "chunk_index", F.col("start_sec").alias("start"), F.col("end_sec").alias("end"))
    words = t.select("segment_id", "job_id", "chunk_index", F.posexplode("words").alias("i", "w")).select("job_id", "chunk_index", (F.col("segment_id") * 1000 + F.col("i")).alias("position"), F.col("w.start_sec").alias("start"), F.col("w.end_sec").alias("end"), F.col("w.text").alias("text"))
    out = chunks.words_of_segments(seg, words, keys=["job_id", "chunk_index"])
    return out.select("segment_id", F.size("words").cast("bigint").alias("n_words"), F.array_join("words.text", " ").alias("words"))


@query("""
WITH c AS (SELECT DISTINCT job_id, chunk_index, start_sec AS off FROM chunks), s AS (SELECT DISTINCT segment_id, job_id, chunk_index, start_sec, end_sec, words FROM segments WHERE start_sec IS NOT NULL AND end_sec IS NOT NULL),
x AS (SELECT segment_id, off, start_sec + off >= 0 AS good, start_sec + off AS start_sec, end_sec + off AS end_sec, list_transform(words, lambda w: struct_pack(a := w.start_sec + off, z := w.end_sec + off)) AS w FROM s JOIN c USING (job_id, chunk_index))
SELECT segment_id, CASE WHEN good THEN start_sec END AS start_sec, CASE WHEN good THEN end_sec END AS end_sec, CASE WHEN good AND len(list_filter(w, lambda v: v.a < 0)) = 0 THEN list_sum(list_transform(w, lambda v: CAST(round(v.a * 1000) AS BIGINT) + CAST(round(v.z * 1000) AS BIGINT)))::BIGINT END AS word_ms FROM x
""")
def prj01_shift(spark: SparkSession, d: str) -> DataFrame:
    """Segments and their words moved by the start of their chunk; the words' bounds summed."""
    c = table(spark, d, "chunks").select("job_id", "chunk_index", F.col("start_sec").alias("by")).distinct()
    t = once(table(spark, d, "segments").select("segment_id", "job_id", "chunk_index", "start_sec", "end_sec", "words"), "segment_id").where("start_sec IS NOT NULL AND end_sec IS NOT NULL")
    out = chunks.shifted(t.join(c, ["job_id", "chunk_index"]), F.col("by"))
    ms = lambda x: F.round(x * 1000).cast("bigint")
    total = F.when(F.size("words") > 0, F.aggregate("words", F.lit(0).cast("bigint"), lambda a, w: a + ms(w["start_sec"]) + ms(w["end_sec"])))
    return out.select("segment_id", "start_sec", "end_sec", total.alias("word_ms"))


@query(f"""
WITH {JOBS_SQL}, g AS (SELECT job_id, list_sort(list(DISTINCT lang)) AS tags FROM documents WHERE job_id IS NOT NULL AND lang IS NOT NULL GROUP BY job_id),
r AS (SELECT job_id, nullif(language, 'auto') AS requested, coalesce(tags, []) AS tags FROM latest LEFT JOIN g USING (job_id)),
t AS (SELECT job_id, requested, unnest(tags) AS tag FROM r),
n AS (SELECT job_id, requested, tag, lower(replace(trim(tag), '_', '-')) AS t, lower(replace(trim(requested), '_', '-')) AS q FROM t),
m AS (SELECT *, split_part(t, '-', 1) AS b, regexp_extract(t, '^[^-]*-(.+)$', 1) AS rest FROM n),
k AS (SELECT *, {ALIAS_SQL} AS base FROM m),
z AS (SELECT job_id, tag, CASE WHEN base || CASE WHEN rest <> '' THEN '-' || rest ELSE '' END = q THEN 0 WHEN base = split_part(q, '-', 1) THEN 1 ELSE 4 END AS rank FROM k WHERE requested IS NOT NULL),
best AS (SELECT job_id, min(struct_pack(rank := rank, tag := tag)) AS x FROM z GROUP BY job_id)
SELECT job_id, requested, CASE WHEN requested IS NULL THEN tags[1] WHEN x.rank <= 1 THEN x.tag END AS selected FROM r LEFT JOIN best USING (job_id)
""")
def rnk05_select_language(spark: SparkSession, d: str) -> DataFrame:
    """Of the languages of each job's documents the one that fits the job's request best."""
    g = table(spark, d, "documents").where("job_id IS NOT NULL AND lang IS NOT NULL").groupBy("job_id").agg(F.array_sort(F.collect_set("lang")).alias("tags"))
    rows = views.jobs(spark, d).select("job_id", F.nullif("language", F.lit("auto")).alias("requested")).join(g, "job_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return rows.select("job_id", "requested", media.select_language(F.col("tags"), F.col("requested")).alias("selected"))


@query(f"WITH {JOBS_SQL} SELECT job_id, strftime(created_at, '%d/%m/%Y %H:%M') AS label, status AS other FROM latest")
def fn18_date_labels(spark: SparkSession, d: str) -> DataFrame:
    """Creation times of jobs as labels; what is no time stays as it is."""
    rows = views.jobs(spark, d).select("job_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("t"), "status")
    return rows.select("job_id", S.date_label(F.col("t")).alias("label"), S.date_label(F.col("status")).alias("other"))


@query(r"""
WITH m AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS t FROM documents WHERE file_format = 'md'),
x AS (SELECT doc_id, t, list_filter(string_split(t, chr(10)), lambda l: starts_with(l, '# ')) AS titles, list_filter(string_split(replace(chr(10) || t, chr(10) || '## ', chr(1) || '## '), chr(1)), lambda p: starts_with(p, '## ')) AS parts FROM m)
SELECT doc_id, CASE WHEN len(titles) = 1 THEN trim(titles[1][3:]) END AS title, CAST(len(parts) AS BIGINT) AS sections,
 CASE WHEN trim(t, ' ' || chr(10)) = '' THEN 'empty' WHEN len(titles) <> 1 THEN 'title' WHEN len(parts) = 0 THEN 'none' ELSE 'ok' END AS state FROM x
""")
def src18_documents(spark: SparkSession, d: str) -> DataFrame:
    """Title, number of sections and state of every Markdown document as a help text."""
    return search.help_states(table(spark, d, "documents").where("file_format = 'md'").select("doc_id", "text"), key="doc_id", markdown="text")


@query("""
WITH w AS (SELECT DISTINCT segment_id, start_sec, end_sec, words FROM segments WHERE start_sec IS NOT NULL AND end_sec IS NOT NULL AND len(words) > 0)
SELECT segment_id, CASE WHEN len(list_filter(words, lambda w: w.end_sec > end_sec + 1e-6 OR w.start_sec < start_sec - 1e-6)) > 0 THEN 'outside' ELSE 'order' END AS reason FROM w
WHERE len(list_filter(words, lambda w: w.end_sec > end_sec + 1e-6 OR w.start_sec < start_sec - 1e-6)) > 0 OR len(list_filter(range(2, len(words) + 1), lambda i: words[i - 1].start_sec > words[i].start_sec)) > 0
""")
def val02_word_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Segments with a word outside of them, or with words out of order."""
    t = once(table(spark, d, "segments").select("segment_id", "start_sec", "end_sec", "words"), "segment_id").where("start_sec IS NOT NULL AND end_sec IS NOT NULL AND size(words) > 0")
    outside = F.exists("words", lambda w: F.coalesce((w["end_sec"] > F.col("end_sec") + 1e-6) | (w["start_sec"] < F.col("start_sec") - 1e-6), F.lit(False)))
    pairs = F.zip_with(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", 2, F.size("words")), lambda a, b: F.coalesce(a["start_sec"] > b["start_sec"], F.lit(False)))
    reason = F.when(outside, "outside").when(F.exists(pairs, lambda p: p), "order")
    return t.select("segment_id", reason.alias("reason")).where("reason IS NOT NULL")


@query("""
WITH c AS (SELECT job_id, list_sort(list(DISTINCT chunk_index)) AS chunks FROM chunks GROUP BY job_id), r AS (SELECT job_id, list_sort(list(DISTINCT chunk_index)) AS done FROM segments WHERE chunk_index IS NOT NULL GROUP BY job_id)
SELECT job_id, chunks[1] = 0 AND chunks[-1] = len(chunks) - 1 AS contiguous, len(list_filter(coalesce(done, []), lambda x: NOT list_contains(chunks, x))) = 0 AS within, len(list_filter(chunks, lambda x: NOT list_contains(coalesce(done, []), x))) = 0 AS complete FROM c LEFT JOIN r USING (job_id)
""")
def val03_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Whether each job's chunks are numbered without gaps, its results are all of its chunks', and none is missing."""
    c = table(spark, d, "chunks").groupBy("job_id").agg(F.array_sort(F.collect_set("chunk_index")).alias("chunks"))
    r = table(spark, d, "segments").groupBy("job_id").agg(F.collect_set("chunk_index").alias("done"))
    done = F.coalesce("done", F.array().cast("array<int>"))
    ok = store.consistent(F.col("chunks"), done, F.create_map().cast("map<int,string>"))
    return c.join(r, "job_id", "left").select("job_id", F.coalesce((F.get("chunks", F.lit(0)) == 0) & (F.try_element_at("chunks", F.lit(-1)) == F.size("chunks") - 1), F.lit(False)).alias("contiguous"), ok.alias("within"), (F.size(F.array_except("chunks", done)) == 0).alias("complete"))


@query(f"WITH {JOBS_SQL} SELECT DISTINCT model FROM latest WHERE provider = 'aurora'")
def flt06_models(spark: SparkSession, d: str) -> DataFrame:
    """Models of one provider."""
    return views.jobs(spark, d).where("provider = 'aurora'").select("model").distinct()


@query("SELECT doc_id, true AS lang_ok FROM documents WHERE file_format = 'md' AND split_part(lower(lang), '-', 1) IN ('pt', 'es')")
def flt05_allowed(spark: SparkSession, d: str) -> DataFrame:
    """Markdown documents whose base language is in a fixed set."""
    rows = table(spark, d, "documents").where("file_format = 'md'").select("doc_id", F.split_part(F.lower("lang"), F.lit("-"), F.lit(1)).alias("base"))
    return search.allowed(rows, "base", ["pt", "es"]).select("doc_id", F.lit(True).alias("lang_ok"))


