"""Every query of the core over empty tables and over tables with nulls, repeats, ties, long texts and clashing columns."""

import pytest

from cadenza.plans import core

DDL = {
    "segments": "segment_id bigint, job_id string, chunk_index int, seg_index int, start_sec double, end_sec double, text string, speaker string, confidence double, words array<struct<start_sec:double,end_sec:double,text:string,confidence:double>>, metadata string, ingested_at timestamp",
    "transcripts": "job_id string, language string, duration double, metadata string, ingested_at timestamp",
    "jobs": "job_id string, media_id string, source_name string, provider string, model string, language string, status string, planner_id int, duration double, settings string, created_at timestamp, updated_at timestamp",
    "chunks": "job_id string, chunk_index int, start_sec double, end_sec double, overlap_before double, boundary string",
    "silences": "silence_id bigint, media_id string, start_sec double, end_sec double, noise_db int, ingested_at timestamp",
    "planners": "planner_id int, target_duration double, search_window double, overlap double, min_duration double, chars_per_sec double, max_chars int",
    "editorial_blocks": "block_id string, job_id string, block_index int, planner_id int, text string, ingested_at timestamp",
    "editorial_requests": "request_id bigint, job_id string, block_id string, text string, model_id string, reasoning_effort string, previous_context string, sent_at timestamp",
    "editorial_responses": "response_id bigint, request_id bigint, text string, model_id string, input_tokens bigint, output_tokens bigint, received_at timestamp",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, job_id string, title string, file_format string, created_at timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double",
}
CLASH = ["key string", "b bigint", "s bigint", "e bigint", "h bigint", "x int", "n int", "at int", "run int", "part int", "name string", "stem string", "start string", "end string", "t string", "k int", "position int"]
LONG = "Uma frase bem longa sobre o rio e a ponte. " * 3_000
WORDS = [(0.0, 0.5, "Bom", 1.0), (None, None, "dia", None)]
ROWS = {
    "segments": [
        (1, "j", 0, 0, 0.0, 1.0, "Bom dia a todos", "Ana Silva", 1.0, WORDS, None, None),
        (1, "j", 0, 0, 0.0, 1.0, "Bom dia a todos", "Ana Silva", 1.0, WORDS, None, None),
        (2, "j", 0, 0, 0.0, 1.0, "Bom dia a todos", "Ana Silva", 1.0, None, None, None),
        (3, "j", None, None, 1.0, 2.0, LONG, None, None, [], None, None),
        (4, None, 0, 2, 1.0, 2.0, "sem trabalho", "F1", None, None, None, None),
        (5, "j", 1, 3, None, None, None, None, None, None, None, None),
        (6, "j", 1, 4, float("nan"), float("inf"), "", "", None, None, None, None),
        (None, "j", 1, 5, 9.0, 2.0, "hum...", "A. Silva", None, None, None, None),
    ],
    "transcripts": [("j", None, None, None, None), (None, "pt", 1.0, None, None), ("k", "", None, None, None)],
    "jobs": [("j", "m", "aula.mp3", "aurora", "v", None, "completed", 1, 90.0, '{"formats":["txt","txt","srt"]}', None, None), ("j", "m", "aula.mp3", "aurora", "v", None, "completed", 1, 90.0, '{"formats":["txt","txt","srt"]}', None, None), ("k", None, None, None, None, "auto", None, None, None, "{", None, None), (None, "m", "aula.mp3", None, None, "pt", None, 2, -1.0, None, None, None)],
    "chunks": [("j", 0, 0.0, 60.0, 0.0, "end"), ("j", 1, 58.0, 90.0, 2.0, None), ("j", 1, 58.0, 90.0, 2.0, None), (None, 0, None, None, None, None), ("k", None, 0.0, 1.0, 0.0, "end")],
    "silences": [(1, "m", 0.0, 1.0, None, None), (2, None, 0.0, 1.0, None, None), (3, "m", None, 1.0, None, None), (4, "m", 5.0, 400.0, None, None), (5, "q", 5.0, 4.0, None, None)],
    "planners": [(1, 60.0, 5.0, 2.0, 10.0, 14.0, 2_000), (2, None, None, None, None, None, None)],
    "editorial_blocks": [("b1", "j", 0, 1, LONG, None), ("b1", "j", 0, 1, LONG, None), ("b2", "j", 1, 1, None, None), ("b3", "j", 2, 2, "x", None), ("b4", None, None, None, "y", None), ("b5", "j", 3, 1, "", None)],
    "editorial_requests": [(1, "j", "b1", LONG, None, None, None, None), (2, None, None, None, None, None, None, None), (3, "j", "b5", "", None, None, None, None)],
    "editorial_responses": [(1, 1, None, None, None, None, None), (2, 1, LONG, None, -5, 3, None), (3, 2, "x", None, None, None, None), (4, None, "y", None, None, None, None), (5, 3, "", None, None, None, None)],
    "documents": [(1, LONG, None, None, None, None, None, None, None), (2, None, "pt", "a", None, "j", None, "md", None), (3, "", "pt", "a", 0, "j", None, "srt", None), (4, "# T\n\n## A\nx", "", " A ", 5, "j", "t", "md", None), (4, "# T\n\n## A\nx", "", " A ", 5, "j", "t", "md", None)],
    "events": [(1, None, None, None, None), (1, None, None, None, None)],
}
NAMES = sorted(core.QUERIES)


def write(spark, folder, rows):
    for name, ddl in DDL.items():
        own = {c.split()[0] for c in ddl.split(", ")}
        more = [c for c in CLASH if c.split()[0] not in own]
        data = [(*r, *[None] * len(more)) for r in rows.get(name, [])]
        spark.createDataFrame(data, ", ".join([ddl, *more])).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), {})


@pytest.fixture(scope="module")
def nasty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("nasty"), ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty(spark, empty, name):
    assert core.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_nasty(spark, nasty, name):
    rows = core.QUERIES[name](spark, nasty).collect()
    if name == "ivl01_merge_silences":
        assert {(r["media_id"], r["start_ms"], r["end_ms"]) for r in rows} == {("m", 0, 1_000), ("m", 5_000, 90_000)}  # within the medium
    if name == "fn10_usage_counts":
        assert {(r["response_id"], r["input_tokens"], r["output_tokens"]) for r in rows} >= {(2, None, 3), (1, None, None)}
    if name == "rnk06_primary":
        assert {(r["job_id"], r["file"]) for r in rows} == {("j", "aula — texto melhorado.txt")}
