"""Every query over empty tables and over tables with nulls, repeats, long texts and clashing columns."""

import pytest

from cadenza.llm import queries
from cadenza.plans import core

DDL = {
    "segments": "segment_id bigint, job_id string, chunk_index int, seg_index int, start_sec double, end_sec double, text string, speaker string, confidence double, words array<struct<start_sec:double,end_sec:double,text:string,confidence:double>>, metadata string, ingested_at timestamp",
    "transcripts": "job_id string, language string, duration double, metadata string, ingested_at timestamp",
    "silences": "silence_id bigint, media_id string, start_sec double, end_sec double, noise_db int, ingested_at timestamp",
    "planners": "planner_id int, target_duration double, search_window double, overlap double, min_duration double, chars_per_sec double, max_chars int",
    "editorial_blocks": "block_id string, job_id string, block_index int, planner_id int, text string, ingested_at timestamp",
    "editorial_requests": "request_id bigint, job_id string, block_id string, text string, model_id string, reasoning_effort string, previous_context string, sent_at timestamp",
    "editorial_responses": "response_id bigint, request_id bigint, text string, model_id string, input_tokens bigint, output_tokens bigint, received_at timestamp",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, job_id string, title string, file_format string, created_at timestamp",
    "eval_items": "item_id bigint, text string, lang string",
    "mix_targets": "mix_id int, source string, target_share double, max_repeats int, budget_ratio double",
}
CLASH = ", key string, b int, s string, e string, word string, token string, class int, label string, who string, n int, x string, p string, g string, domain string, seed int, main string"
LONG = "Uma frase bem longa sobre o rio e a ponte. " * 4_000
ROWS = {
    "segments": [
        (1, "j", 0, 0, 0.0, 1.0, "Bom dia a todos os presentes", "Ana Silva", 1.0, None, None, None),
        (1, "j", 0, 0, 0.0, 1.0, "Bom dia a todos os presentes", "Ana Silva", 1.0, None, None, None),
        (2, "j", None, None, 1.0, 2.0, LONG, None, None, None, None, None),
        (3, None, 0, 2, 1.0, 2.0, "sem trabalho", "F1", None, None, None, None),
        (4, "j", 0, 3, None, None, None, None, None, None, None, None),
        (5, "j", 0, 4, float("nan"), float("inf"), "", "", None, None, None, None),
        (None, "j", 0, 5, 1.0, 2.0, "hum...", "A. Silva", None, None, None, None),
    ],
    "transcripts": [("j", None, None, None, None), (None, "pt", 1.0, None, None), ("k", "??", None, None, None)],
    "silences": [(1, "m", 0.0, 1.0, None, None), (2, None, 0.0, 1.0, None, None), (3, "m", None, 1.0, None, None), (4, "m", 5.0, 4.0, None, None)],
    "planners": [(1, 60.0, 5.0, 2.0, 10.0, 14.0, 2_000), (2, None, None, None, None, None, None)],
    "editorial_blocks": [("b1", "j", 0, 1, LONG, None), ("b1", "j", 0, 1, LONG, None), ("b2", "j", 1, 1, None, None), ("b3", "j", 2, 2, "x", None), ("b4", None, None, None, "y", None), ("b5", "j", 3, 1, "", None)],
    "editorial_requests": [(1, "j", "b1", LONG, None, None, None, None), (2, None, None, None, None, None, None, None), (3, "j", "b5", "", None, None, None, None), (4, "j", "b2", "o rio subiu e a ponte caiu na noite de terça", None, None, None, None)],
    "editorial_responses": [(1, 1, None, None, None, None, None), (2, 1, LONG, None, None, None, None), (3, 2, "x", None, None, None, None), (4, None, "y", None, None, None, None), (5, 3, "", None, None, None, None), (6, 4, "O RIO SUBIU e a ponte caiu na noite de terça", None, None, None, None)],
    "documents": [(1, LONG, None, None, None, None, None, None, None), (2, None, "pt", "a", None, None, None, "txt", None), (3, "", "pt", "a", 0, None, None, "md", None), (4, "só um texto curto sobre o rio", "pt", " A ", 5, "j", "t", "txt", None), (5, "só um texto curto sobre o rio", "pt", "a", 5, "j", "t", "txt", None)],
    "eval_items": [(1, None, None), (2, "curto", "pt"), (3, "uma passagem de teste com bem mais de treze palavras para que possa vazar em algum documento", "pt")],
    "mix_targets": [(1, "a", 1.0, 2, 0.5), (1, None, 1.0, 2, 0.5), (1, "none", 1.0, 2, 0.5), (2, "a", None, None, None), (3, "a", 1.0, 1, None)],
}
NAMES = sorted(queries.QUERIES)


def write(spark, folder, rows):
    for name, ddl in DDL.items():
        more = CLASH.split(", ")[1:]
        data = [(*r, *[None] * len(more)) for r in rows.get(name, [])]
        spark.createDataFrame(data, ddl + CLASH).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), {})


@pytest.fixture(scope="module")
def nasty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("nasty"), ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_nasty(spark, nasty, name):
    rows = queries.QUERIES[name](spark, nasty).collect()
    if name == "p3_found":
        assert {(r["response_id"], r["defect"]) for r in rows} == {(1, "empty"), (5, "empty"), (6, "copy")}
    if name == "p5_found":
        assert [r["block_id"] for r in rows] == ["b1"]
    if name == "p4_found":
        assert {(r["first_segment_id"], r["last_segment_id"]) for r in rows} == {(1, 2)}


def test_core_query(spark, empty, nasty):
    assert core.p1_found(spark, empty).count() == 0
    assert {tuple(r) for r in core.p1_found(spark, nasty).collect()} == {("segment", "j", "period", 0, 2000), ("silence", "m", "period", 0, 1000)}
