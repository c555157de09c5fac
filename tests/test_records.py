"""Caption choices, candidates, text responses, stores, help texts, exports."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cadenza.functions import sources as S
from cadenza.functions import text as T
from cadenza.operators import chunks, render, search
from cadenza.sources import media, store


def test_caption_choice(spark):
    tags = lambda *x: {t: "u" for t in x}
    rows = [
        ("both", json.dumps({"subtitles": tags("en", "pt-BR"), "automatic_captions": tags("pt")}), "pt"),
        ("auto", json.dumps({"subtitles": tags("en", "live_chat"), "automatic_captions": tags("pt", "pt-PT")}), "pt_PT"),
        ("own", json.dumps({"original_language": "es", "subtitles": tags("en", "es-419"), "automatic_captions": tags("es")}), None),
        ("first", json.dumps({"subtitles": tags("live_chat", "fr", "de")}), ""),
        ("none", json.dumps({"subtitles": tags("en")}), "pt"), ("bad", "{", "pt"), ("null", None, None),
    ]
    df = spark.createDataFrame(rows, "k string, j string, r string")
    got = {}
    for r in media.caption_choices(df, key="k", json="j", requested=F.col("r")).orderBy("priority").collect():
        got.setdefault(r["k"], []).append((r["language"], r["automatic"]))
    assert got == {"both": [("pt-BR", False), ("pt", True)], "auto": [("pt-PT", True)], "own": [("es-419", False), ("es", True)], "first": [("fr", False)]}
    assert media.caption_choices(df, key="k", json="j", requested=F.col("r"), allow_automatic=False).where("automatic").count() == 0


def test_candidates_and_outcome(spark):
    files = spark.createDataFrame([("m", "a.pt.vtt", "pt", 1), ("m", "a.pt.srt", "pt", 2)], "k string, file string, language string, rank_key int")
    streams = spark.createDataFrame([("m", 3, "text", "pt", 1), ("n", 4, "image", None, 1), ("n", 5, "unknown", None, 2), ("o", 6, "unknown", None, 1)], "k string, index int, kind string, language string, rank_key int")
    found = media.candidates(files, streams, key="k")
    assert [(r["k"], r["origin"], r["name"]) for r in found.orderBy("k", "priority", "position").collect()] == [("m", "sidecar", "a.pt.vtt"), ("m", "sidecar", "a.pt.srt"), ("m", "stream", "3"), ("n", "stream", "4"), ("n", "stream", "5"), ("o", "stream", "6")]
    texts = spark.createDataFrame([("m", "sidecar", "a.pt.vtt", " "), ("m", "sidecar", "a.pt.srt", None), ("m", "stream", "3", "olá"), ("n", "stream", "4", "x")], "k string, origin string, name string, text string")
    assert {r["k"]: (r["outcome"], r["name"]) for r in media.outcomes(found, texts, key="k").collect()} == {"m": ("text", "3"), "n": ("image", None), "o": ("none", None)}


def test_text_only_responses(spark):
    rows = [("t", json.dumps({"text": "Primeira frase curta. Segunda frase com mais algumas palavras."}), 12.0), ("s", json.dumps({"segments": [{"start": 0, "end": 1, "text": "a", "speaker": "A"}], "text": "x"}), 9.0), ("e", json.dumps({"text": " "}), 1.0), ("z", json.dumps({"text": "um"}), 0.0), ("l", json.dumps({"text": "w " * 57}), 57.0)]
    got = media.transcribed(spark.createDataFrame(rows, "k string, j string, d double"), key="k", json="j", duration="d").orderBy("k", "seg_index").collect()
    assert [(r["k"], r["kind"], r["start"], r["end"], r["text"][:20]) for r in got] == [
        ("l", "estimated", 0.0, 28.0, "w w w w w w w w w w "), ("l", "estimated", 28.0, 56.0, "w w w w w w w w w w "), ("l", "estimated", 56.0, 57.0, "w"),
        ("s", "provider", 0.0, 1.0, "a"), ("t", "estimated", 0.0, 4.0, "Primeira frase curta"), ("t", "estimated", 4.0, 12.0, "Segunda frase com ma"), ("z", "estimated", 0.0, 0.001, "um"),
    ]


def test_manifests_and_results(spark, tmp_path):
    for folder, job in (("a", "a"), ("b", "c"), ("d", "d")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "job.json").write_text(json.dumps({"job_id": job, "n": 1}) if folder != "d" else "{oops")
    assert [r["job_id"] for r in store.manifests(spark, str(tmp_path), StructType.fromDDL("job_id string, n int")).collect()] == ["a"]
    jobs = spark.createDataFrame([("a", [0, 2]), ("b", [])], "job_id string, completed array<int>")
    results = spark.createDataFrame([("a", i, f"r{i}") for i in range(4)] + [("b", 0, "x")], "job_id string, chunk_index int, r string")
    assert [r["r"] for r in store.completed_results(results, jobs).orderBy("chunk_index").collect()] == ["r0", "r2"]
    plan = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("c", 0)], "job_id string, chunk_index int")
    got = store.status(plan, results.select("job_id", "chunk_index"), spark.createDataFrame([("b",)], "job_id string"))
    assert {r["job_id"]: r["status"] for r in got.collect()} == {"a": "running", "b": "corrupt", "c": "open"}
    assert store.editorial_results(spark.createDataFrame([("0" * 20,), ("../x",), (None,)], "block_id string")).count() == 1


def test_events_and_outputs(spark):
    events = [("j", 0, 1, "failed", "late"), ("j", 0, 2, "saved", None), ("j", 1, 1, "saved", None), ("j", 1, 3, "failed", "lost"), ("j", 1, 3, "failed", "lost"), ("j", 2, 1, "seen", None)]
    got = store.applied(spark.createDataFrame(events, "job_id string, chunk_index int, at int, kind string, message string")).collect()
    assert [(r["completed"], r["errors"]) for r in got] == [([0], {1: "lost"})]
    meta = spark.createDataFrame([("g", {"original": ["o"], "improved": ["i"]}, ["x"]), ("f", {}, ["x", "y"]), ("n", None, None)], "job_id string, output_groups map<string,array<string>>, output_paths array<string>")
    out = {r["job_id"]: (r["outputs"], r["groups"]["original"]) for r in store.saved_outputs(meta).collect()}
    assert out == {"g": (["o", "i"], ["o"]), "f": (["x", "y"], ["x", "y"]), "n": ([], [])}


def test_labels_and_sources(spark):
    df = spark.createDataFrame([("2025-06-20T15:02:47",), ("ontem",), (None,)], "t string")
    assert [r[0] for r in df.select(S.date_label(F.col("t"))).collect()] == ["20/06/2025 15:02", "ontem", None]
    rows = [("https://h/x", 1, 1, None, None, True), ("/x", 1, 5, 1, 5, True), ("/x", 1, 5, 2, 5, False), ("/x", None, 5, 2, 6, True), ("/x", 1, 5, None, None, False)]
    df = spark.createDataFrame(rows, "s string, a int, b int, c int, d int, want boolean")
    assert all(r[0] == r[1] for r in df.select(S.unchanged(*[F.col(c) for c in "sabcd"]), "want").collect())


def test_help_texts(spark):
    docs = [("ok", "# T\n## Um\ncorpo\n## Dois\nx"), ("two", "# T\n# U\n## A\nx"), ("same", "# T\n## Ação\nx\n## acao\ny"), ("empty", " \n"), ("null", None), ("none", "# T\ntexto")]
    df = spark.createDataFrame(docs, "k string, m string")
    assert {r["k"]: r["state"] for r in search.help_states(df, key="k", markdown="m").collect()} == {"ok": "ok", "two": "title", "same": "anchor", "empty": "empty", "null": "empty", "none": "none"}
    found = search.sections(df, key="k", markdown="m").withColumn("f", T.fold(F.col("title"))).withColumn("anchor", T.slug(F.col("f")))
    wanted = spark.createDataFrame([("ok", "dois"), ("ok", "tres")], "k string, anchor string")
    got = {r["wanted"]: r["anchor"] for r in search.section_or_default(found, wanted, key="k", default="um").collect()}
    assert got == {"dois": "dois", "tres": "um"} and search.allowed(found, "anchor", ["um"]).count() == 1


def test_formats(spark):
    rows = spark.createDataFrame([("j", 0, 0, 1_000, "Ana", "Olá."), ("j", 0, 1_500, 1_500, None, "fica")], "job_id string, h int, s bigint, e bigint, speaker string, text string")
    text = lambda **k: [r["text"] for r in render.exported(rows, ["job_id"], "h", ["s"], **k).collect()]
    assert text(path="x/y.TXT") == ["Ana: Olá."] and text(format="txt", timestamps=True) == ["[00:00:00] Ana: Olá.", "[00:00:01] fica"] and text(format=".srt")[0].startswith("1\n")
    with pytest.raises(ValueError):
        text(path="x.pdf")
    heads = spark.createDataFrame([("a", " T ", "h/x"), ("b", None, "")], "job_id string, title string, source string")
    assert [r["text"] for r in render.markdown_heads(heads, ["job_id"]).orderBy("job_id").collect()] == ["# T\n\nFonte: `h/x`\n\n## Transcrição\n", "# Transcrição\n\n## Transcrição\n"]


def test_words_with_their_segments(spark):
    seg = spark.createDataFrame([("j", 1, 59.0, 61.0), ("j", 2, 0.0, 1.0)], "job_id string, segment_id int, start double, end double")
    words = spark.createDataFrame([("j", 1, 60.5, 61.00005, "b"), ("j", 0, 58.99995, 59.5, "a"), ("j", 2, 61.0, 61.2, "c")], "job_id string, position int, start double, end double, text string")
    assert {r["segment_id"]: [w["text"] for w in r["words"]] for r in chunks.words_of_segments(seg, words, keys=["job_id"]).collect()} == {1: ["a", "b"], 2: []}
    df = spark.createDataFrame([(1.0, 2.0, [(1.0, 1.5)], 5.0), (0.5, 2.0, [(0.5, 1.0)], None)], "start_sec double, end_sec double, words array<struct<start_sec:double,end_sec:double>>, duration double")
    moved = [tuple(r) for r in chunks.shifted(df, F.lit(-1.0), duration="duration").collect()]
    assert moved[0][:2] == (0.0, 1.0) and moved[0][3] == 4.0 and moved[1][:3] == (None, None, None)


LETTERS = "aAfiImMçãÉßﬁĳſ½e\u0301K…"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(LETTERS, max_size=8), min_size=1, max_size=60), st.sampled_from(["fim", "ss", "a", "ij", "e", "cai"]))
def test_prefilter_passes_whatever_folds_to_the_term(spark, texts, term):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.fold(F.col("t")).contains(term).alias("holds"), T.may_hold(F.col("t"), term).alias("may")).collect()
    assert all(r["may"] for r in rows if r["holds"])
