"""Probe records, subtitle candidates, model responses, stores."""

import json

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cadenza.functions import sources as S
from cadenza.sources import media, store


def test_probe(spark):
    streams = [{"index": 0, "codec_type": "video", "duration": "N/A"}, {"index": 1, "codec_type": "audio", "duration": "12.5"}, {"index": 2, "codec_type": "subtitle", "codec_name": "WebVTT", "tags": {"language": "por"}}, {"index": 3, "codec_type": "subtitle", "codec_name": "webvtt", "tags": {"language": "eng"}, "disposition": {"default": 1}}]
    rows = [("a", json.dumps({"format": {}, "streams": streams})), ("b", "no json"), ("c", None), ("d", json.dumps({"format": {"duration": "0"}, "streams": []}))]
    got = media.probes(spark.createDataFrame(rows, "k string, j string"), key="k", json="j").collect()
    assert [(r["k"], r["duration"], r["audio"], r["video"], [s["kind"] for s in r["streams"]]) for r in got] == [("a", 12.5, 1, 1, ["text", "text"])]
    table = spark.createDataFrame([(s["index"], s["language"], s["is_default"]) for s in got[0]["streams"]], "index int, language string, is_default boolean")
    first = lambda tag: media.ranked_streams(table, F.lit(tag)).orderBy("rank_key").first()["index"]
    assert first("pt-BR") == 2 and first(None) == 3


def test_sidecars_and_fallback(spark):
    m = spark.createDataFrame([("f", "aula.mp4")], "folder string, media string")
    files = spark.createDataFrame([("f", n) for n in ("aula.en.vtt", "aula.pt-BR.srt", "aula.txt", "outra.srt", "aula.por.vtt")], "folder string, file string")
    got = [(r["file"], r["language"]) for r in media.sidecars(m, files, F.lit("pt-BR")).orderBy("rank_key").collect()]
    assert got == [("aula.pt-BR.srt", "pt-BR"), ("aula.por.vtt", "por")]
    c = spark.createDataFrame([("m", 1, "x", " "), ("m", 2, "y", "texto"), ("n", 1, "z", None)], "k string, p int, f string, text string")
    assert [tuple(r) for r in media.first_usable(c, key="k", priority="p", keep=["f"]).collect()] == [("m", "y")]


def test_responses(spark):
    good = {"segments": [{"start": 1.0, "end": 2.0, "text": "a", "speaker": " "}, {"start": None, "end": 9.0, "text": "b"}, {"start": 0.5, "end": 0.6, "text": "c"}, {"text": " "}]}
    df = spark.createDataFrame([("k", json.dumps(good), 5.0), ("l", "{", 5.0), ("m", None, 5.0)], "k string, j string, d double")
    got = [(r["start"], r["end"], r["speaker"], r["text"]) for r in media.responses(df, key="k", json="j", duration="d").orderBy("seg_index").collect()]
    assert got == [(1.0, 2.0, None, "a"), (1.0, 5.0, None, "b"), (1.0, 1.0, None, "c")]


def test_names(spark):
    df = spark.createDataFrame([("https://u:p@h.example:81/a/b%20c.mp3?x#y",), ("https://h.example",), ("/x/y.mp4",), (None,)], "s string")
    assert [r[0] for r in df.select(S.display_name(F.col("s"))).collect()] == ["b c.mp3", "h.example", "y.mp4", None]
    assert [r[0] for r in df.select(S.safe_label(F.col("s"))).collect()] == ["https://h.example:81/a/b%20c.mp3", "https://h.example", "y.mp4", None]
    u = spark.createDataFrame([('{"a":-1,"b":"7"}',), ('{"a":"x"}',), (None,)], "u string")
    assert [r[0] for r in u.select(S.count_of(F.col("u"), "$.a", "$.b")).collect()] == [7, None, None]
    f = spark.createDataFrame([("no",), ("1",), (None,), (" OFF ",)], "f string")
    assert [r[0] for r in f.select(S.flag(F.col("f"))).collect()] == [False, True, False, False]


def test_store(spark, tmp_path):
    schema = StructType.fromDDL("job_id string, n int")
    rows = spark.createDataFrame([("a", '{"job_id":"a","n":1}'), ("b", "{broken"), ("c", None)], "k string, json string")
    good, bad = store.from_json_rows(rows, schema)
    assert [tuple(r) for r in good.collect()] == [("a", 1)] and sorted(r["k"] for r in bad.collect()) == ["b", "c"]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "m.json").write_text('{"job_id":"a","n":1,"more":2}\n')
    (tmp_path / "x" / "bad.json").write_text("{oops\n")
    assert [tuple(r) for r in store.scan(spark, str(tmp_path), schema).collect()] == [("a", 1)]
    chunks = spark.createDataFrame([("j", 0), ("j", 1), ("k", 0)], "job_id string, chunk_index int")
    done = spark.createDataFrame([("j", 0), ("j", 7)], "job_id string, chunk_index int")
    got = {r["job_id"]: (r["completed"], r["pending"], r["progress"]) for r in store.reconcile(chunks, done).collect()}
    assert got == {"j": ([0], [1], 0.5), "k": ([], [0], 0.0)}


def test_set_updates_and_outputs(spark):
    df = spark.range(1).select(F.expr("array(3, 1)").alias("done"), F.expr("map(2, 'late', 4, 'lost')").alias("errors"), F.expr("array(0, 1, 2, 3)").alias("chunks"))
    done, errors = store.with_result(F.col("done"), F.col("errors"), F.lit(2))
    assert tuple(df.select(done, errors).first()) == ([1, 2, 3], {4: "lost"})
    c, d, e = F.col("chunks"), F.col("done"), F.col("errors")
    assert tuple(df.select(store.consistent(c, d, e), store.consistent(c, d, F.map_filter(e, lambda k, _: k < 4)), store.consistent(F.array(F.lit(1)), d, F.map_filter(e, lambda k, _: k < 0))).first()) == (False, True, False)
    groups = spark.range(1).select(F.expr("map('improved', array('i'), 'other', array('x'), 'original', array('b', 'a'))").alias("g"))
    assert groups.select(store.outputs(F.col("g"))).first()[0] == ["b", "a", "i"]
