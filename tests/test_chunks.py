"""Chunk plans, nearest silences, detector logs."""

import random

from pyspark.sql import functions as F

from cadenza.operators import chunks


def test_silence_cut():
    assert chunks.plan(130, [(58, 60)], target=60, window=5, overlap=3, least=15) == [(0, 0.0, 59.0, 0.0, "silence"), (1, 59.0, 130, 0.0, "end")]


def test_hard_cut_keeps_overlap():
    assert chunks.plan(125, [], target=60, window=5, overlap=2, least=10)[:2] == [(0, 0.0, 60.0, 0.0, "hard"), (1, 58.0, 125, 2.0, "end")]


def test_tie_prefers_longer_then_earlier():
    assert chunks.plan(130, [(54, 58), (63, 65)], target=60, window=5, overlap=0, least=5)[0][2] == 56
    assert chunks.plan(130, [(57, 59), (61, 63)], target=60, window=5, overlap=0, least=5)[0][2] == 58


def test_plans_cover_the_medium():
    rng = random.Random(1)
    for _ in range(200):
        length = rng.uniform(1, 2_000)
        spans, t = [], 0.0
        while t < length:
            t += rng.uniform(1, 40)
            spans.append((t, t + rng.uniform(0.1, 3)))
            t = spans[-1][1]
        got = chunks.plan(length, spans, target=60, window=8, overlap=3, least=10)
        assert got[0][1] == 0 and got[-1][2] == length and got[-1][4] == "end"
        for a, b in zip(got, got[1:]):
            assert abs(a[2] - b[3] - b[1]) < 1e-9 and b[1] > a[1]


def test_plans_table_with_nulls(spark):
    rows = [("m", 130.0, 60.0, 5.0, 3.0, 15.0, [(58.0, 60.0)]), ("n", None, 60.0, 5.0, 3.0, 15.0, None), ("o", 30.0, 60.0, 5.0, 3.0, 15.0, None)]
    df = spark.createDataFrame(rows, "media_id string, duration double, target_duration double, search_window double, overlap double, min_duration double, silences array<struct<start:double,end:double>>")
    assert sorted((r["media_id"], r["chunk_index"], r["boundary"]) for r in chunks.plans(df).collect()) == [("m", 0, "silence"), ("m", 1, "end"), ("o", 0, "end")]


def test_nearest_against_brute_force(spark):
    rng = random.Random(2)
    spans = [(rng.choice("ab"), s := rng.randrange(0, 600_000, 500), s + rng.randrange(0, 4_000, 500)) for _ in range(300)]
    points = [(rng.choice("ab"), i, rng.randrange(0, 600_000, 500), rng.choice([1_000, 20_000, 90_000])) for i in range(80)]
    got = {r["id"]: (r["s"], r["e"]) for r in chunks.nearest(spark.createDataFrame(points, "m string, id int, at_ms bigint, window_ms bigint"), spark.createDataFrame(spans, "m string, s bigint, e bigint"), on="m").collect()}
    for m, i, at, window in points:
        near = [(abs(s + e - 2 * at), s - e, s, e) for k, s, e in spans if k == m and e > s and abs(s + e - 2 * at) <= 2 * window]
        assert got.get(i) == (min(near)[2:] if near else None)


def test_log(spark):
    df = spark.createDataFrame([("silence_start: 1.5\nsilence_end: 2 | x\nsilence_start: 9", 12.0), ("silence_start: 3\nsilence_end: 2.5", 5.0), (None, 1.0)], "log string, d double")
    got = [r[0] for r in df.select(chunks.silence_log(F.col("log"), F.col("d"))).collect()]
    assert [[tuple(x) for x in g] if g is not None else g for g in got] == [[(1.5, 2.0), (9.0, 12.0)], [], None]


def test_clip_and_words(spark):
    seg = spark.createDataFrame([("j", 0, 1, -5, 4_000, 0, 3_000, "a"), ("j", 0, 2, 3_500, 4_000, 0, 3_000, "b")], "job_id string, chunk_index int, segment_id int, s bigint, e bigint, chunk_s bigint, chunk_e bigint, text string")
    assert [(r["segment_id"], r["clip_s"], r["clip_e"]) for r in chunks.clipped(seg).collect()] == [(1, 0, 3_000)]
    words = spark.createDataFrame([("j", 0, 100, 200), ("j", 0, 3_600, 4_000), ("j", 1, 100, 200)], "job_id string, chunk_index int, ws bigint, we bigint")
    got = {r[0]: r[1] for r in chunks.contained_words(seg.select("job_id", "chunk_index", "segment_id", F.greatest("s", F.lit(0)).alias("s"), "e"), words, keys=["job_id", "chunk_index"]).collect()}
    assert got == {1: 2, 2: 1}


def test_clipped_words(spark):
    words = "array(named_struct('text', 'a', 'start_sec', 9.0D, 'end_sec', 10.5D), named_struct('text', 'b', 'start_sec', 10.5D, 'end_sec', 13.0D), named_struct('text', 'c', 'start_sec', 12.5D, 'end_sec', 14.0D), named_struct('text', 'd', 'start_sec', CAST(NULL AS DOUBLE), 'end_sec', 11.0D))"
    got = spark.range(1).select(chunks.clipped_words(F.expr(words), F.lit(10_000), F.lit(0), F.lit(2_000)).alias("w")).first()["w"]
    assert [(w["text"], w["clip_s"], w["clip_e"]) for w in got] == [("a", 0, 500), ("b", 500, 2_000)]
