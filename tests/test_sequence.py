"""Numbers and neighbours across buckets against one plain pass."""

import random

from pyspark.sql import functions as F

from cadenza.operators import sequence


def test_against_one_pass(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), p, rng.randrange(50), p // 7) for p in range(200)]
    df = spark.createDataFrame(rows, "k string, p int, v int, b int")
    out = sequence.numbered(df, ["k"], "b", ["p"])
    out = sequence.with_previous(out, ["k"], "b", ["p"], F.col("v"), name="before")
    out = sequence.running_max(out, ["k"], "b", ["p"], F.col("v"), name="top", include=False)
    got = {(r["k"], r["p"]): (r["number"], r["before"], r["top"]) for r in out.collect()}
    for k in "ab":
        n, before, top = 0, None, None
        for _, p, v, _ in [r for r in rows if r[0] == k]:
            n += 1
            assert got[(k, p)] == (n, before, top)
            before, top = v, v if top is None else max(top, v)


def test_text_before(spark):
    rows = [("k", i, i // 3, None if i == 4 else "t%02d" % i) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, i int, b int, t string")
    got = {r["i"]: r["context"] for r in sequence.text_before(df, ["k"], "b", ["i"], "t", most=11).collect()}
    for i in range(30):
        want = " ".join(t for _, j, _, t in rows if j < i and t)[-11:]
        assert got[i] == (want or None)


def test_text_before_looks_back_over_any_number_of_buckets(spark):
    rows = [("k", i, i // 3, "first%02d" % i if i < 3 else "x" if i % 60 == 0 else "  ") for i in range(180)]
    df = spark.createDataFrame(rows, "k string, i int, b int, t string")
    got = {r["i"]: r["context"] for r in sequence.text_before(df, ["k"], "b", ["i"], "t", most=18).collect()}
    for i in range(180):
        want = " ".join(t for _, j, _, t in rows if j < i and t.strip())[-18:]
        assert got[i] == (want or None)
