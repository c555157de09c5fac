"""Periods and gaps against a plain sweep."""

import random

from cadenza.operators import intervals

SCHEMA = "who string, start double, end double, s string, e string, b int"


def sweep(rows, longest):
    by = {}
    for who, a, z, *_ in rows:
        if who is None or a is None or z is None or a != a or z != z or abs(a) == float("inf") or abs(z) == float("inf"):
            continue
        a, z = max(0, round(a * 1000)), max(0, round(z * 1000))
        if z > a:
            by.setdefault(who, []).append((a, z))
    out = set()
    for who, spans in by.items():
        merged = []
        for a, z in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], z)
            else:
                merged.append([a, z])
        out |= {(who, "period", a, z) for a, z in merged}
        out |= {(who, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:]) if y[0] - x[1] <= longest}
    return out


def found(spark, rows, bucket):
    df = spark.createDataFrame(rows, SCHEMA)
    x = intervals.interval_rows(df, [df["who"]], df["start"], df["end"])
    return [(r["e0"], r["piece"], r["start_ms"], r["end_ms"]) for r in intervals.periods_and_gaps(x, longest_gap_ms=4_000, bucket_ms=bucket).collect()]


def test_random_intervals_against_sweep(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(1500):
        a = rng.choice([rng.uniform(-3, 400), float(round(rng.uniform(0, 400))), None, float("nan")] if rng.random() < 0.05 else [rng.uniform(-3, 400)])
        z = None if a is None or rng.random() < 0.03 else a + rng.choice([0.0, -1.0, 0.5, 2.0, rng.expovariate(0.5), 60.0 if rng.random() < 0.02 else 1.0])
        rows.append((rng.choice(["hot", "hot", "hot", "x", "y", None]), a, z, "clash", "clash", 1))
    rows += rows[:50] + [("inf", 0.0, float("inf"), None, None, None)]
    for bucket in (700, 5_000, 10_000_000):
        got = found(spark, rows, bucket)
        assert len(got) == len(set(got))
        assert set(got) == sweep(rows, 4_000)


def test_touching_nested_and_long_across_buckets(spark):
    rows = [("a", 0.0, 10.0), ("a", 1.0, 2.0), ("a", 10.0, 11.0), ("a", 15.0, 16.0), ("a", 30.0, 31.0)]
    got = found(spark, [(*r, None, None, None) for r in rows], 1_000)
    assert set(got) == {("a", "period", 0, 11_000), ("a", "gap", 11_000, 15_000), ("a", "period", 15_000, 16_000), ("a", "period", 30_000, 31_000)}


def test_empty_table(spark):
    assert found(spark, [], 1_000) == []
