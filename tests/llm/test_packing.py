"""Containers: capacity, fill, whole items, order independence."""

import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.llm import packing


def best_fit_decreasing(sizes, capacity):
    room = []
    for x in sorted(sizes, reverse=True):
        fit = [i for i, r in enumerate(room) if r >= x]
        if fit:
            room[min(fit, key=lambda i: room[i])] -= x
        else:
            room.append(capacity - x)
    return len(room)


def checked(sizes, capacity):
    """Number of containers, after checking that every item has its place and no container is over the capacity."""
    fillings = packing.fill(dict(Counter(sizes)), capacity)
    got = Counter()
    for f in fillings:
        assert f.n > 0 and f.room >= 0 and sum(s * m for s, m in f.sizes.items()) == capacity - f.room
        for s, m in f.sizes.items():
            got[s] += m * f.n
    assert got == Counter(sizes)
    where, containers = packing.places(fillings, capacity)
    load = Counter()
    for s, n in Counter(sizes).items():
        for rank in range(n):
            first, each, container, _ = [p for p in where[s] if p[0] <= rank][-1]
            load[container + (rank - first) // each] += s
    assert max(load) < containers and max(load.values()) <= capacity
    return containers


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 100), min_size=1, max_size=60))
def test_capacity_holds(sizes):
    checked(sizes, 100)


def test_fill_is_close_to_the_bound():
    rng = random.Random(2)
    ours = theirs = bound = 0
    for _ in range(150):
        sizes = [min(2000, max(1, int(rng.lognormvariate(6.2, 0.8)))) for _ in range(rng.choice([3, 8, 20, 60, 300]))]
        ours += checked(sizes, 2000)
        theirs += best_fit_decreasing(sizes, 2000)
        bound += -(-sum(sizes) // 2000)
    assert ours <= theirs * 1.005 and ours <= bound * 1.02


def test_many_items_are_packed_as_one_group():
    sizes = [min(2000, max(1, int(random.Random(i).lognormvariate(6.2, 0.8)))) for i in range(60_000)]
    fillings = packing.fill(dict(Counter(sizes)), 2000)
    assert sum(f.n for f in fillings) <= sum(sizes) / 2000 * 1.01 and len(fillings) < 5_000


def test_perfect_triples():
    rng = random.Random(4)
    sizes = []
    for _ in range(12):
        a = rng.randrange(300, 500)
        b = rng.randrange(250, 450)
        sizes += [a, b, 1000 - a - b]
    assert checked(sizes, 1000) <= 13


def test_table(spark):
    rng = random.Random(7)
    rows = [(f"g{rng.choice([0, 0, 0, 1, 2])}", i, rng.choice([5, 400, 900, 2_500]), rng.choice([1_000, 1_000, 600]), "clash") for i in range(400)]
    rows += [("n", 1, None, 1_000, ""), ("n", 2, 5, None, ""), ("z", 1, 0, 1_000, ""), (None, 1, 7, 1_000, ""), (None, 2, 7, 1_000, "")]
    df = spark.createDataFrame(rows, "grp string, item int, size int, cap int, fill string")
    out = packing.pack(df, group="grp", item="item", size="size", capacity="cap").collect()
    again = packing.pack(df.repartition(7), group="grp", item="item", size="size", capacity="cap").collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert {(r["grp"], r["item"]) for r in out if r["container"] is None} == {("n", 1), ("n", 2)}
    load, parts, caps = {}, {}, {}
    for r in [r for r in out if r["container"] is not None]:
        load[r["grp"], r["container"]] = load.get((r["grp"], r["container"]), 0) + r["chars"]
        caps.setdefault((r["grp"], r["container"]), set()).add(r["capacity"])
        parts.setdefault((r["grp"], r["item"]), []).append(r)
    assert all(len(c) == 1 and load[k] <= min(c) for k, c in caps.items())
    assert all(r["container_chars"] == load[r["grp"], r["container"]] for r in out if r["container"] is not None)
    for g in {k[0] for k in load}:
        assert {k[1] for k in load if k[0] == g} == set(range(sum(k[0] == g for k in load)))  # no gaps
    sizes = {(g, i): (n, c) for g, i, n, c, _ in rows if n is not None and c}
    assert set(parts) == set(sizes)
    for k, p in parts.items():
        assert sum(r["chars"] for r in p) == sizes[k][0] and (len(p) == 1 or sizes[k][0] > sizes[k][1])
