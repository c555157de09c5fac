"""Leaks against brute force."""

import random

import numpy as np

from cadenza.llm import leakage


def test_words():
    text = "1\n00:00:01,000 --> 00:00:02,000\nFalante 1: A cole&ccedil;&atilde;o\n\nAna Silva: É LÁ, d'água!"
    assert leakage.words(text) == ["a", "colecao", "e", "la", "d", "agua"]
    assert leakage.words(None) == [] and leakage.words("") == []


def test_alignment():
    a = np.array([1, 2, 3, 4, 5])
    assert leakage.align(a, a) == 10 and leakage.align(np.array([9, 1, 2, 8, 4, 5]), a) == 7 and leakage.align(np.array([7]), a) == 0


def test_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"p{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(10, 40)))) for k in range(30)]
    items += [(90, items[0][1]), (91, None), (92, "curto demais")]
    docs = []
    for i in range(200):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            t = rng.choice(items[:31])[1].split()
            n = rng.randrange(5, 25)
            a = rng.randrange(max(1, len(t) - n + 1))
            w[len(w) // 2 : len(w) // 2] = t[a : a + n]
        docs.append((i, " ".join(w).upper() + "."))
    docs += [(500, None), (501, "")] + [(600 + k, items[3][1]) for k in range(50)]
    got = leakage.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    found = {(r["doc_id"], r["item_id"]) for r in got.where(f"run >= {leakage.LEAST}").collect()}
    want = set()
    for i, d in docs:
        w = leakage.words(d)
        for k, t in items:
            x = leakage.words(t)
            grams = {tuple(x[p : p + 13]) for p in range(len(x) - 12)}
            if any(tuple(w[p : p + 13]) in grams for p in range(len(w) - 12)):
                want.add((i, k))
    assert found == want and len(want) > 50


def test_a_small_bit_map_gives_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(k, " ".join(f"w{k}_{i}" for i in range(20))) for k in range(5)] + [(9, "w0_1 w0_2")], "item_id bigint, text string")
    docs = spark.createDataFrame([(k, " ".join(f"w{k}_{i}" for i in range(2, 18))) for k in range(5)], "doc_id bigint, text string")
    whole = sorted(map(tuple, leakage.find_leaks(docs, items).collect()))
    monkeypatch.setattr(leakage, "BITS", 64)  # every bit is set: all seeds pass and the join drops them
    assert sorted(map(tuple, leakage.find_leaks(docs, items).collect())) == whole and len(whole) == 5


def test_a_passage_in_a_third_of_all_documents(spark):
    text = " ".join(f"q{i}" for i in range(40))
    docs = [(i, f"a{i} b{i} {text if i % 3 == 0 else 'nada'} c{i}") for i in range(900)]
    got = leakage.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, text)], "item_id bigint, text string")).collect()
    assert {r["doc_id"] for r in got} == set(range(0, 900, 3)) and all(r["run"] == 40 and r["score"] == 1.0 for r in got)


def test_edited_copies_are_found(spark):
    """Of copies with every tenth word changed, left out or put in, nearly all are found, and they score far above chance."""
    rng = random.Random(3)
    vocabulary = [f"p{i}" for i in range(400)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(60))) for k in range(120)]
    docs = []
    for k, t in items:
        w = []
        for x in t.split():
            u = rng.random()
            w += [rng.choice(vocabulary)] if u < 0.05 else [] if u < 0.075 else [x, rng.choice(vocabulary)] if u < 0.1 else [x]
        docs.append((k, " ".join([*rng.choices(vocabulary, k=50), *w, *rng.choices(vocabulary, k=50)])))
    docs += [(1_000 + i, " ".join(rng.choices(vocabulary, k=150))) for i in range(200)]
    got = leakage.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    good = {r["doc_id"] for r in got if r["doc_id"] == r["item_id"] and r["score"] > 0.5}
    assert len(good) >= 0.97 * len(items) and not [r for r in got if r["doc_id"] != r["item_id"] and r["score"] > 0.5]
