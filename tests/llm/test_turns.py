"""Labels, rosters and turns against one plain pass."""

import random

import numpy as np
from pyspark.sql import functions as F

from cadenza.llm import rosters, speech, turns

SCHEMA = "segment_id bigint, job_id string, chunk_index int, seg_index int, start_sec double, end_sec double, text string, speaker string"


def test_labels(spark):
    rows = [
        ("[00:00:01.5] Falante 1: bom dia", "#1", "bom dia"), ("<v Ana Silva>olá</v>", "ana silva", "olá"), (">> MODERADORA: sim", "moderadora", "sim"), ("(falante 02) sim", "#2", "sim"),
        ("[porta batendo] sim", None, "sim"), ("♪ música ♪ sim às 03:53", None, "sim às 03:53"), ("- Rep.: sim", "rep.", "sim"), ("00:01:01,219 --> 00:01:03,619 sim", None, "sim"), ("Olha, sim", None, "Olha, sim"), ("[138m48s] hum...", None, "hum..."),
    ]
    bare = speech.without_times(F.col("t"))
    got = spark.createDataFrame([(r[0],) for r in rows], "t string").select(speech.label_key(speech.label_of(bare)), speech.speech_of(bare)).collect()
    assert [tuple(r) for r in got] == [(k, s) for _, k, s in rows]
    keys = ["Falante nº 2", "SPK_02", "  Falante 2 ", "[Falante 2]", "F2", "Silva, Ana", "Ouvinte (telefone)", "", None]
    got = spark.createDataFrame([(k,) for k in keys], "t string").select(speech.label_key(F.col("t"))).collect()
    assert [r[0] for r in got] == ["#2"] * 5 + ["ana silva", "ouvinte", None, None]


def test_hesitations(spark):
    rows = [("hum, hmm", True), ("Éé...", True), ("", True), ("um rio", False), ("... —", True), ("Ähm...", True), ("hã o rio", False)]
    got = spark.createDataFrame(rows, "t string, e boolean").select(speech.only_hesitation(F.col("t")), "e").collect()
    assert all(r[0] == r[1] for r in got)
    texts = spark.createDataFrame([("A gravação eeh, do hum... rio",), ("um rio",)], "t string").select(speech.without_hesitations(F.col("t"))).collect()
    assert [r[0] for r in texts] == ["A gravação do rio", "um rio"]


def test_rosters():
    got = rosters.resolve({"ana silva": 9, "a. silva": 2, "ana": 1, "bruno reis": 4, "reis": 1, "moderadora": 3, "mod.": 1, "ana sylva": 1})
    assert got["a. silva"] == got["ana"] == got["ana sylva"] == "ana silva" and got["reis"] == "bruno reis" and got["mod."] == "moderadora"
    assert rosters.resolve({"j. costa": 1, "joana": 2}, ["joana costa", "joel costa"]) == {"j. costa": "joana costa", "joana": "joana costa"}
    assert rosters.resolve({"j. costa": 1, "joana": 2}) == {"j. costa": "j. costa", "joana": "joana"} and rosters.resolve({"j. costa": 1, "costa": 1}) == {"j. costa": "j. costa", "costa": "j. costa"}
    assert rosters.phonetic("bartholomaeusdottirson") != rosters.phonetic("bartholomaeusdottir")


def test_spellings_are_assigned_one_to_one():
    got = rosters.spellings({"marta lopes": 9, "marta lopez": 2, "marta loppes": 1, "bruno reis": 3, "ana reis": 3})
    assert got["marta lopez"] == got["marta loppes"] == got["marta lopes"] == "marta lopes" and got["bruno reis"] == "bruno reis" and got["ana reis"] == "ana reis"


def test_names_across_transcripts(spark):
    """Given name and initialled surname stand in one job, the full name only in others, misspelt in some, beside many people of the same surname."""
    given = "ana bruno carla diego elisa fabio gilda hugo irene jonas".split()
    family = "silva moreira teixeira cardoso fagundes".split()
    rows, n = [], 0
    for k, (g, f) in enumerate((g, f) for g in given for f in family):
        for j in range(3):
            rows.append((n := n + 1, f"other{k % 7}", 0, n, float(n), 1.0, "fala", f"{g.title()} {f.title()}" if j else f"{g.title()} {f.title().replace('ss', 's').replace('i', 'y', 1)}"))
    planted = [(g, f) for i, g in enumerate(given) for j, f in enumerate(family) if (i + j) % 3 == 0]
    for k, (g, f) in enumerate(planted):
        for who in (f"{g[0].upper()}. {f.title()}", g.title(), "Moderadora"):
            rows.append((n := n + 1, f"job{k}", 0, n, float(n), 1.0, "fala", who))
    table = {(r["job_id"], r["key"]): r["who"] for r in turns.name_table(turns.spoken(spark.createDataFrame(rows, SCHEMA))).collect()}
    hits = sum(table.get((f"job{k}", f"{g[0]}. {f}")) == table.get((f"job{k}", g)) == f"{g} {f}" for k, (g, f) in enumerate(planted))
    assert hits >= 0.9 * len(planted) and not any(k == "moderadora" for _, k in table)


def test_assignment_is_optimal():
    import itertools

    rng = np.random.default_rng(3)
    for _ in range(60):
        n, m = map(int, rng.integers(1, 5, 2))
        cost = rng.integers(0, 20, (n, m)).astype(float)
        got = rosters.assign(cost)
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n)) if n <= m else min(sum(cost[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
        assert sum(cost[i, j] for i, j in enumerate(got) if j >= 0) == best


def test_turns_against_one_pass(spark):
    rng = random.Random(8)
    rows = []
    for i in range(600):
        job = rng.choice(["hot", "hot", "b", "none"])
        who = None if job == "none" else rng.choice([None, None, "Falante 1", "F1", "Falante 2", "speaker_2"])
        text = rng.choice(["fala normal", "[música]", "hum...", None, "Falante 2: sim"]) if rng.random() < 0.3 and job != "none" else "fala normal"
        rows.append((i, job, rng.randrange(3), i, rng.choice([None] + [rng.randrange(0, 40_000) / 2] * 9), 1.0, text, who))
    rows += rows[:40]
    want, last = {}, {}
    key = {"Falante 1": 1, "F1": 1, "Falante 2": 2, "speaker_2": 2}
    for r in sorted(set(rows), key=lambda r: (r[1], r[4] or 0, r[2], r[3])):
        if r[4] is None or r[6] in (None, "[música]", "hum..."):
            continue
        who = key.get(r[7]) or (2 if r[6].startswith("Falante") else None) or last.get(r[1], (None,))[0]
        if r[1] not in last or last[r[1]][0] != who:
            want.setdefault(r[1], []).append([r[0], r[0]])
        want[r[1]][-1][1] = r[0]
        last[r[1]] = (who,)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["job_id"], r["first_segment_id"], r["last_segment_id"]) for r in turns.turn_bounds(df).collect()}
    assert got == {(j, *x) for j, t in want.items() for x in t}
    texts = turns.turn_texts(df).collect()
    assert sorted({(r["job_id"], r["turn_index"]) for r in texts}) == sorted((j, k) for j, t in want.items() for k in range(len(t)))
    starts = {(r["job_id"], r["turn_index"], r["part"]): r for r in texts}
    assert len(starts) == len(texts) and any(r["parts"] > 1 for r in texts)
    for r in texts:
        assert r["text"] and len(r["text"].split()) >= r["segments"] and (r["job_id"], r["turn_index"], r["parts"] - 1) in starts and (r["part"] == 0 or starts[r["job_id"], r["turn_index"], 0]["speaker"] == r["speaker"])
    assert sum(r["segments"] for r in texts) == len({r for r in rows if r[4] is not None and r[6] not in (None, "[música]", "hum...")})
