"""Timestamps, cues, folding, names, languages, packing."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadenza.functions import folds, languages
from cadenza.functions import text as T
from cadenza.operators import assembly, captions, paragraphs, render, search
from cadenza.sources import subtitles
from cadenza.streaming import progress

VTT = "WEBVTT\n\n00:00.500 --> 00:01.750 align:start\n<v.loud Ana>Ol&aacute; &amp; <i>bem-vindos</i></v>\n\nNOTE x\n\n00:75:00.000 --> 00:76:00.000\nno\n\n00:03.000 --> 00:02.000\nno\n\n2\n00:00:02,000 --> 00:00:04,000\nfim\nagora\n"


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).collect()[0][0]


def test_timestamps(spark):
    shown = lambda v, **k: one(spark, lambda c: T.timestamp(c, **k), v, "double")
    assert shown(59.9996, separator=",") == "00:01:00,000"
    assert shown(360_000.0) == "100:00:00.000"
    assert shown(3_661.0, millis=False) == "01:01:01"
    assert shown(-1.0) is None and shown(None) is None and shown(float("nan")) is None
    parsed = lambda v: one(spark, T.parse_timestamp, v)
    assert parsed("01:02:03,5") == 3723.5 and parsed("02:03.250") == 123.25
    assert parsed("00:75:00") is None and parsed("x") is None and parsed(None) is None


def test_cues(spark):
    files = spark.createDataFrame([("a", VTT), ("b", None), ("c", ""), ("d", "﻿1\r\n00:00:01,000 --> 00:00:02,000\r\nolá\r\n")], "path string, content string")
    got = sorted((r["path"], r["start_ms"], r["end_ms"], r["speaker"], r["text"]) for r in subtitles.cues(files).collect())
    assert got == [("a", 500, 1750, "Ana", "Olá & bem-vindos"), ("a", 2000, 4000, None, "fim agora"), ("d", 1000, 2000, None, "olá")]
    assert one(spark, lambda c: subtitles.format_of(c, F.lit("WEBVTT\n")), "") == "vtt"
    assert one(spark, lambda c: subtitles.format_of(c, F.lit("1\n")), None) == "srt"
    assert one(spark, lambda c: subtitles.format_of(c, F.lit("1\n")), "ass") is None
    assert one(spark, T.cue_text, "caf&eacute; &#233; &hellip; <i>x</i> &amp;lt;") == "café é … x &lt;" and one(spark, T.cue_text, None) is None
    assert one(spark, T.cue_speaker, "<v Andr&eacute;>oi") == "André"


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.SRT").write_text("﻿1\n00:00:01,000 --> 00:00:02,500\nAna: olá\n", "utf-8")
    (tmp_path / "in" / "y.txt").write_text("no")
    cues = subtitles.cues(subtitles.read_files(spark, str(tmp_path / "in")))
    rows = cues.select(F.lit("j").alias("job_id"), F.lit(0).alias("h"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), "speaker", "text")
    subtitles.write_lines(render.srt(rows, ["job_id"], "h", ["s"]), str(tmp_path / "out"), key="job_id", order=["cue"], line="text")
    assert spark.read.text(str(tmp_path / "out" / "job_id=j")).collect()[0][0] == "1"
    again = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "out" / "job_id=j")).collect())
    assert again == "1\n00:00:01,000 --> 00:00:02,500\nAna: olá"


def test_folding_and_names(spark):
    assert one(spark, T.fold, "Straße AÇÃO ﬁm") == "strasse acao fim" and one(spark, T.fold, None) is None
    assert one(spark, lambda c: T.slug(T.fold(c)), "Ação: São_Paulo!") == "acao-sao-paulo" and one(spark, T.slug, "!!") == "inicio"
    assert one(spark, T.safe_stem, ' .a/b:c?. ') == "a-b-c" and one(spark, T.safe_stem, "...") == "transcricao"
    assert one(spark, T.stem_of, "x/aula.1.mp3") == "aula.1" and one(spark, T.stem_of, ".rc") == ".rc"
    assert one(spark, T.plain_markdown, "# A [b](http://c) *d*") == "A b d"


def test_languages(spark):
    rank = lambda tag, asked: one(spark, lambda c: languages.rank(c, F.lit(asked)), tag)
    assert [rank("pt_br", "pt-BR"), rank("por", "pt-BR"), rank(None, "pt"), rank("und", "pt"), rank("en", "pt")] == [0, 1, 3, 3, 4]
    assert rank("en", None) == 1 and rank(None, None) == 0
    assert one(spark, lambda c: languages.compatible(c, F.lit("en")), "unknown") is True


def test_search(spark):
    df = spark.createDataFrame([(i, "Como mídias LONGAS são processadas" if i % 2 else None) for i in range(60)], "id int, t string")
    assert [r["id"] for r in search.search(df, "MIDIAS longas", text=F.col("t"), order="id").collect()] == list(range(1, 49, 2))
    assert search.search(df, " ", text=F.col("t"), order="id").count() == 60
    doc = spark.createDataFrame([("d", "# T\nintro\n## Um\ncorpo\n## Dois\n")], "k string, m string")
    assert [(r["title"], r["body"]) for r in search.sections(doc, key="k", markdown="m").collect()] == [("Um", "## Um\ncorpo"), ("Dois", "## Dois")]


def brute_split(text, limit):
    import re

    def pack(units, cut):
        out, open_ = [], []
        for u in units:
            if len(u) > limit:
                if open_:
                    out.append(" ".join(open_))
                    open_ = []
                out += cut(u)
            elif open_ and len(" ".join([*open_, u])) > limit:
                out.append(" ".join(open_))
                open_ = [u]
            else:
                open_.append(u)
        return out + ([" ".join(open_)] if open_ else [])

    words = lambda t: pack(t.split(), lambda w: [w[i : i + limit] for i in range(0, len(w), limit)])
    if len(text) <= limit:
        return [text]
    s = [x.strip() for x in re.split(r"(?<=[.!?…])\s+", text) if x.strip()]
    return words(text) if len(s) <= 1 else pack(s, words)


def test_blocks_against_brute_force(spark):
    import hashlib
    import random
    import re

    rng = random.Random(4)
    texts = ["", "x" * 1_700, None, "\r\n\r\n", "a. " * 900]
    for _ in range(30):
        texts.append("\n\n".join(" ".join("w" * rng.choice([1, 5, 9, 700]) + rng.choice(["", "", ".", "!"]) for _ in range(rng.randrange(1, 90))) for _ in range(rng.randrange(1, 6))))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: list(r["b"] or []) for r in df.select("i", paragraphs.blocks(F.col("t"), 600).alias("b")).collect()}
    for i, t in enumerate(texts):
        units = [u for p in re.split(r"\n{2,}", (t or "").replace("\r\n", "\n").strip()) if p.strip() for u in brute_split(p.strip(), 600)]
        want = []
        for u in units:
            if want and len(want[-1]) + 2 + len(u) <= 600:
                want[-1] += "\n\n" + u
            else:
                want.append(u)
        assert got[i] == want and all(len(b) <= 600 for b in want)
    digest = one(spark, lambda c: paragraphs.block_id(F.lit(3), c), "é")
    assert digest == hashlib.sha256("1\x003\x00é".encode()).hexdigest()[:20]


def test_pack_and_overlap(spark):
    df = spark.createDataFrame([(["aa", "b", "cccc"],), ([],)], "u array<string>")
    assert [r[0] for r in df.select(folds.pack(F.col("u"), 4, " ")).collect()] == [["aa b", "cccc"], []]
    two = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d"]), (["a"], []), (["x"], ["y"])], "l array<string>, r array<string>")
    assert [r[0] for r in two.select(folds.overlap(F.col("l"), F.col("r"))).collect()] == [2, 0, 0]


def test_repeated_starts():
    assert assembly.unrepeated("Terminamos em SÃO TOMÉ", "são tomé e seguimos adiante") == ("e seguimos adiante", 2, 5)
    assert assembly.unrepeated("a b", "b c") == ("b c", 0, 2) and assembly.unrepeated("a b", "b") == ("", 1, 1) and assembly.unrepeated("", " x ") == ("x", 0, 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=9), st.lists(st.sampled_from("ab"), max_size=9))
def test_border_against_brute_force(left, right):
    assert assembly.border(left, right) == max((n for n in range(min(len(left), len(right)) + 1) if n == 0 or left[-n:] == right[:n]), default=0)


ASSEMBLY = "job_id string, chunk_index int, seg_index int, segment_id bigint, s bigint, e bigint, text string, speaker string, word_ends array<bigint>, chunk_s bigint, overlap_ms bigint"


def test_assembly(spark):
    rows = [
        ("j", 0, 0, 1, 50_000, 60_000, "fim em comum", None, None, 0, 0),
        ("j", 1, 0, 2, 58_000, 62_000, "fim em comum e continua", None, None, 58_000, 2_000),
        ("j", 1, 1, 3, 62_000, 70_000, "novo trecho", None, None, 58_000, 2_000),
        # A short chunk, and one without text in between: the context reaches back over both.
        ("j", 2, 0, 4, 70_000, 71_000, "sim", None, None, 70_000, 0),
        ("j", 4, 0, 5, 80_000, 84_000, "novo trecho sim e mais", None, [80_500, 81_000, 82_000, 83_000, 84_000], 80_000, 2_000),
        ("j", 4, 1, 6, 81_000, 82_000, "e mais", None, None, 80_000, 2_000),
    ]
    got = assembly.assemble(spark.createDataFrame(rows, ASSEMBLY)).orderBy("segment_id").collect()
    assert [(r["segment_id"], r["text"], r["removed"]) for r in got] == [(1, "fim em comum", 0), (2, "e continua", 3), (3, "novo trecho", 0), (4, "sim", 0), (5, "e mais", 3)]
    assert got[1]["start_ms"] == 58_000 + 4_000 * 3 / 5 and got[4]["start_ms"] == 82_000


def test_assembly_against_one_pass(spark):
    import random

    rng = random.Random(12)
    rows, n = [], 0
    for job in ("a", "b"):
        for c in range(60):
            words = [rng.choice(["rio", "mapa", "ponte", "casa", "chuva"]) for _ in range(rng.choice([2, 5, 30, 500]))]
            for k in range(3):
                part = words[k * len(words) // 3 : (k + 1) * len(words) // 3] or ["ah"]
                rows.append((job, c, k, n := n + 1, c * 1_000 + k * 900, c * 1_000 + k * 900 + 800, " ".join(part), None, None, c * 1_000, rng.choice([0, 100])))
    rows = [r[:-1] + (rows[[q[:2] for q in rows].index(r[:2])][-1],) for r in rows]
    want = []
    for job in ("a", "b"):
        said = ""
        for r in sorted(r for r in rows if r[0] == job):
            text, removed = r[6], 0
            if r[10] > 0 and r[4] <= r[9] + r[10] + 1_000 and said:
                text, removed, _ = assembly.unrepeated(said[-2_000:], r[6])
            if text:
                want.append((r[3], text, removed))
                said = f"{said} {text}".strip()
    got = assembly.assemble(spark.createDataFrame(rows, ASSEMBLY)).collect()
    assert sorted((r["segment_id"], r["text"], r["removed"]) for r in got) == sorted(want)


def test_rolling_captions(spark):
    texts = ["hoje vamos", "hoje vamos falar de", "falar de mídias", "mídias longas"]
    rows = [("f", i, 0, i * 1000, i * 1000 + 1000, None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "job_id string, i int, h int, start_ms bigint, end_ms bigint, speaker string, text string")
    fresh = captions.without_rolling(df, ["job_id"], "h", ["i"]).where("fresh_text IS NOT NULL").drop("text").withColumnRenamed("fresh_text", "text")
    got = captions.merged(fresh, ["job_id"], "h", ["i"]).collect()
    assert [(r["start_ms"], r["end_ms"], r["text"], r["cues"]) for r in got] == [(0, 4000, "hoje vamos falar de mídias longas", 4)]


def test_merged_against_brute_force(spark):
    import random

    rng = random.Random(9)
    rows, t = [], 0
    for i in range(300):
        t += rng.choice([0, 500, 900, 2_000, 8_000])
        rows.append(("j", i, t // 3_000, t, t + rng.choice([300, 1_500, 4_000]), rng.choice(["A", "A", None]), "x" * rng.randrange(1, 90)))
    want = []
    for _, _, _, s, e, who, text in rows:
        if want and want[-1][2] == who and s <= want[-1][1] + 1_250 and len(want[-1][3]) + 1 + len(text) <= 180:
            want[-1] = (want[-1][0], max(want[-1][1], e), who, f"{want[-1][3]} {text}")
        else:
            want.append((s, e, who, text))
    df = spark.createDataFrame(rows, "job_id string, i int, h int, start_ms bigint, end_ms bigint, speaker string, text string")
    got = sorted(((r["start_ms"], r["end_ms"], r["speaker"], r["text"]) for r in captions.merged(df, ["job_id"], "h", ["i"]).collect()), key=str)
    assert got == sorted(want, key=str)


def test_runs_and_paragraphs(spark):
    rows = [("j", 0, 0, 0, 1_000, "Ana", "Bom dia."), ("j", 1, 0, 1_100, 2_000, "Ana", "Vamos começar."), ("j", 2, 1, 2_100, 3_000, "Bruno", "Perfeito."), ("j", 3, 1, 5_000, 6_000, "Bruno", "Fim.")]
    df = spark.createDataFrame(rows, "job_id string, i int, h int, s bigint, e bigint, speaker string, text string")
    runs = sorted((r["run"]["i"], r["speaker"], r["text"]) for r in paragraphs.speaker_runs(df, ["job_id"], "h", ["i"]).collect())
    assert runs == [(0, "Ana", "Ana: Bom dia. Vamos começar."), (2, "Bruno", "Bruno: Perfeito. Fim.")]
    parts = sorted((r["head"], r["part"], r["speaker"], r["text"]) for r in paragraphs.natural_paragraphs(df, ["job_id"], "h", ["i"]).collect())
    assert parts == [(1, 0, "Ana", "Bom dia. Vamos começar."), (2, 0, "Bruno", "Perfeito. Fim.")]  # a short tail goes back


def test_a_run_over_several_hours_has_parts(spark):
    df = spark.createDataFrame([("j", i, i // 2, "Ana", f"t{i}") for i in range(5)], "job_id string, i int, h int, speaker string, text string")
    got = paragraphs.speaker_runs(df, ["job_id"], "h", ["i"]).orderBy("part").collect()
    assert [(r["part"], r["segments"], r["text"]) for r in got] == [(0, 2, "Ana: t0 t1"), (1, 2, "t2 t3"), (2, 1, "t4")]


def test_paragraph_lengths(spark):
    """A stretch with soft, hard and short lengths just at and beyond their bounds, and short stretches in a chain."""
    sentence = lambda n: "x" * (n - 1) + "."
    texts = [" ".join(map(sentence, (899, 701, 300))), sentence(299), sentence(300), sentence(290), sentence(290), *[sentence(200)] * 9]
    rows = [("j", i, i // 3, i * 10_000, i * 10_000 + 1, None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "job_id string, i int, h int, s bigint, e bigint, speaker string, text string")
    got = [len(r["text"]) for r in paragraphs.natural_paragraphs(df, ["job_id"], "h", ["i"]).orderBy("head", "part").collect()]
    # 899 + 701 + 1 = 1 601: the soft length is not reached; then 300 more are too many. The short ones go back while 1 900 allow.
    assert got == [1_601, 300 + 1 + 299, 300 + 2 * 291 + 5 * 201, 4 * 201 - 1]


def test_render(spark):
    rows = [("j", 0, 500, 1_750, "Ana", "Olá"), ("j", 1, 2_000, 2_000, None, "fica só no texto"), ("j", 1, 2_000, 4_000, None, "fim")]
    df = spark.createDataFrame(rows, "job_id string, h int, s bigint, e bigint, speaker string, text string")
    assert [r["text"] for r in render.srt(df, ["job_id"], "h", ["s", "e"]).orderBy("cue").collect()] == ["1\n00:00:00,500 --> 00:00:01,750\nAna: Olá", "2\n00:00:02,000 --> 00:00:04,000\nfim"]
    assert [r["text"] for r in render.vtt(df, ["job_id"], "h", ["s", "e"]).orderBy("cue").collect()][:2] == ["WEBVTT", "00:00:00.500 --> 00:00:01.750\n<v Ana>Olá</v>"]
    assert [r["text"] for r in render.timed_txt(df, ["job_id"], "h", ["s", "e"]).orderBy("line").collect()] == ["[00:00:00] Ana: Olá", "[00:00:02] fica só no texto", "[00:00:02] fim"]
    assert [r["text"] for r in render.markdown(df, ["job_id"], "h", ["s", "e"]).orderBy("line").collect()][0] == "- `00:00:00` **Ana:** Olá"


def test_latest_batch_and_stream(spark, tmp_path):
    rows = [("a", 1, "x"), ("a", 3, "z"), ("b", 2, "y"), ("a", 3, "z")]
    df = spark.createDataFrame(rows, "k string, n int, v string")
    assert sorted(tuple(r) for r in progress.latest(df, "k", ["n"], ["n", "v"]).collect()) == [("a", 3, "z"), ("b", 2, "y")]
    df.write.parquet(str(tmp_path / "in"))
    seen = {}
    stream = progress.latest_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", ["n"], ["n", "v"])
    progress.upsert(stream, lambda batch, _: seen.update({r["k"]: r["v"] for r in batch.collect()}), str(tmp_path / "cp")).awaitTermination()
    assert seen == {"a": "z", "b": "y"}


def test_markdown_blocks(spark):
    df = spark.createDataFrame([("d", "# T\n\n> [!WARNING] cuidado\n> com [a](http://b)\n\n \n\ntexto"), ("e", None)], "k string, m string")
    got = [(r["block"], r["heading"], r["warning"], r["note"], r["link"]) for r in search.markdown_blocks(df, key="k", markdown="m").orderBy("position").collect()]
    assert got == [("# T", True, False, False, ""), ("cuidado\ncom [a](http://b)", False, True, False, "http://b"), ("texto", False, False, False, "")]


def test_results_of_blocks_are_joined_in_order(spark):
    blocks = [("a", i, f"a{i}") for i in (1, 0, 2, 1)] + [("gap", 0, "g0"), ("gap", 2, "g2"), ("twice", 0, "t"), ("twice", 1, "t"), ("open", 0, "o0"), ("open", 1, "o1"), ("stray", 0, "s0"), ("same", 0, "x"), ("same", 0, "y")]
    answers = [("a", "a0", " eins\r\nzwei \n", 5, 1), ("a", "a0", "later", 6, 2), ("a", "a1", "\t\n", 1, 3), ("a", "a1", "drei", 2, 4), ("a", "a2", "undated", None, 5), ("a", "a2", "vier", 9, 6)]
    answers += [("gap", "g0", "x", 1, 7), ("gap", "g2", "x", 1, 8), ("twice", "t", "x", 1, 9), ("open", "o0", "x", 1, 10), ("open", "o1", None, 1, 11), ("stray", "s0", "x", 1, 12), ("stray", "s9", "x", 1, 13), ("same", "x", "x", 1, 14), ("same", "y", "x", 1, 15), ("none", "n0", "x", 1, 16)]
    got = paragraphs.assemble_results(spark.createDataFrame(blocks, "job_id string, block_index int, block_id string"), spark.createDataFrame(answers, "job_id string, block_id string, text string, received_at int, response_id bigint"))
    assert {r["job_id"]: tuple(r)[1:] for r in got.collect()} == {
        "a": (3, 0, 0, "assembled", "eins\nzwei\n\ndrei\n\nvier"), "gap": (2, 0, 0, "order", None), "twice": (2, 0, 0, "incomplete", None), "open": (2, 1, 0, "incomplete", None),
        "stray": (1, 0, 1, "incomplete", None), "same": (2, 0, 0, "order", None), "none": (0, 0, 1, "incomplete", None),
    }


def test_cues_are_merged_only_in_rolling_files(spark):
    texts = {"r": ["hoje vamos", "vamos falar", "de rios"], "p": ["um", "dois"]}
    rows = [(f, i, 0, i * 1000, i * 1000 + 1000, None, t) for f, x in texts.items() for i, t in enumerate(x)]
    df = spark.createDataFrame(rows, "job_id string, i int, h int, start_ms bigint, end_ms bigint, speaker string, text string")
    got = sorted((r["job_id"], r["start_ms"], r["end_ms"], r["text"], r["cues"]) for r in captions.normalized(df, ["job_id"], "h", ["i"]).collect())
    assert got == [("p", 0, 1000, "um", 1), ("p", 1000, 2000, "dois", 1), ("r", 0, 3000, "hoje vamos falar de rios", 3)]


def test_free_names(spark):
    rows = [(1, "a"), (2, "a"), (3, "a (2)"), (4, "a"), (5, "b"), (6, "c"), (7, None), (8, "a (2)")]
    df = spark.createDataFrame(rows, "id int, stem string")
    names = lambda *e: {r["id"]: r["name"] for r in render.free_names(df, stem="stem", order="id", existing=spark.createDataFrame([(x,) for x in e], "name string")).collect()}
    assert names() == {1: "a", 2: "a (3)", 3: "a (2)", 4: "a (4)", 5: "b", 6: "c", 7: None, 8: "a (2) (2)"}
    assert names("a", "a (3)", "c", "c (2)", "c (4)") == {1: "a (4)", 2: "a (5)", 3: "a (2)", 4: "a (6)", 5: "b", 6: "c (3)", 7: None, 8: "a (2) (2)"}


def test_first_language(spark):
    df = spark.createDataFrame([("a", 2, "en"), ("a", 0, None), ("a", 1, ""), ("a", 3, "pt"), ("b", 0, None)], "job_id string, chunk_index int, language string")
    assert {r["job_id"]: r["language"] for r in assembly.first_language(df).collect()} == {"a": "en", "b": None}
