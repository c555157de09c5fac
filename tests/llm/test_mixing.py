"""Mixes: budget, shares, caps."""

import numpy as np

from cadenza.llm import mixing


def test_targets():
    got = mixing.effective_targets(np.array([1.0, 1.0, 2.0]), 100.0, np.array([10.0, 200.0, 300.0]))
    assert np.allclose(got, [10, 30, 60]) and np.allclose(mixing.effective_targets(np.array([1.0, 1.0]), 100.0, np.array([0.0, 30.0])), [0, 30])


def test_classifier():
    rows = [("gato gato rio", "txt", "pt", "a"), ("carro motor", "md", "pt", "b")] * 40
    names, w = mixing.fit_classifier(rows)
    assert names == ["a", "b"] and mixing.posteriors(w, "gato", "txt", "pt")[0] > 0.9 and mixing.posteriors(w, "motor", "md", "pt")[1] > 0.9


def test_shares_and_caps(spark):
    docs = [(i, f"texto número {i} " * (1 + i % 9), "pt", ["A", " a ", "b", "c", None][i % 5], "txt") for i in range(1_500)] + [(9_999, "solo raro", "pt", "rare", "md")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, file_format string")
    targets = spark.createDataFrame([(1, "a", 2.0, 3, 0.5), (1, "b", 1.0, 3, 0.5), (1, "ghost", 1.0, 2, 0.5), (2, "rare", 1.0, 2, 0.4), (2, "c", 1.0, 4, 0.4), (2, "b", 2.0, 4, 0.4)], "mix_id int, source string, target_share double, max_repeats int, budget_ratio double")
    mixed = mixing.mix(df, targets).toPandas()
    assert not mixed.duplicated(["mix_id", "doc_id"]).any()
    mixed["tokens"] = mixed.n_tokens * mixed.copies
    _, measured = mixing.measured(df)
    base = measured.where("domain IS NOT NULL").groupBy().sum("n_tokens").collect()[0][0]
    one, two = mixed[mixed.mix_id == 1], mixed[mixed.mix_id == 2]
    assert abs(one.tokens.sum() / (0.5 * base) - 1) < 0.01 and abs(two.tokens.sum() / (0.4 * base) - 1) < 0.01
    share = one.groupby("source").tokens.sum() / one.tokens.sum()
    assert abs(share["a"] - 2 / 3) < 0.01 and abs(share["b"] - 1 / 3) < 0.01
    assert one.copies.max() <= 3 and two[two.source == "rare"].copies.tolist() == [2]
    report = mixing.shares(mixing.mix(df, targets), targets).toPandas()
    assert len(report) == 6 and report[report.source == "ghost"].tokens.tolist() == [0]


def test_documents_without_source_serve_a_short_domain(spark):
    words = {"a": "gato rio mapa", "b": "carro motor roda", "c": "festa canto dança"}
    docs = [(i, words["a"], "pt", "a", "txt") for i in range(20)] + [(100 + i, words["b"], "pt", "b", "md") for i in range(400)] + [(600 + i, words["c"], "pt", "c", "csv") for i in range(60)]
    docs += [(1_000 + i, words["a"], "pt", None, "txt") for i in range(200)] + [(2_000 + i, words["c"], "pt", None, "csv") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, file_format string")
    # Mix 1: the documents without a source give all that is missing. Mix 2: they don't, and the rest goes to b. Mix 3: c is short only by what a can't give.
    wanted = [(1, "a", 1.0, 1, 0.5), (1, "b", 1.0, 1, 0.5), (2, "a", 9.0, 1, 0.8), (2, "b", 1.0, 2, 0.8), (3, "a", 8.0, 1, 0.6), (3, "c", 2.0, 1, 0.6)]
    targets = spark.createDataFrame(wanted, "mix_id int, source string, target_share double, max_repeats int, budget_ratio double")
    mixed = mixing.mix(df, targets).toPandas()
    mixed["tokens"] = mixed.n_tokens * mixed.copies
    _, measured = mixing.measured(df)
    n = {r["domain"]: r["s"] for r in measured.groupBy("domain").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "s").collect()}
    a, c = n["a"] // 20, n["c"] // 60
    base = n["a"] + n["b"] + n["c"]
    got = mixed.groupby(["mix_id", "source"]).tokens.sum()
    for k, ratio in (1, 0.5), (2, 0.8), (3, 0.6):
        assert abs(got[k].sum() - min(ratio * base, 220 * a + 100 * c if k == 3 else np.inf)) <= 2 * max(a, c)
    assert abs(got[1]["a"] - 0.25 * base) <= a and abs(got[2]["a"] - min(0.72 * base, 220 * a)) <= a
    assert abs(got[3]["c"] - min(0.6 * base - min(0.48 * base, 220 * a), 100 * c)) <= c and got[3]["c"] > n["c"]
    # Documents with and without a source serve their domain alike, and only together can they.
    one = set(mixed[(mixed.mix_id == 1) & (mixed.source == "a")].doc_id)
    assert one & set(range(20)) and len(one & set(range(1_000, 1_200))) > 20 and mixed[mixed.mix_id != 2].copies.max() == 1


def test_posteriors_count_in_part(spark):
    """Texts that are as likely of one source as of the other count half for each; own documents make up the rest."""
    docs = [(i, "gato rio", "pt", "a", "txt") for i in range(200)] + [(300 + i, "carro motor", "pt", "b", "txt") for i in range(200)]
    docs += [(600 + i, "gato carro", "pt", s, "txt") for i, s in enumerate(["a", "b"] * 50)] + [(1_000 + i, "gato carro", "pt", None, "txt") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, file_format string")
    targets = spark.createDataFrame([(1, "a", 1.0, 1, 0.8), (1, "b", 3.0, 1, 0.8)], "mix_id int, source string, target_share double, max_repeats int, budget_ratio double")
    mixed = mixing.mix(df, targets).toPandas()
    assert len(mixed[mixed.doc_id >= 1_000]) > 0  # documents without a source are taken in every mix they fit
    names, measured = mixing.measured(df)
    p = {r["doc_id"]: r["p"] for r in measured.where("domain IS NULL").collect()}
    assert 0.3 < p[1_000][0] < 0.7
    own = mixed[mixed.doc_id < 1_000].groupby("source").n_tokens.sum()
    soft = mixed[mixed.doc_id >= 1_000].n_tokens.sum()
    b = own["b"] + soft * p[1_000][names.index("b")]
    assert abs(b / mixed.n_tokens.sum() - 0.75) < 0.01


def test_tokens_are_counted_without_running_the_folder(tmp_path):
    import shutil

    shutil.copy(f"{mixing.TOKENIZERS}/{mixing.VOCABULARY}", tmp_path)
    (tmp_path / "__init__.py").write_text("PATTERN = r'x+'\nraise SystemExit\n")
    assert mixing.vocabulary(str(tmp_path))[0] == "x+"
