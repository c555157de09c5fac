"""Character models and language paths."""

import random

import numpy as np
import pyarrow as pa

from cadenza.llm import charlm, language

PT = "o barqueiro encontrou a previsão de chuva na estação e não avisou ninguém sobre as notas de rodapé durante a transmissão da manhã".split()
EN = "the boatman found the forecast of rain at the station and did not tell anyone about the footnotes during the morning broadcast".split()


def models():
    rng = random.Random(1)
    return charlm.train([(lang, [rng.choice(w) for _ in range(30)]) for lang, w in (("pt", PT), ("en", EN)) for _ in range(60)] + [("pt", EN), ("en", PT)])


def test_probabilities_add_up():
    m = charlm.CharModel({"ab": 3, "abc": 2, "b": 1}, alphabet=50)
    for ctx in ("", "a", "ab", "x"):
        total = 0.0
        for c in [" ", *map(chr, range(97, 146))]:  # 50 characters
            w = ctx + (c if c != " " else "")
            codes = charlm.encode([w])
            full = m.score(codes[:, : len(w) + (2 if c == " " else 1)])[0]
            head = m.score(charlm.encode([ctx])[:, : len(ctx) + 1])[0] if ctx else 0.0
            total += np.exp(full - head)
        assert abs(total - 1) < 0.02


def test_words_and_rejection():
    m = models()
    words = ["transmissão", "broadcast", "estação", "station"]
    assert [m.names[i] for i in m.scores(words).argmax(axis=1)] == ["pt", "en", "pt", "en"]
    odd = ["xqzwvkjx", "qqqq"]
    assert m.rejected(odd, m.scores(odd)).all()


def test_held_out_accuracy():
    m = models()
    rng = random.Random(2)
    hits = 0
    for k in range(200):
        lang, w = (("pt", PT), ("en", EN))[k % 2]
        text = [rng.choice(w) for _ in range(8)]
        hits += m.names[int(m.scores(text).sum(axis=0).argmax())] == lang
    assert hits >= 196


def test_paths_keep_loan_words_and_find_switches():
    m = models()
    scores = language.WordScores(m, language.CAP)
    texts = pa.array([PT[:6] + ["broadcast"] + PT[6:12], PT[:6] + EN[:6], [], None, EN[:3]], pa.list_(pa.string()))
    label, _, _, at = language.label_words(texts, scores, language.SWITCH)
    names = [[m.names[i] for i in label[a:b]] for a, b in zip(at, at[1:])]
    assert set(names[0]) == {"pt"} and names[1] == ["pt"] * 6 + ["en"] * 6 and names[2] == names[3] == [] and set(names[4]) == {"en"}


def test_path_against_brute_force():
    import itertools

    rng = np.random.default_rng(5)
    for _ in range(40):
        emit = -rng.random((5, 3)) * 4
        label = charlm.spans(emit, np.array([0, 5]), 1.5)
        cost = lambda p: sum(emit[i, k] for i, k in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))
        assert abs(cost(label) - max(cost(p) for p in itertools.product(range(3), repeat=5))) < 1e-9


def test_label_spellings(spark):
    from pyspark.sql import functions as F

    rows = [("pt_BR", "pt"), ("Português", "pt"), ("ENG", "en"), ("inglês", "en"), ("es-419", "es"), ("français", "fr"), ("Deutsch", "de"), ("und", None), ("", None), (None, None), ("n/a", None), ("xx", None)]
    got = spark.createDataFrame(rows, "t string, c string").select(language.normal_code(F.col("t")), "c").collect()
    assert all(r[0] == r[1] for r in got)


def test_whole_words_count():
    m = models()
    long = "gravação" * 30
    one, other = long + "previsão", long + "forecast"  # differ far behind any fixed width
    assert not np.allclose(m.scores([one])[0], m.scores([other])[0])
    alone = np.concatenate([m.scores([w]) for w in [one, "rio", "", "x" * 5_000]])
    assert np.allclose(m.scores([one, "rio", "", "x" * 5_000]), alone)


def test_confidence_is_calibrated():
    rng = np.random.default_rng(7)
    spans = []
    for gap in rng.uniform(0, 6, 20_000):
        best = int(rng.integers(2))
        emit = np.zeros((1, 2))
        emit[0, 1 - best] = -gap
        spans.append((best if rng.random() < 1 / (1 + np.exp(0.2 - 0.5 * gap)) else 1 - best, emit))
    slope, offset = charlm.calibrated(spans)
    assert abs(slope - 0.5) < 0.05 and abs(offset + 0.2) < 0.1
    assert charlm.calibrated([]) == (1.0, 0.0)
