"""Each kind of defect, and what is none."""

from cadenza.llm import pairs

RAW = "o barqueiro explicou a previsão de chuva na sala ao lado hum o coro da paróquia guardou o mapa da travessia no fim da estação"
GOOD = "O barqueiro explicou a previsão de chuva na sala ao lado. O coro da paróquia guardou o mapa da travessia no fim da estação."


def test_empty():
    blank = (None, "", " \n", "\u200b", "N/A", "[vazio]", '""', "...", "—", "<bloco></bloco>", "null", "[nenhum texto a devolver]", "zzz")
    assert all(pairs._is_empty(t, RAW) for t in blank)
    assert not pairs._is_empty("sim", "sim") and not pairs._is_empty("barqueiro", RAW) and not pairs._is_empty("[o barqueiro]", RAW) and not pairs._is_empty("não posso ajudar com isso", RAW)


def test_tail():
    words = pairs._content
    assert pairs.missing_tail(words(RAW), words(GOOD)) == 0
    assert pairs.missing_tail(words(RAW), words("O barqueiro explicou a previsão de chuva na sala ao lado…")) > 0.3
    assert pairs.missing_tail(words(RAW), words("O barqueiro explicou a previsão de chuva, foi na sala ao lado. O coro da paróquia guardou o mapa da travessia no fim da esta")) < 0.1
    assert pairs.missing_tail([], ["a"]) == 0 and pairs.missing_tail(["a"], []) == 1


def test_copy():
    assert pairs.is_copy(RAW, RAW.upper()) and pairs.is_copy(RAW, "  " + RAW.replace(" ", "\n")) and pairs.is_copy(RAW, f"Segue o bloco: {RAW}") and pairs.is_copy(RAW, f"<bloco id='1'>{RAW}</bloco>")
    assert not pairs.is_copy(RAW, GOOD) and not pairs.is_copy(GOOD, GOOD) and not pairs.is_copy(RAW, "outra coisa")


SCHEMA = "response_id bigint, prompt bigint, ratio double, answer string"


def test_refusals_are_learned_from_recurring_openings(spark):
    template = "Perdão mas esse trecho fica fora do que me cabe tratar hoje aqui"  # stands in no list
    rows = [(i, i, 0.9, template + (" mesmo" if i % 2 else "")) for i in range(6)] + [(10, 10, 1.1, "The boatman kept the map of the crossing during the broadcast at the station")]
    rows += [(20, 20, 0.9, "Ninguém pediu que eu lesse isto em voz alta ontem"), (30, 30, 0.9, "Isto foi dito uma vez só por um prompt repetido"), (31, 30, 0.9, "Isto foi dito uma vez só por um prompt repetido"), (32, 30, 0.9, "Isto foi dito uma vez só por um prompt repetido")]
    asked = [(f"the boatman kept the map of the crossing during the broadcast {i}",) for i in range(5)] + [("perdão pelo rio",)]
    got = pairs.refusals(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(asked, "text string"))
    assert {r["response_id"] for r in got.collect()} == {0, 1, 2, 3, 4, 5}


def test_a_single_short_answer_that_is_no_speech_declines(spark):
    rows = [(1, 1, 0.2, "Esse pedido não me cabe"), (2, 2, 0.2, "the boatman kept the map"), (3, 3, 1.0, "Esse outro texto tem o tamanho de tudo")]
    got = pairs.refusals(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("the boatman kept the map of the crossing",)], "text string"))
    assert {r["response_id"] for r in got.collect()} == {1}


def test_no_list_of_sentences_decides():
    held = [v for k, v in vars(pairs).items() if k.isupper() or k.startswith("_") and not k.startswith("__")]
    assert not [x for v in held if isinstance(v, (list, tuple, set, frozenset, dict, str)) for x in ([v] if isinstance(v, str) else v) if isinstance(x, str)]


def test_classes_against_brute_force(spark):
    import random

    rng = random.Random(6)
    base = [[f"s{k}_{i}" for i in range(20)] for k in range(8)]
    texts = []
    for i in range(60):
        x = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            x[rng.randrange(20)] = f"n{i}"
        texts.append((i, sorted(set(x))))
    got = {r["id"]: r["class"] for r in pairs.near_classes(spark.createDataFrame(texts, "id bigint, shingles array<string>")).collect()}
    parent = list(range(60))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in texts:
        for j, b in texts:
            if i < j and len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert got == {i: root(i) for i, _ in texts}
