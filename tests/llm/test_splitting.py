"""Pieces: limit, coverage, overlap, natural cuts."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.llm import splitting


@settings(max_examples=200, deadline=None)
@given(st.text("ab .\n#-!", max_size=400), st.integers(1, 60), st.integers(0, 70))
def test_cover_within_limit(text, limit, overlap):
    got = splitting.split(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(b - a <= limit for a, b, _ in got)
    for (_, b, _), (c, _, before) in zip(got, got[1:]):
        assert c == b - before and 0 <= before <= overlap


def test_cuts_at_headings_items_and_sentences():
    text = "# A\n\nintro text here. More words.\n\n## B\n\n- one item\n- two item\n  - nested x\n\n## C\n\nlast paragraph is long. It has sentences. And more."
    got = [text[a:b] for a, b, _ in splitting.split(text, 40, 0)]
    assert got[0] == "# A\n\nintro text here. More words.\n\n" and got[1].startswith("## B") and got[2].startswith("## C") or got[1].startswith("## B")
    assert "".join(got) == text


def test_words_whole_where_they_fit():
    rng = random.Random(1)
    text = " ".join("w" * rng.randrange(1, 12) for _ in range(300))
    for a, b, _ in splitting.split(text, 50, 0):
        assert (a == 0 or text[a - 1] == " ") and (b == len(text) or text[b - 1] == " ")
    assert [b - a for a, b, _ in splitting.split("x" * 95, 40, 0)] == [40, 40, 15]


def test_overlap_is_of_whole_words():
    text = " ".join(["palavra"] * 200)
    got = splitting.split(text, 100, 20)
    assert all(before == 16 and text[a : a + 8] == "palavra " for a, _, before in got[1:])
    assert all(before == 20 for _, _, before in splitting.split("x" * 500, 100, 20)[1:])
    # A short piece is repeated with what it repeats itself, as far as the overlap goes.
    text = "# A\n\n" + "um dois tres quatro " * 3 + "\n\n# B\n\n" + "cinco " * 30
    for (a, b, _), (c, _, before) in zip(got := splitting.split(text, 60, 25), got[1:]):
        assert a <= c < b and (before >= 25 - 7 or c == a)


def test_first_piece_uses_its_room():
    text = " ".join(f"w{i:02}" for i in range(60))
    first, second = splitting.split(text, 48, 20)[:2]
    assert first[1] - first[0] > 48 - 20 and second[1] - second[0] <= 48


def test_lists_are_trees_of_any_depth():
    text = "\n".join(f"- um {i}\n" + "\n".join(f"  - dois {i}.{j}\n" + "\n".join(f"    - tres {i}.{j}.{k}" for k in range(2)) for j in range(2)) for i in range(3))

    def depth(node):
        return 1 + max((depth(c) for c in node.children), default=0)

    node = splitting.Node(0, len(text))
    splitting._lines(text, node)
    assert len(node.children) == 3
    for one in node.children:
        assert text[one.start :].startswith("- um") and len(one.children) == 2  # its own line, and the list below it
        two = one.children[1].children
        assert len(two) == 2 and all(text[x.start :].lstrip().startswith("- dois") for x in two)
        for x in two:
            three = x.children[1].children
            assert len(three) == 2 and all(text[y.start :].lstrip().startswith("- tres") for y in three)
    assert "".join(text[a:b] for a, b, _ in splitting.split(text, 70, 0)) == text and all(text[a:].startswith("- um") for a, _, _ in splitting.split(text, 110, 0))
