"""Pieces of oversized texts, cut at natural boundaries by packing a structure tree."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HEADING = re.compile(r"(#{1,6})[ \t]+\S")
_ITEM = re.compile(r"([ \t]*)(?:[-*+•]|\d{1,3}[.)])[ \t]+\S")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”’»)\]]*\s+")
_SPACE = re.compile(r"\s+")


def tidy(text: Column) -> Column:
    """Text with CRLF and CR as LF and without outer white space."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"^[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}\x1c-\x1f]+", "")
    return F.regexp_replace(t, r"[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}\x1c-\x1f]+$", "")


@dataclass
class Node:
    """A stretch ``text[start:end]``; its children cover it without gaps."""

    start: int
    end: int
    children: list[Node] = field(default_factory=list)


def _by(text: str, start: int, end: int, at: list[int]) -> list[Node]:
    marks = [start, *[a for a in at if start < a < end], end]
    return [Node(a, b) for a, b in zip(marks, marks[1:])]


def _words(text: str, node: Node) -> None:
    node.children = _by(text, node.start, node.end, [m.end() for m in _SPACE.finditer(text, node.start, node.end)])
    if len(node.children) < 2:
        node.children = []


def _sentences(text: str, node: Node) -> None:
    node.children = _by(text, node.start, node.end, [m.end() for m in _SENTENCE.finditer(text, node.start, node.end)])
    for child in node.children:
        _words(text, child)
    if len(node.children) < 2:
        node.children = node.children[0].children if node.children else []


def _items(text: str, node: Node, items: list[tuple[int, int]]) -> None:
    """List items (start, depth) of a node as its children, deeper ones below the item before them, at any depth."""
    level = min(depth for _, depth in items)
    node.children = _by(text, node.start, node.end, [s for s, depth in items if depth == level])
    for child in node.children:
        inner = [(s, depth) for s, depth in items if child.start <= s < child.end and depth > level]
        if not inner:
            _sentences(text, child)
        elif inner[0][0] == child.start:  # deeper items before the first of this level
            _items(text, child, inner)
        else:
            head, rest = Node(child.start, inner[0][0]), Node(inner[0][0], child.end)
            _sentences(text, head)
            _items(text, rest, inner)
            child.children = [head, rest]


def _lines(text: str, node: Node) -> None:
    """Lines of a paragraph: list items (nested by their indent) or, in plain prose, sentences."""
    starts = [node.start, *[m.end() for m in re.compile("\n").finditer(text, node.start, node.end) if m.end() < node.end]]
    items = [(s, len(m.group(1).expandtabs(4))) for s in starts if (m := _ITEM.match(text, s, node.end))]
    if len(items) < 2:
        _sentences(text, node)
    else:
        _items(text, node, items)


def parse(text: str) -> Node:
    """Tree of a text: headings by level, then paragraphs, list items, sentences and words."""
    root = Node(0, len(text))
    paragraphs = _by(text, 0, len(text), [m.end() for m in re.compile(r"\n[ \t]*(?:\n[ \t]*)*\n").finditer(text)] + [m.start() for m in re.compile(r"^#{1,6}[ \t]+\S", re.M).finditer(text)])
    paragraphs = sorted({(p.start, p.end) for p in paragraphs})
    marks = sorted({s for s, _ in paragraphs} | {len(text)})
    stack = [(0, root)]
    for a, b in zip(marks, marks[1:]):
        heading = _HEADING.match(text, a)
        if heading:
            level = len(heading.group(1))
            while stack[-1][0] >= level:
                stack.pop()
            section = Node(a, b)
            stack[-1][1].children.append(section)
            stack.append((level, section))
        leaf = Node(a, b)
        _lines(text, leaf)
        stack[-1][1].children.append(leaf)
    _stretch(root)
    return root


def _stretch(node: Node) -> None:
    for child in node.children:
        _stretch(child)
    if node.children:
        node.end = max(node.end, node.children[-1].end) if node.start != node.end else node.children[-1].end


def pack(text: str, node: Node, limit: int, first: int | None = None) -> list[tuple[int, int]]:
    """Stretches of at most ``limit`` characters (``first`` at the start of the text) that cover the node.

    Subtrees that fit are whole; neighbours are merged as long as they fit together; only a subtree
    over the limit is entered, and its parts join what stands beside it. A word over the limit is cut.
    """
    room = lambda start: first if first and start == 0 else limit
    if node.end - node.start <= room(node.start):
        return [(node.start, node.end)]
    out: list[tuple[int, int]] = []
    if not node.children:
        at = node.start
        while at < node.end:
            out.append((at, min(at + room(at), node.end)))
            at = out[-1][1]
        return out
    for child in node.children:
        for start, end in pack(text, child, limit, first):
            if out and end - out[-1][0] <= room(out[-1][0]):
                out[-1] = (out[-1][0], end)
            else:
                out.append((start, end))
    return out


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, overlap) of the pieces of a text; each repeats the whole words that end the piece before it, at most ``overlap`` characters of them.

    Pieces with their overlap stay within ``limit``; white space at the cut belongs to the piece
    before. A text within the limit is one piece. The overlap is at most half the limit and no more
    than the piece before with its own overlap; only if a word is longer does it begin within it.
    """
    if len(text) <= limit or limit <= 0:
        return [(0, len(text), 0)]
    overlap = max(0, min(overlap, limit // 2))
    begins = [0, *[m.end() for m in _SPACE.finditer(text)]]
    parts = pack(text, parse(text), limit - overlap, limit)  # the first piece repeats nothing and has more room
    out: list[tuple[int, int, int]] = []
    for start, end in parts:
        back = max(start - overlap, out[-1][0]) if out else start
        k = bisect_left(begins, back)
        at = begins[k] if k < len(begins) and begins[k] < start else back
        out.append((at, end, start - at))
    return out


def pieces(blocks: DataFrame, limits: DataFrame, *, keys: tuple[str, ...] = ("block_id",)) -> DataFrame:
    """``keys``, piece, start_char, end_char, overlap, text of every block; ``pieces`` tells how many there are.

    ``limits`` has planner_id, char_limit, char_overlap; blocks without a planner or with a NULL or
    non-positive limit, and blocks within the limit, stay whole. NULL texts have no pieces. Blocks
    that are delivered again count once. Only oversized texts leave the JVM.
    """
    rows = (
        blocks.where(F.col("text").isNotNull()).select(*keys, "planner_id", tidy(F.col("text")).alias("body"))
        .join(limits.select("planner_id", F.col("char_limit").alias("most"), F.col("char_overlap").alias("shared")), "planner_id", "left")
    )
    over = F.coalesce((F.col("most") > 0) & (F.length("body") > F.col("most")), F.lit(False))
    whole = rows.where(~over & (F.length("body") > 0)).dropDuplicates(list(keys)).select(
        *keys, F.lit(0).alias("piece"), F.lit(1).alias("pieces"), F.lit(0).alias("start_char"), F.length("body").alias("end_char"), F.lit(0).alias("overlap"), F.col("body").alias("text")
    )
    names = [*keys, "piece", "pieces", "start_char", "end_char", "overlap", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                cuts = split(row.body, int(row.most), int(row.shared or 0))
                for k, (a, b, before) in enumerate(cuts):
                    out.append((*[getattr(row, c) for c in keys], k, len(cuts), a, b, before, row.body[a:b]))
            yield pd.DataFrame(out, columns=names)

    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in keys], "piece int, pieces int, start_char int, end_char int, overlap int, text string"])
    return rows.where(over).dropDuplicates(list(keys)).mapInPandas(run, schema).unionByName(whole)


def limits_of(planners: DataFrame) -> DataFrame:
    """planner_id, char_limit, char_overlap from durations and speech rate, rounded down."""
    return planners.select(
        "planner_id",
        F.floor(F.col("target_duration") * F.col("chars_per_sec")).cast("int").alias("char_limit"),
        F.floor(F.col("overlap") * F.col("chars_per_sec")).cast("int").alias("char_overlap"),
    )
