"""Test passages in a training corpus: rare n-gram seeds, then Smith-Waterman alignment of words.

The corpus is read once, however many test items there are: a bit map of fixed size, in which every
item seed has its bit, keeps the seeds of a document that may be an item's, and these meet the items'
seeds in a join by their hash.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.common import cut, join_spread

#: Words of a seed, and of the shortest passage that counts as leaked.
SEED, LEAST = 8, 13
#: Bits of the map of item seeds; more items only let more seeds through that the join then drops.
BITS = 1 << 25
#: Documents that a rare seed may stand in, at least and as a share of all that hold any item's seed.
FEW, RARE = 2, 0.001
#: Words whose hashes a worker keeps.
KEPT = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1

_CUES = re.compile(r"^[ \t]*(?:\d+[ \t]*\r?\n[ \t]*)?\d{1,3}:\d{2}(?::\d{2})?[.,]\d{1,3}[ \t]*-->[^\n]*$", re.M)
_LABELS = re.compile(
    r"^[ \t]*(?:>>+|[-–—])?[ \t]*(?:<v[^>\n]{1,60}>|[\[(][^\])\n\d]{1,40}\d{0,3}[\])][ \t]*:?(?=[ \t])"
    r"|(?:[^\W\d_][\w.]*[ _]?(?:n[º°o.]*[ ]?)?\d{1,3}|[A-ZÀ-ÖØ-Þ][^\s:,.!?;]*(?:[ ][A-ZÀ-ÖØ-Þ][^\s:,.!?;]*){0,3}|[^\W\d_]+)[ \t]*:(?=[ \t]))",
    re.M,
)
_MARKS = re.compile("[̀-ͯ]+")
_WORDS = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Words of letters and digits, without case, accents, entities, cue lines and speaker labels at line starts."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "-->" in text:
        text = _CUES.sub(" ", text)
    if ":" in text or "[" in text or "(" in text or "<v" in text:
        text = _LABELS.sub(" ", text)
    return _WORDS.findall(_MARKS.sub("", unicodedata.normalize("NFD", text.casefold())))


class Hashes(dict):
    """64-bit hashes of words, computed once a worker."""

    def __missing__(self, word: str) -> int:
        if len(self) > KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        return np.array([self[w] for w in words(text)], np.uint64)


_KEYS = np.random.default_rng(7).integers(1, 2**63, SEED, dtype=np.uint64) | np.uint64(1)


def seeds(hashes: np.ndarray) -> np.ndarray:
    """Hash of the ``SEED`` words from each position on."""
    span = len(hashes) - SEED + 1
    if span <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(span, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SEED):
            h += (hashes[k : k + span] ^ (hashes[k : k + span] >> np.uint64(32))) * _KEYS[k]
        return h ^ (h >> np.uint64(31))


def align(doc: np.ndarray, item: np.ndarray) -> int:
    """Smith-Waterman score of two word sequences."""
    index = np.arange(len(doc) + 1) * -GAP
    row, best = np.zeros(len(doc) + 1, np.int64), 0
    for w in item:
        diagonal = row[:-1] + np.where(doc == w, MATCH, MISMATCH)
        now = np.zeros(len(doc) + 1, np.int64)
        now[1:] = np.maximum(np.maximum(diagonal, row[1:] + GAP), 0)
        row = np.maximum(np.maximum.accumulate(now + index) - index, 0)
        best = max(best, int(row.max()))
    return best


def run_length(doc: np.ndarray, item: np.ndarray, at: int, pos: int) -> int:
    """Length of the exact run through ``doc[at]`` and ``item[pos]``."""
    back = 0
    while back < min(at, pos) and doc[at - back - 1] == item[pos - back - 1]:
        back += 1
    ahead = 0
    while at + ahead < len(doc) and pos + ahead < len(item) and doc[at + ahead] == item[pos + ahead]:
        ahead += 1
    return back + ahead


def _score(doc: np.ndarray, item: np.ndarray, hits: list[tuple[int, int]]) -> tuple[int, int]:
    """(best alignment score, longest exact run) over the windows around the seeds of one pair."""
    longest, best = 0, 0
    spans: list[list[int]] = []
    for at, pos in sorted(hits):
        longest = max(longest, run_length(doc, item, at, pos))
        low, high = max(0, at - 2 * pos - SEED), min(len(doc), at + 2 * (len(item) - pos) + SEED)
        if spans and low <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], high)
        else:
            spans.append([low, high])
    for low, high in spans:
        best = max(best, align(doc[low:high], item))
    return best, longest


def _hashed(rows: DataFrame, key: str) -> DataFrame:
    """``key``, words (hashes) of texts with ``SEED`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            out = [hashes.of(t).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({key: batch.column(key), "words": pa.array(out, pa.list_(pa.int64())), "seeds": pa.array([seeds(x.view(np.uint64)).view(np.int64) for x in out], pa.list_(pa.int64()))})

    return rows.select(key, "text").mapInArrow(run, f"{key} bigint, words array<bigint>, seeds array<bigint>").where(F.size("words") >= SEED)


def _bitmap(item_seeds: DataFrame) -> np.ndarray:
    """One bit for each seed, packed; at most ``BITS`` / 64 numbers come to the driver."""
    slot = F.pmod("seed", F.lit(BITS))
    rows = item_seeds.select(F.floor(slot / 64).alias("at"), F.expr(f"shiftleft(1L, cast(pmod(seed, {BITS}) % 64 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).collect()
    out = np.zeros(BITS // 64, np.int64)
    out[[r["at"] for r in rows]] = [r["bits"] for r in rows]
    return out.view(np.uint8)


def _seeded(documents: DataFrame, bits: np.ndarray) -> DataFrame:
    """doc_id, words, at, seed: documents with seeds whose bit is set, and where these stand."""
    shared = documents.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = Hashes(), shared.value
        gap = np.zeros(SEED, np.uint64)
        for batch in batches:
            texts = [hashes.of(t) for t in batch.column("text").to_pylist()]
            h = seeds(np.concatenate([x for t in texts for x in (t, gap)] or [gap]))
            slot = h & np.uint64(BITS - 1)
            at = np.flatnonzero(bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
            start = np.concatenate([[0], np.cumsum([len(t) + SEED for t in texts])])
            owner = np.searchsorted(start, at, side="right") - 1
            at, owner = (x[at - start[owner] <= np.array([len(t) for t in texts])[owner] - SEED] for x in (at, owner)) if len(at) else (at, owner)
            docs, first = np.unique(owner, return_index=True)
            parts = list(zip(docs, np.split(at, first[1:]))) if len(docs) else []
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").take(pa.array(docs, pa.int64())),
                    "words": pa.array([texts[d].view(np.int64) for d, _ in parts], pa.list_(pa.int64())),
                    "at": pa.array([(a - start[d]).astype(np.int32) for d, a in parts], pa.list_(pa.int32())),
                    "seed": pa.array([h[a].view(np.int64) for _, a in parts], pa.list_(pa.int64())),
                }
            )

    source = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id bigint, words array<bigint>, at array<int>, seed array<bigint>")


def rare_seeds(item_seeds: DataFrame, frequency: DataFrame, most: float) -> DataFrame:
    """seed, places (array of item_id, pos): every seed in at most ``most`` documents, and of each window of ``LEAST`` words of an item the one in fewest.

    A passage of ``LEAST`` words of an item can stand in a document only if all its seeds do; then the
    rarest is taken however often it occurs, so none is lost. ``frequency``: seed, n.
    """
    counted = item_seeds.join(frequency, "seed", "left").select("item_id", "pos", "seed", "n")
    inside = Window.partitionBy("item_id").orderBy("pos").rowsBetween(0, LEAST - SEED)
    windows = counted.select("item_id", "pos", "seed", "n", F.min(F.struct("n", "seed", "pos")).over(inside).alias("x"), F.count("n").over(inside).alias("there"))
    own = F.when(F.col("n") <= most, F.struct("seed", "pos"))
    rarest = F.when(F.col("there") == LEAST - SEED + 1, F.struct("x.seed", "x.pos"))
    chosen = windows.select("item_id", F.inline(F.array_compact(F.array(own, rarest)))).distinct()
    return chosen.groupBy("seed").agg(F.collect_list(F.struct("item_id", "pos")).alias("places"))


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score, run of every document and test item that share a rare seed.

    ``score`` is the Smith-Waterman score as a part of the item's own; ``run`` the longest exact run
    of words. Items and documents with NULL text or too few words share nothing.
    """
    hashed = cut(_hashed(items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), "text"), "item_id"))
    item_seeds = hashed.select("item_id", F.posexplode("seeds").alias("pos", "seed"))
    hits = cut(_seeded(documents, _bitmap(item_seeds)))
    spread = hits.select("doc_id", F.inline(F.arrays_zip("at", "seed")))
    known = spread.join(item_seeds.select("seed").distinct(), "seed", "left_semi")
    frequency = cut(known.groupBy("seed", "doc_id").agg(F.count("*").alias("m")).groupBy("seed").agg(F.count("*").alias("n"), F.sum("m").alias("m")))
    chosen = cut(rare_seeds(item_seeds, frequency, max(FEW, RARE * hits.count())))
    met = join_spread(spread.join(chosen.select("seed"), "seed", "left_semi"), chosen, ["seed"], frequency.join(chosen.select("seed"), "seed", "left_semi").select("seed", "m"), n="m")
    pairs = cut(met.select("doc_id", F.inline("places"), "at").groupBy("doc_id", "item_id").agg(F.collect_list(F.struct("at", "pos")).alias("places")))
    with_doc = pairs.join(hits.select("doc_id", F.col("words").alias("doc")), "doc_id")
    both = join_spread(with_doc, hashed.select("item_id", F.col("words").alias("item")), ["item_id"], pairs.groupBy("item_id").agg(F.count("*").alias("n")))

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, item, places, d, x in zip(pdf["doc_id"], pdf["item_id"], pdf["places"], pdf["doc"], pdf["item"]):
                score, run = _score(np.asarray(d, np.int64), np.asarray(x, np.int64), [(p["at"], p["pos"]) for p in places])
                out.append((doc, item, score / (MATCH * len(x)), run))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "score", "run"])

    return both.select("doc_id", "item_id", "places", "doc", "item").mapInPandas(aligned, "doc_id bigint, item_id bigint, score double, run int")
