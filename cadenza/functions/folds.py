"""Greedy packing and overlap matching as higher-order functions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions.text import SPACE, let, sentences, words


def pack(units: Column, limit: int | Column, separator: str) -> Column:
    """Neighbouring units joined by ``separator`` as long as they stay within ``limit`` characters."""
    most = F.lit(limit) if isinstance(limit, int) else limit
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def add(acc: Column, unit: Column) -> Column:
        joined = F.concat(acc["open"], F.lit(separator), unit)
        fits = acc["open"].isNull() | (F.length(joined) <= most)
        return F.struct(
            F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"),
            F.when(acc["open"].isNull() | ~fits, unit).otherwise(joined).alias("open"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    return F.aggregate(units, start, add, finish)


def slices(word: Column, limit: int | Column) -> Column:
    """A word cut into stretches of ``limit`` characters."""
    most = F.lit(limit) if isinstance(limit, int) else limit
    count = F.greatest(F.lit(1), F.ceil(F.length(word) / most)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substr(word, i * most + 1, most))


def _apart(units: Column, limit: int, cut: object, separator: str) -> Column:
    """Pack units within the limit; one beyond it closes what is open and is cut by itself."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def add(acc: Column, unit: Column) -> Column:
        closed = F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        joined = F.concat(acc["open"], F.lit(separator), unit)
        fits = acc["open"].isNotNull() & (F.length(joined) <= limit)
        return F.when(F.length(unit) > limit, F.struct(F.concat(closed, cut(unit)).alias("done"), F.lit(None).cast("string").alias("open"))).otherwise(
            F.struct(F.when(fits, acc["done"]).otherwise(closed).alias("done"), F.when(fits, joined).otherwise(unit).alias("open"))
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    return F.aggregate(units, start, add, finish)


def split_words(text: Column, limit: int) -> Column:
    """Text as stretches of words within ``limit``; a longer word is cut at the limit."""
    return _apart(words(text), limit, lambda w: slices(w, limit), " ")


def split_unit(text: Column, limit: int) -> Column:
    """A paragraph as stretches within ``limit``: whole if it fits, else by sentences, else by words."""
    by_sentence = let(sentences(text), lambda s: F.when(F.size(s) <= 1, split_words(text, limit)).otherwise(_apart(s, limit, lambda x: split_words(x, limit), " ")))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(by_sentence)


def paragraphs(text: Column) -> Column:
    """Paragraphs between blank lines, trimmed."""
    clean = F.regexp_replace(text, "\r\n?", "\n")
    return F.filter(F.transform(F.split(clean, r"\n{2,}"), lambda p: F.regexp_replace(p, rf"^{SPACE}+|{SPACE}+$", "")), lambda p: p != "")


def paragraph_of(lengths: Column, soft: int, hard: int) -> Column:
    """For each of a row of sentence lengths the paragraph it falls into, from 0.

    A sentence begins another paragraph if the one before has at least ``soft`` characters and would
    have more than ``hard`` with it; a space stands between sentences.
    """
    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("k"), F.array().cast("array<int>").alias("of"))

    def add(acc: Column, n: Column) -> Column:
        fresh = (acc["size"] >= soft) & (acc["size"] + 1 + n > hard)
        k = acc["k"] + fresh.cast("int")
        return F.struct(F.when(fresh | (acc["size"] == 0), n).otherwise(acc["size"] + 1 + n).alias("size"), k.alias("k"), F.concat(acc["of"], F.array(k)).alias("of"))

    return F.aggregate(lengths, start, add, lambda acc: acc["of"])


def overlap(left: Column, right: Column, most: int | None = None) -> Column:
    """Length of the longest end of ``left`` that is a beginning of ``right``, both arrays of keys."""
    a = F.slice(left, F.greatest(F.lit(1), F.size(left) - most + 1), F.lit(most)) if most else left
    b = F.slice(right, 1, most) if most else right

    def sizes(x: Column) -> Column:
        n = F.least(F.size(x), F.size(b))
        ks = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        hits = F.filter(ks, lambda k: F.slice(x, F.size(x) - k + 1, k) == F.slice(b, F.lit(1), k))
        return F.coalesce(F.array_max(hits), F.lit(0))

    return let(a, sizes)
