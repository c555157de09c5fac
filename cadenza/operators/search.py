"""Accent-insensitive filters, term search, ranking and help sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import text as T

#: Hits of a search with terms.
MOST_HITS = 24


def matches(fields: list[Column], query: str, folded_query: str | None = None) -> Column:
    """Whether the folded query is part of the folded fields, which are joined by spaces."""
    wanted = folded_query if folded_query is not None else fold_plain(query)
    return T.fold(F.concat_ws(" ", *fields)).contains(wanted)


def fold_plain(value: str) -> str:
    """The fold of :func:`cadenza.functions.text.fold` for one value on the driver."""
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFKD", value.casefold()) if not unicodedata.combining(c))


def search(sections: DataFrame, query: str, *, text: Column, order: str) -> DataFrame:
    """Sections whose folded text holds every term, at most 24 in ``order``; all of them without terms."""
    terms = [fold_plain(t) for t in query.split()]
    if not terms:
        return sections
    hit = sections
    for t in terms:  # most rows are turned away without leaving the JVM
        hit = hit.where(T.may_hold(text, t))
    hit = hit.withColumn("_t", T.fold(text))
    for t in terms:
        hit = hit.where(F.col("_t").contains(t))
    return hit.orderBy(order).limit(MOST_HITS).drop("_t")


def preview(plain: Column) -> Column:
    """The first 132 characters, trimmed, with '…' if there are more."""
    return F.when(F.length(plain) > 132, F.concat(F.rtrim(F.substring(plain, 1, 132)), F.lit("…"))).otherwise(plain)


def best(rows: DataFrame, group: str, order: list[Column], keep: list[str]) -> DataFrame:
    """The row of each group that comes first by ``order``; a partial aggregate, no sort."""
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    return rows.groupBy(group).agg(F.min_by(F.struct(*keep), key).alias("x")).select(group, "x.*")


def sections(documents: DataFrame, *, key: str, markdown: str) -> DataFrame:
    """key, position, title, body of every '## ' section with a body; what stands before the first is none."""
    parts = F.split(F.concat(F.lit("\n"), F.regexp_replace(F.col(markdown), "\r\n?", "\n")), r"\n(?=## )")
    rows = documents.select(key, F.posexplode(parts).alias("position", "raw")).where(F.col("raw").startswith("## "))
    return rows.select(key, "position", F.trim(F.regexp_extract("raw", r"^## ([^\n]*)", 1)).alias("title"), T.strip(F.col("raw")).alias("body"))


def markdown_blocks(documents: DataFrame, *, key: str, markdown: str) -> DataFrame:
    """key, position, block, heading, warning, note, link of each block between blank lines.

    Call-outs lose their mark and quote signs; ``link`` is the first link's target or an empty text.
    """
    rows = documents.select(key, F.posexplode(F.split(F.regexp_replace(F.col(markdown), "\r\n?", "\n"), r"\n\s*\n")).alias("position", "raw"))
    raw = T.strip(F.col("raw"))
    warning, note = raw.rlike(r"^>\s*\[!WARNING\]"), raw.rlike(r"^>\s*\[!NOTE\]")
    bare = F.regexp_replace(F.regexp_replace(raw, r"(?i)^>\s*\[!(?:WARNING|NOTE)\]\s*", ""), r"(?m)^>\s?", "")
    out = rows.where(raw != "").select(key, "position", F.when(warning | note, bare).otherwise(raw).alias("block"), warning.alias("warning"), note.alias("note"))
    return out.withColumn("heading", F.col("block").rlike(r"^#{1,6}\s")).withColumn("link", F.regexp_extract("block", r"\[[^\]]+\]\(([^)]+)\)", 1))


def allowed(rows: DataFrame, anchor: str, anchors: list[str]) -> DataFrame:
    """Rows whose anchor is one of a fixed set."""
    return rows.where(F.col(anchor).isin(anchors))


def section_or_default(sections: DataFrame, wanted: DataFrame, *, key: str, anchor: str = "anchor", default: str) -> DataFrame:
    """``wanted`` (key, anchor) with title and body of the section of that anchor, or else of the one named ``default``."""
    table = sections.select(key, F.col(anchor).alias("_anchor"), "title", "body")
    first = table.where(F.col("_anchor") == default).select(key, F.struct(F.col("_anchor").alias("anchor"), "title", "body").alias("_d"))
    own = table.select(key, F.col("_anchor").alias(anchor), F.struct(F.col("_anchor").alias("anchor"), "title", "body").alias("_own"))
    both = wanted.join(own, [key, anchor], "left").join(first, key, "left").withColumn("_x", F.coalesce("_own", "_d"))
    return both.select(*[c for c in wanted.columns if c != anchor], F.col(anchor).alias("wanted"), F.col("_x.anchor").alias("anchor"), F.col("_x.title").alias("title"), F.col("_x.body").alias("body"))


def help_states(documents: DataFrame, *, key: str, markdown: str) -> DataFrame:
    """key, title, sections, state of every help document.

    ``state`` is 'empty' without text, 'title' unless exactly one line begins with '# ', 'anchor' if two
    sections with a body have one anchor, 'none' without any such section, else 'ok'.
    """
    lines = F.split(F.regexp_replace(F.coalesce(F.col(markdown), F.lit("")), "\r\n?", "\n"), "\n")
    titles = F.filter(lines, lambda x: x.startswith("# "))
    docs = documents.select(key, T.strip(F.coalesce(F.col(markdown), F.lit(""))).alias("_t"), titles.alias("_titles"))
    found = sections(documents, key=key, markdown=markdown).withColumn("_a", T.fold(F.col("title")))
    sums = found.groupBy(key).agg(F.count("*").alias("sections"), F.countDistinct(T.slug(F.col("_a"))).alias("_anchors"))
    n = F.coalesce("sections", F.lit(0))
    state = F.when(F.col("_t") == "", "empty").when(F.size("_titles") != 1, "title").when(F.col("_anchors") < n, "anchor").when(n == 0, "none").otherwise("ok")
    title = F.when(F.size("_titles") == 1, T.strip(F.regexp_extract(F.element_at("_titles", 1), "^# (.*)$", 1)))
    return docs.join(sums, key, "left").select(key, title.alias("title"), n.alias("sections"), state.alias("state"))
