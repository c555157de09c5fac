"""Language tags: normal form, compatibility and rank against a requested tag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Three-letter codes and their two-letter form; labels that name no language.
ALIASES = {
    "ara": "ar", "ces": "cs", "chi": "zh", "cze": "cs", "dan": "da", "deu": "de", "dut": "nl", "ell": "el", "eng": "en", "fas": "fa",
    "fin": "fi", "fra": "fr", "fre": "fr", "ger": "de", "gre": "el", "heb": "he", "hin": "hi", "ind": "id", "ita": "it", "jpn": "ja",
    "kor": "ko", "nld": "nl", "nor": "no", "per": "fa", "pol": "pl", "por": "pt", "ron": "ro", "rum": "ro", "rus": "ru", "spa": "es",
    "swe": "sv", "tur": "tr", "ukr": "uk", "vie": "vi", "zho": "zh",
}
UNDEFINED = ["", "und", "unknown", "zxx"]


def normal(tag: Column) -> Column:
    """Trimmed lower-case tag with '-', a three-letter base as two letters; NULL if undefined."""
    t = F.lower(F.replace(F.trim(tag), F.lit("_"), F.lit("-")))
    base, rest = F.split_part(t, F.lit("-"), F.lit(1)), F.regexp_extract(t, r"^[^-]*-(.+)$", 1)
    table = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    short = F.coalesce(F.element_at(table, base), base)
    return F.when(tag.isNotNull() & ~t.isin(UNDEFINED), F.when(rest != "", F.concat(short, F.lit("-"), rest)).otherwise(short))


def compatible(tag: Column, requested: Column) -> Column:
    """Whether two tags may be one language: unknown on either side, or the same base."""
    a, b = normal(tag), normal(requested)
    return F.coalesce(F.split_part(a, F.lit("-"), F.lit(1)) == F.split_part(b, F.lit("-"), F.lit(1)), F.lit(True))


def rank(tag: Column, requested: Column) -> Column:
    """0 exact, 1 same base, 3 unlabelled or undefined, 4 another; without a request 0 unlabelled and 1 labelled."""
    a, b = normal(tag), normal(requested)
    asked = F.when(a.isNull() | b.isNull(), 3).when(a == b, 0).when(F.split_part(a, F.lit("-"), F.lit(1)) == F.split_part(b, F.lit("-"), F.lit(1)), 1).otherwise(4)
    return F.when(F.coalesce(requested, F.lit("")) == "", F.when(a.isNull(), 0).otherwise(1)).otherwise(asked)
