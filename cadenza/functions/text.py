"""Text columns: folding, timestamps, cue cleaning, plain text, slugs and file names."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space at which words and texts are cut.
SPACE = r"[\s\x1c-\x1f\x85\xA0]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    """Full case folding, compatibility decomposition, combining marks dropped. NULL stays NULL."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        if t.isascii():
            return t.lower()
        return "".join(c for c in unicodedata.normalize("NFKD", t.casefold()) if not unicodedata.combining(c))

    return text.map(one, na_action="ignore")


#: Characters that fold to one character at most, or to marks no search term holds.
_SINGLE = r"\x00-\x7F\x{A0}-\x{BB}\x{BF}-\x{DE}\x{E0}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{300}-\x{36F}\x{2010}-\x{2023}\x{2026}\x{2030}-\x{2032}\x{2039}\x{203A}\x{20AC}"


def may_hold(text: Column, term: str) -> Column:
    """Whether folded text may contain an ASCII term: every text that does passes, few others do.

    A character beyond ASCII may stand for any letter, or be an accent behind one; the rest is compared
    in lower case. Texts with characters that fold to several, and terms with '.' or spaces, pass.
    """
    if not term.isascii() or not term.replace("-", "").isalnum():
        return F.lit(True)
    letters = [rf"(?:{re.escape(c)}[^\x00-\x7F]*|[^\x00-\x7F]+)" for c in term]
    return text.rlike("(?i)" + "".join(letters)) | text.rlike(f"[^{_SINGLE}]")


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Character entities of the whole HTML table. NULL stays NULL."""
    return text.map(html.unescape, na_action="ignore")


def strip(text: Column) -> Column:
    """Text without outer white space of any kind."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def squeeze(text: Column) -> Column:
    """Each run of white space as one space, none outside."""
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def words(text: Column) -> Column:
    """Words between white space; none for NULL or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"{SPACE}+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Sentences: cut at white space behind an end mark; the mark stays."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), rf"(?<=[.!?…]){SPACE}+"), strip), lambda s: s != "")


def timestamp(seconds: Column, *, separator: str = ".", millis: bool = True) -> Column:
    """HH:MM:SS and milliseconds, rounded half to even, hours unbounded. NULL for NULL, NaN and negative times."""

    def shown(ms: Column) -> Column:
        parts = [F.expr("1"), None]
        hours, minutes, secs = F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60
        parts = [F.lpad(hours.cast("string"), 2, "0"), F.lpad(minutes.cast("string"), 2, "0"), F.lpad(secs.cast("string"), 2, "0")]
        wide = F.when(hours > 99, hours.cast("string")).otherwise(parts[0])
        base = F.concat(wide, F.lit(":"), parts[1], F.lit(":"), parts[2])
        return F.concat(base, F.lit(separator), F.lpad((ms % 1000).cast("string"), 3, "0")) if millis else base

    ms = F.bround(seconds * 1000).cast("bigint")
    return F.when(seconds.isNotNull() & ~F.isnan(seconds) & (seconds >= 0), let(ms, shown))


def parse_timestamp(text: Column) -> Column:
    """Seconds of ``[H:]MM:SS[.,mmm]``; NULL if minutes or seconds reach 60 or the form is another."""
    form = r"^\s*(?:(\d{1,3}):)?(\d{1,2}):(\d{1,2}(?:[.,]\d{1,3})?)\s*$"
    hours = F.coalesce(F.nullif(F.regexp_extract(text, form, 1), F.lit("")), F.lit("0")).try_cast("int")
    minutes = F.regexp_extract(text, form, 2).try_cast("int")
    seconds = F.replace(F.regexp_extract(text, form, 3), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(text.rlike(form) & (minutes < 60) & (seconds < 60), hours * 3600 + minutes * 60 + seconds)


def cue_speaker(raw: Column) -> Column:
    """Name in the first voice tag ('<v Name>', classes behind dots); NULL without one."""
    name = F.regexp_extract(raw, r"<[vV](?:\.[^\s.<>]+)*[ \t\n]+([^<>]+)>", 1)
    return F.nullif(strip(entities(name)), F.lit(""))


def entities(text: Column) -> Column:
    """Character entities resolved; only text with an ampersand leaves the JVM."""
    return F.coalesce(unescape(F.when(text.contains("&"), text)), text)


def cue_text(raw: Column) -> Column:
    """Cue text without tags, entities resolved, white space squeezed."""
    return squeeze(entities(F.regexp_replace(raw, r"</?[^>]+>", "")))


def word_key(word: Column) -> Column:
    """A word in lower case without anything that is no letter, digit or underscore; accents stay."""
    return F.regexp_replace(F.lower(word), r"(?U)[^\w]+", "")


def plain_markdown(text: Column) -> Column:
    """Markdown without link targets and marks."""
    t = F.regexp_replace(text, r"\[([^\]]+)\]\([^)]+\)", "$1")
    return squeeze(F.regexp_replace(t, r"[#*`>\[\]()]", " "))


def slug(folded: Column) -> Column:
    """Anchor of an already folded title; 'inicio' if nothing is left."""
    t = F.regexp_replace(folded, r"(?U)[^\w\s-]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[\s_]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("inicio"))


def safe_stem(name: Column) -> Column:
    """File name stem: unsafe runs as '-', at most 120 characters, 'transcricao' if nothing is left."""
    t = F.regexp_replace(name, r"""[\x00-\x1f<>:"/\\|?*]+""", "-")
    t = F.regexp_replace(t, r"^[ .\-]+|[ .\-]+$", "")
    return F.regexp_replace(F.substring(F.coalesce(F.nullif(t, F.lit("")), F.lit("transcricao")), 1, 120), r"[ .]+$", "")


def stem_of(path: Column) -> Column:
    """Last part of a path without its extension."""
    last = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(last, r"(?<=.)\.[^.]*$", "")
