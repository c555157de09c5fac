"""Names, addresses, codecs and usage counts in source records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Subtitle codecs that hold text, and those that hold pictures.
TEXT_CODECS = ["ass", "eia_608", "eia_708", "mov_text", "srt", "ssa", "subrip", "text", "ttml", "webvtt"]
IMAGE_CODECS = ["dvb_subtitle", "dvd_subtitle", "hdmv_pgs_subtitle", "pgssub", "vobsub", "xsub"]


def codec_kind(codec: Column) -> Column:
    """'text', 'image' or 'unknown' of a subtitle codec."""
    c = F.lower(F.trim(codec))
    return F.when(c.isin(TEXT_CODECS), "text").when(c.isin(IMAGE_CODECS), "image").otherwise("unknown")


def is_url(source: Column) -> Column:
    """Whether a source is an http or https address with a host."""
    return F.coalesce(source.rlike(r"(?i)^https?://[^/?#\s]+"), F.lit(False))


def _part(source: Column, group: int) -> Column:
    """Scheme, authority or path of an address, spaces in it or not."""
    return F.regexp_extract(source, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)", group)


def display_name(source: Column) -> Column:
    """File name of a path; decoded last part of an address's path, or else its host."""
    tail = F.try_url_decode(F.element_at(F.split(_part(source, 3), "/"), -1))
    return F.when(is_url(source), F.coalesce(F.nullif(F.trim(tail), F.lit("")), _part(source, 2))).otherwise(F.element_at(F.split(source, "/"), -1))


def safe_label(source: Column) -> Column:
    """An address without user, query and fragment, the port kept; a file's name."""
    authority = F.regexp_replace(_part(source, 2), r"^.*@", "")
    return F.when(is_url(source), F.concat(F.lower(_part(source, 1)), F.lit("://"), authority, _part(source, 3))).otherwise(F.element_at(F.split(source, "/"), -1))


def safe_id(value: Column) -> Column:
    """Whether a value may name a folder (a fixed rule: 1 to 128 letters, digits, dots, lines and dashes, no mark first)."""
    return F.coalesce(value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"), F.lit(False))


def count_of(json: Column, *paths: str) -> Column:
    """The first path with a whole number that is not negative; NULL if none has."""
    found = [F.get_json_object(json, p).try_cast("bigint") for p in paths]
    return F.coalesce(*[F.when(x >= 0, x) for x in found])


def flag(text: Column) -> Column:
    """False for NULL, blank, 0, false, no and off, else true."""
    return F.coalesce(~F.lower(F.trim(text)).isin("", "0", "false", "no", "off"), F.lit(False))


def date_label(moment: Column) -> Column:
    """A date and time in ISO form as 'dd/MM/yyyy HH:mm' of the session's time zone; anything else as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(moment), "dd/MM/yyyy HH:mm"), moment)


def unchanged(source: Column, size: Column, modified: Column, size_now: Column, modified_now: Column) -> Column:
    """Whether a source may be gone on with: an address, or a file that is there and of the recorded size and time, where both were recorded."""
    same = size.isNull() | modified.isNull() | ((size == size_now) & (modified == modified_now))
    return is_url(source) | F.coalesce(size_now.isNotNull() & same, F.lit(False))
