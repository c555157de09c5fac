"""Columns that take one transcript segment apart: timestamps, annotations, labels, hesitations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sound annotations by language (pt, en, es, fr, de), folded to lower case without accents.
SOUNDS = [
    "musica", "aplausos", "risos", "ruido", "tosse", "porta batendo", "silencio", "inaudivel", "pausa", "suspiro", "vozes",
    "music", "applause", "laughter", "noise", "coughs", "cough", "door slams", "silence", "inaudible", "pause", "sigh", "laughs", "crosstalk",
    "risas", "tos", "portazo", "puerta", "inaudible", "golpe de puerta", "puerta que golpea", "se cierra una puerta",
    "musique", "applaudissements", "rires", "bruit", "toux", "porte qui claque", "inaudible", "soupir",
    "musik", "applaus", "beifall", "lachen", "gelachter", "gerausch", "husten", "tur knallt", "tur schlagt zu", "turknallen", "stille", "unverstandlich",
]
# Words before a speaker's number, folded.
NUMBERED = ["falante", "speaker", "spk", "orador", "oradora", "locutor", "hablante", "sprecher", "intervenant", "participante", "f", "s", "sp"]

_FROM = "áàâãäåăąéèêëęěíìîïóòôõöőúùûüűçćčñńňšşśžźżýÿłßœæð"
_TO = "aaaaaaaaeeeeeeiiiioooooouuuuucccnnnssszzzyylsoad"

#: Timestamps and cue times in brackets, as ranges, or before a dash. A spoken time of day stays.
TIMES = (
    r"\d{1,3}:\d{2}(?::\d{2})?[.,]\d{1,3}\s*-->\s*\d{1,3}:\d{2}(?::\d{2})?[.,]\d{1,3}"
    r"|[<\[({]\s*(?:\d{1,4}:)?\d{1,4}:\d{2}(?:[.,]\d{1,3})?\s*[>\])}]"
    r"|[<\[({]\s*(?:\d+h\s*)?\d+m\s*\d{1,2}s\s*[>\])}]"
    r"|\b\d{1,3}:\d{2}:\d{2}(?:[.,]\d{1,3})?\s+[-–—](?=\s|$)"
)
_SOUND_ALT = "|".join(sorted(set(SOUNDS), key=lambda x: (-len(x), x)))
#: Sounds between notes, stars or double brackets, which never name a speaker.
MARKS = r"♪[^♪]*♪|♪+|\(\([^()]*\)\)|\*[^*]*\*|</v>"
#: Anything else in brackets.
BRACKETS = r"\[[^\]]*\]|\([^()]*\)|<[^>]*>|\{[^}]*\}"
_LABEL = (
    r"^(?:<v(?:\.\w+)?\s+([^>]{1,60})>"
    r"|(?:>>+|[-–—])\s*([^:<>\[\](){}!?]{1,60}?)\s*:(?=\s|$)"
    r"|\[([^\]:]{1,60})\]|\(([^():]{1,60})\)"
    r"|((?i:(?:falante|speaker|spk|orador|oradora|locutor|hablante|sprecher|intervenant|participante)[ _]*(?:n[º°o.]*)?[ _]*\d{1,3}))\s*:(?=\s|$)"
    r"|([\p{L}][\p{L}.'’]*(?:,? [\p{L}][\p{L}.'’]*){0,3}(?: \([^()]*\))?)\s*:(?=\s|$))"
)
_HESITATION = (
    r"h+u*m+|u+h+m*|u+m+|h+[ãa]+n*|a+h+n*|é{2,}|e+h+m*|m{2,}|e+r+|e+u+h+|h+e+u+|ä+h+m*|ö+h+m*|h+é+"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(c), _FROM, _TO)


def marked(text: Column) -> Column:
    """Whether a text may hold anything but speech: brackets, colons, stars, notes, a dash at the start, odd characters."""
    return text.rlike(r"[\[({<>*:\x00-\x1F\x7F-\xA0\x{2000}-\x{2012}\x{201A}-\x{2025}\x{2027}-\x{10FFFF}]|^\s*[-–—]|^ | $|  ")


def without_times(text: Column) -> Column:
    """Text without timestamps, note marks and known sound annotations, outer white space cut."""
    return F.when(marked(text), _unmarked(text)).otherwise(F.trim(text))


def _unmarked(text: Column) -> Column:
    t = F.regexp_replace(text, TIMES, " ")
    t = F.regexp_replace(t, MARKS, " ")
    # Sounds in plain brackets; accents and case are ignored by listing the words folded.
    sounds = _SOUND_ALT.replace("u", "[uúü]").replace("o", "[oóô]").replace("i", "[ií]").replace("a", "[aáäâ]").replace("e", "[eéê]")
    t = F.regexp_replace(t, rf"(?iu)\[\s*(?:{sounds})\s*\]|\(\s*(?:{sounds})\s*\)|<\s*(?:{sounds})\s*>", " ")
    return F.trim(F.regexp_replace(t, r"[\s ​]+", " "))


def label_of(bare: Column) -> Column:
    """The speaker label at the start of :func:`without_times` text, NULL if none.

    A label stands in a voice tag or in brackets, or before a colon with or without a dialogue dash.
    """
    inner = F.concat(*[F.coalesce(F.regexp_extract(bare, _LABEL, k), F.lit("")) for k in range(1, 7)])
    return let(F.trim(inner), lambda t: F.nullif(t, F.lit("")))


def speech_of(bare: Column) -> Column:
    """What is spoken: no label, no bracketed remarks."""
    t = F.regexp_replace(bare, _LABEL, " ")
    t = F.regexp_replace(t, BRACKETS, " ")
    return F.trim(F.regexp_replace(t, r"[\s ]+", " "))


def without_hesitations(speech: Column) -> Column:
    """Speech without hesitation sounds and the mark behind them.

    A sound that is also a word somewhere ('um', 'er', 'eh') goes only before a mark or at the end.
    """
    t = F.regexp_replace(speech, rf"(?iu)(?=[hHuUaAeEéÉmMäÄöÖ])(?<![\p{{L}}\p{{N}}'’])(?:{_HESITATION})(?:\s*(?:\.{{2,}}|…|,)|\s*[.!?]?\s*$)", " ")
    t = F.regexp_replace(t, r"(?iu)(?=[hHuUaAeEéÉmMäÄöÖ])(?<![\p{L}\p{N}'’])(?:h+u+m+|h*m{2,}|hm+|h+ã+|a+h+n+|é{2,}|e{2,}h+m*|e+hm+|u+hm+|u+h|e+u+h+|h+e+u+|ä+h+m*|ö+h+m*)(?![\p{L}\p{N}'’])", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^[\s,.;…–-]+(?=\p{L})", ""))


def only_hesitation(speech: Column) -> Column:
    """Whether nothing but hesitation sounds and marks is left (or nothing at all)."""
    return speech.rlike(rf"(?iu)^[^\p{{L}}\p{{N}}]*+(?:(?:{_HESITATION})(?![\p{{L}}\p{{N}}])[^\p{{L}}\p{{N}}]*+)*+$")


def label_key(label: Column) -> Column:
    """A label without case, accents, brackets, remarks and marks; '#n' for a numbered one; NULL if blank.

    'Surname, Given' is turned round. What is left of a name is resolved against the rosters.
    """
    # Most labels are names of letters and dots, of which the rest would leave everything as it is.
    return let(fold(label), lambda t: F.when(t.rlike(r"^[\p{L}.]+(?: [\p{L}.]+)*+$"), t).otherwise(_bare_label(t)))


def _bare_label(folded: Column) -> Column:
    """:func:`label_key` of a folded label with anything but letters, dots and single spaces."""
    t = F.regexp_replace(folded, r"(?<=\S)\s*\([^()]*\)", " ")
    t = F.regexp_replace(t, r"[\[\]<>{}():\"“”*]|^[\s>–-]+", " ")
    t = F.trim(F.regexp_replace(t, r"[\s_ ]+", " "))
    number = rf"^(?:{'|'.join(NUMBERED)}) ?(?:n ?[º°o]?\.? ?)?0*(\d+)$"
    turned = F.regexp_replace(t, r"^([^,]+?) ?, ?([^,]+)$", "$2 $1")
    numbered = let(F.regexp_extract(t, number, 1), lambda n: F.when(n != "", F.concat(F.lit("#"), n)))
    return F.coalesce(numbered, F.nullif(turned, F.lit("")))
