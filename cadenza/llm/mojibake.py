"""Text decoded with the wrong encoding: found and restored by noisy-channel decoding.

Every distinct token with a character beyond ASCII is decoded once. For each pair of a wrong and a
right encoding its bytes form a lattice: an edge is a character whose bytes stand there, where a
replacement character is a wildcard for a lost byte (or for a lost character). The best path is found
by Viterbi search over character transitions of the corpus's distinct words, and corpus word
frequencies decide between the token as it is, its decodings and the words that the lattice admits.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.common import cut

#: A run of visible characters with one beyond ASCII in it.
TOKEN = r"[\x21-\x7E]*+[^\x00-\x7F][^ \t\r\n]*"
EDGES = r"^[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+$"
#: Evidence, in nats, from which a token counts as damaged.
THRESHOLD = 3.0
#: Documents that must hold a single-byte decoding for it to be a word of the corpus.
LEAST_DOCS = 3
#: Evidence of a token whose characters have the structure of a multi-byte encoding, which sound text has by chance only.
STRUCTURE = 4.0
#: In how many times as many distinct texts as its single-byte decoding a damaged form may stand before its transitions must outweigh the odds.
MOST_AS_IS = 10
#: Most that one token weighs among the transitions.
HEAVIEST = 50
#: Nats that a character beyond ASCII costs if it stands for itself beside lost bytes.
SELF = 3.0
#: Characters from here on, but for those of the code pages, share a symbol with the others of their block of 128, which bounds the transition model.
WIDE = 0x800

# Encodings in which multi-byte text is wrongly read, and single-byte mix-ups (read as, is).
READ_AS = ["cp1252", "latin_1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251"]
MIXED_UP = [
    ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1250", "cp1252"), ("cp1251", "cp1252"),
    ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp437"),
]
#: What a letter may turn out to be besides a letter, inside or at the end of a word.
PUNCTUATION = "…“”‘’—–"
LOST = "�"


def _table(codec: str) -> dict[str, int]:
    """Character -> byte of the upper half; bytes a Windows page leaves open stand for themselves."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


#: A character beyond ASCII that is no letter between letters.
_INSIDE = re.compile(r"[^\W\d_][^\x00-\x7f\w’‘·\xad][^\W\d_]|[^\W\d_][¹²³¼½¾ªº][^\W\d_]")


_TABLES = {c: _table(c) for c in READ_AS}
_PAGES = frozenset(c for t in _TABLES.values() for c in t)


def symbol(c: str) -> str:
    """What the transition model takes a character for."""
    return c if ord(c) < WIDE or c in _PAGES else chr(0xF0000 + ord(c) // 128)


class Channel:
    """Candidate decodings of tokens under a character transition model."""

    def __init__(self, pairs: dict[str, int], seen: dict[str, int] | None = None) -> None:
        self.total: Counter = Counter()
        self.seen = seen or self.total  # by documents, copies and all
        for p, n in pairs.items():
            self.total[p[0]] += n
        self.kinds = max(2, len({p[1] for p in pairs}))
        self.pairs = pairs
        self.next: dict[str, dict[str, float]] = defaultdict(dict)
        for p in pairs:
            self.next[p[0]][p[1]] = self.step(*p)
        beyond = sorted({p[1] for p in pairs if 127 < ord(p[1]) < 0xF0000 and p[1] != LOST})
        self.letters = [c for c in beyond if c.isalpha() or c in "…“”"]
        self.encoded = [(c, c.encode("utf-8")) for c in beyond]
        self.fitting: dict[tuple, list[str]] = {}
        self.kept: dict[tuple, np.ndarray] = {}
        self.swap = {}
        for read, real in MIXED_UP:
            back = {b: c for c, b in _table(real).items()}
            self.swap[(read, real)] = {c: back[b] for c, b in _table(read).items()}

    def step(self, a: str, b: str) -> float:
        """Log probability that symbol ``b`` follows ``a``."""
        return math.log((self.pairs.get(a + b, 0) + 0.02) / (self.total.get(a, 0) + 0.02 * self.kinds))

    def gain(self, old: str, new: str) -> float:
        """How much likelier ``new`` is than ``old``."""
        return self._score(new) - self._score(old)

    def _score(self, token: str) -> float:
        s = [" ", *map(symbol, token), " "]
        return sum(map(self.step, s, s[1:]))

    def _multibyte(self, token: str, codec: str) -> str | None:
        """All runs beyond ASCII as UTF-8 that was read as ``codec``; None if one isn't."""
        table = _TABLES[codec]

        def run(m: re.Match) -> str:
            s = m.group()
            if m.end() == len(token) and table.get(s[-1], 0) in (0xC2, 0xC3) and not token[m.start() - 1 : m.start()].isupper():
                s += "\xa0" if "\xa0" in table else ""  # the second byte, a no-break space, became a space
            return bytes(table[c] for c in s).decode("utf-8")

        try:
            return re.sub(r"[^\x00-\x7f]+", run, token)
        except (KeyError, UnicodeDecodeError):
            return None

    def structured(self, token: str) -> bool:
        """Whether all of a token beyond ASCII has the structure of UTF-8 in some single-byte encoding."""
        return any(self._multibyte(token, c) is not None for c in READ_AS)

    def _matching(self, code: tuple[int | None, ...]) -> list[str]:
        """Characters whose UTF-8 bytes are these, None being any byte; the corpus's if bytes are missing."""
        if code not in self.fitting:
            if None in code:
                found = [c for c, b in self.encoded if len(b) == len(code) and all(x is None or x == y for x, y in zip(code, b))]
            else:
                try:
                    found = [bytes(code).decode("utf-8")]
                except UnicodeDecodeError:
                    found = []
            self.fitting[code] = [c for c in found if len(c) == 1]
        return self.fitting[code]

    def _edges(self, token: str, codec: str | None) -> list[list[tuple[int, float, list[str]]]]:
        """For each position of a token the edges that begin there: (end, cost, characters)."""
        table = _TABLES.get(codec, {})
        code = [ord(c) if ord(c) < 128 else table.get(c) for c in token]
        out: list[list[tuple[int, float, list[str]]]] = []
        for i, c in enumerate(token):
            if ord(c) < 128:
                out.append([(i + 1, 0.0, [c])])
                continue
            here = [(i + 1, 0.0, self.letters)] if c == LOST else [(i + 1, SELF, [c])]
            for k in (2, 3, 4):
                part = token[i : i + k]
                if len(part) == k and all(x == LOST or ord(x) > 127 and x in table for x in part):
                    here.append((i + k, 0.0, self._matching(tuple(None if x == LOST else table[x] for x in part))))
            if i == len(token) - 1 and code[i] in (0xC2, 0xC3):  # the second byte, a no-break space, became a space
                here.append((i + 1, 0.0, self._matching((code[i], 0xA0))))
            out.append([e for e in here if e[2]])
        return out

    def _steps(self, a: list[str], b: list[str]) -> np.ndarray:
        """Log probabilities of every character of ``b`` after every one of ``a``; those of two long lists are kept."""
        key = (id(a), id(b)) if len(a) > 1 and len(b) > 1 else None
        if key in self.kept:
            return self.kept[key]
        first = [symbol(c) for c in a]
        out = np.repeat(np.array([[math.log(0.02 / (self.total.get(x, 0) + 0.02 * self.kinds))] for x in first]), len(b), axis=1)
        column: dict[str, list[int]] = defaultdict(list)
        for j, c in enumerate(b):
            column[symbol(c)].append(j)
        for i, x in enumerate(first):
            known = self.next.get(x, {})
            for y in known if len(known) < len(column) else column:
                if y in known and y in column:
                    out[i, column[y]] = known[y]
        if key:
            self.kept[key] = out
        return out

    def path(self, token: str, codec: str | None) -> tuple[float, str] | None:
        """(log probability, text) of the best path through a token's lattice; None if there is none."""
        edges = [*self._edges(token, codec), [(len(token) + 1, 0.0, [" "])]]
        # What ends at each position, an edge each: characters, their best scores, and where these come from.
        ends: list[list[tuple[list[str], np.ndarray, tuple]]] = [[([" "], np.zeros(1), ())]] + [[] for _ in edges]
        for i, here in enumerate(edges):
            for end, cost, chars in here if ends[i] else []:
                best, edge, row = np.full(len(chars), -np.inf), np.zeros(len(chars), np.int64), np.zeros(len(chars), np.int64)
                for g, (before, score, _) in enumerate(ends[i]):
                    value = score[:, None] + self._steps(before, chars)
                    top = value.argmax(axis=0)
                    value = value[top, np.arange(len(chars))]
                    better = value > best
                    best, edge, row = np.where(better, value, best), np.where(better, g, edge), np.where(better, top, row)
                ends[end].append((chars, best - cost, (i, edge, row)))
        if not ends[-1]:
            return None
        at, g, r, text = len(edges), 0, 0, []
        while at:
            chars, _, (start, edge, row) = ends[at][g]
            text.append(chars[r])
            at, g, r = start, int(edge[r]), int(row[r])
        return float(ends[-1][0][1][0]), "".join(reversed(text[1:]))

    def candidates(self, token: str) -> list[tuple[str, str, float]]:
        """(decoding, kind, evidence) with some evidence; kind is utf8, single or lost."""
        if LOST in token:
            read = READ_AS if any(ord(c) > 127 and c != LOST for c in token) else []
            found = [p for codec in (None, *read) if (p := self.path(token, codec))]
            return [(max(found)[1], "lost", 99.0)] if found else [(token, "lost", 99.0)]
        out: dict[str, tuple[str, float]] = {}
        beyond = {c for c in token if ord(c) > 127}
        frontier = [token]
        while frontier:  # every round makes the text shorter
            found = []
            for t in frontier:
                for codec in READ_AS:
                    c = self._multibyte(t, codec) if all(ord(x) < 128 or x in _TABLES[codec] for x in t) else None
                    if c and c != t and c not in out and c not in found and any(ord(x) > 127 for x in c):
                        found.append(c)
                        if all(self.seen.get(symbol(x), 0) >= LEAST_DOCS for x in c if ord(x) > 127):
                            out[c] = ("utf8", STRUCTURE + self.gain(token, c))
            frontier = [c for c in found if len(c) < max(map(len, frontier))]
        for table in self.swap.values():
            if beyond <= table.keys():
                c = "".join(table.get(x, x) for x in token)
                if c != token and c not in out and not any(x.isalpha() and not (y.isalpha() or y in PUNCTUATION and len(c) > 1) for x, y in zip(token, c) if x != y):
                    out[c] = ("single", self.gain(token, c) + (STRUCTURE if _INSIDE.search(token) else 0.0))
        return [(c, kind, gain) for c, (kind, gain) in out.items() if gain > 0.0 or kind == "single"]


def explains(token: str, word: str) -> bool:
    """Whether a token with lost bytes may be what is left of ``word``: read in one of the wrong encodings, bytes or characters lost."""
    gap = re.escape(LOST)
    for codec in (None, *READ_AS):
        back = {b: c for c, b in _TABLES[codec].items()} if codec else {}
        form = ""
        for c in word:
            if ord(c) < 128:
                form += re.escape(c)
                continue
            code = c.encode("utf-8")
            read = "".join(f"(?:{re.escape(back[b])}|{gap})" if b in back else gap for b in code)
            form += f"(?:{re.escape(c)}|{gap}|{read})"
        if re.fullmatch(form, token):
            return True
    return False


_EDGE = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F“”‘’«»…—¿¡"


def core(word: Column) -> Column:
    """A token without the punctuation at its edges."""
    return F.regexp_replace(word, f"^[{_EDGE}]+|[{_EDGE}]+$", "")


def pattern(word: Column) -> Column:
    """A token's core with every run beyond ASCII as one wildcard."""
    return F.regexp_replace(core(word), r"[^\x00-\x7F]+", "*")


def tokens_of(documents: DataFrame) -> DataFrame:
    """doc_id, copy (the same for equal texts), token: the distinct tokens with characters beyond ASCII of each document."""
    found = F.regexp_extract_all("text", F.lit(TOKEN), 0)
    return documents.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("copy"), F.explode(F.array_distinct(F.transform(found, lambda t: F.regexp_replace(t, EDGES, "")))).alias("token"))


def damaged_tokens(tokens: DataFrame) -> DataFrame:
    """token, restored: the tokens that the noisy channel explains better than the language does.

    A multi-byte decoding counts by its transitions; a single-byte one must also be a word of the
    corpus (in ``LEAST_DOCS`` documents); a token with a replacement character is always damaged, and
    the most frequent word of its pattern, if its bytes may be what is left of it (:func:`explains`),
    is preferred to the letters of the Viterbi path. Punctuation at a token's edges is kept.
    Transitions are counted over distinct tokens that are not structured like a multi-byte encoding,
    each weighing as much as distinct texts have it, at most ``HEAVIEST``, so that neither damaged
    texts nor many copies of one look sound. A single-byte decoding that only copies of fewer distinct
    texts hold needs a gain of ``THRESHOLD``, and one in far fewer distinct texts than the token
    (``MOST_AS_IS``) a gain beyond that by the logarithm of the ratio; one in far more distinct texts
    counts with that logarithm, since many damaged texts make their own transitions likely.
    """
    counts = cut(tokens.groupBy("token", "copy").agg(F.count("*").alias("n")).groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("texts")))
    spark = tokens.sparkSession

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, seen = Counter(), Counter()
        channel = Channel({})
        for pdf in batches:
            for t, n, texts in zip(pdf["token"], pdf["n"], pdf["texts"]):
                if LOST in t or channel.structured(t):
                    continue
                s = [" ", *map(symbol, t), " "]
                for x, y in zip(s, s[1:]):
                    c[x + y] += min(texts, HEAVIEST)
                    seen[x + y] += min(n, HEAVIEST)
        if c:
            yield pd.DataFrame({"pair": list(c), "n": list(c.values()), "seen": list(seen.values())})

    spread = counts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "token")  # few bytes, much work
    model = spread.select("token", "n", "texts").mapInPandas(pairs, "pair string, n bigint, seen bigint").groupBy("pair").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")).collect()  # of some thousand symbols
    seen: Counter = Counter()
    for r in model:
        seen[r["pair"][0]] += r["seen"]
    shared = spark.sparkContext.broadcast(({r["pair"]: r["n"] for r in model}, dict(seen)))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        channel = Channel(*shared.value)
        for pdf in batches:
            rows = [(t, c, kind, gain) for t in pdf["token"] for c, kind, gain in channel.candidates(t)]
            yield pd.DataFrame(rows, columns=["token", "candidate", "kind", "gain"])

    found = spread.select("token").mapInPandas(decode, "token string, candidate string, kind string, gain double")
    words = counts.groupBy(core(F.col("token")).alias("word")).agg(F.sum("n").alias("docs"), F.sum("texts").alias("known"))
    best = F.struct(F.col("score"), F.col("known"), F.col("candidate"))
    odds = F.log(F.col("as_is")) - F.log(MOST_AS_IS * F.greatest("known", F.lit(1)))
    needed = F.greatest(F.when(F.col("known") < LEAST_DOCS, THRESHOLD).otherwise(0.0), F.when(odds > 0.0, odds + THRESHOLD).otherwise(0.0))
    ratio = F.log(F.greatest("known", F.lit(1))) - F.log(F.greatest("as_is", F.lit(1)))
    sure = (F.col("gain") > 1.0) & (F.col("gain") >= needed) | (F.col("gain") + ratio >= THRESHOLD) & (ratio >= THRESHOLD / 2)
    decoded = cut(
        found.withColumn("word", core(F.col("candidate"))).join(words, "word", "left")
        .withColumn("plain", core(F.col("token"))).join(words.select(F.col("word").alias("plain"), F.col("known").alias("as_is")), "plain", "left")
        .withColumn("known", F.coalesce("known", F.lit(0)))
        .where((F.col("kind") != "single") | (F.col("docs") >= LEAST_DOCS) & sure)
        .withColumn("score", F.col("gain") + F.log1p(F.col("known").cast("double")))
        .groupBy("token").agg(F.max(best).alias("x")).where(F.col("x.score") >= THRESHOLD)
        .select("token", F.col("x.candidate").alias("restored"))
    )
    lost = counts.where(F.col("token").contains(LOST)).select("token", pattern(F.col("token")).alias("p"))
    fits = (
        counts.where(~F.col("token").contains(LOST)).join(decoded.select("token"), "token", "left_anti").withColumn("p", pattern(F.col("token")))
        .join(lost.select("p").distinct(), "p", "left_semi")
        .groupBy("p", core(F.col("token")).alias("word")).agg(F.sum("n").alias("n"))
        .groupBy("p").agg(F.max(F.struct("n", "word")).alias("w"))
    )
    filled = lost.join(fits, "p").select("token", F.col("w.word").alias("fit"))

    @F.pandas_udf("string")
    def settled(token: pd.Series, restored: pd.Series, fit: pd.Series) -> pd.Series:
        def one(t: str, r: str, f: str | None) -> str:
            if f is None:
                return r
            inner = edges.sub("", t)
            return t.replace(inner, f, 1) if explains(inner, f) else r

        return pd.Series([one(*x) for x in zip(token, restored, fit)])

    edges = re.compile(f"^[{_EDGE}]+|[{_EDGE}]+$")
    return decoded.join(filled, "token", "left").select("token", F.when(F.col("token").contains(LOST), settled("token", "restored", "fit")).otherwise(F.col("restored")).alias("restored"))


def find(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id of damaged documents, doc_id with its damaged tokens and what they are restored to).

    Documents with NULL or plain ASCII text are never damaged.
    """
    tokens = cut(tokens_of(documents))
    hits = tokens.drop("copy").join(damaged_tokens(tokens), "token")
    return hits.select("doc_id").distinct(), hits


def restore(documents: DataFrame) -> DataFrame:
    """doc_id, restored (text with every damaged token replaced), tokens (distinct ones replaced), open (tokens with bytes still lost)."""
    _, hits = find(documents)
    table = hits.groupBy("doc_id").agg(F.collect_list(F.struct("token", "restored")).alias("pairs"))
    token, edges = re.compile(TOKEN), re.compile(EDGES)

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text, pairs in zip(pdf["doc_id"], pdf["text"], pdf["pairs"]):
                to = {p["token"]: p["restored"] for p in pairs}

                def one(m: re.Match, to: dict = to) -> str:
                    inner = edges.sub("", m.group())
                    return m.group().replace(inner, to[inner], 1) if inner in to else m.group()

                new = token.sub(one, text)
                out.append((doc, new, len(to), new.count(LOST)))
            yield pd.DataFrame(out, columns=["doc_id", "restored", "tokens", "open"])

    return documents.select("doc_id", "text").join(table, "doc_id").mapInPandas(mend, "doc_id bigint, restored string, tokens int, open int")
