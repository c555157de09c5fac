"""Broken request and response pairs, each with its kind of defect.

Answers that have nothing in common with their request are compared with each other: their openings
are clustered by MinHash, similar pairs verified, and what recurs across unrelated requests without
being speech is a refusal template. An answer that is far shorter than its request and no speech
either is none of its renderings and declines too, so that a template need not recur in small tables.
The other kinds are found pair by pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.common import cut
from cadenza.llm import charlm, language, leakage, speech

#: Share of an answer's three-word sequences that its request must hold for the two to be related.
RELATED = 0.3
#: Requests across which an opening must recur to be a template, at least and as a share of all with unrelated answers, and share of an answer that templates must explain.
LEAST_PROMPTS, PROMPT_SHARE, EXPLAINED = 3, 0.001, 0.4
#: Words of an answer as a part of its request's below which it is no rendering of all of it.
WHOLE = 0.7
#: Most words of a placeholder for no content.
PLACEHOLDER = 2
#: Share of an opening's sequences that may occur in requests; speech in another language has more.
SPOKEN = 0.55
#: Words of an opening, words of a shingle, similarity of one template's openings, hash functions a band, bands.
OPENING, SHINGLE, SIMILAR, ROWS, BANDS = 16, 5, 0.8, 4, 24
#: Part of the request's words at its end that must be missing for an answer to be truncated.
TAIL = 0.1

_TAGS = re.compile(r"</?[A-Za-z_][^<>]*>|```\w*|\*\*|__")
_ENDS = re.compile(r"[.?!…](?=[\s\"”’»)\]]|$)")
_REMARK = re.compile(r"\[[^\]]*\]|\([^()]*\)")
_HESITATION = re.compile(r"(?:h+u*m+|u+h+m*|h+a+n*|a+h+n*|e{2,}|e+h+m*|m{2,}|e+u+h+|h+e+u+|o+h+m*|a+h+m*)")


def _is_empty(text: str | None, request: str | None = None) -> bool:
    """Whether an answer holds no content: nothing but marks, tags and remarks, or a word or two that stand for nothing.

    What the request says too is content, and so is any answer to a request that is about as short.
    """
    said = leakage.words(_TAGS.sub(" ", text.replace("\u200b", ""))) if text else []
    if not said:
        return True
    asked = leakage.words(_TAGS.sub(" ", request)) if request else []
    if 2 * sum(w in asked for w in said) > len(said) or len(said) >= WHOLE * len(asked):
        return False
    return len(said) <= PLACEHOLDER or not leakage.words(_REMARK.sub(" ", _TAGS.sub(" ", text)))


def _content(text: str) -> list[str]:
    """Words without labels, tags and hesitation sounds."""
    return [w for w in leakage.words(_TAGS.sub(" ", text)) if not _HESITATION.fullmatch(w)]


def _related(answer: list[str], request: list[str]) -> float:
    """Share of the answer's three-word sequences that the request holds."""
    n = min(3, len(answer))
    if not n:
        return 0.0
    there = {tuple(request[i : i + n]) for i in range(len(request) - n + 1)}
    own = [tuple(answer[i : i + n]) for i in range(len(answer) - n + 1)]
    return sum(g in there for g in own) / len(own)


def missing_tail(request: list[str], answer: list[str]) -> float:
    """Part of the request's words, at its end, to which nothing in the answer corresponds.

    The answer is aligned as a whole with every beginning of the request; what stands behind the
    best one is missing.
    """
    n = len(request)
    if not n or not answer:
        return 1.0 if n else 0.0
    if answer[-3:] == request[-3:] and len(answer) >= 0.9 * n:
        return 0.0
    number: dict[str, int] = {}
    r = np.array([number.setdefault(w, len(number)) for w in request])
    index = np.arange(n + 1)
    row = -index.astype(np.int64)  # request words left out before the first answer word
    for w in answer:
        k = number.get(w, -1)
        now = row - 1
        now[1:] = np.maximum(now[1:], row[:-1] + np.where(r == k, 2, -1))
        row = np.maximum.accumulate(now + index) - index
    return (n - int(row.argmax())) / n


def is_copy(request: str, answer: str) -> bool:
    """Whether an unpunctuated request came back unrevised but for case, white space, a lead-in or markup.

    What surrounds it is short if it has at most 15 words, or fewer than the request itself.
    """
    if _ENDS.search(request):
        return False
    r = leakage.words(request)
    body = _TAGS.sub(" ", answer)
    a = leakage.words(body)
    if not r or len(a) < len(r) or len(a) - len(r) > max(15, len(r) - 1):
        return False
    for k in range(len(a) - len(r) + 1):
        if a[k : k + len(r)] == r:
            break
    else:
        return False
    # Marks count only inside the part that is the request.
    tokens = list(re.finditer(r"[^\W_]+", body))
    raw = leakage.words(request)
    first = next((t.start() for i, t in enumerate(tokens) if leakage.words(t.group()) == raw[:1] and [w for x in tokens[i : i + 3] for w in leakage.words(x.group())] == raw[:3]), 0)
    inside = body[first:]
    tail = len(a) - k - len(r)
    if tail:
        inside = inside[: [t.start() for t in re.finditer(r"[^\W_]+", inside)][-tail]] if tail < len(tokens) else inside
        inside = inside.rstrip(" \n\t.-—*\"'")
    return not re.search(r"[.?!…](?=\s)", inside) and not re.search(r"[?!…]$", inside.rstrip()) and inside.count(",") <= request.count(",")


def examine(pairs: DataFrame, models: charlm.LanguageModels) -> DataFrame:
    """response_id, request_id, related, ratio (of words), empty, foreign (share of the answer's words in another language), tail, copied."""
    names = models.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = language.WordScores(models, language.CAP)
        for batch in batches:
            label_r, _, emit_r, at_r = language.label_words(batch.column("request_words"), scores, language.SWITCH)
            label_a, _, _, at_a = language.label_words(batch.column("answer_words"), scores, language.SWITCH)
            out: dict[str, list] = {k: [] for k in ("related", "ratio", "empty", "foreign", "tail", "copied")}
            for i, (q, a) in enumerate(zip(batch.column("request").to_pylist(), batch.column("answer").to_pylist())):
                empty = _is_empty(a, q)
                request, answer = (_content(q), _content(_REMARK.sub(" ", a))) if not empty else ([], [])
                own = np.bincount(label_r[at_r[i] : at_r[i + 1]], minlength=len(names))
                theirs = np.bincount(label_a[at_a[i] : at_a[i + 1]], minlength=len(names))
                out["related"].append(_related(answer, request))
                out["ratio"].append(len(answer) / max(1, len(request)))
                out["empty"].append(empty)
                out["foreign"].append(float(1 - theirs[own.argmax()] / theirs.sum()) if own.sum() and theirs.sum() else 0.0)
                out["tail"].append(missing_tail(request, answer) if not empty else 1.0)
                out["copied"].append(not empty and is_copy(q, a))
            yield pa.RecordBatch.from_pydict({"response_id": batch.column("response_id"), "request_id": batch.column("request_id"), **{k: pa.array(v, pa.bool_() if k in ("empty", "copied") else pa.float64()) for k, v in out.items()}})

    spoken = lambda c: language.words_of(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?m)^[^:\n]{1,30}:(?=\s)|<[^>]*>", " "))
    rows = pairs.select("response_id", "request_id", "request", "answer", spoken(F.col("request")).alias("request_words"), spoken(F.col("answer")).alias("answer_words"))
    return rows.mapInArrow(run, "response_id bigint, request_id bigint, related double, ratio double, empty boolean, foreign double, tail double, copied boolean")


def plain_words(text: Column) -> Column:
    """Folded words of letters and digits."""
    return F.filter(F.split(speech.fold(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words: Column, n: int) -> Column:
    """Distinct sequences of ``n`` words (all of them as one if there are fewer)."""

    def of(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.concat_ws(" ", *[F.element_at(w, i + k) for k in range(n)]))
        return F.when(F.size(w) >= n, F.array_distinct(many)).otherwise(F.array(F.array_join(w, " ")))

    return speech.let(words, of)


def _linked(rows: DataFrame, similar: float) -> DataFrame:
    """x, y: links of rows to representatives that share a MinHash band with them and are ``similar``.

    Of each band's bucket one row, drawn by a hash that differs from band to band, represents the
    others, so that a bucket of n rows gives n pairs. Rows that are not similar to it get another
    representative in the next round, until none is left.
    """
    sig = F.transform(F.sequence(F.lit(0), F.lit(ROWS * BANDS - 1)), lambda k: F.array_min(F.transform("shingles", lambda s: F.xxhash64(s, k))))
    bands = rows.withColumn("sig", sig).select("id", "shingles", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(F.slice("sig", b * ROWS + 1, ROWS)))).alias("band", "h"))
    left, links = cut(bands), []
    while True:
        first = left.groupBy("band", "h").agg(F.min_by(F.struct("id", "shingles"), F.struct(F.xxhash64("id", "band"), "id")).alias("r"), F.count("*").alias("n")).where("n > 1")
        shared = F.size(F.array_intersect("shingles", "r.shingles"))
        both = left.join(first.hint("merge"), ["band", "h"]).where(F.col("id") != F.col("r.id"))
        tried = cut(both.select("band", "h", "id", "shingles", F.col("r.id").alias("y"), (shared >= similar * (F.size("shingles") + F.size("r.shingles") - shared)).alias("same")))
        links.append(tried.where("same").select(F.col("id").alias("x"), "y").distinct())
        left = tried.where("NOT same").drop("y", "same")
        if left.isEmpty():
            return reduce(DataFrame.unionAll, links).distinct()


def near_classes(texts: DataFrame, *, similar: float = SIMILAR) -> DataFrame:
    """id, class: classes of distinct texts whose shingle sets are ``similar``; input id, shingles.

    Classes are the connected components of the links to representatives (:func:`_linked`): each row
    takes the least class among its neighbours, then the class of that class, until nothing changes.
    """
    links = cut(_linked(texts, similar))
    edges = links.unionAll(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
    alone = texts.select("id").join(edges.select(F.col("x").alias("id")).distinct(), "id", "left_anti").select("id", F.col("id").alias("class"))
    now = cut(edges.select(F.col("x").alias("id")).distinct().select("id", F.col("id").alias("class")))
    while True:
        least = edges.join(now.withColumnRenamed("id", "y"), "y").groupBy(F.col("x").alias("id")).agg(F.min("class").alias("near"))
        hop = cut(now.join(least, "id").select("id", F.col("class").alias("old"), F.least("class", "near").alias("class")))
        far = hop.select(F.col("id").alias("class"), F.col("class").alias("next"))
        then = cut(hop.join(far, "class").select("id", F.col("next").alias("class"), (F.col("next") < F.col("old")).alias("moved")))
        now = then.select("id", "class")
        if then.where("moved").isEmpty():
            return now.unionAll(alone)


def refusals(unrelated: DataFrame, requests: DataFrame) -> DataFrame:
    """response_id of answers that decline; ``unrelated``: response_id, prompt, ratio, answer with nothing of its request.

    An answer declines if templates explain ``EXPLAINED`` of its three-word sequences, or if it is
    shorter than ``WHOLE`` of its request and at most ``SPOKEN`` of it occurs in any request.
    Templates are the classes of openings that recur across ``LEAST_PROMPTS`` different requests and
    ``PROMPT_SHARE`` of all in question, and of which at most ``SPOKEN`` occurs in requests.
    """
    rows = cut(unrelated.withColumn("w", plain_words(F.col("answer"))).select("response_id", "prompt", "ratio", shingles(F.col("w"), 3).alias("threes"), F.array_join(F.slice("w", 1, OPENING), " ").alias("opening")))
    asked = requests.select(F.explode(shingles(plain_words(F.col("text")), 3)).alias("s"))
    seen = cut(asked.join(rows.select(F.explode("threes").alias("s")).distinct(), "s", "left_semi").distinct().withColumn("known", F.lit(1)))
    openings = cut(rows.groupBy("opening").agg(F.min("response_id").alias("id")))
    parts = openings.withColumn("w", F.split("opening", " "))
    classes = near_classes(parts.select("id", shingles(F.col("w"), SHINGLE).alias("shingles")))
    threes = parts.select("id", F.explode(shingles(F.col("w"), 3)).alias("s"))
    spoken = threes.join(seen, "s", "left").groupBy("id").agg(F.avg(F.coalesce("known", F.lit(0))).alias("spoken"))
    member = cut(openings.join(classes, "id").join(spoken, "id"))
    prompts = rows.select("opening", "prompt").distinct().join(member.select("opening", "class"), "opening").groupBy("class").agg(F.countDistinct("prompt").alias("prompts"))
    least = max(LEAST_PROMPTS, PROMPT_SHARE * rows.select("prompt").distinct().count())
    recurring = (
        member.groupBy("class").agg(F.avg("spoken").alias("spoken")).where(F.col("spoken") <= SPOKEN)
        .join(prompts, "class").where(F.col("prompts") >= least)
    )
    known = threes.join(member.select("id", "class"), "id").join(recurring.select("class"), "class", "left_semi").select("s").distinct().withColumn("template", F.lit(1))
    part = lambda c: F.avg(F.coalesce(c, F.lit(0)))
    explained = rows.select("response_id", "ratio", F.explode("threes").alias("s")).join(known, "s", "left").join(seen, "s", "left").groupBy("response_id", "ratio").agg(part("template").alias("part"), part("known").alias("spoken"))
    return explained.where((F.col("part") >= EXPLAINED) | (F.col("ratio") < WHOLE) & (F.col("spoken") <= SPOKEN)).select("response_id")


def defects(requests: DataFrame, responses: DataFrame, models: charlm.LanguageModels) -> DataFrame:
    """response_id, defect of each defective pair; the first that fits of empty, refusal, other_language, truncated, copy.

    Exact repeats count once. Responses without a request, or whose request has no text, are no pairs.
    """
    asked = requests.where(F.col("text").isNotNull()).select("request_id", F.col("text").alias("request")).dropDuplicates(["request_id"])
    given = responses.select("response_id", "request_id", F.col("text").alias("answer")).dropDuplicates(["response_id"])
    pairs = given.join(asked, "request_id")
    seen = cut(examine(pairs, models))
    unrelated = seen.where(~F.col("empty") & (F.col("related") < RELATED)).select("response_id", "ratio")
    alone = unrelated.join(pairs.select("response_id", "answer", F.xxhash64(plain_words(F.col("request"))).alias("prompt")), "response_id")
    declined = refusals(alone, asked.select(F.col("request").alias("text"))).withColumn("declined", F.lit(True))
    kind = (
        F.when(F.col("empty"), "empty").when(F.col("declined"), "refusal").when(F.col("foreign") > 0.5, "other_language")
        .when(F.col("tail") >= TAIL, "truncated").when(F.col("copied"), "copy")
    )
    return seen.join(declined, "response_id", "left").select("response_id", kind.alias("defect")).where(F.col("defect").isNotNull())
