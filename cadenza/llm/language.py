"""Languages of transcripts, segments and texts, by character models with calibrated rejection."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.common import bounded_sample, cut, join_spread, table
from cadenza.llm import charlm, speech

#: Most labelled texts that the models are fitted on; they are drawn by a hash of their id.
SAMPLE = 1500
#: Cost of a change of language within a text, and the most that one word can speak for a language.
SWITCH, CAP = 5.0, 4.0
#: Least words in another language for a segment to be listed.
LEAST_WORDS = 4
#: Stands for any language where no labelled text is at hand; nothing is ever in another one then.
NO_LANGUAGE = "und"
#: Distinct words whose scores a worker keeps.
KEPT = 300_000

# Names of the languages, folded to lower case without accents; codes come before a region.
LANGUAGE_NAMES = {
    "pt": ["pt", "por", "portugues", "portuguese", "portugais", "portugiesisch", "brasileiro", "brazilian"],
    "es": ["es", "spa", "espanhol", "espanol", "spanish", "espagnol", "spanisch", "castellano", "castelhano", "castilian"],
    "en": ["en", "eng", "ingles", "english", "anglais", "englisch"],
    "fr": ["fr", "fra", "fre", "frances", "francais", "french", "franzosisch"],
    "de": ["de", "deu", "ger", "alemao", "aleman", "german", "allemand", "deutsch"],
}
_TO_CODE = {name: code for code, names in LANGUAGE_NAMES.items() for name in names}


def normal_code(label: Column) -> Column:
    """Two-letter code of a label in any spelling, with or without a region; NULL if it names no known language."""
    first = F.regexp_extract(speech.fold(F.trim(label)), r"^[^\p{L}]*(\p{L}+)", 1)
    known = F.create_map(*[F.lit(x) for pair in sorted(_TO_CODE.items()) for x in pair])
    return F.element_at(known, first)


def words_of(text: Column) -> Column:
    """Lower-case words of letters, with inner apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+(?:['’]\p{L}+)*"), 0)


#: Hesitation sounds that are words in none of the languages.
_SOUND = re.compile(r"h+u+m+|h+m+|m{2,}|u+h+m*|h+ã+|a+h+n+|é{2,}|e{2,}h+m*|e+h+m+|e+u+h+|h+e+u+|ä+h+m*|ö+h+m*")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def fit(spark: SparkSession, sf_dir: str, *, sample: int = SAMPLE) -> charlm.LanguageModels:
    """Models fitted on the labelled evaluation items and about ``sample`` labelled documents.

    Twice the sample size is the bound of what reaches the driver; everything else the models are used for
    covers all rows.
    """
    items = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("id"), "text", "lang").limit(sample)
    docs = (
        table(spark, sf_dir, "documents").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .select(F.col("doc_id").alias("id"), "text", "lang")
    )
    rows = items.unionAll(bounded_sample(docs, "id", sample)).select(normal_code(F.col("lang")).alias("code"), "text").where("code IS NOT NULL AND text IS NOT NULL").collect()
    return charlm.train([(r["code"], _WORD.findall(r["text"].lower())) for r in sorted(rows)] or [(NO_LANGUAGE, ["-"] * 20)], cap=CAP)


class WordScores:
    """Scores of words, kept over batches: one row a distinct word, one column a language."""

    def __init__(self, models: charlm.LanguageModels, cap: float) -> None:
        self.models, self.cap = models, cap
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.emit = np.zeros((0, len(self.models.names)))
        self.real = np.zeros(0, bool)

    def rows(self, words: list[str]) -> np.ndarray:
        """Row numbers of ``words`` in ``emit``, the log likelihood relative to the best language.

        Words of no language have zeros all along and are not ``real``.
        """
        if len(self.row) > KEPT:
            self.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.row]
        if new:
            score = self.models.scores(new)
            out = self.models.rejected(new, score) | np.array([bool(_SOUND.fullmatch(w)) for w in new], bool)
            rel = np.maximum(score - score.max(axis=1, keepdims=True), -self.cap)
            rel[out] = 0.0
            for w in new:
                self.row[w] = len(self.row)
            self.emit = np.concatenate([self.emit, rel])
            self.real = np.concatenate([self.real, ~out])
        return np.fromiter((self.row[w] for w in words), np.int64, len(words))


def label_words(words: pa.Array, scores: WordScores, switch: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Language number, realness and likelihood row of each word of a list array, and its offsets."""
    words = words.fill_null([]) if words.null_count else words
    flat = words.flatten()
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64))])
    coded = pc.dictionary_encode(flat)
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    rows = scores.rows(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
    emit = scores.emit[rows] if len(rows) else np.zeros((0, len(scores.models.names)))
    return charlm.spans(emit, at, switch), scores.real[rows] if len(rows) else np.zeros(0, bool), emit, at


def count_words(df: DataFrame, text: Column, keys: list[str], models: charlm.LanguageModels, *, switch: float = SWITCH) -> DataFrame:
    """``keys`` and, for each language, ``n_xx`` words and ``m_xx``, how clearly they speak for it.

    The words of a text are cut into spans by a Viterbi path over the models' likelihoods, in which
    one word alone can't change the language: loan words and names stay with their neighbours. On
    that path each span has the language of its lowest cross-entropy a character, every word's excess
    over its best language being bounded by ``CAP``: were another one's lower, the path with it would
    be better. Words of no language count for none. A NULL or empty text has zeros.
    """
    names = models.names
    cost, cap = switch, CAP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(models, cap)
        for batch in batches:
            label, real, emit, at = label_words(batch.column("words"), scores, cost)
            size = len(at) - 1
            owner = np.repeat(np.arange(size), np.diff(at))
            columns = [batch.column(k) for k in keys]
            if len(label):
                rest = emit.copy()
                rest[np.arange(len(label)), label] = -np.inf
                margin = emit[np.arange(len(label)), label] - rest.max(axis=1, initial=-cap)
            for k in range(len(names)):
                own = (label == k) & real
                columns.append(pa.array(np.bincount(owner[own], minlength=size).astype(np.int32)))
                columns.append(pa.array(np.bincount(owner[own], weights=margin[own], minlength=size).astype(np.float64) if len(label) else np.zeros(size)))
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, *[f"{p}_{n}" for n in names for p in ("n", "m")]])

    kinds = dict(df.select(*keys).dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], *[f"n_{n} int, m_{n} double" for n in names]])
    return df.select(*keys, words_of(text).alias("words")).mapInArrow(run, schema)


def _greatest(columns: list[Column]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def _top(names: list[str], prefix: str = "n") -> Column:
    """Struct (words, margin, language) of the language with most words; ties go to the clearer one, then by name."""
    return _greatest([F.struct(F.col(f"{prefix}_{n}").alias("words"), F.col(f"m_{n}").alias("margin"), F.lit(n).alias("language")) for n in names])


def _sure(margin: Column, models: charlm.LanguageModels) -> Column:
    """Calibrated probability that the language with this margin is the right one."""
    return 1.0 / (1.0 + F.exp(-(margin * models.slope + models.offset)))


def segment_languages(segments: DataFrame, models: charlm.LanguageModels) -> DataFrame:
    """Word counts by language of each segment's speech: job_id, segment_id, n_xx, m_xx. Re-delivered rows count once."""
    said = F.when(speech.marked(F.col("text")), speech.let(speech.without_times(F.col("text")), speech.speech_of)).otherwise(F.col("text"))
    rows = segments.select("job_id", "segment_id", "text")
    return count_words(rows, said, ["job_id", "segment_id"], models).dropDuplicates(["segment_id"])


def transcript_languages(segments: DataFrame, models: charlm.LanguageModels) -> tuple[DataFrame, DataFrame]:
    """(main language of each job with its confidence, word counts of each segment).

    The main language is that of most words. Its confidence is the calibrated probability of its words'
    margin times the share of the words that are in it.
    """
    counts = cut(segment_languages(segments, models))
    names = models.names
    total = counts.groupBy("job_id").agg(*[F.sum(f"{p}_{n}").alias(f"{p}_{n}") for n in names for p in ("n", "m")])
    known = [n for n in names if n != NO_LANGUAGE]
    if not known:
        return total.select("job_id", F.lit(None).cast("string").alias("main"), F.lit(0).cast("bigint").alias("words"), F.lit(0.0).alias("confidence")).limit(0), counts
    best = total.select("job_id", _top(names).alias("best"), sum(F.col(f"n_{n}") for n in names).alias("all_words")).where(F.col("best.words") > 0)
    sure = _sure(F.col("best.margin"), models)
    main = best.select("job_id", F.col("best.language").alias("main"), F.col("best.words").alias("words"), (sure * F.col("best.words") / F.col("all_words")).alias("confidence"))
    return main, counts


def mixed_segments(counts: DataFrame, main: DataFrame, models: charlm.LanguageModels, *, least: int = LEAST_WORDS) -> DataFrame:
    """job_id, segment_id, language, words, confidence of segments with ``least`` words in another language than the job's.

    Of several other languages the one with most words is named.
    """
    names = models.names
    maybe = counts.where(sum((F.col(f"n_{n}") >= least).cast("int") for n in names) >= 1)
    other = _greatest([F.when(F.col("main") != n, F.struct(F.col(f"n_{n}").alias("words"), F.col(f"m_{n}").alias("margin"), F.lit(n).alias("language"))) for n in names])
    both = join_spread(maybe, main.select("job_id", "main"), ["job_id"], maybe.groupBy("job_id").agg(F.count("*").alias("n"))).where("main IS NOT NULL")
    rows = both.select("job_id", "segment_id", other.alias("x")).select("job_id", "segment_id", "x.*")
    return rows.where(F.col("words") >= least).select("job_id", "segment_id", "language", "words", _sure(F.col("margin"), models).alias("confidence"))


def wrong_labels(transcripts: DataFrame, main: DataFrame) -> DataFrame:
    """job_id, main, confidence of transcripts whose label is missing, unknown or names another language."""
    labels = transcripts.select("job_id", normal_code(F.col("language")).alias("code")).distinct()
    return labels.join(main, "job_id").where(F.col("code").isNull() | (F.col("code") != F.col("main"))).select("job_id", "main", "confidence")
