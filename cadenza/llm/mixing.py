"""Documents of several sources mixed to target shares of tokens.

A document with a source belongs to it; a classifier fitted on a bounded sample of such rows gives
every other document a calibrated posterior over the domains. Document rates are fitted by
distributed projected-gradient least squares, so that the expected tokens of each domain, posteriors
counted in part, meet its target: all documents of one source have one rate, so their tokens are
summed once, and every pass sums rates times tokens over the documents without a source; only those
sums, a few numbers a mix and domain, come to the driver. Whole copies are then dealt out by error
diffusion within hashed buckets.
"""

from __future__ import annotations

import ast
import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.common import bounded_sample, cut

#: Folder of the public tokenizers' vocabulary files, and the file taken from it.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
#: Labelled rows (twice as many at most) that the classifier is fitted on, and its hashed features.
SAMPLE, FEATURES = 4_000, 2_048
#: Posteriors below this are noise of the classifier and count for nothing.
FAINT = 0.05
#: Relative residual at which the projected gradient stops, and least relative gain of a pass with which it goes on.
CLOSE, PROGRESS = 1e-6, 1e-3
#: Documents of a bucket within which copies are dealt out.
BUCKET = 2_000


def domain(source: Column) -> Column:
    """A source trimmed and in lower case; NULL if blank."""
    return F.nullif(F.lower(F.trim(source)), F.lit(""))


def vocabulary(folder: str = TOKENIZERS, name: str = VOCABULARY) -> tuple[str, bytes]:
    """(pre-tokenizer pattern, rank file) of a public byte-level vocabulary; the folder's module is read, not run."""
    with open(os.path.join(folder, "__init__.py"), encoding="utf-8") as f:
        pattern = next(ast.literal_eval(n.value) for n in ast.parse(f.read()).body if isinstance(n, ast.Assign) and n.targets[0].id == "PATTERN")
    with open(os.path.join(folder, name), "rb") as f:
        return pattern, f.read()


_FORMAT = re.compile(r"[^\W_]+")


def _features(text: str | None, kind: str | None, lang: str | None) -> np.ndarray:
    """Hashed word counts, scaled, with the file format and language label."""
    import zlib

    x = np.zeros(FEATURES, np.float32)
    for w in _FORMAT.findall((text or "").lower()):
        x[zlib.crc32(w.encode()) % (FEATURES - 64)] += 1
    x = np.log1p(x)
    n = float(np.linalg.norm(x))
    if n:
        x /= n
    x[FEATURES - 64 + zlib.crc32(f"f{kind}".encode()) % 32] = 1
    x[FEATURES - 32 + zlib.crc32(f"l{(lang or '')[:2].lower()}".encode()) % 31] = 1
    x[FEATURES - 1] = 1
    return x


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True, initial=0.0))
    return p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)


def fit_classifier(rows: list[tuple[str | None, str | None, str | None, str]], *, steps: int = 150, rate: float = 2.0, decay: float = 1e-4) -> tuple[list[str], np.ndarray]:
    """(domains, weights) of a multinomial logistic regression on (text, format, language, domain).

    The weights are scaled so that posteriors of every fifth row, held out while the scale is fitted, are likeliest.
    """
    names = sorted({r[3] for r in rows})
    if not names:
        return [], np.zeros((FEATURES, 0), np.float32)
    x = np.stack([_features(*r[:3]) for r in rows])
    y = np.zeros((len(rows), len(names)), np.float32)
    y[np.arange(len(rows)), [names.index(r[3]) for r in rows]] = 1

    def fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        w = np.zeros((FEATURES, len(names)), np.float32)
        for _ in range(steps):
            w -= rate * (x.T @ (_softmax(x @ w) - y) / len(x) + decay * w)
        return w

    held = np.arange(len(rows)) % 5 == 4
    scale = 1.0
    if held.sum() >= 10:
        z = x[held] @ fitted(x[~held], y[~held])
        scale = max((2.0**k for k in np.arange(-1, 6.1, 0.25)), key=lambda c: np.log(np.maximum((_softmax(c * z) * y[held]).sum(axis=1), 1e-9)).sum())
    return names, fitted(x, y) * np.float32(scale)


def posteriors(weights: np.ndarray, text: str | None, kind: str | None, lang: str | None) -> np.ndarray:
    z = _features(text, kind, lang) @ weights
    p = np.exp(z - z.max()) if len(z) else z
    return p / p.sum() if len(z) else p


def measured(documents: DataFrame, *, folder: str = TOKENIZERS, name: str = VOCABULARY, sample: int = SAMPLE) -> tuple[list[str], DataFrame]:
    """(domains, doc_id, domain, n_tokens, p): tokens and membership of every document with text.

    ``p`` is NULL for a document with a source, else its posterior over the domains. NULL texts and
    texts without tokens are left out; documents count by doc_id, repeated texts and all.
    """
    spark = documents.sparkSession
    rows = documents.where(F.col("text").isNotNull()).select("doc_id", domain(F.col("source")).alias("domain"), "text", "file_format", "lang")
    drawn = bounded_sample(rows.where("domain IS NOT NULL"), "doc_id", sample).collect()
    names, weights = fit_classifier([(r["text"], r["file_format"], r["lang"], r["domain"]) for r in drawn])
    shared = spark.sparkContext.broadcast((vocabulary(folder, name), weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        (pattern, ranks), w = shared.value
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        encode = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        for batch in batches:
            texts, own = batch.column("text").to_pylist(), batch.column("domain").to_pylist()
            kinds, langs = batch.column("file_format").to_pylist(), batch.column("lang").to_pylist()
            p = [None if d is not None else posteriors(w, t, k, g) for t, d, k, g in zip(texts, own, kinds, langs)]
            tokens = pa.array([len(encode(t)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("domain"), tokens, pa.array(p, pa.list_(pa.float64()))], names=["doc_id", "domain", "n_tokens", "p"])

    kind = dict(documents.dtypes)["doc_id"]
    return names, cut(rows.mapInArrow(run, f"doc_id {kind}, domain string, n_tokens bigint, p array<double>").where("n_tokens > 0"))


def effective_targets(weights: np.ndarray, budget: float, most: np.ndarray) -> np.ndarray:
    """Tokens for each domain: the budget by weights, what a domain can't give going to the others."""
    target, open_ = np.zeros(len(weights)), most > 0
    for _ in range(len(weights) + 1):
        left = budget - target[~open_].sum()
        share = np.where(open_, weights, 0.0)
        if share.sum() <= 0 or left <= 0:
            break
        want = left * share / share.sum()
        over = open_ & (want >= most)
        if not over.any():
            target[open_] = want[open_]
            break
        target[over], open_ = most[over], open_ & ~over
    return target


class Mix:
    """One mix: caps and targets of its domains, and what a part of each domain adds to a document's rate."""

    def __init__(self, mix_id: int, caps: np.ndarray, targets: np.ndarray, pull: np.ndarray) -> None:
        self.mix_id, self.caps, self.targets, self.pull = mix_id, caps, targets, pull

    def membership(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(posteriors among the mix's domains, cap) of documents; one whose likeliest domain isn't in the mix has cap 0."""
        cap = self.caps[p.argmax(axis=1)] if p.shape[1] else np.zeros(len(p))
        own = p * (self.caps > 0) * (p >= FAINT)
        return own / np.maximum(own.sum(axis=1, keepdims=True), 1e-300), cap

    def rates(self, p: np.ndarray, cap: np.ndarray) -> np.ndarray:
        """Rates of documents with membership ``p``, projected on [0, cap]."""
        return np.clip(p @ self.pull, 0.0, cap)

    def sums(self, p: np.ndarray, cap: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Expected tokens of each domain, and below them how they change with ``pull``."""
        r = self.rates(p, cap)
        inside = (r > 0) & (r < cap)
        return np.concatenate([[(tokens * r) @ p], (p * (tokens * inside)[:, None]).T @ p])


def _posteriors(batch: pa.RecordBatch, size: int) -> np.ndarray:
    p = np.zeros((batch.num_rows, size))
    flat = batch.column("p").flatten().to_numpy(zero_copy_only=False)
    if len(flat):
        p[:, : len(flat) // batch.num_rows] = flat.reshape(batch.num_rows, -1)
    return p


def fit_rates(soft: DataFrame, supply: np.ndarray, mixes: list[Mix]) -> None:
    """Projected gradient until it is converged; sets the ``pull`` of ``mixes``.

    ``soft``: n_tokens, p of the documents without a source; ``supply``: tokens of each domain's own
    documents. Minimised is the squared difference of expected and wanted tokens over rates projected
    on [0, cap]; a step is the residual in the metric of the tokens that can still move, halved as
    long as it makes the residual larger. A mix is done when its residual is ``CLOSE`` to nothing or
    steps gain less than ``PROGRESS`` of it, as when its caps admit no more.
    """
    size = len(supply)
    shape = (len(mixes), 1 + size, size)

    def distributed() -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                p, t = _posteriors(batch, size), batch.column("n_tokens").to_numpy(zero_copy_only=False).astype(float)
                for i, m in enumerate(mixes):
                    total[i] += m.sums(*m.membership(p), t)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"k": at, "v": total.ravel()[at]})

        out = np.zeros(int(np.prod(shape)))
        for r in soft.select("n_tokens", "p").mapInArrow(run, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            out[r["k"]] = r["v"]
        return out.reshape(shape)

    some = not soft.isEmpty()
    best = [(np.inf, m.pull, m.pull) for m in mixes]  # residual, pull and the step that led on from there
    stuck = [0] * len(mixes)
    open_ = set(range(len(mixes)))
    while open_:
        total = distributed() if some else np.zeros(shape)
        for k in sorted(open_):
            m = mixes[k]
            held, slope = np.split(total[k] + m.sums(*m.membership(np.eye(size)), supply), [1])
            residual = m.targets - held[0]
            left = float(np.sqrt((residual**2).sum()))
            if left <= CLOSE * max(1.0, m.targets.sum()):
                open_.discard(k)
                continue
            if left < best[k][0] * (1 - PROGRESS):
                stuck[k] = 0
                damp = np.diag(1e-3 * np.maximum(supply, 1.0))
                best[k] = (left, m.pull, np.linalg.solve(slope + damp, residual))
            else:
                stuck[k] += 1
                best[k] = (best[k][0], best[k][1], best[k][2] / 4)
            m.pull = best[k][1] + (best[k][2] if stuck[k] < 5 else 0.0)
            if stuck[k] == 5:
                open_.discard(k)


def mix(documents: DataFrame, targets: DataFrame, *, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """mix_id, doc_id, source, n_tokens, copies of every document that a mix takes, ``copies`` times each.

    Shares are relative weights. A mix's size is ``budget_ratio`` of the tokens of all documents with
    a source. Documents without a source count for each domain in proportion to their posterior among
    the mix's domains; ``source`` names the likeliest. A target without documents, or with too few for
    its cap, gives what it can, and the rest goes to the others by their weights, who may then fall
    short themselves. No document is taken more than the ``max_repeats`` of its (likeliest) source in
    that mix, and none whose likeliest source the mix doesn't have. Targets with NULL or non-positive
    shares or caps count as absent. With no documents or no targets the result is empty.
    """
    names, docs = measured(documents, folder=folder, name=name)
    held = {r["domain"]: (r["tokens"], r["n"]) for r in docs.where("domain IS NOT NULL").groupBy("domain").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).collect()}
    # Domains of the classifier come first, in its order; then those that its sample missed.
    names = names + sorted(set(held) - set(names))
    supply = np.array([held.get(n, (0, 0))[0] for n in names], float)
    rows = targets.select("mix_id", domain(F.col("source")).alias("source"), "target_share", "max_repeats", "budget_ratio").where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").orderBy("mix_id", "source").collect()
    most = F.array_position("p", F.array_max("p")).cast("int")
    likeliest = F.element_at(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.nullif(most, F.lit(0)))
    soft = cut(docs.where("domain IS NULL").select("doc_id", "n_tokens", "p", likeliest.alias("domain")).where("domain IS NOT NULL"))
    # What the documents without a source can give to the domain that is likeliest theirs; others get no more than its share of them.
    sums = {r["domain"]: (r["tokens"], r["n"]) for r in soft.groupBy("domain").agg(F.sum(F.col("n_tokens") * F.array_max("p")).alias("tokens"), F.count("*").alias("n")).collect()}
    counts = {k: n for k, (_, n) in sums.items()}
    spare = np.array([sums.get(n, (0, 0))[0] for n in names], float)
    mixes = []
    for mix_id in sorted({r["mix_id"] for r in rows}):
        own = [r for r in rows if r["mix_id"] == mix_id]
        weight, caps = np.zeros(len(names)), np.zeros(len(names))
        for r in own:
            if r["source"] in held:
                k = names.index(r["source"])
                weight[k] += r["target_share"]
                caps[k] = max(caps[k], r["max_repeats"])
        budget = max((r["budget_ratio"] or 0.0) for r in own) * float(supply.sum())
        wanted = effective_targets(weight, budget, (supply + spare) * caps)
        mixes.append(Mix(mix_id, caps, wanted, wanted / np.maximum(supply + spare, 1.0)))
    if mixes and supply.sum():
        fit_rates(soft, supply, mixes)
    size, ids = len(names), [m.mix_id for m in mixes]
    plain = np.array([m.rates(*m.membership(np.eye(size))) for m in mixes]).reshape(len(mixes), size)
    kind = dict(documents.dtypes)["doc_id"]

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _posteriors(batch, size)
            r = np.array([m.rates(*m.membership(p)) for m in mixes]).reshape(len(mixes), len(p))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "domain", "n_tokens")], pa.array(list(r.T), pa.list_(pa.float64()))], names=["doc_id", "domain", "n_tokens", "r"])

    of = F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (n, F.array(*[F.lit(float(v)) for v in plain[:, k]]).cast("array<double>"))]) if names else F.lit(None).cast("map<string,array<double>>")
    buckets = lambda n: F.create_map(*[F.lit(x) for k, c in n.items() for x in (k, -(-c // BUCKET))]) if n else F.create_map(F.lit(""), F.lit(1))
    hard = docs.where("domain IS NOT NULL").select("doc_id", "domain", "n_tokens", F.element_at(of, F.col("domain")).alias("r"), F.lit(False).alias("soft"), F.element_at(buckets({k: c for k, (_, c) in held.items()}), F.col("domain")).alias("m"))
    some = soft.mapInArrow(rated, f"doc_id {kind}, domain string, n_tokens bigint, r array<double>").select("*", F.lit(True).alias("soft"), F.element_at(buckets(counts), F.col("domain")).alias("m"))
    dealt = (
        hard.unionByName(some).withColumn("u", F.pmod(F.xxhash64("doc_id"), F.col("m")))
        .groupBy("domain", "soft", "u").agg(F.sort_array(F.collect_list(F.struct(F.col("n_tokens").alias("t"), "doc_id", "r")), asc=False).alias("x"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, x in zip(pdf["domain"], pdf["x"]):
                out = []
                for i, mix_id in enumerate(ids):
                    due = done = 0.0
                    for e in x:
                        t, r = e["t"], e["r"][i]
                        copies = int(r + 1e-9)
                        due, done = due + r * t, done + copies * t
                        if r - copies > 1e-9 and done + t / 2 <= due:
                            copies, done = copies + 1, done + t
                        if copies:
                            out.append((mix_id, e["doc_id"], d, t, copies))
                yield pd.DataFrame(out, columns=["mix_id", "doc_id", "source", "n_tokens", "copies"])

    return dealt.mapInPandas(run, f"mix_id int, doc_id {kind}, source string, n_tokens bigint, copies int")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_id, source, target_share (of 1), tokens, actual_share, documents, most_copies for each target, reached or not."""
    got = mixed.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    whole = got.groupBy("mix_id").agg(F.sum("tokens").alias("all_tokens"))
    wanted = targets.select("mix_id", domain(F.col("source")).alias("source"), "target_share", "max_repeats").where("source IS NOT NULL AND target_share > 0")
    norm = wanted.groupBy("mix_id").agg(F.sum("target_share").alias("all_shares"))
    return (
        wanted.join(norm, "mix_id").join(got, ["mix_id", "source"], "left").join(whole, "mix_id", "left")
        .select(
            "mix_id", "source", F.round(F.col("target_share") / F.col("all_shares"), 6).alias("target_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"), F.coalesce("documents", F.lit(0)).alias("documents"),
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats",
        )
    )
