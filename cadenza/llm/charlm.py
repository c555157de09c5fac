"""Interpolated Kneser-Ney character models, one a language, kept in sorted hash arrays.

An n-gram is the 64-bit hash of its characters; each order has one sorted array of hashes with the
interpolated probability beside it and one of contexts with their back-off weight. A whole batch of
distinct words is scored with a few binary searches a character position.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Mapping

import numpy as np

#: Longest n-gram in characters, the leading word boundary included.
ORDER = 5
#: Characters that are scored at once; a longer word is scored alone.
CELLS = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xBF58476D1CE4E5B9)


def _step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Hash of an n-gram prolonged by one character."""
    with np.errstate(over="ignore"):
        x = (h ^ (c + _MIX)) * _MUL
        return x ^ (x >> np.uint64(29))


def encode(words: list[str]) -> np.ndarray:
    """Code points of ' word ' in rows of equal width, 0 behind the end."""
    out = np.zeros((len(words), max(map(len, words), default=0) + 2), dtype=np.uint64)
    for i, w in enumerate(words):
        codes = np.frombuffer((" " + w + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        out[i, : len(codes)] = codes
    return out


def _hash_rows(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that end at each position from n-1 on."""
    span = codes.shape[1] - n + 1
    h = np.full((codes.shape[0], span), n, dtype=np.uint64)
    for k in range(n):
        h = _step(h, codes[:, k : k + span])
    return h


class CharModel:
    """One language's model."""

    def __init__(self, words: Mapping[str, int], alphabet: int = 200) -> None:
        self.alphabet = alphabet
        grams = [Counter() for _ in range(ORDER + 1)]
        for w, count in words.items():
            s = " " + w + " "
            for i in range(1, len(s)):
                grams[min(ORDER, i + 1)][s[max(0, i + 1 - ORDER) : i + 1]] += count
        # Below the top order a count is the number of different characters seen before the n-gram;
        # n-grams that begin at the word boundary have nothing before them and keep their counts.
        for n in range(ORDER, 1, -1):
            for g in list(grams[n]):
                grams[n - 1][g[1:]] += 1
        prob: list[dict[str, float]] = [{} for _ in range(ORDER + 1)]
        back: list[dict[str, float]] = [{} for _ in range(ORDER + 1)]
        for n in range(1, ORDER + 1):
            total, kinds = Counter(), Counter()
            ones = sum(1 for c in grams[n].values() if c == 1)
            twos = sum(1 for c in grams[n].values() if c == 2)
            d = min(0.95, max(0.3, ones / (ones + 2 * twos))) if ones else 0.5
            for g, c in grams[n].items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            for ctx in total:
                back[n][ctx] = d * kinds[ctx] / total[ctx]
            for g, c in grams[n].items():
                lower = (prob[n - 1].get(g[1:]) if n > 1 else 1.0 / alphabet) or self._lower(prob, back, g[1:])
                prob[n][g] = (c - d) / total[g[:-1]] + back[n][g[:-1]] * lower
        self.base = np.log(back[1].get("", 1.0) / alphabet)
        self.probs = [self._sorted(prob[n], n) for n in range(ORDER + 1)]
        self.backs = [self._sorted(back[n], n - 1) for n in range(ORDER + 1)]

    def _lower(self, prob: list[dict], back: list[dict], g: str) -> float:
        weight = 1.0
        while g:
            if g in prob[len(g)]:
                return weight * prob[len(g)][g]
            weight *= back[len(g)].get(g[:-1], 1.0)
            g = g[1:]
        return weight / self.alphabet

    @staticmethod
    def _sorted(table: dict[str, float], n: int) -> tuple[np.ndarray, np.ndarray]:
        if not table or n < 0:
            return np.zeros(0, np.uint64), np.zeros(0)
        codes = np.array([[ord(c) for c in g] for g in table], dtype=np.uint64).reshape(len(table), n)
        h = np.full(len(table), n, dtype=np.uint64)
        for k in range(n):
            h = _step(h, codes[:, k])
        order = np.argsort(h)
        return h[order], np.log(np.fromiter(table.values(), float, len(table)))[order]

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = table
        if not len(keys):
            return np.zeros(h.shape, bool), np.zeros(h.shape)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = keys[at] == h
        return hit, np.where(hit, values[at], 0.0)

    def score(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of each row of :func:`encode`, its end included."""
        rows, width = codes.shape
        out = np.zeros((rows, width - 1))
        open_ = np.ones((rows, width - 1), bool)  # position k scores character k + 1
        for n in range(min(ORDER, width), 0, -1):
            first = max(n - 1, 1)
            h = _hash_rows(codes, n)[:, first - (n - 1) :]
            hit, value = self._find(self.probs[n], h)
            todo = open_[:, first - 1 :]
            out[:, first - 1 :] += np.where(todo & hit, value, 0.0)
            if n > 1:
                _, weight = self._find(self.backs[n], _hash_rows(codes, n - 1)[:, first - (n - 1) : -1])
                out[:, first - 1 :] += np.where(todo & ~hit, weight, 0.0)
            open_[:, first - 1 :] &= ~hit
        out += np.where(open_, self.base, 0.0)
        return np.where(codes[:, 1:] > 0, out, 0.0).sum(axis=1)


class LanguageModels:
    """Models of several languages with a calibrated rejection of words that belong to none.

    ``slope`` and ``offset`` turn the margin of the best language over the others into a probability.
    """

    slope, offset = 1.0, 0.0

    def __init__(self, models: dict[str, CharModel], reject_at: float) -> None:
        self.names = sorted(models)
        self.models = models
        self.reject_at = reject_at

    def scores(self, words: list[str]) -> np.ndarray:
        """Log probabilities, one row a word, one column a language in the order of ``names``."""
        if not words:
            return np.zeros((0, len(self.names)))
        out = np.zeros((len(words), len(self.names)))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        while order:  # words of about the same length together
            longest = bisect_right(order, CELLS, key=lambda i: (len(words[i]) + 2) * len(order))
            part = order[: max(1, min(longest, len(order)))]
            order = order[len(part) :]
            codes = encode([words[i] for i in part])
            if codes.shape[1] <= ORDER:
                codes = np.pad(codes, ((0, 0), (0, ORDER + 1 - codes.shape[1])))
            out[part] = np.stack([self.models[n].score(codes) for n in self.names], axis=1)
        return out

    def rejected(self, words: list[str], scores: np.ndarray) -> np.ndarray:
        """Whether even the best language is less likely a character than the calibrated bound."""
        length = np.array([len(w) + 1 for w in words], float)
        return -scores.max(axis=1, initial=-1e9) / np.maximum(length, 1) > self.reject_at


def train(samples: Iterable[tuple[str, list[str]]], *, rounds: int = 2, keep: float = 0.998, cap: float = 4.0) -> LanguageModels:
    """Fit on ``(language, words of one text)``; labels may be wrong here and there.

    After each round every text goes to the language of its lowest cross-entropy, so that wrongly
    labelled texts train the right model in the next one. The rejection bound is the ``keep``
    quantile of the held-out words' cross-entropy (every tenth text); the same texts calibrate the
    confidence, a word speaking for a language with at most ``cap``.
    """
    data = [(lang, Counter(words)) for lang, words in samples if words]
    labels = [lang for lang, _ in data]
    fit = None
    for _ in range(rounds):
        counts: dict[str, Counter] = {}
        for k, (lang, (_, words)) in enumerate(zip(labels, data)):
            if k % 10 != 9 or len(data) < 50:
                counts.setdefault(lang, Counter()).update(words)
        fit = LanguageModels({lang: CharModel(c) for lang, c in counts.items() if sum(c.values()) >= 20}, 99.0)
        if not fit.names:  # too little text: one model of all there is
            return LanguageModels({lang: CharModel(c) for lang, c in counts.items()}, 99.0)
        vocabulary = sorted(set().union(*(w for _, w in data)))
        row = {w: i for i, w in enumerate(vocabulary)}
        table = fit.scores(vocabulary)
        labels = [
            fit.names[int(np.argmax(sum(table[row[w]] * c for w, c in words.items())))] if len(words) >= 4 else lang
            for lang, (_, words) in zip(labels, data)
        ]
    held = [row[w] for k, (_, words) in enumerate(data) if k % 10 == 9 for w in words] or list(row.values())
    entropy = -table[held].max(axis=1) / np.array([len(vocabulary[i]) + 1 for i in held], float)
    fit.reject_at = float(np.quantile(entropy, keep))
    emit = np.maximum(table - table.max(axis=1, keepdims=True), -cap)
    held_out = [(lab, [row[w] for w in words.elements()]) for k, (lab, (_, words)) in enumerate(zip(labels, data)) if k % 10 == 9 or len(data) < 50]
    fit.slope, fit.offset = calibrated([(fit.names.index(lab), emit[w[a : a + n]]) for lab, w in held_out if lab in fit.names for n in (1, 2, 3, 5, 8) for a in range(0, len(w) - n + 1, n)])
    return fit


def margin(emit: np.ndarray, label: int) -> float:
    """How much the words together speak for ``label`` rather than for any other language."""
    rest = np.delete(emit, label, axis=1)
    return float((emit[:, label] - rest.max(axis=1)).sum()) if rest.shape[1] else 0.0


def calibrated(spans: list[tuple[int, np.ndarray]], *, rounds: int = 30) -> tuple[float, float]:
    """(slope, offset) of the logistic function that gives the chance that a span's best language is the right one.

    ``spans``: language and the words' likelihoods. Fitted by Newton's method with a weak pull to (1, 0).
    """
    x, y = [], []
    for lab, emit in spans:
        best = int(emit.sum(axis=0).argmax())
        x.append(margin(emit, best))
        y.append(best == lab)
    m, hit = np.array(x), np.array(y, float)
    w = np.array([1.0, 0.0])
    a = np.stack([m, np.ones(len(m))], axis=1) if len(m) else np.zeros((0, 2))
    loss = lambda v: np.logaddexp(0, np.where(hit > 0, -1, 1) * (a @ v)).sum() + ((v - [1.0, 0.0]) ** 2).sum() / 2
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - hit) + (w - [1.0, 0.0])
        curve = (a * (p * (1 - p))[:, None]).T @ a + np.eye(2)
        step = np.linalg.solve(curve, gradient)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
    return float(w[0]), float(w[1])


def spans(emit: np.ndarray, at: np.ndarray, switch: float) -> np.ndarray:
    """Best language of each word of many word sequences at once (Viterbi over languages).

    ``emit``: one row a word, all sequences one after the other. ``at``: offsets of the sequences,
    one more than there are. Changing the language within a sequence costs ``switch``.
    """
    size, langs = np.diff(at), emit.shape[1]
    label = np.zeros(len(emit), np.int64)
    order = np.argsort(-size, kind="stable")
    most = int(size.max(initial=0))
    if not most:
        return label
    starts, lengths = at[:-1][order], size[order]
    alive = np.searchsorted(-lengths, -np.arange(1, most + 1), side="right")  # sequences of at least t + 1 words
    back = []
    best = emit[starts[: alive[0]]].copy()
    for t in range(1, most):
        prev = best[: alive[t]]
        top = prev.argmax(axis=1)
        moved = prev[np.arange(len(prev)), top] - switch
        stay = prev >= moved[:, None]
        back.append(np.where(stay, np.arange(langs)[None, :], top[:, None]).astype(np.int8))
        best[: alive[t]] = np.where(stay, prev, moved[:, None]) + emit[starts[: alive[t]] + t]
    state = best.argmax(axis=1)
    for t in range(most - 1, 0, -1):
        k = alive[t]
        label[starts[:k] + t] = state[:k]
        state[:k] = back[t - 1][np.arange(k), state[:k]]
    label[starts[: alive[0]]] = state[: alive[0]]
    return label
