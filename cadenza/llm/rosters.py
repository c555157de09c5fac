"""Who is meant by a label: rosters, phonetic blocks and optimal assignment."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import numpy as np

# Letters that sound alike in the languages at hand share a code; vowels have none.
_SOUND = str.maketrans("bpfvcgjkqxsztdlmnr", "bbvvkkkkksssttlmmr")


def phonetic(token: str) -> str:
    """First letter and consonant classes of a folded token, repeats and vowels left out."""
    coded = token.translate(_SOUND)
    out = [c for i, c in enumerate(coded) if c not in "aeiouyhw" and (i == 0 or coded[i - 1] != c)]
    return coded[:1] + "".join(out)


def block(name: str) -> str:
    """What names that sound alike have in common."""
    return " ".join(phonetic(t) for t in name.split())


def distance(a: str, b: str) -> int:
    """Edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def assign(cost: np.ndarray) -> list[int]:
    """Cheapest one-to-one assignment of rows to columns (shortest augmenting paths); -1 if there are too few columns."""
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = ~used[1:]
            slack = c[i0 - 1] - u[i0] - v[1:]
            better = free & (slack < low[1:])
            low[1:][better], way[1:][better] = slack[better], j0
            j1 = int(np.argmin(np.where(free, low[1:], np.inf))) + 1
            delta = low[j1]
            u[match[used]] += delta
            v[used] -= delta
            low[1:][free] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [-1] * cost.shape[0]
    for j in range(1, m + 1):
        if match[j]:
            if turned:
                out[j - 1] = match[j] - 1
            else:
                out[match[j] - 1] = j - 1
    return out


_FAR = 50.0


def _form(key: str) -> str:
    """How a label names someone: full, initial, single, short."""
    tokens = key.split()
    if any(t.endswith(".") or len(t) == 1 for t in tokens):
        return "initial" if len(tokens) > 1 else "short"
    return "full" if len(tokens) > 1 else "single"


def _cost(key: str, name: str) -> float:
    """How far a label is from a roster name; _FAR if it can't mean it."""
    a, b = key.split(), name.split()
    if _form(key) == "full":
        if len(a) != len(b) or [phonetic(x) for x in a] != [phonetic(x) for x in b]:
            return _FAR
        d = distance(key, name)
        return float(d) if d <= max(1, len(name) // 10) else _FAR
    if _form(key) == "initial":
        if len(a) != len(b):
            return _FAR
        cost = 0.0
        for x, y in zip(a, b):
            if x.endswith(".") or len(x) == 1:
                if not y.startswith(x.rstrip(".")):
                    return _FAR
            elif x != y:
                d = distance(x, y)
                if phonetic(x) != phonetic(y) or d > 1:
                    return _FAR
                cost += d
        return cost
    if _form(key) == "short":
        return 0.0 if any(y.startswith(a[0].rstrip(".")) for y in b) else _FAR
    best = _FAR
    for k, y in enumerate(b):
        if a[0] == y or (phonetic(a[0]) == phonetic(y) and distance(a[0], y) <= 1 and len(y) > 4):
            best = min(best, distance(a[0], y) + 0.1 * k)
    return best


def spellings(counts: dict[str, int]) -> dict[str, str]:
    """For each full name the most frequent of its spellings.

    Within a phonetic block the names that no more frequent one is a spelling of stand for persons;
    the others are assigned to them at the least total distance, one to each person a round.
    """
    blocks: dict[str, list[str]] = defaultdict(list)
    for key in sorted(counts, key=lambda k: (-counts[k], k)):
        blocks[block(key)].append(key)
    out: dict[str, str] = {}
    for names in blocks.values():
        people: list[str] = []
        others: list[str] = []
        for key in names:
            (others if any(_cost(key, p) < _FAR for p in people) else people).append(key)
        out.update({p: p for p in people})
        while others:
            cost = np.array([[_cost(k, p) for p in people] for k in others])
            pairs = [(k, people[j]) for i, (k, j) in enumerate(zip(others, assign(cost))) if j >= 0 and cost[i, j] < _FAR]
            out.update(pairs)
            others = [k for k in others if k not in out]
    return out


def orphans(counts: dict[str, int]) -> list[str]:
    """Labels of one transcript that none of its full names explains."""
    names = set(spellings({k: n for k, n in counts.items() if _form(k) == "full"}).values())
    return sorted(k for k in counts if _form(k) != "full" and all(_cost(k, n) >= _FAR for n in names))


def compositions(labels: list[str]) -> list[tuple[str, str, str]]:
    """(label, other label, full name that both would mean) for labels of one transcript without a full name."""
    out = []
    singles = [k for k in labels if _form(k) == "single"]
    for k in labels:
        if _form(k) == "initial":
            tokens = k.split()
            gaps = [i for i, t in enumerate(tokens) if t.endswith(".") or len(t) == 1]
            if len(gaps) == 1:
                out += [(k, x, " ".join(x if i == gaps[0] else t for i, t in enumerate(tokens))) for x in singles if x.startswith(tokens[gaps[0]].rstrip("."))]
        elif _form(k) == "single":
            out += [(k, x, f"{k} {x}") for x in singles if x != k]
    return out


def resolve(counts: dict[str, int], known: Iterable[str] = ()) -> dict[str, str]:
    """Speaker of each label of one transcript.

    ``counts``: label keys with how often each stands there. ``known``: names of the roster of all
    transcripts that may be meant by two or more labels that no name of this transcript explains. The
    one that explains most of them takes them; an initial and the same surname mean one person even
    if no roster tells who. Labels of one form are assigned to the transcript's names one-to-one at
    the least total distance; within a form two labels never mean one person unless they are
    spellings of each other.
    """
    rank = sorted(counts, key=lambda k: (-counts[k], k))
    out = spellings({k: n for k, n in counts.items() if _form(k) == "full"})
    roster = [k for k in rank if out.get(k) == k]
    open_ = orphans(counts)
    while True:
        of = {n: [k for k in open_ if _cost(k, n) < _FAR] for n in known}
        best = max(of, key=lambda n: (len(of[n]), [-ord(c) for c in n]), default=None)
        if best is None or len(of[best]) < 2:
            break
        roster.append(best)
        out.update({k: best for k in of[best]})
        open_ = [k for k in open_ if k not in out]
    for key in [k for k in open_ if _form(k) == "initial"]:
        same = [k for k in open_ if _form(k) == "single" and k not in out and key.split()[-1] == k]
        if same and key not in out:
            roster.append(key)
            out.update({k: key for k in (key, *same)})
    for key in rank:  # single words that are no part of a full name are names of their own (roles, given names)
        if key not in out and _form(key) == "single" and all(_cost(key, n) >= _FAR for n in roster):
            twin = next((n for n in roster if _form(n) == "single" and phonetic(n) == phonetic(key) and distance(n, key) <= 1 and len(key) > 4), None)
            if twin is None:
                roster.append(key)
            out[key] = twin or key
    for form in ("single", "initial", "short"):
        left = [k for k in rank if k not in out and _form(k) == form]
        if not left or not roster:
            continue
        cost = np.array([[_cost(k, n) for n in roster] for k in left])
        for i, (k, j) in enumerate(zip(left, assign(cost))):
            if j >= 0 and cost[i, j] < _FAR:
                out[k] = roster[j]
        for i, k in enumerate(left):  # more labels than names: the nearest name
            if k not in out and cost[i].min() < _FAR:
                out[k] = roster[int(cost[i].argmin())]
    return out | {k: k for k in rank if k not in out}
