"""Containers of fixed capacity filled by linear grouping and configurations.

Sizes are whole numbers up to the capacity, so a group's items are planned as counts of sizes: a plan
holds at most one entry a size, however many items there are. The large sizes are cut into groups of
equal cardinality, each rounded up to its largest. A linear programme over the configurations of the
few rounded sizes (revised simplex, every configuration priced at once) says how often each
configuration is used; its integral part, and then the fullest configurations that the remaining
items allow, are filled with actual sizes, the same filling as often as the counts allow. The small
sizes go where they leave the least room. Items then take the places of their size in order.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.common import cut

#: Sizes over this part of the capacity are large.
LARGE = 1 / 7
#: Groups of equal cardinality.
GROUPS = 12
#: Ways the items of one size are spread while they are numbered.
SALTS = 256


def configurations(sizes: np.ndarray, capacity: int, counts: np.ndarray) -> np.ndarray:
    """All maximal ways to fill a container with rounded sizes, largest first, one row each, none beyond ``counts``.

    With ``GROUPS`` sizes, none of which fits more than six times, there are under 19 000.
    """
    rows: list[list[int]] = []

    def grow(k: int, room: int, row: list[int]) -> None:
        if k == len(sizes):
            if any(row):
                rows.append(row)
            return
        fit = min(int(room // sizes[k]), int(counts[k]))
        for n in range(fit, -1, -1):
            if n == 0 and fit and k == len(sizes) - 1:
                break  # room for one more of the smallest: not maximal
            grow(k + 1, room - n * int(sizes[k]), [*row, n])

    grow(0, capacity, [])
    return np.array(rows, np.int64).reshape(len(rows), len(sizes))


def fractional(configs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices of configurations, how often each is used) of a basic optimum that covers ``counts``."""
    k = len(counts)
    columns = np.eye(k)
    for i in range(k):  # start from containers with one size each, as many of it as fit
        columns[i, i] = max(1, configs[:, i].max())
    basis, index = columns.copy(), np.full(k, -1)
    for _ in range(50 * k + 50):
        inverse = np.linalg.inv(basis)
        price = np.ones(k) @ inverse
        gain = configs @ price
        best = int(gain.argmax())
        if gain[best] <= 1 + 1e-9:
            break
        x, step = inverse @ counts, inverse @ configs[best]
        ratio = np.where(step > 1e-12, x / np.where(step > 1e-12, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out], index[out] = configs[best], best
    return index, np.linalg.inv(basis) @ counts


class Filling:
    """Containers filled alike: how many, how often each size stands in one, and the room left."""

    def __init__(self, n: int, sizes: dict[int, int], room: int) -> None:
        self.n, self.sizes, self.room = n, sizes, room


class _Large:
    """Counts of the large sizes in groups of equal cardinality."""

    def __init__(self, stock: list[tuple[int, int]]) -> None:
        per = -(-sum(n for _, n in stock) // GROUPS)
        self.groups: list[list[list[int]]] = [[]]
        room = per
        for size, n in stock:  # largest first
            while n:
                if not room:
                    self.groups.append([])
                    room = per
                part = min(n, room)
                self.groups[-1].append([size, part])
                n, room = n - part, room - part
        self.first = [0] * len(self.groups)
        self.places: dict[int, list[tuple[int, int]]] = {}
        for k, g in enumerate(self.groups):
            for j, (size, _) in enumerate(g):
                self.places.setdefault(size, []).append((k, j))
        self.alive = sorted(self.places)

    def counts(self) -> np.ndarray:
        return np.array([sum(n for _, n in g) for g in self.groups])

    def rounded(self) -> np.ndarray:
        return np.array([g[0][0] for g in self.groups])

    def _free(self, used: Counter, k: int, j: int) -> int:
        return self.groups[k][j][1] - used[k, j]

    def filling(self, row: np.ndarray, capacity: int) -> tuple[Counter, int]:
        """((group, place) with how often it is used, room left) of one container by a configuration; its last slot, and what room rounding left, get the best fit."""
        used: Counter = Counter()
        room = capacity
        slots = [k for k, n in enumerate(row) for _ in range(int(n))]
        for k in slots[:-1] or slots:
            g, j = self.groups[k], self.first[k]
            while j < len(g) and not self._free(used, k, j):
                j += 1
            if j < len(g) and g[j][0] <= room:
                used[k, j] += 1
                room -= g[j][0]
        at = bisect_right(self.alive, room) - 1
        while at >= 0:
            size = self.alive[at]
            place = next((p for p in self.places[size] if self._free(used, *p)), None) if size <= room else None
            if place is None:
                at = min(at - 1, bisect_right(self.alive, room) - 1)
                continue
            used[place] += 1
            room -= size
        return used, room

    def take(self, used: Counter, times: int) -> int:
        """Use a filling as often as the counts allow, at most ``times``; how often that was."""
        n = min(times, min(self.groups[k][j][1] // m for (k, j), m in used.items()))
        for (k, j), m in used.items():
            self.groups[k][j][1] -= n * m
            size = self.groups[k][j][0]
            if not self.groups[k][j][1]:
                while self.first[k] < len(self.groups[k]) and not self.groups[k][self.first[k]][1]:
                    self.first[k] += 1
                if not any(self.groups[a][b][1] for a, b in self.places[size]) and size in self.places:
                    at = bisect_left(self.alive, size)
                    if at < len(self.alive) and self.alive[at] == size:
                        del self.alive[at]
        return n


def _large(stock: list[tuple[int, int]], capacity: int) -> list[Filling]:
    large = _Large(stock)
    rounded, out = large.rounded(), []
    configs = configurations(rounded, capacity, large.counts())

    def use(row: np.ndarray, times: int) -> None:
        while times and large.alive:
            used, room = large.filling(row, capacity)
            n = large.take(used, times)
            sizes: Counter = Counter()
            for (k, j), m in used.items():
                sizes[large.groups[k][j][0]] += m
            out.append(Filling(n, dict(sizes), room))
            times -= n

    index, times = fractional(configs, large.counts().astype(float))
    planned = sorted(((configs[c] @ rounded, c, int(t + 1e-9)) for c, t in zip(index, times) if c >= 0), key=lambda x: (-x[0], x[1]))
    for _, c, t in planned:
        use(configs[c], t)
    weight = configs @ rounded
    while large.alive:  # what the integral part leaves: the fullest configuration that the items allow
        left = large.counts()
        allowed = (configs <= left).all(axis=1)
        row = configs[np.where(allowed, weight, -1).argmax()] if allowed.any() else np.eye(len(left), dtype=np.int64)[int(np.flatnonzero(left)[0])]
        used, _ = large.filling(row, capacity)
        use(row, max(1, min((large.groups[k][j][1] // m for (k, j), m in used.items()), default=1)))
    return out


def fill(stock: dict[int, int], capacity: int) -> list[Filling]:
    """Containers for ``stock`` (size: how many); sizes from 0 to ``capacity``.

    The number of different fillings is in proportion to the number of different sizes.
    """
    order = sorted((x for x in stock.items() if x[1] > 0 and x[0] > 0), reverse=True)
    if not stock or not sum(stock.values()):
        return []
    if sum(s * n for s, n in order) <= capacity:  # one configuration holds everything
        return [Filling(1, {s: n for s, n in stock.items() if n > 0}, capacity - sum(s * n for s, n in order))]
    out = _large([x for x in order if x[0] > capacity * LARGE], capacity) if order[0][0] > capacity * LARGE else []
    free = sorted((f.room, k) for k, f in enumerate(out))

    def add(f: Filling) -> None:
        out.append(f)
        insort(free, (f.room, len(out) - 1))

    for size, n in [x for x in order if x[0] <= capacity * LARGE]:
        while n:
            at = bisect_left(free, (size, -1))
            if at == len(free):
                add(Filling(-(-n // (capacity // size)), {}, capacity))
                continue
            # A container goes on taking this size until it is full: no other has less room.
            room, k = free.pop(at)
            f, each = out[k], min(room // size, n)
            filled = min(f.n, n // each)
            if f.n > filled:  # the others stay as they are
                add(Filling(f.n - filled, dict(f.sizes), room))
            f.n, f.room = filled, room - each * size
            f.sizes[size] = f.sizes.get(size, 0) + each
            insort(free, (f.room, k))
            n -= filled * each
    if stock.get(0):
        first = out[0]
        if first.n > 1:
            out.append(Filling(first.n - 1, dict(first.sizes), first.room))
            first.n = 1
        first.sizes[0] = stock[0]
    return out


def places(fillings: list[Filling], capacity: int) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """(for each size, places in order: rank of the first item, items a container, first container, load; number of containers)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    begun: Counter = Counter()
    container = 0
    for f in fillings:
        for size, m in f.sizes.items():
            out.setdefault(size, []).append((begun[size], m, container, capacity - f.room))
            begun[size] += m * f.n
        container += f.n
    return out, container


def _joined(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
    """Equi-join in which NULL equals NULL."""
    named = right.withColumnsRenamed({c: f"_{c}" for c in on})
    return left.join(named, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]).drop(*[f"_{c}" for c in on])


def pack(items: DataFrame, *, group: str, item: str, size: str, capacity: str) -> DataFrame:
    """``group``, ``item``, part, parts, start_char, chars, container, capacity, container_chars, fill.

    Each group and capacity is packed by itself, as a whole. Containers are numbered from 0 within a
    group, one capacity after the other. Items over the capacity are cut into full parts and a
    remainder that is packed like an item. Items without a size or a positive capacity are in no
    container: ``container``, ``container_chars`` and ``fill`` are NULL; items of size 0 are packed.
    The result does not depend on the order of the rows.
    """
    rows = items.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(size).cast("bigint").alias("n"), F.col(capacity).cast("int").alias("cap"))
    sized = F.coalesce((F.col("n") >= 0) & (F.col("cap") > 0), F.lit(False))
    names = ["g", "i", "part", "parts", "start_char", "chars"]
    last = F.greatest(F.ceil(F.col("n") / F.col("cap")).cast("int") - 1, F.lit(0))
    parts = (
        rows.where(sized).select("g", "i", "n", "cap", (last + 1).alias("parts"), F.explode(F.sequence(F.lit(0), last)).alias("part"))
        .select("g", "i", "part", "parts", "cap", (F.col("part").cast("bigint") * F.col("cap")).alias("start_char"), F.least(F.col("cap"), F.col("n") - F.col("part").cast("bigint") * F.col("cap")).cast("int").alias("chars"))
        .withColumn("salt", F.pmod(F.xxhash64("i", "part"), F.lit(SALTS)).cast("int"))
    )
    parts = cut(parts)
    counted = cut(parts.groupBy("g", "cap", "chars", "salt").agg(F.count("*").alias("n")))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done: list[tuple] = []
            for g, cap, x in zip(pdf["g"], pdf["cap"], pdf["x"]):
                where, all_ = places(fill({int(e["chars"]): int(e["n"]) for e in x}, int(cap)), int(cap))
                done += [(g, cap, all_, s, p) for s, p in where.items()]
            yield pd.DataFrame(done, columns=["g", "cap", "containers", "chars", "places"])

    schema = f"g {kinds['g']}, cap int, containers bigint, chars int, places array<struct<rank:bigint,each:bigint,first:bigint,load:int>>"
    stock = counted.groupBy("g", "cap", "chars").agg(F.sum("n").alias("n"))
    # A fixed number of partitions: by bytes the groups are small, by work they are not.
    spread = stock.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g", "cap")
    plan = cut(spread.groupBy("g", "cap").agg(F.collect_list(F.struct("chars", "n")).alias("x")).mapInPandas(run, schema))
    by_cap = Window.partitionBy("g").orderBy("cap").rowsBetween(Window.unboundedPreceding, -1)
    offsets = plan.select("g", "cap", "containers").distinct().select("g", "cap", F.coalesce(F.sum("containers").over(by_cap), F.lit(0)).alias("offset"))
    salted = counted.select(
        "g", "cap", "chars", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("g", "cap", "chars").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    )
    placed = _joined(plan.drop("containers"), offsets, "g", "cap")
    table = _joined(salted, placed, "g", "cap", "chars")
    numbered = parts.withColumn("k", F.row_number().over(Window.partitionBy("g", "cap", "chars", "salt").orderBy("i", "part")))
    both = _joined(numbered, table, "g", "cap", "chars", "salt").withColumn("rank", F.col("k") - 1 + F.col("base"))
    place = F.element_at(F.filter("places", lambda p: p["rank"] <= F.col("rank")), -1)
    out = both.withColumn("p", place).select(
        *names, (F.expr("p.first + (rank - p.rank) div p.each") + F.col("offset")).alias("container"), F.col("cap").alias("capacity"),
        F.col("p.load").alias("container_chars"), (F.col("p.load") / F.col("cap")).alias("fill"),
    )
    none = rows.where(~sized).select(
        "g", "i", F.lit(0).alias("part"), F.lit(1).alias("parts"), F.lit(0).cast("bigint").alias("start_char"), F.col("n").cast("int").alias("chars"),
        F.lit(None).cast("bigint").alias("container"), F.col("cap").alias("capacity"), F.lit(None).cast("int").alias("container_chars"), F.lit(None).cast("double").alias("fill"),
    )
    return out.unionByName(none).withColumnsRenamed({"g": group, "i": item})
