"""Filling containers of fixed capacity with items of varying length.

Only the histogram of lengths (at most one row per length up to the capacity) reaches the driver. The
configuration linear program over it, min sum x_p with sum_p a(p, s) x_p >= n(s) for every length s, is solved
by multiplicative weights. Every phase adds one more demand n to what is still to be served, fills a knapsack
table at the present prices and takes, for each length that waits, the best pattern which holds it, as often as
what waits allows, while patterns are worth nearly as much as the best of the phase. Then the price of each
length grows by a factor that depends on the share of it that waits. The average of all phases is the
fractional solution; the prices, scaled by the table's best value, are a dual solution and so give a lower
bound. Phases end when the two are within ``GAP``, or after ``WORK`` table steps.

The averaged patterns are rounded to whole containers, most used first. What is left over is packed by the same
patterns of highest price, and the few items at the end best-fit from the longest length down.

Items are then matched to the pattern slots of their length by their rank within the length. Ranks are
counted per (length, salt), so that a length which a third of all items share is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 2048
#: Relative gap between fractional solution and dual bound that ends the phases, and steps of knapsack tables (some five seconds) that do so otherwise; how fast prices follow demand; how much less than the best a pattern may be worth at first.
GAP = 0.002
WORK = 1_200_000
RATE = 0.1
LENIENCE = 0.02
#: Items of one length that one task ranks, at most about.
RANK_ROWS = 500_000


@dataclass
class Plan:
    """Slots of the containers. patterns: (first container, containers, {length: items in each})."""

    patterns: list[tuple[int, int, dict[int, int]]]
    containers: int
    lower_bound: int

    def slots(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per length: rank of the first slot of each pattern, its first container, items of the length in each container."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        filled: dict[int, int] = {}
        for first, times, pattern in self.patterns:
            for size, each in pattern.items():
                found.setdefault(size, []).append((filled.get(size, 0), first, each))
                filled[size] = filled.get(size, 0) + each * times
        return {size: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for size, rows in found.items()}


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Unbounded knapsack: highest price per capacity, the length taken last (-1: none), and the steps it took. ``sizes`` ascend."""
    value, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    blocks = int((capacity // sizes).sum())
    if blocks < capacity * 2 // 3:  # few or long lengths: length by length, in blocks within which nothing depends on itself
        for k, (size, price) in enumerate(zip(sizes.tolist(), prices.tolist(), strict=True)):
            for low in range(size, capacity + 1, size):
                high = min(low + size, capacity + 1)
                more = value[low - size : high - size] + price
                better = more > value[low:high] + 1e-12
                value[low:high][better] = more[better]
                taken[low:high][better] = k
        return value, taken, 2 * blocks
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(int(sizes[0]), capacity + 1):
        gains = value[c - sizes[: fits[c]]] + prices[: fits[c]]
        best = int(gains.argmax())
        if gains[best] > value[c - 1]:
            value[c], taken[c] = gains[best], best
        else:
            value[c] = value[c - 1]
    return value, taken, capacity


def _pattern(taken: list[int], sizes: list[int], c: int, first: int) -> dict[int, int]:
    """The best pattern that holds ``first``: that one and the best filling of the remaining capacity c, as counts."""
    counts = {first: 1}
    while c > 0:
        k = taken[c]
        if k < 0:
            c -= 1
        else:
            counts[k] = counts.get(k, 0) + 1
            c -= sizes[k]
    return counts


def _serve(sizes: np.ndarray, prices: np.ndarray, waiting: np.ndarray, order: list[int], capacity: int, least: float | None, lenience: float, whole: bool) -> tuple[dict[tuple[tuple[int, int], ...], float], float, int]:
    """(patterns with how often each is used, best value of the table, steps): one table, and for each length that waits its best pattern, if that is worth ``least`` (or the table's best) but for the lenience. Takes from ``waiting``."""
    active = np.flatnonzero(waiting > 0)
    own = sizes[active]
    value, taken, steps = knapsack(own, prices[active], capacity)
    best = float(value[capacity]) if least is None else least
    worth = (prices[active] + value[capacity - own]) / best
    chain, lengths, ids = taken.tolist(), own.tolist(), active.tolist()
    at = {k: i for i, k in enumerate(ids)}
    used: dict[tuple[tuple[int, int], ...], float] = {}
    for k in order:
        i = at.get(k)
        if i is None or worth[i] < 1 - lenience or waiting[k] <= 0:
            continue
        counts = _pattern(chain, lengths, capacity - lengths[i], i)
        times = min(waiting[ids[j]] / a for j, a in counts.items())
        times = int(times) if whole else float(times)
        if times <= 0:
            continue
        for j, a in counts.items():
            waiting[ids[j]] -= a * times
        key = tuple(sorted((ids[j], a) for j, a in counts.items()))
        used[key] = used.get(key, 0) + times
    return used, best, steps


def fractional(sizes: np.ndarray, demand: np.ndarray, capacity: int, work: int = WORK, gap: float = GAP) -> tuple[dict[tuple[tuple[int, int], ...], float], np.ndarray, float]:
    """(patterns with their fractional use, prices of the best dual solution, dual bound) of the configuration program."""
    draw = np.random.default_rng(0)  # tiny differences between equal prices, so that a phase does not always pick the same filler
    logs = np.log(sizes / capacity)
    bound, prices = float((sizes * demand).sum()) / capacity, np.exp(logs)
    waiting = np.zeros(len(sizes))
    total: dict[tuple[tuple[int, int], ...], float] = {}
    phases, lenience, spent, served = 0, LENIENCE, 0, 0.0
    alone = capacity // sizes
    while True:
        phases += 1
        waiting += demand
        now = np.exp(logs) * (1 + 0.0005 * draw.random(len(sizes)))
        best = None
        while (waiting > 0).any():
            order = np.argsort(-waiting / demand, kind="stable").tolist()
            used, best, steps = _serve(sizes, now, waiting, order, capacity, best, lenience, whole=False)
            if float(now @ demand) / best > bound:  # ``best`` is always that of the phase's first table, in which every length waits
                bound, prices = float(now @ demand) / best, now
            spent += steps + len(sizes) // 4
            for key, times in used.items():
                total[key] = total.get(key, 0.0) + times
                served += times
            waiting[waiting < 1e-9 * demand] = 0
            if not used:
                break
        cost = (served + float((waiting / alone).sum())) / phases
        if cost <= bound * (1 + gap) or spent > work:
            return {key: times / phases for key, times in total.items()}, prices, bound
        share = waiting / demand
        if share.max() < 0.1:
            lenience = max(lenience * 0.8, gap / 8)
        logs += RATE / np.sqrt(phases) * np.clip(share - share.mean(), -1, 1)


def solve(histogram: dict[int, int], capacity: int = CAPACITY, work: int = WORK) -> Plan:
    """Containers for n items of each length (1 .. capacity); the number of items does not matter to its cost."""
    demand = {int(s): int(n) for s, n in histogram.items() if n > 0}
    if not demand:
        return Plan([], 0, 0)
    sizes = np.array(sorted(demand), np.int64)
    left = np.array([demand[s] for s in sizes.tolist()], np.int64)
    use, prices, bound = fractional(sizes, left.astype(np.float64), capacity, work)
    patterns: dict[tuple[tuple[int, int], ...], int] = {}

    def add(key: tuple[tuple[int, int], ...], times: int) -> None:
        patterns[key] = patterns.get(key, 0) + times

    for key, times in sorted(use.items(), key=lambda kv: (-kv[1], kv[0])):
        often = min(int(times + 0.5), *(int(left[k]) // a for k, a in key))
        if often > 0:
            add(key, often)
            for k, a in key:
                left[k] -= a * often
    while (left > 0).any():  # what rounding left over, as long as a pattern of highest price can be filled
        order = sorted(np.flatnonzero(left > 0).tolist(), reverse=True)
        used, _, _ = _serve(sizes, prices, left, order, capacity, None, LENIENCE, whole=True)
        if not used:
            break
        for key, times in used.items():
            add(key, int(times))
    while (left > 0).any():  # the longest first, then whatever fits best
        rest, counts = capacity, []
        for k in np.flatnonzero(left > 0)[::-1].tolist():
            each = min(rest // int(sizes[k]), int(left[k]))
            if each:
                counts.append((k, each))
                rest -= each * int(sizes[k])
        often = min(int(left[k]) // a for k, a in counts)
        add(tuple(sorted(counts)), often)
        for k, a in counts:
            left[k] -= a * often
    made, rows = 0, []
    for key, times in patterns.items():
        rows.append((made, times, {int(sizes[k]): a for k, a in key}))
        made += times
    return Plan(rows, made, int(np.ceil(bound - 1e-6)))


def pieces(items: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, n_pieces, size): an item above the capacity gives full pieces and a remainder, any other one piece."""
    n = F.greatest(F.ceil(F.col(size_col) / F.lit(capacity)), F.lit(1)).cast("int")
    cut = items.select(id_col, F.coalesce(F.col(size_col), F.lit(0)).alias(size_col)).withColumn("n_pieces", n)
    cut = cut.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
    return cut.select(id_col, "piece", "n_pieces", F.when(F.col("piece") < F.col("n_pieces") - 1, F.lit(capacity)).otherwise(F.col(size_col) - F.lit(capacity) * (F.col("n_pieces") - 1)).cast("int").alias("size"))


def ranked(parts: DataFrame, id_col: str, rank_rows: int = RANK_ROWS) -> DataFrame:
    """``parts`` with rank (from 0) among the parts of the same size; needs parts that are written already, as it reads them three times. A size with more than ``rank_rows`` parts is ranked by several tasks."""
    sizes = parts.groupBy("size").agg(F.ceil(F.count("*") / F.lit(rank_rows)).cast("int").alias("salts"))  # at most capacity + 1 rows
    salted = parts.join(F.broadcast(sizes), "size").withColumn("salt", F.pmod(F.xxhash64(id_col, "piece"), F.col("salts")).cast("int")).drop("salts")
    counts = salted.groupBy("size", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("size", "salt", F.coalesce(before, F.lit(0)).alias("before"))  # one row per size and salt
    order = Window.partitionBy("size", "salt").orderBy(id_col, "piece")
    return salted.withColumn("nth", F.row_number().over(order)).join(offsets, ["size", "salt"]).select(id_col, "piece", "n_pieces", "size", (F.col("before") + F.col("nth") - 1).alias("rank"))


def assign(ranks: DataFrame, plan: Plan, id_col: str) -> DataFrame:
    """(id, piece, n_pieces, size, container). Items of size 0 take no room and are dealt out over the containers."""
    slots = ranks.sparkSession.sparkContext.broadcast((plan.slots(), max(1, plan.containers)))  # bounded by patterns x lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = slots.value
        for batch in batches:
            size, rank = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            container = np.empty(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            edges = np.flatnonzero(np.diff(size[order])) + 1
            for group in np.split(order, edges) if len(order) else []:
                s = int(size[group[0]])
                if not s:
                    container[group] = rank[group] % total
                    continue
                start, first, each = table[s]
                k = np.searchsorted(start, rank[group], side="right") - 1
                container[group] = first[k] + (rank[group] - start[k]) // each[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(container)], names=[id_col, "piece", "n_pieces", "size", "container"])

    return ranks.select(F.col(id_col).cast("long"), "piece", "n_pieces", "size", F.col("rank").cast("long")).mapInArrow(run, f"{id_col} long, piece int, n_pieces int, size int, container long")


def histogram_of(parts: DataFrame) -> dict[int, int]:
    """Parts per positive size: at most one row per length up to the capacity."""
    return {r["size"]: r["n"] for r in parts.where("size > 0").groupBy("size").agg(F.count("*").alias("n")).collect()}


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY) -> DataFrame:
    """A container for each item, and for each piece of an item above the capacity.

    ``items`` is read three times and should be written already. A null size counts as 0. Ties in size are
    ordered by id, so the result is the same on every run; repeated ids are separate items only if ``id_col``
    is unique, as ranks of equal (id, piece) are arbitrary between them. An empty table gives an empty result.
    """
    parts = pieces(items, id_col, size_col, capacity)
    return assign(ranked(parts, id_col), solve(histogram_of(parts), capacity), id_col)
