"""Items of varying length into containers of fixed capacity by a configuration linear program.

A configuration is a multiset of lengths that fits one container. The program asks for the fewest containers whose
configurations cover the histogram of lengths. Multiplicative weights price the lengths, and knapsack dynamic programming
finds the best configurations at those prices. The fractional solution is rounded down, what is left is a program of its
own, and so on; once rounding down takes too little, the best configurations at the prices of what is left are taken whole
until nothing is left. The prices also bound from below what any packing needs. All of that sees only the histogram, which
has at most ``capacity`` rows, and items are assigned by their number among those of their length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import materialize, ship

#: How far a configuration may be from the best at the present prices, and the most that a round adds to a length's
#: coverage, in shares of its demand.
NEAR, STEP = 0.05, 0.1
#: Items of one length that are numbered in one task.
PART = 100_000


@dataclass
class Plan:
    """Rows (length, from, to, first container, items a container): which containers the items of a length go to. ``by_program``
    containers come from rounding programs down, the others from taking priced configurations whole. No packing
    has fewer than ``bound`` containers."""

    slots: list[tuple[int, int, int, int, int]]
    containers: int
    by_program: int
    bound: int


class Knapsack:
    """The greatest price of a configuration for each capacity, without bounds on how often a length is taken."""

    def __init__(self, lengths: np.ndarray, prices: np.ndarray, capacity: int):
        lo, hi = int(lengths[0]), int(lengths[-1])
        dense = np.full(hi - lo + 1, -np.inf)
        dense[lengths - lo] = prices
        back = np.zeros(capacity + 1)  # the value of c at capacity - c, so that what is added is contiguous
        chosen = [0] * (capacity + 1)
        room, best = np.empty(hi - lo + 1), 0.0
        for c in range(lo, capacity + 1):
            k = min(c, hi) - lo + 1
            gain = np.add(dense[:k], back[capacity - c + lo : capacity - c + lo + k], out=room[:k])
            i = int(gain.argmax())
            if gain[i] > best:
                best, chosen[c] = gain[i], i + lo
            back[capacity - c] = best
        self.value, self._chosen, self._at = back[::-1], chosen, [0] * (capacity + 1)
        at = 0
        for c in range(capacity + 1):
            at = c if chosen[c] else at
            self._at[c] = at

    def configuration(self, capacity: int) -> dict[int, int]:
        """Length: how often, of the best configuration."""
        out: dict[int, int] = {}
        c = self._at[capacity]
        while c:
            n = self._chosen[c]
            out[n] = out.get(n, 0) + 1
            c = self._at[c - n]
        return out

    def with_length(self, n: int, capacity: int) -> dict[int, int]:
        """The best configuration that has length n."""
        out = self.configuration(capacity - n)
        out[n] = out.get(n, 0) + 1
        return out


def _best_configuration(lengths: np.ndarray, prices: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """A configuration of great price with at most ``most`` of each length: the best without that bound, cut to it, and the
    room this leaves filled in the same way with lengths that are not used up; the best one where nothing is cut."""
    out, room = np.zeros(len(lengths), dtype=np.int64), capacity
    while len(free := np.flatnonzero((out < most) & (lengths <= room))):
        best = np.zeros(len(free), dtype=np.int64)
        for n, a in Knapsack(lengths[free], prices[free], room).configuration(room).items():
            best[np.searchsorted(lengths[free], n)] = a
        taken = np.minimum(best, most[free] - out[free])
        out[free] += taken
        room -= int((taken * lengths[free]).sum())
        if (taken == best).all():
            break
    return out


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int) -> tuple[dict[tuple, float], np.ndarray, float]:
    """Configurations (length and how often) with how often each is used, by multiplicative weights; the coverage of the
    lengths, in shares of their demand; and the greatest bound from prices.

    A length's price is its volume, less the more it is covered. Each round takes the configurations that are NEAR the best
    at the present prices, those of the least covered lengths first, until each of their lengths has gained a step. Prices
    at which no configuration is worth more than 1 make the demand's worth a bound, so each round's prices, scaled by
    the best configuration's, are one.
    """
    demand = dict(zip(lengths.tolist(), counts.tolist()))
    covered = np.zeros(capacity + 1)
    found: dict[tuple, float] = {}
    bound = 0.0
    for r in range(rounds):
        step = STEP * min(1.0, 2.2 - 2 * r / rounds)  # smaller in the second half
        prices = lengths / capacity * np.exp(covered[lengths].min() - covered[lengths])
        sack = Knapsack(lengths, prices, capacity)
        top = sack.value[capacity]
        bound = max(bound, float(counts @ prices) / top)
        reach = prices + sack.value[capacity - lengths]
        near = np.flatnonzero(reach >= (1 - NEAR) * top)
        gained: dict[int, float] = {}
        for n in [int(lengths[reach.argmax()]), *lengths[near[np.argsort(covered[lengths[near]], kind="stable")]].tolist()]:
            if n in gained:
                continue
            a = sack.with_length(n, capacity)
            times = min((step - gained.get(m, 0.0)) * demand[m] / k for m, k in a.items())
            if times > 0:
                for m, k in a.items():
                    gained[m] = gained.get(m, 0.0) + k * times / demand[m]
                key = tuple(sorted(a.items()))
                found[key] = found.get(key, 0.0) + times
        for n, g in gained.items():
            covered[n] += g
    return found, covered[lengths], bound


def _simple_bound(counts: dict[int, int], capacity: int) -> int:
    """The volume, and prices in steps of 1/k: of lengths over a (k+1)-th of the capacity at most k fit side by side."""
    best = -(-sum(n * c for n, c in counts.items()) // capacity)
    for k in range(1, 20):
        # An exact multiple of capacity / (k + 1) keeps its volume, any other length is worth whole steps only.
        worth = {n: n * k if n * (k + 1) % capacity == 0 else n * (k + 1) // capacity * capacity for n in counts}
        best = max(best, -(-sum(worth[n] * c for n, c in counts.items()) // (capacity * k)))
    return best


def pack_histogram(counts: dict[int, int], capacity: int, rounds: int = 120) -> Plan:
    """A plan for ``counts`` items of each length from 1 to capacity; deterministic."""
    left = {n: c for n, c in counts.items() if c > 0}
    slots: list[tuple[int, int, int, int, int]] = []
    used = {n: 0 for n in left}
    containers, bound = 0, _simple_bound(left, capacity)

    def place(configuration: dict[int, int], times: int) -> None:
        nonlocal containers
        for n, a in configuration.items():
            slots.append((n, used[n], used[n] + a * times, containers, a))
            used[n] += a * times
            left[n] -= a * times
            if not left[n]:
                del left[n]
        containers += times

    def fits(configuration: dict[int, int]) -> int:
        return min(left.get(n, 0) // a for n, a in configuration.items())

    fill = lambda c: sum(n * a for n, a in c)
    first, size = True, -1
    while left and (first or sum(left.values()) < 0.9 * size):
        size = sum(left.values())
        lengths = np.array(sorted(left), dtype=np.int64)
        found, _, least = fractional(lengths, np.array([left[int(n)] for n in lengths]), capacity, rounds if first else max(8, rounds // 4))
        if first:
            bound = max(bound, int(np.ceil(least - 1e-6)))
        first = False
        scale = sum(n * c for n, c in left.items()) / sum(x * fill(c) for c, x in found.items())  # so that the volume covered is that of all items
        # Fullest configurations first; each as often as its share of the program and the items left allow.
        for c, x in sorted(found.items(), key=lambda p: (-fill(p[0]), -p[1], p[0])):
            if (times := min(int(x * scale), fits(dict(c)))) > 0:
                place(dict(c), times)
    by_program, whole = containers, dict(left)
    while left:
        lengths = np.array(sorted(left), dtype=np.int64)
        share = np.array([left[n] / whole[n] for n in lengths.tolist()])
        prices = lengths / capacity * np.exp(share - share.max())  # what is covered less is worth more
        sack = Knapsack(lengths, prices, capacity)
        reach = prices + sack.value[capacity - lengths]
        before = containers
        for n in lengths[::-1][reach[::-1] >= (1 - NEAR) * sack.value[capacity]].tolist():
            if n in left and (times := fits(a := sack.with_length(n, capacity))):
                place(a, max(1, times // 2))
        if containers == before:
            # No configuration is left whole: the longest length with the best that fits beside it, in the numbers left.
            most = np.array([left[n] for n in lengths.tolist()])
            most[-1] -= 1
            beside = _best_configuration(lengths, prices, most, capacity - int(lengths[-1]))
            beside[-1] += 1
            a = {int(n): int(k) for n, k in zip(lengths, beside) if k}
            place(a, fits(a))
    return Plan(slots, containers, by_program, bound)


def _assign(plan: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Numbered items (id, piece, size, number) to their containers; ``plan`` has the slots as columns, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, start, _, first, each = plan.value
        base = np.searchsorted(length, np.arange(int(length[-1]) + 2)) if len(length) else np.zeros(1, np.int64)
        wide = int(start.max()) + 1 if len(start) else 1
        key = length * wide + start  # sorted, as slots of a length are by their start
        for batch in batches:
            size, number = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            at = np.minimum(np.searchsorted(key, size * wide + np.minimum(number, wide - 1), side="right"), base[size + 1]) - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(first[at] + (number - start[at]) // each[at])], ["id", "piece", "size", "container"])

    return run


def pack(items: DataFrame, id_column: str, size: str, capacity: int, rounds: int = 120, part: int = PART) -> DataFrame:
    """Every item in containers of ``capacity``: id_column, piece, size, container.

    An item of at most the capacity stays whole (piece 0). A longer one is cut into pieces of the capacity and a rest.
    Empty items take no room; they are dealt to the containers by their id's hash (container 0 where there is none).
    Items of a length are numbered in parts of about ``part`` by their hash, so a length that most items have isn't one
    task. Items with a null size count as empty. Ids should be unique; rows with equal ids and sizes may trade places.

    What is broadcast, the lengths and the plan, has a size that depends on the capacity and rounds, not on the items: a
    length has at most as many slots as there are configurations, and each program finds few of them.
    """
    spark = items.sparkSession
    ship(spark)
    base = items.select(id_column, F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("_size"))
    full = F.floor(F.col("_size") / capacity)
    rest = F.col("_size") - full * capacity
    pieces = F.when((full > 0) & (rest == 0), full).otherwise(full + 1)
    cut = base.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))).withColumn("size", F.least(F.col("_size") - F.col("piece") * capacity, F.lit(capacity)))
    cut = materialize(cut.select(id_column, "piece", "size"), "items")
    counts = {r["size"]: r["n"] for r in cut.where("size > 0").groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    plan = pack_histogram(counts, capacity, rounds)
    parts = spark.createDataFrame([(n, -(-c // part)) for n, c in counts.items()], "_len long, _parts long")
    dealt = cut.join(F.broadcast(parts), F.col("size") == F.col("_len")).select(id_column, "piece", "size", F.pmod(F.xxhash64(id_column, "piece"), F.col("_parts")).alias("_part"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy("size", "_part").agg(F.count(F.lit(1)).alias("_n")).select("size", "_part", before.alias("_off"))  # a row for ``part`` items
    numbered = dealt.withColumn("_rn", F.row_number().over(Window.partitionBy("size", "_part").orderBy(id_column, "piece")) - 1)
    numbered = numbered.join(offsets.hint("merge"), ["size", "_part"]).select(id_column, "piece", "size", (F.col("_rn") + F.col("_off")).alias("_no"))
    table = np.array(sorted(plan.slots), dtype=np.int64).reshape(-1, 5).T.copy()
    kind = dict(items.dtypes)[id_column]
    packed = numbered.mapInArrow(_assign(spark.sparkContext.broadcast(table)), f"id {kind}, piece long, size long, container long").withColumnRenamed("id", id_column)
    empty = cut.where("size = 0").select(id_column, "piece", "size", F.pmod(F.coalesce(F.xxhash64(id_column), F.lit(0)), F.lit(max(1, plan.containers))).cast("long").alias("container"))
    return packed.unionByName(empty)
