"""The cheapest sets of offers that cover a demand, for each order on its own."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import ship


def cheapest_cover(demand: dict[str, int], offers: list[tuple[str, int, dict[str, int]]], best: int = 1) -> list[tuple[int, tuple[str, ...]]]:
    """The ``best`` least total prices and offers (repeated as often as bought) that give at least the demand.

    Dynamic programming over what is still wanted: an order's wants are few, so their states are few. Offers that give
    nothing wanted are never bought; ties go to the smaller tuple of offers.
    """
    names = sorted(n for n, k in demand.items() if k > 0)
    start = tuple(demand[n] for n in names)
    useful = [(o, price, tuple(gives.get(n, 0) for n in names)) for o, price, gives in sorted(offers) if price >= 0]
    useful = [x for x in useful if any(x[2])]
    memo: dict[tuple[int, ...], list[tuple[int, tuple[str, ...]]]] = {}

    def solve(want: tuple[int, ...]) -> list[tuple[int, tuple[str, ...]]]:
        if not any(want):
            return [(0, ())]
        if want not in memo:
            i = next(k for k, w in enumerate(want) if w)  # the first want must be met by some offer: no order of buying twice
            found = set()
            for o, price, gives in useful:
                if gives[i]:
                    for cost, rest in solve(tuple(max(0, w - g) for w, g in zip(want, gives))):
                        found.add((cost + price, tuple(sorted((o, *rest)))))
            memo[want] = sorted(found)[:best]
        return memo[want]

    return solve(start)


def covers(demands: DataFrame, offers: DataFrame, best: int = 1) -> DataFrame:
    """demands (order_id, sku, qty) and offers (order_id, offer, price, sku, gives) to order_id, place, cost, offers.

    An order's wants and offers, which are few, become two arrays of one row; the rows go through Python in Arrow batches,
    and orders that want and are offered the same are solved once a batch. Orders without any cover have no rows; null
    numbers count as 0 and rows with a null order are left out.
    """
    ship(demands.sparkSession)
    want = demands.where("order_id is not null").groupBy("order_id", "sku").agg(F.sum("qty").alias("q")).groupBy("order_id").agg(F.array_sort(F.collect_list(F.struct("sku", "q"))).alias("want"))
    given = offers.where("order_id is not null").groupBy("order_id").agg(F.array_sort(F.collect_list(F.struct("offer", "price", "sku", "gives"))).alias("given"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            solved: dict = {}
            rows = []
            for order, w, g in zip(*(c.to_pylist() for c in batch.columns)):
                key = (tuple((x["sku"], x["q"]) for x in w), tuple((x["offer"], x["price"], x["sku"], x["gives"]) for x in g or []))
                if key not in solved:
                    listed: dict[str, tuple[int, dict[str, int]]] = {}
                    for offer, price, sku, gives in key[1]:
                        has = listed.setdefault(offer, (int(price or 0), {}))[1]
                        has[sku] = has.get(sku, 0) + int(gives or 0)
                    solved[key] = cheapest_cover({s: int(q or 0) for s, q in key[0]}, [(o, p, has) for o, (p, has) in listed.items()], best)
                rows += [(order, i + 1, cost, ",".join(picked)) for i, (cost, picked) in enumerate(solved[key])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.int32(), pa.int64(), pa.string()))], ["order_id", "place", "cost", "offers"])

    return want.join(given, "order_id", "left").select("order_id", "want", "given").mapInArrow(run, "order_id long, place int, cost long, offers string")
