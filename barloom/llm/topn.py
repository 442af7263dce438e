"""The N best items of every group by stored, bucketed, sorted runs and loser-tree merges of them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import scratch, ship

#: Columns of the runs; items' columns of these names, and one called place, give way.
GROUP, RUN, AT, BUCKET = "__group", "__run", "__at", "__bucket"


class LoserTrees:
    """Multiway merges of many groups at once, in step. Each group has ``k`` sorted sources, a power of two: the rows from
    ``head`` to ``end`` (both groups x k; empty sources have none). Inner nodes hold the loser of their match, so only the
    winner's path is replayed. ``keys`` are the rows' keys as columns of whole numbers; equal keys go to the lower source.
    """

    def __init__(self, head: np.ndarray, end: np.ndarray, keys: list[np.ndarray]):
        self.keys, self.end = keys, end
        self.head = np.where(head < end, head, -1)
        self.groups, self.k = head.shape
        self.all = np.arange(self.groups)
        self.losers = np.zeros((self.groups, self.k), dtype=np.int64)
        winners = np.tile(np.arange(self.k), (self.groups, 1))
        while winners.shape[1] > 1:
            a, b = winners[:, 0::2], winners[:, 1::2]
            ahead = self._beats(a, b)
            half = a.shape[1]
            self.losers[:, half : 2 * half] = np.where(ahead, b, a)
            winners = np.where(ahead, a, b)
        self.winner = winners[:, 0]

    def _beats(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether source a's next row comes before source b's, group by group."""
        g = self.all if a.ndim == 1 else self.all[:, None]
        x, y = self.head[g, a], self.head[g, b]
        less, same = np.zeros(a.shape, bool), np.ones(a.shape, bool)
        for key in self.keys:
            u, v = key[x], key[y]
            less |= same & (u < v)
            same &= u == v
        return (x >= 0) & ((y < 0) | less | same & (a < b)) | (x < 0) & (y < 0) & (a < b)

    def pop(self) -> np.ndarray:
        """The next row of each group, -1 where it has no more."""
        row = self.head[self.all, self.winner]
        after = row + 1
        self.head[self.all, self.winner] = np.where((row >= 0) & (after < self.end[self.all, self.winner]), after, -1)
        at, node = self.winner, (self.winner + self.k) >> 1
        for _ in range(self.k.bit_length() - 1):
            other = self.losers[self.all, node]
            lost = self._beats(other, at)
            self.losers[self.all, node] = np.where(lost, at, other)
            at, node = np.where(lost, other, at), node >> 1
        self.winner = at
        return row


def _keys(column: pa.ChunkedArray, down: bool) -> list[np.ndarray]:
    """A column as whole numbers of the same order, nulls last: for floats their bits, so NaN is the greatest number."""
    kind = column.type
    empty = column.is_null().to_numpy()
    if pa.types.is_floating(kind):
        bits = (column.fill_null(0).cast(pa.float64()).to_numpy() + 0.0).view(np.int64)
        number = bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))
        number = np.where(np.isnan(bits.view(np.float64)), np.iinfo(np.int64).max, number)
    elif pa.types.is_integer(kind) or pa.types.is_boolean(kind):
        number = column.cast(pa.int64()).fill_null(0).to_numpy()
    else:
        codes = column.combine_chunks().dictionary_encode()
        rank = np.empty(len(codes.dictionary) + 1, dtype=np.int64)
        rank[pc.sort_indices(codes.dictionary).to_numpy()] = np.arange(len(codes.dictionary))
        number = rank[codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)]
    number = np.where(empty, 0, ~number if down else number)
    return [empty.astype(np.int64), number] if empty.any() else [number]


def _first_of_groups(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a stream sorted by the group, the first n rows of each with their number in it; after them it seeks the next
    group's start."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, taken = None, 0
        for batch in batches:
            if not len(batch):
                continue
            codes = batch.column(GROUP).dictionary_encode()
            ids = codes.indices.to_numpy(zero_copy_only=False)
            start = np.r_[0, np.flatnonzero(np.diff(ids)) + 1]
            size = np.diff(np.r_[start, len(ids)])
            had = np.zeros(len(start), dtype=np.int64)
            had[0] = taken if codes.dictionary[ids[0]].as_py() == group else 0
            at = np.arange(len(ids)) - np.repeat(start - had, size)
            group, taken = codes.dictionary[ids[-1]].as_py(), int(at[-1]) + 1
            keep = np.flatnonzero(at < n)
            out = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(at[keep].astype(np.int32))], [*batch.schema.names, AT])

    return take


def store_runs(items: DataFrame, group: list[str], order: list[tuple[str, bool]], n: int, spread: list[str] | None, buckets: int) -> DataFrame:
    """Sorted runs of items as a table in the shared folder, bucketed by group.

    Each task of the dealt items is a run, sorted by group and order. The table has the first n items of each group of a
    run (the others have n of their own run before them), the run and their number in it, and is sorted by them in each
    of its ``buckets`` files. Reading a bucket needs no shuffle.
    """
    spark = items.sparkSession
    by = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order]
    name = F.to_json(F.struct(*group), {"ignoreNullFields": "false"})
    dealt = items.repartition(*spread) if spread else items
    runs = dealt.withColumn(GROUP, name).sortWithinPartitions(GROUP, *by)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema)
    first = runs.mapInArrow(_first_of_groups(n), f"{fields}, {AT} int").withColumn(RUN, F.spark_partition_id())
    # A few numbers of a bucket column share a file, so that files are even; a task merges one number at a time.
    first = first.withColumn(BUCKET, F.pmod(F.xxhash64(GROUP), F.lit(4 * buckets)).cast("int"))
    table = f"runs_{uuid.uuid4().hex}"
    out = first.repartition(buckets, BUCKET).write.bucketBy(buckets, BUCKET).sortBy(BUCKET, GROUP, RUN, AT)
    out.option("path", f"{scratch(spark)}/{table}").format("parquet").saveAsTable(table)
    return spark.table(table)


def merge_runs(runs: DataFrame, order: list[tuple[str, bool]], n: int) -> DataFrame:
    """The first n items of each group of stored runs, with their ``place``: a bucket's loser trees merge the runs of all its
    groups in step and stop after n."""
    keep = [f for f in runs.schema if f.name not in (GROUP, RUN, AT, BUCKET)]

    def merge(bucket: pa.Table) -> pa.Table:
        codes = bucket[GROUP].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        run, at = bucket[RUN].to_numpy(), bucket[AT].to_numpy()
        rows = bucket.take(pa.array(np.lexsort((at, run, codes)))).select([f.name for f in keep])
        codes, run = (x[np.lexsort((at, run, codes))] for x in (codes, run))
        keys = [k for c, down in order for k in _keys(rows[c], down)]
        start = np.flatnonzero(np.r_[True, (np.diff(codes) != 0) | (np.diff(run) != 0)]) if len(codes) else np.zeros(0, np.int64)
        end = np.r_[start[1:], len(codes)]
        first = np.flatnonzero(np.r_[True, np.diff(codes[start]) != 0]) if len(start) else start  # a group's first run
        sources = np.diff(np.r_[first, len(start)])
        found, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for k in sorted({1 << int(s - 1).bit_length() for s in sources}):
            own = np.flatnonzero((sources <= k) & (sources > k // 2))
            at = first[own][:, None] + np.arange(k)
            there = np.arange(k) < sources[own][:, None]
            at = np.where(there, at, 0)
            trees = LoserTrees(np.where(there, start[at], 0), np.where(there, end[at], 0), keys)
            for place in range(1, n + 1):
                row = trees.pop()
                row = row[row >= 0]
                if not len(row):
                    break
                found.append(row)
                places.append(np.full(len(row), place, np.int32))
        out = rows.take(pa.array(np.concatenate(found)))
        return pa.table([*out.columns, pa.array(np.concatenate(places))], names=[*out.column_names, "place"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return runs.groupBy(BUCKET).applyInArrow(merge, f"{types}, place int")


def top_n(items: DataFrame, group: list[str], order: list[tuple[str, bool]], n: int, spread: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """The n first items of every group by ``order`` (column, descending), with their ``place`` from 1.

    Nulls come last in either direction; NaN counts as the greatest number, and -0.0 as 0.0. Items tied in all of ``order``
    are taken in any order, so end it with a column unique in a group. Groups with a null in ``group`` are groups too.
    Fewer than n items are all given; an empty table gives no rows.

    Items are dealt to runs by ``spread``, so a group of any size is spread over all tasks, or left where they are if
    ``spread`` is None (they are spread already, as after an aggregation by more than the group). Of a group at most n rows
    from each task are stored and merged. ``buckets``, by default as many as a shuffle has partitions, should grow with the
    number of groups: a task holds a quarter of a bucket.
    """
    ship(items.sparkSession)
    items = items.drop(GROUP, RUN, AT, BUCKET, "place")
    buckets = buckets or int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return merge_runs(store_runs(items, group, order, n, spread, buckets), order, n)
