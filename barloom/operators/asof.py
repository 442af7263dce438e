"""As-of joins on two times: attributes as known at an event's time and valid at its time.

History rows of a shard go into a path-copied persistent search tree in the order in which they became known. An event
takes the root of its known time and searches the greatest valid-time key not after its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.session import materialize, ship


class PersistentTree:
    """A path-copied tree over leaf positions 0..2**levels-1; inserting row i at ``ranks[i]`` makes version i + 1.

    A row copies the nodes on its path, so node i of a level is the copy that row made there; ``child`` holds for each
    level and node the nodes below (-1: none). Nodes of all versions are kept, n * (levels + 1) in total.
    """

    def __init__(self, ranks: np.ndarray, size: int):
        n = len(ranks)
        self.n, self.levels = n, max(1, int(size - 1).bit_length())
        self.left, self.right = [], []
        rows = np.arange(n, dtype=np.int64)
        for level in range(1, self.levels + 1):
            place = ranks >> (level - 1)
            # The newest copy of the sibling made before row i: rows sorted by (place, row), then a search below (sibling, i).
            order = np.lexsort((rows, place))
            packed = place[order] * n + rows[order]
            at = np.searchsorted(packed, (place ^ 1) * n + rows) - 1
            hit = (at >= 0) & (place[order[at.clip(0)]] == place ^ 1)
            other = np.where(hit, order[at.clip(0)], -1)
            odd = (place & 1).astype(bool)
            self.left.append(np.where(odd, other, rows))
            self.right.append(np.where(odd, rows, other))

    def floor(self, version: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """For each query the row at the greatest rank <= ``rank`` in ``version`` (its latest copy), -1 if there is none."""
        node = np.where(rank < 0, -1, version - 1).astype(np.int64)
        back = np.full(len(node), -1, dtype=np.int64)
        back_level = np.zeros(len(node), dtype=np.int64)
        for level in range(self.levels, 0, -1):
            on = node >= 0
            bit = (rank >> (level - 1)) & 1 == 1
            l = np.where(on, self.left[level - 1][node.clip(0)], -1) if self.n else node  # noqa: E741
            r = np.where(on, self.right[level - 1][node.clip(0)], -1) if self.n else node
            turn = on & bit & (l >= 0)
            back, back_level = np.where(turn, l, back), np.where(turn, level - 1, back_level)
            node = np.where(bit, r, l)
        out = node.copy()
        todo = np.where(node < 0, back, -1)
        for level in range(self.levels, 0, -1):
            go = (todo >= 0) & (back_level >= level)
            r = self.right[level - 1][todo.clip(0)] if self.n else todo
            l = self.left[level - 1][todo.clip(0)] if self.n else todo  # noqa: E741
            todo = np.where(go, np.where(r >= 0, r, l), todo)
        return np.where(node < 0, todo, out)


def _search(batch: pa.Table) -> pa.Table:
    """One shard group: history rows (``_event`` null) and events, mixed. Gives the events with the row in force."""
    event = np.asarray(batch["_event"].is_valid())
    shard, valid, known = (np.asarray(batch[c].cast(pa.int64())) for c in ("_shard", "_valid", "_known"))
    tie = np.asarray(batch["_tie"].fill_null(0).cast(pa.int64()))
    h = np.flatnonzero(~event)
    h = h[np.lexsort((tie[h], known[h]))]
    e = np.flatnonzero(event)
    # Keys (shard, valid) get ranks together, so one tree serves all shards of the group.
    order = np.lexsort((valid[h], shard[h]))
    sv, ss = valid[h][order], shard[h][order]
    new = np.r_[True, (ss[1:] != ss[:-1]) | (sv[1:] != sv[:-1])] if len(h) else np.zeros(0, bool)
    rank_of = np.empty(len(h), dtype=np.int64)
    rank_of[order] = np.cumsum(new) - 1
    ks, kv = ss[new], sv[new]
    # Rank of the last key <= (shard, valid) of each event, by a joint sort.
    both = np.lexsort((np.r_[np.zeros(len(ks), np.int8), np.ones(len(e), np.int8)], np.r_[kv, valid[e]], np.r_[ks, shard[e]]))
    rank = np.empty(len(e), dtype=np.int64)
    count = np.cumsum(both < len(ks)) - 1
    is_e = both >= len(ks)
    rank[both[is_e] - len(ks)] = count[is_e]
    tree = PersistentTree(rank_of, max(1, len(ks)))
    version = np.searchsorted(known[h], known[e], side="right")
    found = tree.floor(version, rank)
    ok = found >= 0
    ok[ok] = shard[h][found[ok]] == shard[e][ok]
    value = batch["_value"].combine_chunks().take(pa.array(np.where(ok, h[found.clip(0)], -1), mask=~ok)) if len(h) else pa.nulls(len(e), pa.string())
    hv = pa.array(valid[h][found.clip(0)] if len(h) else np.zeros(len(e), np.int64), mask=~ok)
    hk = pa.array(known[h][found.clip(0)] if len(h) else np.zeros(len(e), np.int64), mask=~ok)
    return pa.table({"_event": batch["_event"].combine_chunks().take(pa.array(e)), "_found": hv, "_when": hk, "_value": value})


def _routed(events: DataFrame, blocks: DataFrame, keys: list[str], block: str) -> DataFrame:
    """Events with each block (``block``) they may find their row in: their own, and the nearest earlier one with a row known
    in time, which answers if their own doesn't. ``blocks`` (keys, block, first): the first known time of each block, which
    become one array for each key."""
    arrays = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(block).alias("b"), F.col("first").alias("k")))).alias("_blocks"))
    met = events.join(arrays, keys)
    own = F.exists("_blocks", lambda x: x["b"] == F.col(block))
    earlier = F.filter("_blocks", lambda x: (x["b"] < F.col(block)) & (x["k"] <= F.col("_known")))
    to = F.array_compact(F.array(F.when(own, F.struct(F.col(block).alias("b"))), F.when(F.size(earlier) > 0, F.struct(F.element_at(earlier, -1)["b"].alias("b")))))
    return met.withColumn("_to", to).drop("_blocks", block).select("*", F.explode("_to.b").alias(block)).drop("_to")


def as_known(
    events: DataFrame, history: DataFrame, key: str, event_id: str, event_known: Column, event_valid: Column,
    known: Column, valid: Column, tie: Column, value: Column, block: int, rows_a_task: int = 200_000,
) -> DataFrame:
    """For each event the value of the history row in force: of its key, with known <= the event's known time and valid
    not after the event's valid time, the one with the greatest valid, then known, then tie.

    Gives event_id and ``value`` (null if no row qualifies). known, valid and tie are whole numbers; events and history
    rows with a null key, known or valid time don't take part (such events get null). Events must be distinct by
    event_id. Tied rows (equal valid, known and tie) are taken to be equal.

    A key is cut into blocks of ``block`` of valid time. A block with more than ``rows_a_task`` rows of history is cut
    again, along valid and then known time, and one with as many events into salts, so no task holds a whole key. An event
    goes to its own block, and to the nearest earlier one with a row known in time, which answers if its own doesn't: all
    rows it may see come before it in the order of valid and then known time. Blocks of a key are as few as the calendar
    has. Tasks hold about ``rows_a_task`` rows, of as many blocks as that takes.
    """
    ship(events.sparkSession)
    e = events.select(F.col(event_id).cast("string").alias("_event"), F.col(key).alias("_key"), event_known.cast("long").alias("_known"), event_valid.cast("long").alias("_valid"))
    h = history.select(F.col(key).alias("_key"), known.cast("long").alias("_known"), valid.cast("long").alias("_valid"), tie.cast("long").alias("_tie"), value.cast("string").alias("_value")).dropna(subset=["_key", "_known", "_valid"])
    h = materialize(h.withColumn("_block", F.floor(F.col("_valid") / block)), "history")
    keys, none = ["_key", "_block"], F.lit(None).cast("struct<valid:bigint,piece:bigint>")
    blocks = materialize(h.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_known").alias("first"), F.max("_known").alias("last")), "blocks")
    live = e.dropna(subset=["_key", "_known", "_valid"]).withColumn("_block", F.floor(F.col("_valid") / block))
    routed = _routed(live, blocks.select(*keys, "first"), ["_key"], "_block")
    heavy = blocks.where(F.col("_n") > rows_a_task)
    if heavy.isEmpty():
        h, routed = h.withColumn("_sub", none), routed.withColumn("_sub", none)
    else:
        width = F.greatest(F.lit(1), F.floor((F.col("last") - F.col("first") + 1) * (rows_a_task / F.col("_n"))))
        sub = F.struct(F.col("_valid").alias("valid"), F.floor((F.col("_known") - F.col("first")) / width).alias("piece"))
        cuts = heavy.select(*keys, "_n", "first", "last")
        h = h.join(cuts, keys, "left").withColumn("_sub", F.when(F.col("_n").isNotNull(), sub)).drop("_n", "first", "last")
        routed = routed.join(cuts, keys, "left").withColumn("_sub", F.when(F.col("_n").isNotNull(), sub)).drop("_n", "first", "last")
        subs = h.where("_sub is not null").groupBy(*keys, "_sub").agg(F.min("_known").alias("first"))
        cols = ["_event", *keys, "_known", "_valid", "_sub"]
        routed = routed.where("_sub is null").select(cols).unionByName(_routed(routed.where("_sub is not null"), subs, keys, "_sub").select(cols))
    routed = materialize(routed.withColumn("_shard", F.xxhash64(*keys, "_sub")).select("_event", "_known", "_valid", "_shard"), "routed")
    load = materialize(routed.groupBy("_shard").agg(F.count(F.lit(1)).alias("_n")).withColumn("_salts", F.ceil(F.col("_n") / rows_a_task)), "load")
    met = h.withColumn("_shard", F.xxhash64(*keys, "_sub")).select("_known", "_valid", "_tie", "_value", "_shard").join(load.select("_shard", "_salts"), "_shard")
    salts = load.where("_salts > 1").select("_shard", "_salts")
    # Few shards have so many events that they need salts; all others have the one salt 0.
    spread = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("_event"), F.col("_salts"))).cast("long")
    asked = routed.join(salts, "_shard", "left").withColumn("_salt", spread)
    copies = met.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)))
    cols = ["_event", F.xxhash64("_shard", "_salt").alias("_shard"), "_known", "_valid", "_tie", "_value"]
    mixed = asked.withColumns({"_tie": F.lit(None).cast("long"), "_value": F.lit(None).cast("string")}).select(*cols).unionByName(copies.withColumn("_event", F.lit(None).cast("string")).select(*cols))
    # A group is what a task holds at once. Each salt of a shard has a copy of its history, about ``rows_a_task`` at most.
    n, more = load.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum(F.col("_salts") - 1), F.lit(0))).first()
    rows = n + h.count() + more * rows_a_task
    groups = max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_a_task))
    out = mixed.withColumn("_group", F.pmod(F.col("_shard"), F.lit(groups))).groupBy("_group").applyInArrow(_search, "_event string, _found long, _when long, _value string")
    # Of an event's two blocks the later one that has a row answers, so the greatest valid time and, in cut blocks, known time.
    best = out.where("_found is not null").groupBy("_event").agg(F.max_by("_value", F.struct("_found", "_when")).alias("value"))
    ids = events.select(F.col(event_id), F.col(event_id).cast("string").alias("_event"))
    return ids.join(best, "_event", "left").select(event_id, "value")
