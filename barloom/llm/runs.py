"""Runs of equal consecutive events, collapsed into one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import micros
from barloom.operators.neighbours import neighbours
from barloom.session import materialize


def collapse_runs(events: DataFrame, keys: list[str], order: str, value: str, at: str, segment: Column) -> DataFrame:
    """Each maximal run of equal consecutive ``value`` of a key as one row: keys, value, first, last (of ``order``),
    n_events, started, ended (``at`` of its first and last event) and duration_s.

    Only boundary rows are kept, those that differ from their predecessor. The next start's position less the own one is
    the count, and the next start's predecessor is the run's last event. Events with a null key don't count; a null
    value is a value of its own; events of equal order come in any order, so the order should be unique in a key.
    ``segment`` cuts a key's order into pieces, so a key that holds most rows isn't one task: what ends a key's last run
    comes with the pieces' summaries too.
    """
    d = events.select(*keys, order, value, at).withColumn("_seg0", segment)
    piece = F.col("_seg0")
    d = materialize(neighbours(materialize(d, "events"), keys, [order], piece, lag={"_pv": value, "_po": order, "_pa": at}, last={"_eo": order, "_ea": at}, count="_n"), "placed")
    starts = d.where((F.col("pos") == 1) | ~F.col(value).eqNullSafe(F.col("_pv"))).select(*keys, "_seg0", order, value, at, F.col("pos").alias("_pos"), "_po", "_pa", "_eo", "_ea", "_n")
    runs = neighbours(starts, keys, [order], piece, lead={"_np": "_pos", "_lo": "_po", "_la": "_pa"})
    last = runs["_np"].isNull()
    return runs.select(
        *keys,
        value,
        F.col(order).alias("first"),
        F.when(last, F.col("_eo")).otherwise(F.col("_lo")).alias("last"),
        (F.when(last, F.col("_n") + 1).otherwise(F.col("_np")) - F.col("_pos")).alias("n_events"),
        F.col(at).alias("started"),
        F.when(last, F.col("_ea")).otherwise(F.col("_la")).alias("ended"),
    ).withColumn("duration_s", (micros(F.col("ended")) - micros(F.col("started"))) / 1e6)
