"""Predecessors, successors and positions along an ordered key, without one task per key.

A plain window over a key puts the whole key into one task. Here the key is cut into segments of its order; inside a
segment a window does the work, and one summary row for each segment carries positions and edge values across. The
largest group is thus a segment, and the summaries of a key are as few as its segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(
    df: DataFrame, keys: list[str], order: list[str], segment: Column, lag: dict[str, str] | None = None, lead: dict[str, str] | None = None,
    last: dict[str, str] | None = None, carry: dict[str, str] | None = None, count: str | None = None,
) -> DataFrame:
    """Add ``pos`` (from 1 in each key), and of the row before and after the columns named in ``lag`` and ``lead``
    (new name: column). ``last`` gives columns of the key's last row, and ``carry`` the last value that isn't null up to and
    including the row; ``count`` names the key's number of rows. ``segment`` must not decrease along ``order``. Rows with a null key are left out; at the ends of
    a key the added columns are null. The order must be total, or ties come in any order.
    """
    lag, lead, last, carry = lag or {}, lead or {}, last or {}, carry or {}
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    d = df.withColumn("_seg", segment)
    w = Window.partitionBy(*keys, "_seg").orderBy(*order)
    by = F.struct(*order)
    summary = d.groupBy(*keys, "_seg").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.max_by(F.struct(F.col(c).alias("v")), by).alias(f"_last_{n}") for n, c in lag.items()],
        *[F.min_by(F.struct(F.col(c).alias("v")), by).alias(f"_first_{n}") for n, c in lead.items()],
        *[F.max_by(F.struct(F.col(c).alias("v")), by).alias(f"_end_{n}") for n, c in last.items()],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), by)).alias(f"_held_{n}") for n, c in carry.items()],
    )
    ws = Window.partitionBy(*keys).orderBy("_seg")
    before, whole = ws.rowsBetween(Window.unboundedPreceding, -1), ws.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summary = summary.select(
        *keys,
        "_seg",
        F.col("_n").alias("_of"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        *[F.lag(f"_last_{n}").over(ws).alias(f"_last_{n}") for n in lag],
        *[F.lead(f"_first_{n}").over(ws).alias(f"_first_{n}") for n in lead],
        *[F.last(f"_end_{n}").over(whole).alias(f"_end_{n}") for n in last],
        *([F.sum("_n").over(whole).alias("_count")] if count else []),
        *[F.last(f"_held_{n}", ignorenulls=True).over(before).alias(f"_held_{n}") for n in carry],
    )
    d = d.select(
        "*",
        F.row_number().over(w).alias("_rn"),
        *[F.lag(c).over(w).alias(f"_in_{n}") for n, c in lag.items()],
        *[F.lead(c).over(w).alias(f"_on_{n}") for n, c in lead.items()],
        *[F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_up_{n}") for n, c in carry.items()],
    )
    out = d.join(summary.withColumnRenamed("_seg", "_sseg").withColumnsRenamed({k: f"_k_{k}" for k in keys}), [d[k] == F.col(f"_k_{k}") for k in keys] + [d["_seg"].eqNullSafe(F.col("_sseg"))])
    return out.select(
        *df.columns,
        (F.col("_rn") + F.col("_off")).alias("pos"),
        *[F.when(F.col("_rn") == 1, F.col(f"_last_{n}.v")).otherwise(F.col(f"_in_{n}")).alias(n) for n in lag],
        *[F.when(F.col("_rn") == F.col("_of"), F.col(f"_first_{n}.v")).otherwise(F.col(f"_on_{n}")).alias(n) for n in lead],
        *[F.col(f"_end_{n}.v").alias(n) for n in last],
        *([F.col("_count").alias(count)] if count else []),
        *[F.coalesce(f"_up_{n}", f"_held_{n}").alias(n) for n in carry],
    )
