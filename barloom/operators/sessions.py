"""Activity into sessions by merging interval state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import materialize


def merge_sessions(df: DataFrame, keys: list[str], position: str, gap: int | float | Column, width: int | float) -> DataFrame:
    """Sessions of each key: every event opens the interval [position, position + gap], and overlapping ones merge.

    Gives the keys, ``first``, ``last`` (positions of the first and last event), ``duration`` (last - first) and
    ``n_events`` (rows). Events whose key or position is null don't count; an empty table gives no rows; repeated
    events change only n_events. The order of arrival is immaterial, so late events merge as any other.

    The intervals of a key merge first within buckets of ``width`` positions. An interval between two others of its
    bucket is final there; only the first and last of a bucket can touch another bucket, so the second merge of a key
    sees at most two rows for each bucket.
    """
    gap = gap if isinstance(gap, Column) else F.lit(gap)
    for k in [*keys, position]:
        df = df.where(F.col(k).isNotNull())
    events = df.groupBy(*keys, F.col(position).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    events = events.withColumn("_b", F.floor(F.col("_p") / F.lit(width)))
    w = Window.partitionBy(*keys, "_b").orderBy("_p")
    opens = F.coalesce((F.col("_p") > F.lag("_p").over(w) + gap).cast("int"), F.lit(0))
    local = (
        events.withColumn("_open", opens)
        .withColumn("_i", F.sum("_open").over(w))
        .groupBy(*keys, "_b", "_i")
        .agg(F.min("_p").alias("first"), F.max("_p").alias("last"), F.sum("_n").alias("n_events"))
        .withColumn("_edge", (F.col("_i") == 0) | (F.col("_i") == F.max("_i").over(Window.partitionBy(*keys, "_b"))))
    )
    local = materialize(local, "intervals")
    wk = Window.partitionBy(*keys).orderBy("first")
    edges = (
        local.where("_edge")
        .withColumn("_open", F.coalesce((F.col("first") > F.max("last").over(wk.rowsBetween(Window.unboundedPreceding, -1)) + gap).cast("int"), F.lit(0)))
        .withColumn("_j", F.sum("_open").over(wk))
        .groupBy(*keys, "_j")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n_events").alias("n_events"))
    )
    cols = [*keys, "first", "last", "n_events"]
    both = edges.select(*cols).unionByName(local.where(~F.col("_edge")).select(*cols))
    return both.select(*keys, "first", "last", (F.col("last") - F.col("first")).alias("duration"), "n_events")


def numbered_days(run_days: DataFrame) -> DataFrame:
    """run_day and its number ``no``, from 1; the calendar is a fixed table of a few hundred days."""
    return run_days.where("run_day is not null").select("run_day").distinct().select("run_day", F.row_number().over(Window.orderBy("run_day")).cast("long").alias("no"))


def episodes(appearances: DataFrame, run_days: DataFrame, missed: int = 3) -> DataFrame:
    """Episodes of each ticker: sessions of its run_days, ended by ``missed`` run_days without a listing.

    Gives ticker, start_day, last_day, dropout_day (the day that ended it, or 'open'), n_days (distinct run_days)
    and span (run_days from start to end). Rows without ticker (null or blank) or run_day, or with a run_day
    that isn't in run_days, don't count. Extra columns are ignored.
    """
    days = numbered_days(run_days)
    seen = appearances.where(F.trim("ticker") != "").groupBy("ticker", "run_day").agg(F.count(F.lit(1)).alias("_rows"))
    seen = seen.join(days, "run_day").select("ticker", "no")
    merged = merge_sessions(seen, ["ticker"], "no", missed, width=64)
    merged = named_days(merged, days, missed)
    return merged.select("ticker", "start_day", "last_day", "dropout_day", F.col("n_events").alias("n_days"), (F.col("duration") + 1).alias("span"))


def named_days(merged: DataFrame, days: DataFrame, missed: int) -> DataFrame:
    """Add start_day, last_day and dropout_day (or 'open') to episodes whose ``first`` and ``last`` are numbers of run_days."""
    for name, at in (("start_day", F.col("first")), ("last_day", F.col("last")), ("dropout_day", F.col("last") + missed)):
        side = days.select(F.col("run_day").alias(name), F.col("no").alias(f"_{name}"))
        merged = merged.join(side, at == F.col(f"_{name}"), "left").drop(f"_{name}")
    return merged.withColumn("dropout_day", F.coalesce("dropout_day", F.lit("open")))
