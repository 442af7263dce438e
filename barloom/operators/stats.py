"""Statistics of outcomes: rates, overlapping strata, buckets, paired differences and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import materialize


def win_rates(outcomes: DataFrame, *by: str) -> DataFrame:
    """By group: n, won, lost, expired, win_pct (of won and lost), mean_days of those won, expectancy (mean result_pct)."""
    o = F.col("outcome")
    n = lambda c: F.count(F.when(c, 1))
    g = outcomes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), n(o == "WON").alias("won"), n(o == "LOST").alias("lost"), n(o == "EXPIRED").alias("expired"), F.avg(F.when(o == "WON", F.col("days"))).alias("mean_days"), F.avg("result_pct").alias("expectancy")
    )
    return g.withColumn("win_pct", F.try_divide(F.col("won") * 100.0, F.col("won") + F.col("lost")))


def strata(df: DataFrame, labels: list[Column]) -> DataFrame:
    """A row for each stratum a row belongs to (``stratum``); null labels are none. Strata may overlap."""
    return df.select("*", F.explode(F.array_compact(F.array(*labels))).alias("stratum"))


def half_open(key: Column, bounds: list[float]) -> Column:
    """The label [lo,hi) of the bucket a key is in; null for null keys and those outside all buckets."""
    out = F.lit(None).cast("string")
    for lo, hi in reversed(list(zip(bounds, bounds[1:]))):
        out = F.when((key >= lo) & (key < hi), f"[{lo:g},{hi:g})").otherwise(out)
    return out


def interval(value: Column) -> Column:
    """Half the 95 % interval of a mean."""
    return F.stddev_samp(value) * 1.96 / F.sqrt(F.count(value))


def paired(df: DataFrame, current: str, base: str, *by: str) -> DataFrame:
    """By group: n, delta, ci of current - base over the rows that have both."""
    d = F.col(current) - F.col(base)
    return df.where(d.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("delta"), interval(d).alias("ci"))


def edges(df: DataFrame, group: str, value: str, least: int = 10) -> DataFrame:
    """group, n, mean, ci of each group with at least ``least`` rows; the others are one group, Other, with ``members``.

    Rows with a null value don't count; the null group is a group, named '?'. Two partial aggregations, no windows.
    """
    d = df.where(F.col(value).isNotNull()).select(F.coalesce(F.col(group), F.lit("?")).alias("_g"), F.col(value).alias("_v"))
    sizes = d.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    d = d.join(sizes, "_g").withColumn("group", F.when(F.col("_n") < least, "Other").otherwise(F.col("_g")))
    g = d.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"), interval(F.col("_v")).alias("ci"), F.array_sort(F.collect_set("_g")).alias("members"))
    return g.withColumn("members", F.when(F.col("group") == "Other", F.array_join("members", ",")))


def tercile_cuts(df: DataFrame, value: str, least: int = 9) -> DataFrame:
    """One row low, high: the values at positions n // 3 and 2n // 3 (from 0) of the sorted ones; null under ``least`` rows.

    Exact order statistics: counts by value are split by ranges of the value, each range knows how many lie before it, and
    sums run within ranges. No task sees more than a range of the distinct values.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    c = materialize(c.repartitionByRange("_v").withColumn("_range", F.spark_partition_id()), "ranges")
    ranges = c.groupBy("_range").agg(F.sum("_n").alias("_m"))  # as many rows as a shuffle has partitions
    ranges = ranges.select("_range", (F.sum("_m").over(Window.orderBy("_range")) - F.col("_m")).alias("_before"), F.sum("_m").over(Window.partitionBy()).alias("_all"))
    w = Window.partitionBy("_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    c = c.join(ranges, "_range").withColumn("_upto", F.sum("_n").over(w) + F.col("_before"))
    at = lambda k: F.min(F.when(F.col("_upto") > F.floor(F.col("_all") * k / 3), F.col("_v")))
    return c.where(F.col("_all") >= least).agg(at(1).alias("low"), at(2).alias("high"))


def breakdown(df: DataFrame, group: str, top: int = 5) -> DataFrame:
    """group and n of the ``top`` largest groups (ties by name), the rest as Other; null is '?'."""
    g = df.groupBy(F.coalesce(F.col(group), F.lit("?")).alias("group")).agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("_k", F.row_number().over(Window.orderBy(F.col("n").desc(), "group")))  # one row a group
    return g.groupBy(F.when(F.col("_k") <= top, F.col("group")).otherwise("Other").alias("group")).agg(F.sum("n").alias("n"))
