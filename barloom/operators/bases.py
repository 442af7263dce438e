"""Bases (sideways ranges) and contractions in a ticker's closes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def detect_bases(bars: DataFrame, shortest: int = 30, longest: int = 200, step: int = 5, lookback: int = 252, max_width: float = 25, band: float = 2, from_high: float = 15) -> DataFrame:
    """The best base of each ticker: ticker, offset, days, width_pct, to_pivot_pct, pivot, breakout_day, quality,
    smoothness_pct, dryup and today_ratio.

    Candidates end at the latest session or three before it and are ``shortest`` to ``longest`` sessions long, in steps.
    Their range is at most ``max_width`` % of its top. At offset 0 the close lies between 25 % below and 0.5 % above the
    top; at offset 3 it is 0.2 % above it. The greatest days / max(width, 1) wins, on a tie the first: offset 0, shorter.
    Tickers with fewer than ``lookback`` bars, or more than ``from_high`` % below their top, have none.

    A ticker's last ``lookback`` closes make one array, so all candidates are sliced from one row.
    """
    d = bars.where(F.col("back") < lookback)
    g = d.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("sess_no", "close", "volume"))).alias("a"))
    g = g.where(F.size("a") == lookback).select("ticker", F.col("a.close").alias("c"), F.col("a.volume").alias("v"))
    g = g.withColumn("last", F.element_at("c", -1)).where((F.col("last") / F.array_max("c") - 1) * 100 >= -from_high)
    each = g.select("ticker", "c", "v", "last", F.explode(F.array(F.lit(0), F.lit(3))).alias("offset"))
    each = each.select("*", F.explode(F.sequence(F.lit(shortest), F.lit(longest), F.lit(step))).alias("days")).where(F.col("days") <= lookback - F.col("offset") - 1)
    each = each.withColumn("s", F.slice("c", lookback - F.col("offset") - F.col("days") + 1, F.col("days")))
    each = each.withColumn("hi", F.array_max("s")).withColumn("lo", F.array_min("s"))
    each = each.withColumn("width_pct", (F.col("hi") - F.col("lo")) / F.col("hi") * 100).withColumn("to_pivot_pct", (F.col("last") / F.col("hi") - 1) * 100)
    fits = F.when(F.col("offset") == 0, F.col("to_pivot_pct").between(-25, 0.5)).otherwise(F.col("last") >= F.col("hi") * 1.002)
    each = each.where((F.col("width_pct") <= max_width) & fits).withColumn("quality", F.col("days") / F.greatest(F.col("width_pct"), F.lit(1.0)))
    best = each.withColumn("_k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("quality").desc(), "offset", "days"))).where("_k = 1")
    mean = F.aggregate("s", F.lit(0.0), lambda acc, x: acc + x) / F.col("days")
    best = best.withColumn("_mean", mean)
    near = F.size(F.filter("s", lambda x: F.abs(x / F.col("_mean") - 1) * 100 <= band)) / F.col("days") * 100
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    return best.select(
        "ticker", "offset", "days", "width_pct", "to_pivot_pct", F.col("hi").alias("pivot"),
        F.when(F.col("offset") == 0, F.col("to_pivot_pct") >= -0.2).otherwise(F.lit(True)).alias("breakout_day"), "quality", near.alias("smoothness_pct"),
        ((total(F.slice("v", -20, 20)) / 20) / (total(F.slice("v", -80, 60)) / 60)).alias("dryup"), (F.element_at("v", -1) / (total(F.slice("v", -21, 20)) / 20)).alias("today_ratio"),
    )


def swings(bars: DataFrame, sessions: int, order: int = 5) -> DataFrame:
    """Alternating highs and lows of the last ``sessions`` closes: ticker, sess_no, close, kind.

    A session is a high (low) if none within ``order`` sessions closes higher (lower), as far as the data go. Successive
    swings of one kind become their most extreme one, the earliest on a tie.
    """
    d = bars.where(F.col("back") < sessions)
    w = Window.partitionBy("ticker").orderBy("sess_no")
    around = w.rowsBetween(-order, order)
    d = d.select("ticker", "sess_no", "close", F.max("close").over(around).alias("_hi"), F.min("close").over(around).alias("_lo"), F.row_number().over(w).alias("_i")).where(F.col("_i") > order)
    kind = F.when((F.col("close") == F.col("_hi")) & (F.col("_hi") > F.col("_lo")), "H").when((F.col("close") == F.col("_lo")) & (F.col("_hi") > F.col("_lo")), "L")
    d = d.withColumn("kind", kind).where("kind is not null")
    d = d.withColumn("_new", F.when(F.col("kind") == F.lag("kind").over(w), 0).otherwise(1)).withColumn("_g", F.sum("_new").over(w))
    extreme = F.when(F.col("kind") == "H", -F.col("close")).otherwise(F.col("close"))
    return d.groupBy("ticker", "_g", "kind").agg(F.min_by(F.struct("sess_no", "close"), F.struct(extreme, F.col("sess_no"))).alias("x")).select("ticker", "x.sess_no", "x.close", "kind")


def contractions(bars: DataFrame, sessions: int = 120, tolerance: float = 1.15, overall: float = 0.5, last_max: float = 10, fewest: int = 2, most: int = 6) -> DataFrame:
    """Successive falls from a high to the next low: ticker, n, depths (array, in %), ratio (last / first), is_vcp.

    The pattern holds if there are ``fewest`` to ``most`` falls, each at most ``tolerance`` times the one before, the last
    at most ``overall`` of the first and ``last_max`` %.
    """
    w = Window.partitionBy("ticker").orderBy("sess_no")
    legs = swings(bars, sessions).withColumn("_low", F.lead("close").over(w)).where("kind = 'H' and _low is not null").select("ticker", "sess_no", ((F.col("close") - F.col("_low")) / F.col("close") * 100).alias("depth"))
    g = legs.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("sess_no", "depth"))).alias("a")).select("ticker", F.col("a.depth").alias("depths"))
    first, last, n = F.element_at("depths", 1), F.element_at("depths", -1), F.size("depths")
    steps = F.forall(F.zip_with(F.slice("depths", 1, F.greatest(n - 1, F.lit(0))), F.slice("depths", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: b <= a * tolerance), lambda ok: ok)
    vcp = n.between(fewest, most) & steps & (last <= first * overall) & (last <= last_max)
    return g.select("ticker", n.alias("n"), "depths", (last / first).alias("ratio"), vcp.alias("is_vcp"))
