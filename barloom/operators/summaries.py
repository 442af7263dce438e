"""Projections and summaries of quotes, options, statements, holders and calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def option_summary(chain: DataFrame, spot: str, moneyness_pct: float | None = None) -> DataFrame:
    """By underlying: nearest strikes to the spot of calls and puts, summed volume and interest, put/call ratios.

    chain: underlying, leg (call, put), strike, volume, interest and ``spot``. Within ``moneyness_pct`` of the spot only,
    if given. Sums of nothing but nulls are null, as are ratios over 0; of equally near strikes the lower one counts.
    """
    d = chain if moneyness_pct is None else chain.where(F.col(spot).isNull() | F.col("strike").between(F.col(spot) * (1 - moneyness_pct / 100), F.col(spot) * (1 + moneyness_pct / 100)))
    leg = lambda name, c: F.when(F.col("leg") == name, c)
    near = lambda name: F.min_by("strike", leg(name, F.struct(F.abs(F.col("strike") - F.col(spot)), F.col("strike"))))
    g = d.groupBy("underlying").agg(
        near("call").alias("atm_call"), near("put").alias("atm_put"),
        *[F.sum(leg(n, F.col(c))).alias(f"{n}_{c}") for n in ("call", "put") for c in ("volume", "interest")],
    )
    return g.withColumn("pc_volume", F.try_divide(F.col("put_volume"), F.col("call_volume"))).withColumn("pc_interest", F.try_divide(F.col("put_interest"), F.col("call_interest")))


def consensus(counts: list[str]) -> tuple[Column, Column]:
    """The mean rating (1 for the first column) and the share of the first two, of columns of counts."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in counts), F.lit(0))
    weighted = sum((F.coalesce(F.col(c), F.lit(0)) * (i + 1) for i, c in enumerate(counts)), F.lit(0))
    return F.try_divide(weighted, total), F.try_divide(sum((F.coalesce(F.col(c), F.lit(0)) for c in counts[:2]), F.lit(0)) * 100.0, total)


def growth(df: DataFrame, key: str, period: str, value: str, lag: int = 1) -> DataFrame:
    """Add growth over the value ``lag`` periods before; null where that isn't positive."""
    before = F.lag(value, lag).over(Window.partitionBy(key).orderBy(period))
    return df.withColumn("growth", F.when(before > 0, F.col(value) / before - 1))


def concentration(df: DataFrame, group: str, name: str, weight: str, top: int = 5) -> DataFrame:
    """By group: the heaviest name, the sum of the ``top`` heaviest and their share in %; nulls weigh nothing."""
    d = df.where(F.col(weight).isNotNull())
    total = d.groupBy(group).agg(F.sum(weight).alias("_t"))
    d = d.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(F.col(weight).desc(), name))).where(F.col("_k") <= top)
    g = d.groupBy(group).agg(F.max_by(name, -F.col("_k")).alias("top_name"), F.sum(weight).alias("top_sum"))
    return g.join(total, group).select(group, "top_name", "top_sum", (F.col("top_sum") / F.col("_t") * 100).alias("share_pct"))


def dominant(df: DataFrame, group: str, kind: str, value: str) -> DataFrame:
    """By group: its commonest kind (by name on a tie) and mean, min and max of the values within it."""
    g = df.groupBy(group, kind).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    g = g.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(F.col("n").desc(), kind)))  # one row a kind
    return g.where("_k = 1").drop("_k")


def head_tail(df: DataFrame, key: str, order: str, head: int | None = None, tail: int | None = None) -> DataFrame:
    """The first or last rows of each key, with ``total`` and ``shown``; head and tail exclude each other."""
    if head is not None and tail is not None:
        raise ValueError("head and tail exclude each other")
    n, by = (head, F.col(order)) if head is not None else (tail, F.col(order).desc())
    # The cut comes first, so no task holds a whole key; the totals are counted in each task and joined to what is left.
    d = df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(by))).where(F.col("_k") <= n).drop("_k")
    total = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("total"))
    return d.join(total, F.col(key).eqNullSafe(F.col("_key"))).drop("_key").withColumn("shown", F.least("total", F.lit(n)))


def split_events(shares: DataFrame, key: str, day: str, value: str, ratio: float = 1.5) -> DataFrame:
    """Days on which a count rose or fell by the ratio or more against the one before; of one day the greatest counts."""
    d = shares.where(F.col(value).isNotNull()).groupBy(key, day).agg(F.max(value).alias("_v"))
    change = F.col("_v") / F.lag("_v").over(Window.partitionBy(key).orderBy(day))
    return d.withColumn("ratio", change).where((F.col("ratio") >= ratio) | (F.col("ratio") <= 1 / ratio)).select(key, day, "ratio")


def sparks(candidates: DataFrame, events: DataFrame, cap: float = 8e11) -> DataFrame:
    """Candidates (ticker, sector) with how many events bear on them: ticker, n_own, n_sector, n_market, and next_own, the
    first day of an own one.

    An event of the same ticker is its own. One of another ticker of the same known sector is the sector's; of another or
    unknown sector it is the market's if its cap is at least ``cap``. Events are counted by ticker and by sector, and what a
    candidate's own or its sector's are is taken off the totals, so no candidate meets an event of another ticker.
    """
    n, giant = F.count(F.lit(1)), F.count(F.when(F.col("cap") >= cap, 1))
    by_both = events.groupBy(F.col("ticker").alias("_t"), F.col("sector").alias("_s")).agg(n.alias("n"), giant.alias("g"), F.min("day").alias("day"))
    own = by_both.groupBy("_t").agg(F.sum("n").alias("own"), F.sum("g").alias("own_g"), F.min("day").alias("next_own"))
    sector = by_both.where("_s is not null").groupBy("_s").agg(F.sum("n").alias("sec"), F.sum("g").alias("sec_g"))
    same = by_both.select(F.col("_t").alias("_t2"), F.col("_s").alias("_s2"), F.col("n").alias("both"), F.col("g").alias("both_g"))
    d = candidates.join(own, F.col("ticker") == F.col("_t"), "left").join(sector, F.col("sector") == F.col("_s"), "left").join(same, (F.col("ticker") == F.col("_t2")) & (F.col("sector") == F.col("_s2")), "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    d = d.withColumn("_all", events.agg(giant).scalar())
    return d.select("ticker", z("own").alias("n_own"), (z("sec") - z("both")).alias("n_sector"), (F.col("_all") - z("own_g") - z("sec_g") + z("both_g")).alias("n_market"), "next_own")


def merged_watchlists(first: DataFrame, second: DataFrame, names: tuple[str, str]) -> DataFrame:
    """ticker and the lists it is on, of two lists."""
    a = first.select("ticker").distinct().withColumn("_a", F.lit(names[0]))
    b = second.select("ticker").distinct().withColumn("_b", F.lit(names[1]))
    return a.join(b, "ticker", "full").select("ticker", F.concat_ws("+", "_a", "_b").alias("lists"))


def disagreeing(a: DataFrame, b: DataFrame, value: str, threshold: float) -> DataFrame:
    """Tickers in both feeds whose values are further apart than the threshold."""
    d = a.select("ticker", F.col(value).alias("_x")).join(b.select("ticker", F.col(value).alias("_y")), "ticker")
    return d.where(F.abs(F.col("_x") - F.col("_y")) > threshold).select("ticker", (F.col("_x") - F.col("_y")).alias("difference"))


def movers(quotes: DataFrame, top: int, value: str, *conditions: Column) -> DataFrame:
    """The greatest and least values: ticker, value, side; a ticker among the gainers isn't among the losers."""
    d = quotes.where(F.col(value).isNotNull())
    for c in conditions:
        d = d.where(c)
    up = d.orderBy(F.col(value).desc(), "ticker").limit(top).select("ticker", value, F.lit("up").alias("side"))
    down = d.orderBy(F.col(value), "ticker").limit(top).select("ticker", value, F.lit("down").alias("side"))
    return up.unionByName(down.join(up.select("ticker"), "ticker", "left_anti"))
