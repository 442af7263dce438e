"""Rolling indicators of bars. All frames count sessions; a value is null until its frame is full.

Functions take bars with sess_no and back (sources.bars.numbered) and share one window, a ticker's sessions in order, so
a chain of them is one shuffle. Null prices make the values that need them null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_session():
    """A ticker's sessions in order; made when called, as a window needs a session."""
    return Window.partitionBy("ticker").orderBy("session")


def full(value: Column, n: int, frame=None) -> Column:
    """``value`` over a frame of n sessions, null until there are n."""
    return F.when(F.col("sess_no") >= n, value.over(frame if frame is not None else by_session().rowsBetween(1 - n, 0)))


def sma(column: str, n: int) -> Column:
    return full(F.avg(column), n)


def change(column: str, k: int) -> Column:
    """x / x of k sessions before - 1."""
    return F.col(column) / F.lag(column, k).over(by_session()) - 1


def daily_returns(bars: DataFrame) -> DataFrame:
    return bars.withColumn("ret", change("close", 1))


def window_summary(bars: DataFrame, sessions: int) -> DataFrame:
    """Over each ticker's last ``sessions``: return_pct, max_dd_pct, from_high_pct, ann_vol_pct, last close and score.

    score is the return over the drawdown's size, at least 1. Volatility is the sample deviation of the returns inside
    the window times the root of 252.
    """
    w = Window.partitionBy("ticker").orderBy("session")
    d = bars.where(F.col("back") < sessions)
    d = d.withColumn("_r", F.col("close") / F.lag("close").over(w) - 1).withColumn("_dd", F.col("close") / F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    g = d.groupBy("ticker").agg(
        F.min_by("close", "session").alias("_first"), F.max_by("close", "session").alias("close"), F.min("_dd").alias("_dd"), F.max("close").alias("_max"), F.stddev_samp("_r").alias("_sd"), F.count("close").alias("n")
    )
    ret, dd = (F.col("close") / F.col("_first") - 1) * 100, F.col("_dd") * 100
    return g.select(
        "ticker", "n", "close", ret.alias("return_pct"), dd.alias("max_dd_pct"), ((F.col("close") / F.col("_max") - 1) * 100).alias("from_high_pct"),
        (F.col("_sd") * F.sqrt(F.lit(252.0)) * 100).alias("ann_vol_pct"), (ret / F.greatest(F.abs(dd), F.lit(1.0))).alias("score"),
    )


def volatility_halves(bars: DataFrame, sessions: int) -> DataFrame:
    """Annualised volatility of the first and second half of the last returns: v1, v2 (in percent) and n returns.

    The first half is the shorter one of an odd number.
    """
    d = daily_returns(bars).where((F.col("back") < sessions) & F.col("ret").isNotNull())
    w = Window.partitionBy("ticker")
    d = d.withColumn("_i", F.row_number().over(w.orderBy("session"))).withColumn("n", F.count(F.lit(1)).over(w))
    first = F.col("_i") <= F.floor(F.col("n") / 2)
    year = F.sqrt(F.lit(252.0)) * 100
    return d.groupBy("ticker", "n").agg((F.stddev_samp(F.when(first, F.col("ret"))) * year).alias("v1"), (F.stddev_samp(F.when(~first, F.col("ret"))) * year).alias("v2"))


def true_range(bars: DataFrame) -> DataFrame:
    """Add tr; greatest() skips nulls, so the first bar has its own range."""
    before = F.lag("close").over(by_session())
    return bars.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """Add atr, the plain mean of the last n true ranges (from n + 1 bars on), and atr_pct of the close."""
    d = true_range(bars).withColumn("atr", F.when(F.col("sess_no") > n, F.avg("tr").over(by_session().rowsBetween(1 - n, 0))))
    return d.withColumn("atr_pct", F.col("atr") / F.col("close") * 100)


#: Sessions of one block of smoothed().
BLOCK = 64


def smoothed(bars: DataFrame, n: int, **values: str) -> DataFrame:
    """Add exponential means with factor 1/n (new name=column, never null), from each ticker's first bar on.

    The recurrence y = y' + (x - y') / n has the closed form of a sum with geometric weights. Within a block of sessions it
    is a running sum; what the blocks before give is carried by the last row of each, over as many blocks as have
    a weight that a double can tell from 0 beside 1. So it is windows over a ticker's sessions, which share a shuffle.
    """
    q = 1 - 1 / n
    back = 1
    while q ** (BLOCK * back) > 1e-18:
        back += 1
    w = by_session()
    d = bars.withColumn("_i", F.row_number().over(w) - 1).withColumn("_off", F.col("_i") % BLOCK).withColumn("_ends", F.col("_off") == BLOCK - 1)
    inner = Window.partitionBy("ticker", F.floor(F.col("_i") / BLOCK)).orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    # The first value seeds the mean, so it weighs 1 and not 1/n.
    own = {k: F.pow(F.lit(q), F.col("_off")) * F.sum(F.col(c) * F.when(F.col("_i") == 0, 1.0).otherwise(1 / n) * F.pow(F.lit(q), -F.col("_off"))).over(inner) for k, c in values.items()}
    d = d.withColumns({f"_{k}": v for k, v in own.items()})
    ends = Window.partitionBy("ticker", "_ends").orderBy("session")
    given = {k: sum((F.coalesce(F.lag(f"_{k}", j).over(ends), F.lit(0.0)) * q ** (BLOCK * j) for j in range(1, back)), F.col(f"_{k}")) for k in values}
    d = d.withColumns({f"_to_{k}": F.when(F.col("_ends"), v) for k, v in given.items()})
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    carried = {k: F.coalesce(F.last(f"_to_{k}", ignorenulls=True).over(before), F.lit(0.0)) * F.pow(F.lit(q), F.col("_off") + 1) for k in values}
    d = d.withColumns({k: F.col(f"_{k}") + v for k, v in carried.items()})
    return d.drop("_i", "_off", "_ends", *[f"_{k}" for k in values], *[f"_to_{k}" for k in values])


def rsi(bars: DataFrame, n: int) -> DataFrame:
    """The bars with rsi: the share of the smoothed rises in all smoothed moves, in %, from the n-th close on.

    A bar without a rise or fall counts as neither; where there was no fall at all it is 100. Moves so old that their weight
    is under 1e-18 of a new one's don't count. Bars without a close are left out.
    """
    d = bars.where("close is not null")
    step = F.coalesce(F.col("close") - F.lag("close").over(by_session()), F.lit(0.0))
    d = d.withColumn("_step", step).withColumns({"_rise": F.greatest("_step", F.lit(0.0)), "_fall": F.greatest(-F.col("_step"), F.lit(0.0))})
    d = smoothed(d, n, _up="_rise", _down="_fall")
    value = F.when(F.col("_down") == 0, 100.0).otherwise(F.col("_up") / (F.col("_up") + F.col("_down")) * 100)
    return d.withColumn("rsi", F.when(F.row_number().over(by_session()) >= n, value)).drop("_step", "_rise", "_fall", "_up", "_down")


def volume_fields(bars: DataFrame, n: int = 20, days: int = 25, decline: float = -0.002) -> DataFrame:
    """Add vol_ratio (to the mean of the n sessions before), dollar_vol_m (mean of n, in millions) and dist_days: the
    sessions of the last ``days`` that fell by ``decline`` or more on a greater volume than the session before."""
    before = by_session().rowsBetween(-n, -1)
    ratio = F.when(F.col("sess_no") > n, F.col("volume") / F.avg("volume").over(before))
    fell = (change("close", 1) <= decline) & (F.col("volume") > F.lag("volume").over(by_session()))
    d = bars.withColumn("vol_ratio", ratio).withColumn("dollar_vol_m", full(F.avg(F.col("close") * F.col("volume")), n) / 1e6).withColumn("_fell", F.when(fell, 1).otherwise(0))
    return d.withColumn("dist_days", F.when(F.col("sess_no") > days, F.sum("_fell").over(by_session().rowsBetween(1 - days, 0)))).drop("_fell")


def relative_strength(bars: DataFrame, periods: tuple[int, ...] = (63, 126, 189, 252), weights: tuple[float, ...] = (0.4, 0.2, 0.2, 0.2)) -> DataFrame:
    """ticker, strength and rs_rating of the latest session: place among all tickers with all periods, times 99 / count.

    Equal strengths are placed by ticker. The rating's order is over one row a ticker, in one task, as a ranking of all
    must be; tickers are the rows that a universe has, not those of the bars.
    """
    moves = [F.col("close") / F.lag("close", p).over(by_session()) - 1 for p in periods]
    d = bars.withColumn("strength", sum((m * w for m, w in zip(moves, weights)), F.lit(0.0))).where((F.col("back") == 0) & F.col("strength").isNotNull())
    all_ = Window.partitionBy()
    return d.select("ticker", "strength", (F.row_number().over(Window.orderBy("strength", F.col("ticker"))) / F.count(F.lit(1)).over(all_) * 99).alias("rs_rating"))


def trend_template(bars: DataFrame, ratings: DataFrame, min_rating: float = 70, above_low: float = 30, below_high: float = 25) -> DataFrame:
    """ticker, passes, reason: the first rule of the trend template that the latest session fails (null if none).

    Rules in order: enough bars (221), close > ma150 > ma200, ma200 above that of 21 sessions ago, ma50 > ma150 > ma200,
    close > ma50, close at least ``above_low`` % over the year's low and ``below_high`` % under its high at most, and a
    rating of ``min_rating``. The year is the last 252 sessions, or all there are.
    """
    year = by_session().rowsBetween(-251, 0)
    d = bars.select("ticker", "sess_no", "back", "session", "close", sma("close", 50).alias("ma50"), sma("close", 150).alias("ma150"), sma("close", 200).alias("ma200"), F.min("close").over(year).alias("lo"), F.max("close").over(year).alias("hi"))
    d = d.withColumn("ma200_before", F.lag("ma200", 21).over(by_session())).where("back = 0").join(ratings.select("ticker", "rs_rating"), "ticker", "left")
    c = F.col("close")
    reason = (
        F.when(F.col("sess_no") < 221, "short")
        .when(~((c > F.col("ma150")) & (F.col("ma150") > F.col("ma200"))), "close_ma150_ma200")
        .when(~(F.col("ma200") > F.col("ma200_before")), "ma200_slope")
        .when(~((F.col("ma50") > F.col("ma150")) & (F.col("ma150") > F.col("ma200"))), "ma_order")
        .when(~(c > F.col("ma50")), "close_ma50")
        .when((c / F.col("lo") - 1) * 100 < above_low, "near_low")
        .when((c / F.col("hi") - 1) * 100 < -below_high, "far_from_high")
        .when(F.coalesce(F.col("rs_rating"), F.lit(0.0)) < min_rating, "rating")
    )
    return d.select("ticker", reason.isNull().alias("passes"), reason.alias("reason"))


def band_percentile(bars: DataFrame, n: int = 20, lookback: int = 126) -> DataFrame:
    """ticker, width and bb_pctile of the latest session: the share (in %) of the last ``lookback`` widths below it.

    A width is four deviations over the mean of n sessions. Null before n + lookback - 1 bars.
    """
    d = bars.withColumn("width", full(F.stddev_samp("close"), n) * 4 / sma("close", n)).where(F.col("back") < lookback)
    last = Window.partitionBy("ticker")
    d = d.withColumn("_last", F.max_by("width", "session").over(last))
    g = d.groupBy("ticker").agg(F.first("_last").alias("width"), F.count("width").alias("_n"), F.count(F.when(F.col("width") < F.col("_last"), 1)).alias("_below"))
    return g.select("ticker", "width", F.when(F.col("_n") == lookback, F.col("_below") / lookback * 100).alias("bb_pctile"))


def tight_weeks(bars: DataFrame, weeks: int = 3, threshold: float = 1.5) -> DataFrame:
    """ticker, spread_pct, tight: (max - min) / mean of the last closes of the last ``weeks`` weeks (ending on Friday)."""
    d = bars.withColumn("_week", F.next_day(F.date_sub("session", 1), "FRI")).groupBy("ticker", "_week").agg(F.max_by("close", "session").alias("c"))
    d = d.withColumn("_k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("_week").desc()))).where(F.col("_k") <= weeks)
    g = d.groupBy("ticker").agg(F.count("c").alias("_n"), ((F.max("c") - F.min("c")) / F.avg("c") * 100).alias("spread_pct"))
    return g.where(F.col("_n") == weeks).select("ticker", "spread_pct", (F.col("spread_pct") <= threshold).alias("tight"))


def strength_slope(bars: DataFrame, index: DataFrame, sessions: int) -> DataFrame:
    """ticker, slope_pct_per_week: least squares of close / index over the last sessions, as a share of its first value."""
    d = bars.where(F.col("back") < sessions).join(index, "session").withColumn("_q", F.col("close") / F.col("index_close"))
    w = Window.partitionBy("ticker").orderBy("session")
    d = d.withColumn("_x", F.row_number().over(w)).withColumn("_y", F.col("_q") / F.first("_q").over(w))
    return d.groupBy("ticker").agg((F.regr_slope(F.col("_y"), F.col("_x").cast("double")) * 500).alias("slope_pct_per_week"))


def recent_breakout(bars: DataFrame, lookback: int = 10, min_bars: int = 50, over: float = 1.002, surge: float = 1.7) -> DataFrame:
    """ticker, session, days_since: the latest of the last sessions that closed above all before it on a surge of volume.

    The close is at least ``over`` times the highest before, of at least ``min_bars``, and the volume ``surge`` times the
    mean of the 20 sessions before. days_since counts the latest session as 1.
    """
    top = F.max("close").over(by_session().rowsBetween(Window.unboundedPreceding, -1))
    d = bars.withColumn("_top", top).withColumn("_vol", F.avg("volume").over(by_session().rowsBetween(-20, -1)))
    d = d.where((F.col("back") < lookback) & (F.col("sess_no") > min_bars) & (F.col("close") >= F.col("_top") * over) & (F.col("volume") >= F.col("_vol") * surge))
    return d.groupBy("ticker").agg(F.max("session").alias("session"), (F.min("back") + 1).alias("days_since"))


def crossings(values: DataFrame, column: str, threshold: float, lookback: int) -> DataFrame:
    """ticker, crossings: how often the column fell below the threshold in the last sessions, without the latest."""
    return with_crossings(values, column, threshold, lookback).groupBy("ticker").agg(F.max("crossings").alias("crossings"))


def with_crossings(values: DataFrame, column: str, threshold: float, lookback: int) -> DataFrame:
    """Add crossings() to every row of a ticker, by windows of the one shuffle that its other indicators have."""
    w, whole = by_session(), Window.partitionBy("ticker")
    d = values.withColumn("_before", F.lag(column).over(w)).withColumn("_from_end", F.count(F.lit(1)).over(whole) - F.row_number().over(w))
    hit = (F.col("_before") >= threshold) & (F.col(column) < threshold) & F.col("_from_end").between(1, lookback - 1)
    return d.withColumn("_hit", F.when(hit, 1)).withColumn("crossings", F.count("_hit").over(whole)).drop("_before", "_from_end", "_hit")


def breadth(bars: DataFrame) -> DataFrame:
    """One row: percent of tickers above their 50 and 200 session means at their latest session, highs and lows of 252.

    A ticker without enough bars abstains. A close that is both the highest and the lowest counts as a high.
    """
    d = bars.select("ticker", "sess_no", "back", "session", "close", sma("close", 50).alias("ma50"), sma("close", 200).alias("ma200"), full(F.max("close"), 252).alias("hi"), full(F.min("close"), 252).alias("lo")).where("back = 0")
    high, low = F.col("close") >= F.col("hi"), F.col("close") <= F.col("lo")
    return d.agg(
        (F.avg((F.col("close") > F.col("ma50")).cast("int")) * 100).alias("above_50_pct"),
        (F.avg((F.col("close") > F.col("ma200")).cast("int")) * 100).alias("above_200_pct"),
        F.count(F.when(high, 1)).alias("new_highs"),
        F.count(F.when(~high & low, 1)).alias("new_lows"),
        F.count("hi").alias("n"),
    )


def forward_returns(bars: DataFrame, horizons: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Add fwd_k, the return over the next k sessions in percent; null past the end of the data."""
    return bars.withColumns({f"fwd_{k}": (F.lead("close", k).over(by_session()) / F.col("close") - 1) * 100 for k in horizons})


def bell(value: Column, ideal: float, falloff: float, most: float) -> Column:
    return F.coalesce(F.exp(-0.5 * F.pow((value - ideal) / falloff, 2.0)) * most, F.lit(0.0))


def linear(value: Column, best: float, worst: float, most: float) -> Column:
    """0 at ``worst``, ``most`` at ``best``, clamped; null gives 0, and equal ends give half."""
    if best == worst:
        return F.lit(most / 2)
    return F.coalesce(F.least(F.greatest((value - worst) / (best - worst), F.lit(0.0)), F.lit(1.0)) * most, F.lit(0.0))
