"""Trades replayed on daily bars: as-of anchors, targets, stops and horizons, entries and held periods.

Bars carry sess_no, so "k sessions later" is an equality on numbers. A signal meets at most the bars of its horizon, and
first hits are conditional minima, so nothing loops. Signals need a unique ``sid``; ones with a null ticker, session or
price have no outcome (status no_bars).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(bars: DataFrame, asked: DataFrame, tolerance: int = 5) -> DataFrame:
    """asked (qid, ticker, day) with the last bar at or before day: session, sess_no, close; null if older than
    ``tolerance`` calendar days. Bars and questions are merged by ticker and month, and a question looks only at the
    month before its own as well, so no join is by range alone.
    """
    b = bars.select(F.col("ticker").alias("_t"), "session", "sess_no", "close", F.explode(F.sequence(F.trunc("session", "month"), F.trunc(F.date_add("session", tolerance), "month"), F.expr("interval 1 month"))).alias("_m"))
    q = asked.withColumn("_qm", F.trunc("day", "month"))
    near = q.join(b, (q["ticker"] == F.col("_t")) & (F.col("_qm") == F.col("_m")) & (F.col("session") <= F.col("day")) & (F.col("session") >= F.date_sub("day", tolerance)))
    hit = near.groupBy("qid").agg(F.max_by(F.struct("session", "sess_no", "close"), "session").alias("_h"))
    return asked.join(hit, "qid", "left").select(*asked.columns, "_h.session", "_h.sess_no", "_h.close")


def re_anchored(bars: DataFrame, signals: DataFrame, near: float = 2, far: float = 5, back: int = 3) -> DataFrame:
    """Signals (sid, ticker, sess_no, recorded) with their anchor: the bar at sess_no, or the first of up to ``back`` before
    it within ``near`` % of the recorded close; status unit_mismatch if the best one is over ``far`` % off.
    """
    b = bars.select("ticker", F.col("sess_no").alias("_s"), "close")
    c = signals.select("*", F.explode(F.sequence(F.lit(0), F.lit(back))).alias("_k")).withColumn("_s", F.col("sess_no") - F.col("_k")).join(b, ["ticker", "_s"])
    off = F.abs(F.col("close") / F.col("recorded") - 1) * 100
    g = c.groupBy("sid").agg(F.min(F.when(off <= near, F.col("_k"))).alias("_hit"), F.min_by("_s", F.when(off <= near, F.col("_k"))).alias("_at"), F.min_by("_s", "_k").alias("_own"), F.min_by(off, "_k").alias("_off"))
    status = F.when(F.col("_hit").isNotNull(), F.when(F.col("_hit") == 0, "exact").otherwise("moved")).when(F.col("_off") <= far, "exact").otherwise("unit_mismatch")
    return g.select("sid", F.coalesce("_at", "_own").alias("anchor"), status.alias("status"))


def _path(bars: DataFrame, signals: DataFrame, sessions: int, at: str = "sess_no") -> DataFrame:
    """Signals with each of the next ``sessions`` bars, k from 1."""
    b = bars.select("ticker", F.col("sess_no").alias("_s"), "session", "open", "high", "low", "close", "volume")
    return signals.select("*", F.explode(F.sequence(F.lit(1), F.lit(sessions))).alias("k")).withColumn("_s", F.col(at) + F.col("k")).join(b, ["ticker", "_s"])


def in_series_units(bars: DataFrame, signals: DataFrame, near: float = 2, far: float = 5) -> DataFrame:
    """Signals (sid, ticker, sess_no, recorded, target, stop) moved onto the series: sid, ticker, sess_no, entry, target, stop
    and status (ok, unit_mismatch, no_bars).

    The anchor is the bar at sess_no; where its close is over ``near`` % off the recorded one and the bar before is nearer,
    it is that bar. entry is the anchor's close; target and stop are scaled by its ratio to the recorded close, as a series
    adjusted since then has other units. A ratio over ``far`` % off is a mismatch; such prices are null.
    """
    w = Window.partitionBy("ticker").orderBy("sess_no")
    b = bars.select("ticker", "sess_no", F.col("close").alias("_c"), F.lag("close").over(w).alias("_p"))
    d = signals.join(b, ["ticker", "sess_no"], "left")
    own, prior = F.col("_c") / F.col("recorded"), F.col("_p") / F.col("recorded")
    back = (F.abs(own - 1) * 100 > near) & F.coalesce(F.abs(prior - 1) < F.abs(own - 1), F.lit(False))
    d = d.withColumn("_back", back).withColumn("_ratio", F.when(back, prior).otherwise(own))
    status = F.when(F.col("_ratio").isNull(), "no_bars").when(F.abs(F.col("_ratio") - 1) * 100 > far, "unit_mismatch").otherwise("ok")
    ok = status == "ok"
    return d.select(
        "sid", "ticker", (F.col("sess_no") - F.when(F.col("_back"), 1).otherwise(0)).alias("sess_no"), F.when(ok, F.when(F.col("_back"), F.col("_p")).otherwise(F.col("_c"))).alias("entry"),
        *[F.when(ok, F.col(c) * F.col("_ratio")).alias(c) for c in ("target", "stop")], status.alias("status"),
    )


def entered_next_open(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """Signals (sid, ticker, sess_no, target, stop) entered at the next session's open, with ``entry`` and ``status``: ok,
    gap_skip if that open is at or beyond the target or stop already, and no_bars without one."""
    b = bars.select("ticker", (F.col("sess_no") - 1).alias("sess_no"), F.col("open").alias("_o"))
    d = signals.drop("entry", "status").join(b, ["ticker", "sess_no"], "left")
    beyond = (F.col("_o") >= F.col("target")) | F.coalesce(F.col("_o") <= F.col("stop"), F.lit(False))
    return d.withColumn("status", F.when(F.col("_o").isNull(), "no_bars").when(beyond, "gap_skip").otherwise("ok")).withColumnRenamed("_o", "entry")


def target_stop(bars: DataFrame, signals: DataFrame, horizon: int, gaps: bool = False) -> DataFrame:
    """Signals (sid, ticker, sess_no, entry, target, stop) replayed: sid, outcome, days, result_pct, ambiguous, mae_pct.

    The first day with high >= target is WON, unless the stop came on an earlier day; low <= stop is LOST; otherwise
    EXPIRED at the close of day ``horizon``, or OPEN if there are fewer days. A day with both is WON and ambiguous. With
    ``gaps`` fills are at the open where it is beyond the price. mae_pct is the worst low up to the exit, at most 0.
    """
    p = _path(bars, signals, horizon)
    g = p.groupBy("sid").agg(
        F.min(F.when(F.col("high") >= F.col("target"), F.col("k"))).alias("_w"), F.min(F.when(F.col("low") <= F.col("stop"), F.col("k"))).alias("_l"), F.max("k").alias("_n"),
        F.sort_array(F.collect_list(F.struct("k", "open", "low", "close"))).alias("_p"),  # at most ``horizon`` bars
    )
    g = signals.select("sid", "entry", "target", "stop").join(g, "sid", "left")
    won = F.col("_w").isNotNull() & (F.col("_l").isNull() | (F.col("_w") <= F.col("_l")))
    lost = F.col("_l").isNotNull() & ~won
    outcome = F.when(F.col("_n").isNull(), "no_bars").when(won, "WON").when(lost, "LOST").when(F.col("_n") >= horizon, "EXPIRED").otherwise("OPEN")
    days = F.when(won, F.col("_w")).when(lost, F.col("_l")).when(outcome == "EXPIRED", horizon)
    bar = F.try_element_at("_p", days)
    win, lose = (F.greatest("target", bar["open"]), F.least("stop", bar["open"])) if gaps else (F.col("target"), F.col("stop"))
    price = F.when(won, win).when(lost, lose).when(outcome == "EXPIRED", bar["close"])
    worst = F.array_min(F.transform(F.slice("_p", 1, F.coalesce(days, F.lit(0))), lambda b: b["low"]))
    return g.select(
        "sid", outcome.alias("outcome"), days.alias("days"), ((price / F.col("entry") - 1) * 100).alias("result_pct"), (won & F.col("_w").eqNullSafe(F.col("_l"))).alias("ambiguous"),
        F.when(days.isNotNull(), F.least((worst / F.col("entry") - 1) * 100, F.lit(0.0))).alias("mae_pct"),
    )


def buy_stop(bars: DataFrame, listings: DataFrame, horizon: int = 20, stop_pct: float = 8, entry: str = "touch", max_cut: int | None = None, surge: float = 1.5) -> DataFrame:
    """Listed pivots (sid, ticker, sess_no, last_no, pivot) as buy-stop orders: sid, outcome, trigger_day, fill, ret_5, ret_h,
    fellback_5, trade_pct, exit_day.

    The order works from the session after the first listing through the one after the last. ``entry`` touch triggers on
    a high at the pivot and fills there, or at a higher open; close triggers on a close at it, confirmed also needs
    ``surge`` times the mean volume of the 20 sessions before, and both fill at the next open. Day 0 is that of the fill.
    The stop is ``stop_pct`` below it, on day 0 of a touch judged by the close. With ``max_cut`` a close under the pivot on
    day 1 to max_cut ends the trade there, unless the stop came first. Otherwise it ends at the horizon; undecided trades
    have null results. Without a trigger the outcome is BROKE_DOWN if a close in the window was 8 % under the first one,
    else FADED; PENDING until the window has passed.
    """
    before = F.avg("volume").over(Window.partitionBy("ticker").orderBy("sess_no").rowsBetween(-20, -1))
    b = bars.select("ticker", F.col("sess_no").alias("_s"), "open", "high", "low", "close", (F.col("volume") >= surge * before).alias("_surge"))
    at = listings.withColumn("_s", F.explode(F.sequence(F.col("sess_no"), F.col("last_no") + 1))).join(b, ["ticker", "_s"])
    inside = F.col("_s") > F.col("sess_no")
    hits = F.col("high") >= F.col("pivot") if entry == "touch" else F.col("close") >= F.col("pivot")
    hits = hits & F.col("_surge") if entry == "confirmed" else hits
    w = at.groupBy("sid").agg(F.min(F.when(inside & hits, F.col("_s"))).alias("_t"), F.max("_s").alias("_end"), F.min(F.when(inside, F.col("close"))).alias("_low"), F.min_by("close", "_s").alias("_c0"))
    d = listings.join(w, "sid", "left")
    first = F.col("_t") if entry == "touch" else F.col("_t") + 1
    path = d.where("_t is not null").select("sid", "ticker", "pivot", first.alias("_f"), F.explode(F.sequence(F.lit(0), F.lit(horizon))).alias("k")).withColumn("_s", F.col("_f") + F.col("k")).join(b, ["ticker", "_s"])
    start = F.max(F.when(F.col("k") == 0, F.col("open"))).over(Window.partitionBy("sid"))
    path = path.withColumn("fill", F.greatest("pivot", start) if entry == "touch" else start).where("fill is not null")
    test = F.when(F.col("k") == 0, F.col("close")).otherwise(F.col("low")) if entry == "touch" else F.col("low")
    under = F.col("close") < F.col("pivot")
    r = path.withColumn("_test", test).groupBy("sid").agg(
        F.first("fill").alias("fill"), F.min(F.when(F.col("_test") <= F.col("fill") * (1 - stop_pct / 100), F.col("k"))).alias("_stop"), F.max(F.when(F.col("k") == 5, F.col("close"))).alias("_c5"), F.max(F.when(F.col("k") == horizon, F.col("close"))).alias("_ch"),
        F.bool_or(under & F.col("k").between(1, 5)).alias("fellback_5"), F.min(F.when(under & F.col("k").between(1, max_cut or 0), F.col("k"))).alias("_cut"), F.min_by("close", F.when(under & F.col("k").between(1, max_cut or 0), F.col("k"))).alias("_cc"),
    )
    d = d.join(r, "sid", "left")
    pct = lambda c: (F.col(c) / F.col("fill") - 1) * 100
    stopped = F.col("_stop").isNotNull() & (F.col("_cut").isNull() | (F.col("_stop") <= F.col("_cut")))
    outcome = F.when(F.col("_t").isNotNull(), "TRIGGERED").when(F.col("_end").isNull() | (F.col("_end") <= F.col("last_no")), "PENDING").when((F.col("_low") / F.col("_c0") - 1) * 100 <= -8, "BROKE_DOWN").otherwise("FADED")
    return d.select(
        "sid", outcome.alias("outcome"), (F.col("_t") - F.col("sess_no")).alias("trigger_day"), "fill", pct("_c5").alias("ret_5"), pct("_ch").alias("ret_h"), "fellback_5",
        F.when(stopped, F.lit(-float(stop_pct))).when(F.col("_cut").isNotNull(), pct("_cc")).otherwise(pct("_ch")).alias("trade_pct"),
        F.when(stopped, F.col("_stop")).when(F.col("_cut").isNotNull(), F.col("_cut")).when(F.col("_ch").isNotNull(), horizon).alias("exit_day"),
    )


def entry_plans(bars: DataFrame, plans: DataFrame, gap_pct: float = 3) -> DataFrame:
    """Plans (sid, ticker, sess_no, entry_type, level, spot, stop, valid) to fills: sid, status, fill_day, fill, realized_r.

    market fills at the next open unless it gaps over ``gap_pct`` above the spot (skipped). pullback-limit fills at the level, or
    a lower open, on the first day whose low reaches it; pivot-stop at the level, or a higher open, on the first whose high
    does; both within ``valid`` sessions, else expired. A stop on the fill day counts as hit (the pessimistic reading).
    realized_r is the result at the last valid session, or at the stop, in units of the risk.
    """
    b = bars.select("ticker", F.col("sess_no").alias("_s"), "open", "high", "low", "close")
    p = plans.select("*", F.explode(F.sequence(F.lit(1), F.col("valid"))).alias("k")).withColumn("_s", F.col("sess_no") + F.col("k")).join(b, ["ticker", "_s"])
    kind = F.col("entry_type")
    ok = F.when(kind == "market", F.col("k") == 1).when(kind == "pullback-limit", F.col("low") <= F.col("level")).otherwise(F.col("high") >= F.col("level"))
    price = F.when(kind == "market", F.col("open")).when(kind == "pullback-limit", F.least("level", "open")).otherwise(F.greatest("level", "open"))
    f = p.groupBy("sid").agg(F.min(F.when(ok, F.col("k"))).alias("fill_day"), F.min_by(price, F.when(ok, F.col("k"))).alias("fill"), F.max("k").alias("_n"))
    d = plans.join(f, "sid", "left")
    skipped = (kind == "market") & (F.col("fill") > F.col("spot") * (1 + gap_pct / 100))
    d = d.withColumn("status", F.when(F.col("_n").isNull(), "no_bars").when(skipped, "gap_skip").when(F.col("fill_day").isNotNull(), "filled").when(F.col("_n") < F.col("valid"), "working").otherwise("expired"))
    after = p.select("sid", "k", "open", "low", "close").join(d.where("status = 'filled'").select("sid", "fill_day", "fill", "stop"), "sid").where("k >= fill_day")
    out = after.groupBy("sid").agg(F.min(F.when(F.col("low") <= F.col("stop"), F.col("k"))).alias("_k"), F.min_by(F.when(F.col("k") > F.col("fill_day"), F.least("stop", "open")).otherwise(F.least("stop", "fill")), F.when(F.col("low") <= F.col("stop"), F.col("k"))).alias("_x"), F.max_by("close", "k").alias("_c"))
    d = d.join(out, "sid", "left")
    filled = F.col("status") == "filled"
    r = F.try_divide(F.coalesce("_x", "_c") - F.col("fill"), F.col("fill") - F.col("stop"))
    return d.select("sid", "status", F.when(filled, F.col("fill_day")).alias("fill_day"), F.when(filled, F.col("fill")).alias("fill"), F.when(filled & (F.col("fill") > F.col("stop")), r).alias("realized_r"))


def held_to_dropout(bars: DataFrame, spells: DataFrame, after: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Spells (sid, ticker, sess_no, out_no) held from the first close to the drop-out session: sid, status, htd_pct and
    post_k, the returns over the k sessions after it. Without out_no the spell is open and valued at the latest close."""
    last = bars.where("back = 0").select("ticker", F.col("sess_no").alias("_last"), F.col("close").alias("_lc"))
    b = bars.select("ticker", F.col("sess_no").alias("_s"), F.col("close").alias("_c"), *[F.lead("close", k).over(Window.partitionBy("ticker").orderBy("sess_no")).alias(f"_c{k}") for k in after])
    d = spells.join(b.select("ticker", F.col("_s").alias("sess_no"), F.col("_c").alias("_in")), ["ticker", "sess_no"], "left").join(last, "ticker", "left")
    d = d.join(b.select(F.col("ticker"), F.col("_s").alias("out_no"), F.col("_c").alias("_out"), *[f"_c{k}" for k in after]), ["ticker", "out_no"], "left")
    status = F.when(F.col("_in").isNull(), "no_bars").when(F.col("_out").isNull(), "open").otherwise("resolved")
    return d.select("sid", status.alias("status"), ((F.coalesce("_out", "_lc") / F.col("_in") - 1) * 100).alias("htd_pct"), *[((F.col(f"_c{k}") / F.col("_out") - 1) * 100).alias(f"post_{k}") for k in after])


def matched_benchmark(index: DataFrame, trades: DataFrame) -> DataFrame:
    """The index over each trade's own sessions: by day the number of trades, their mean result and the index's.

    index: session, index_close; trades: day, days, result_pct. Trades whose window leaves the index are dropped.
    """
    ix = index.withColumn("_i", F.row_number().over(Window.orderBy("session")))  # one row a session of the calendar
    a = ix.select(F.col("session").alias("day"), F.col("_i").alias("_a"), F.col("index_close").alias("_p"))
    z = ix.select(F.col("_i").alias("_z"), F.col("index_close").alias("_q"))
    d = trades.where("days is not null").join(a, "day").withColumn("_z", F.col("_a") + F.col("days")).join(z, "_z")
    return d.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.avg("result_pct").alias("mean_pct"), F.avg((F.col("_q") / F.col("_p") - 1) * 100).alias("index_pct"))


def running_mean(daily: DataFrame, day: str, n: str, mean: str) -> DataFrame:
    """Add ``running``: the mean of all items up to the day, from daily means weighted by their numbers."""
    w = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    return daily.withColumn("running", F.sum(F.col(mean) * F.col(n)).over(w) / F.sum(n).over(w))


def compounded(daily: DataFrame, day: str, ret: str) -> DataFrame:
    """Add ``curve``: 100 times the compounded daily returns (fractions); a null return carries flat."""
    w = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    return daily.withColumn("curve", F.exp(F.sum(F.log1p(F.coalesce(F.col(ret), F.lit(0.0)))).over(w)) * 100)


def inverse_volatility(bars: DataFrame, sessions: int = 60, target_pct: float = 15, clip: tuple[float, float] = (0.25, 1.0)) -> DataFrame:
    """ticker, vol_pct, leverage, weight_pct: weights inverse to volatility, scaled so the cohort's volatility meets the target."""
    d = bars.withColumn("_r", F.col("close") / F.lag("close").over(Window.partitionBy("ticker").orderBy("session")) - 1).where((F.col("back") < sessions) & F.col("_r").isNotNull())
    year = F.sqrt(F.lit(252.0)) * 100
    vol = d.groupBy("ticker").agg((F.stddev_samp("_r") * year).alias("vol_pct")).where("vol_pct > 0")
    cohort = d.groupBy("back").agg(F.avg("_r").alias("_m")).agg(F.stddev_samp("_m") * year).scalar()
    total = vol.agg(F.sum(1 / F.col("vol_pct"))).scalar()
    vol = vol.withColumn("_t", total).withColumn("leverage", F.least(F.greatest(target_pct / cohort, F.lit(clip[0])), F.lit(clip[1])))
    return vol.select("ticker", "vol_pct", "leverage", (1 / F.col("vol_pct") / F.col("_t") * F.col("leverage") * 100).alias("weight_pct"))


def tape(bars: DataFrame) -> DataFrame:
    """ticker, down_streak, ret5_pct, down_gaps, vol_ratio, quiet of the latest session.

    down_streak counts the falling closes at the end; down_gaps the opens under the low before, of five sessions;
    vol_ratio is the mean volume of five sessions over that of twenty; quiet: the five-session return is above -4 %.
    """
    w = Window.partitionBy("ticker").orderBy("session")
    d = bars.select("ticker", "back", "session", "close", (F.col("close") < F.lag("close").over(w)).alias("_down"), (F.col("open") < F.lag("low").over(w)).alias("_gap"), F.lag("close", 5).over(w).alias("_c5"), "volume", "sess_no")
    g = d.groupBy("ticker").agg(
        F.coalesce(F.min(F.when(~F.coalesce(F.col("_down"), F.lit(False)), F.col("back"))), F.max("back")).alias("down_streak"), F.max_by((F.col("close") / F.col("_c5") - 1) * 100, "session").alias("ret5_pct"),
        F.count(F.when(F.col("_gap") & (F.col("back") < 5), 1)).alias("down_gaps"), (F.avg(F.when(F.col("back") < 5, F.col("volume"))) / F.avg(F.when(F.col("back") < 20, F.col("volume")))).alias("vol_ratio"),
    )
    return g.withColumn("quiet", F.col("ret5_pct") > -4)


def trailing_stop(bars: DataFrame, entries: DataFrame, multiple: float = 2.5) -> DataFrame:
    """entries (sid, ticker, sess_no) with close_stop, the latest close less a multiple of ATR, and trail_stop, the highest
    close since the entry less it; bars need atr."""
    w = Window.partitionBy("ticker").orderBy("sess_no")
    since, whole = w.rowsBetween(0, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # A maximum that runs from the end holds the highest close since each session; an entry meets its own session's row only.
    d = bars.select("ticker", "sess_no", F.max("close").over(since).alias("_top"), F.last("close").over(whole).alias("_c"), F.last("atr").over(whole).alias("_atr"))
    d = entries.select("sid", "ticker", "sess_no").join(d, ["ticker", "sess_no"])
    return d.select("sid", (F.col("_c") - multiple * F.col("_atr")).alias("close_stop"), (F.col("_top") - multiple * F.col("_atr")).alias("trail_stop"))
