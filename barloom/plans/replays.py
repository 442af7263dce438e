"""Queries that replay trades on the derived bars. Signals: closes that are the lowest of twenty sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import indicators as ind
from barloom.operators import replay
from barloom.plans.market import BARS
from barloom.plans.registry import Registry, tidy
from barloom.sources.bars import index_bars, published

query = Registry(BARS)
_SIG = ", lows as (select *, close = min(close) over (partition by ticker order by session rows 19 preceding) as lowest from bars), sig as materialized (select ticker || '-' || sess_no as sid, ticker, session, sess_no, close as entry, close * 1.5 as target, close * 0.6 as stop, isodow(session) as dow from lows where lowest and sess_no >= 20)"


def _bars(spark, sf):
    return published(spark, sf)


def _signals(bars):
    lowest = F.col("close") == F.min("close").over(ind.by_session().rowsBetween(-19, 0))
    return bars.withColumn("_lowest", lowest).where("_lowest and sess_no >= 20").select(F.concat_ws("-", "ticker", "sess_no").alias("sid"), "ticker", "session", "sess_no", F.col("close").alias("entry"), (F.col("close") * 1.5).alias("target"), (F.col("close") * 0.6).alias("stop"), (F.weekday("session") + 1).alias("dow"))


@query(_SIG + """
, q as (select sid as qid, ticker, session + 2 as day from sig), h as (select q.qid, max(b.session) as s from q join bars b on b.ticker = q.ticker and b.session between q.day - 5 and q.day group by q.qid)
select q.qid, cast(b.session as varchar) as session, b.sess_no, round(b.close, 6) as close from q left join h using (qid) left join bars b on b.ticker = q.ticker and b.session = h.s
""")
def asof_prior_close(spark, sf):
    bars = _bars(spark, sf)
    asked = _signals(bars).select(F.col("sid").alias("qid"), "ticker", F.date_add("session", 2).alias("day"))
    return tidy(replay.as_of(bars, asked).select("qid", "session", "sess_no", "close"))


@query(_SIG + """
, q as (select s.sid, s.ticker, s.sess_no, b.close * 1.01 as recorded from sig s join bars b on b.ticker = s.ticker and b.sess_no = s.sess_no - s.dow % 3),
c as (select q.sid, k.k, b.sess_no as s, abs(b.close / q.recorded - 1) * 100 as off from q, (select unnest([0, 1, 2, 3]) as k) k join bars b on b.ticker = q.ticker and b.sess_no = q.sess_no - k.k),
g as (select sid, min(k) filter (where off <= 2) as hit, arg_min(s, k) filter (where off <= 2) as moved_to, arg_min(s, k) as own, arg_min(off, k) as off from c group by sid)
select sid, coalesce(moved_to, own) as anchor, case when hit = 0 then 'exact' when hit is not null then 'moved' when off <= 5 then 'exact' else 'unit_mismatch' end as status from g
""".replace("from q, (select unnest([0, 1, 2, 3]) as k) k join", "from q cross join (select unnest([0, 1, 2, 3]) as k) k join"))
def asof_re_anchor(spark, sf):
    bars = _bars(spark, sf)
    was = bars.select("ticker", F.col("sess_no").alias("_w"), (F.col("close") * 1.01).alias("recorded"))
    s = _signals(bars).withColumn("_w", F.col("sess_no") - F.col("dow") % 3).join(was, ["ticker", "_w"]).select("sid", "ticker", "sess_no", "recorded")
    return replay.re_anchored(bars, s)


_REPLAY = _SIG + """
, p as (select s.*, b.sess_no - s.sess_no as k, b.open, b.high, b.low, b.close from sig s join bars b on b.ticker = s.ticker and b.sess_no between s.sess_no + 1 and s.sess_no + 10),
g as (select sid, min(k) filter (where high >= target) as w, min(k) filter (where low <= stop) as l, max(k) as n from p group by sid),
d as (select s.*, g.w, g.l, g.n, g.w is not null and (g.l is null or g.w <= g.l) as won, case when g.w is not null and (g.l is null or g.w <= g.l) then g.w when g.l is not null then g.l when g.n >= 10 then 10 end as days from sig s left join g using (sid)),
o as (select d.*, case when n is null then 'no_bars' when won then 'WON' when l is not null then 'LOST' when n >= 10 then 'EXPIRED' else 'OPEN' end as outcome, b.open as xo, b.close as xc, (select min(p.low) from p where p.sid = d.sid and p.k <= d.days) as worst from d left join bars b on b.ticker = d.ticker and b.sess_no = d.sess_no + d.days)
"""
_RESULT = "select sid, outcome, cast(days as int) as days, round((case outcome when 'WON' then {win} when 'LOST' then {lose} when 'EXPIRED' then xc end / entry - 1) * 100, 6) as result_pct, won and w = l as ambiguous, round(case when days is not null then least((worst / entry - 1) * 100, 0) end, 6) as mae_pct from o"


@query(_REPLAY + _RESULT.format(win="target", lose="stop").replace("won and w = l as", "coalesce(won and w = l, false) as"))
def replay_target_stop(spark, sf):
    bars = _bars(spark, sf)
    return tidy(replay.target_stop(bars, _signals(bars), 10)).withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))


@query(_REPLAY + _RESULT.format(win="greatest(target, xo)", lose="least(stop, xo)").replace("won and w = l as", "coalesce(won and w = l, false) as"))
def replay_gap_aware(spark, sf):
    bars = _bars(spark, sf)
    return tidy(replay.target_stop(bars, _signals(bars), 10, gaps=True)).withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))


@query(_SIG + """
, l as (select sid, ticker, sess_no, sess_no + 5 as last_no, entry * 1.2 as pv from sig),
a as (select l.*, b.sess_no as s, b.high, b.close from l join bars b on b.ticker = l.ticker and b.sess_no between l.sess_no and l.last_no + 1),
w as (select sid, min(s) filter (where s > sess_no and high >= pv) as t, max(s) as e, min(close) filter (where s > sess_no) as lo, arg_min(close, s) as c0 from a group by sid),
f as (select l.*, w.t, w.e, w.lo, w.c0, greatest(l.pv, b.open) as fill from l left join w using (sid) left join bars b on b.ticker = l.ticker and b.sess_no = w.t),
x as (select f.sid, min(b.sess_no - f.t) filter (where case when b.sess_no = f.t then b.close else b.low end <= f.fill * 0.92) as k, max(b.close) filter (where b.sess_no = f.t + 5) as c5, max(b.close) filter (where b.sess_no = f.t + 20) as ch, bool_or(b.close < f.pv and b.sess_no - f.t between 1 and 5) as fb,
  min(b.sess_no - f.t) filter (where b.close < f.pv and b.sess_no - f.t between 1 and 3) as cut, arg_min(b.close, b.sess_no) filter (where b.close < f.pv and b.sess_no - f.t between 1 and 3) as cc from f join bars b on b.ticker = f.ticker and b.sess_no between f.t and f.t + 20 where f.t is not null group by f.sid)
select sid, case when t is not null then 'TRIGGERED' when e is null or e <= last_no then 'PENDING' when (lo / c0 - 1) * 100 <= -8 then 'BROKE_DOWN' else 'FADED' end as outcome, t - sess_no as trigger_day, round(case when t is not null then fill end, 6) as fill, round(case when t is not null then (ch / fill - 1) * 100 end, 6) as ret_h, round(case when t is not null then (c5 / fill - 1) * 100 end, 6) as ret_5, cast(fb as varchar) as fellback_5, round(case when k is not null and (cut is null or k <= cut) then -8.0 when cut is not null then (cc / fill - 1) * 100 when t is not null then (ch / fill - 1) * 100 end, 6) as trade_pct,
  cast(case when k is not null and (cut is null or k <= cut) then k when cut is not null then cut when ch is not null then 20 end as int) as exit_day from f left join x using (sid)
""")
def replay_buy_stop(spark, sf):
    bars = _bars(spark, sf)
    listed = _signals(bars).select("sid", "ticker", "sess_no", (F.col("sess_no") + 5).alias("last_no"), (F.col("entry") * 1.2).alias("pivot"))
    return tidy(replay.buy_stop(bars, listed, max_cut=3)).withColumn("fellback_5", F.col("fellback_5").cast("string"))


@query(_SIG + """
, p as (select sid, ticker, sess_no, entry as spot, case dow % 3 when 0 then 'market' when 1 then 'pullback-limit' else 'pivot-stop' end as entry_type, case when dow % 3 = 1 then entry * 0.9 else entry * 1.1 end as level, entry * 0.7 as stop from sig),
w as (select p.*, b.sess_no - p.sess_no as k, b.open, b.high, b.low, b.close from p join bars b on b.ticker = p.ticker and b.sess_no between p.sess_no + 1 and p.sess_no + 5),
m as (select *, case entry_type when 'market' then k = 1 when 'pullback-limit' then low <= level else high >= level end as ok, case entry_type when 'market' then open when 'pullback-limit' then least(level, open) else greatest(level, open) end as price from w),
f as (select sid, min(k) filter (where ok) as fill_day, arg_min(price, k) filter (where ok) as fill, max(k) as n from m group by sid),
d as (select p.*, f.fill_day, f.fill, f.n, case when n is null then 'no_bars' when entry_type = 'market' and fill > spot * 1.03 then 'gap_skip' when fill_day is not null then 'filled' when n < 5 then 'working' else 'expired' end as status from p left join f using (sid)),
x as (select d.sid, arg_min(case when w.k > d.fill_day then least(d.stop, w.open) else least(d.stop, d.fill) end, w.k) filter (where w.low <= d.stop) as x, arg_max(w.close, w.k) as c from d join w using (sid) where d.status = 'filled' and w.k >= d.fill_day group by d.sid)
select sid, status, cast(case when status = 'filled' then fill_day end as bigint) as fill_day, round(case when status = 'filled' then fill end, 6) as fill, round(case when status = 'filled' and fill > stop then (coalesce(x, c) - fill) / (fill - stop) end, 6) as realized_r from d left join x using (sid)
""")
def entry_plan_fill(spark, sf):
    bars = _bars(spark, sf)
    kind = F.col("dow") % 3
    plans = _signals(bars).select(
        "sid", "ticker", "sess_no", F.col("entry").alias("spot"), F.when(kind == 0, "market").when(kind == 1, "pullback-limit").otherwise("pivot-stop").alias("entry_type"),
        F.when(kind == 1, F.col("entry") * 0.9).otherwise(F.col("entry") * 1.1).alias("level"), (F.col("entry") * 0.7).alias("stop"), F.lit(5).alias("valid"),
    )
    return tidy(replay.entry_plans(bars, plans))


@query(_SIG + """
, s as (select sid, ticker, sess_no, entry, sess_no + 12 as out_no from sig), l as (select ticker, close as lc from bars where back = 0), b as (select *, lead(close, 5) over o as c5, lead(close, 10) over o as c10 from bars window o as (partition by ticker order by sess_no))
select sid, case when b.close is null then 'open' else 'resolved' end as status, round((coalesce(b.close, lc) / entry - 1) * 100, 6) as htd_pct, round((c5 / b.close - 1) * 100, 6) as post_5, round((c10 / b.close - 1) * 100, 6) as post_10 from s join l using (ticker) left join b on b.ticker = s.ticker and b.sess_no = s.out_no
""")
def held_to_dropout(spark, sf):
    bars = _bars(spark, sf)
    return tidy(replay.held_to_dropout(bars, _signals(bars).select("sid", "ticker", "sess_no", (F.col("sess_no") + 12).alias("out_no"))))


_IX = ", ix as (select session, avg(close) as c, row_number() over (order by session) as i from bars group by session)"
_MATCH = _REPLAY.replace(_SIG, _SIG + _IX) + """
, t as (select session as day, days, (case outcome when 'WON' then target when 'LOST' then stop when 'EXPIRED' then xc end / entry - 1) * 100 as result_pct from o where days is not null),
m as (select day, count(*) as n, avg(result_pct) as mean_pct, avg((z.c / a.c - 1) * 100) as index_pct from t join ix a on a.session = t.day join ix z on z.i = a.i + t.days group by day)
"""


def _matched(spark, sf):
    bars = _bars(spark, sf)
    signals = _signals(bars)
    trades = replay.target_stop(bars, signals, 10).join(signals.select("sid", F.col("session").alias("day")), "sid")
    return replay.matched_benchmark(index_bars(bars), trades)


@query(_MATCH + "select cast(day as varchar) as day, n, round(mean_pct, 6) as mean_pct, round(index_pct, 6) as index_pct from m")
def matched_benchmark(spark, sf):
    return tidy(_matched(spark, sf))


@query(_MATCH + "select cast(day as varchar) as day, round(sum(mean_pct * n) over w / sum(n) over w, 5) + 0 as running from m window w as (order by day rows unbounded preceding)")
def running_mean(spark, sf):
    return tidy(replay.running_mean(_matched(spark, sf), "day", "n", "mean_pct").select("day", "running"), 5)


_BOARD = """
, r as (select *, close / lag(close) over (partition by ticker order by session) - 1 as ret, close > lag(close, 20) over (partition by ticker order by session) as on_board from bars),
d as (select session as day, count(*) filter (where ret is not null) as n, avg(ln(1 + ret)) filter (where on_board) / 50 as ret from r group by session)
"""


@query(_BOARD + "select cast(day as varchar) as day, n, round(exp(sum(ln(1 + coalesce(ret, 0))) over (order by day rows unbounded preceding)) * 100, 5) as curve from d")
def board_curve(spark, sf):
    bars = ind.daily_returns(_bars(spark, sf)).withColumn("_on", ind.change("close", 20) > 0)
    daily = bars.groupBy(F.col("session").alias("day")).agg(F.count("ret").alias("n"), (F.avg(F.when(F.col("_on"), F.log1p("ret"))) / 50).alias("ret"))
    return tidy(replay.compounded(daily, "day", "ret").select("day", "n", "curve"), 5)


@query(_BOARD + """
, k as (select day, exp(sum(ln(1 + coalesce(ret, 0))) over (order by day rows unbounded preceding)) * 100 as curve, ret from d), f as (select arg_min(curve, day) as base from k where ret is not null)
select cast(day as varchar) as day, round(curve / base * 100, 5) as rebased from k, f
""")
def rebased_curve(spark, sf):
    bars = ind.daily_returns(_bars(spark, sf)).withColumn("_on", ind.change("close", 20) > 0)
    daily = bars.groupBy(F.col("session").alias("day")).agg((F.avg(F.when(F.col("_on"), F.log1p("ret"))) / 50).alias("ret"))
    k = replay.compounded(daily, "day", "ret")
    base = k.where("ret is not null").agg(F.min_by("curve", "day")).scalar()
    return tidy(k.select("day", (F.col("curve") / base * 100).alias("rebased")), 5)


@query("""
, r as (select *, close / lag(close) over (partition by ticker order by session) - 1 as r from bars), d as (select * from r where back < 60 and r is not null), v as (select ticker, stddev_samp(r) * sqrt(252) * 100 as vol_pct from d group by ticker),
c as (select stddev_samp(m) * sqrt(252) * 100 as v from (select back, avg(r) as m from d group by back)), l as (select least(greatest(15 / v, 0.25), 1.0) as leverage from c)
select ticker, round(vol_pct, 6) as vol_pct, round(leverage, 6) as leverage, round(1 / vol_pct / (select sum(1 / vol_pct) from v) * leverage * 100, 6) as weight_pct from v, l
""")
def inverse_vol_weights(spark, sf):
    return tidy(replay.inverse_volatility(_bars(spark, sf)))


@query("""
, t as (select *, close < lag(close) over o as down, open < lag(low) over o as gap, lag(close, 5) over o as c5 from bars window o as (partition by ticker order by session)),
g as (select ticker, coalesce(min(back) filter (where not coalesce(down, false)), max(back)) as down_streak, max((close / c5 - 1) * 100) filter (where back = 0) as ret5_pct, count(*) filter (where gap and back < 5) as down_gaps, avg(volume) filter (where back < 5) / avg(volume) filter (where back < 20) as vol_ratio from t group by ticker)
select ticker, down_streak, round(ret5_pct, 6) as ret5_pct, down_gaps, round(vol_ratio, 6) as vol_ratio, ret5_pct > -4 as quiet from g
""")
def tape_check(spark, sf):
    return tidy(replay.tape(_bars(spark, sf)))


@query(_SIG + """
, t as (select *, greatest(high - low, abs(high - lag(close) over o), abs(low - lag(close) over o)) as tr from bars window o as (partition by ticker order by session)), a as (select *, avg(tr) over (partition by ticker order by session rows 13 preceding) as atr from t),
e as (select sid, ticker, sess_no from sig), m as (select e.sid, max(b.close) as top from e join bars b on b.ticker = e.ticker and b.sess_no >= e.sess_no group by e.sid)
select sid, round(a.close - 2.5 * atr, 6) as close_stop, round(top - 2.5 * atr, 6) as trail_stop from e join m using (sid) join a on a.ticker = e.ticker and a.back = 0
""")
def atr_stops(spark, sf):
    bars = ind.atr(_bars(spark, sf))
    return tidy(replay.trailing_stop(bars, _signals(bars).select("sid", "ticker", "sess_no")))


@query(_SIG + """
, p as (select s.sid, s.ticker, s.session, s.sess_no, coalesce(lag(s.sess_no) over (partition by s.ticker order by s.sess_no), 0) as prior from sig s)
select p.sid, round(max(b.high), 6) as interval_high, count(*) as n from p join bars b on b.ticker = p.ticker and b.sess_no > p.prior and b.sess_no <= p.sess_no group by p.sid
""")
def interval_high(spark, sf):
    bars = _bars(spark, sf)
    # The interval since the run day before is an island of sessions: each bar belongs to the next run day.
    w = Window.partitionBy("ticker").orderBy("sess_no").rowsBetween(0, Window.unboundedFollowing)
    runs = _signals(bars).select("ticker", "sess_no", F.col("sess_no").alias("_at"))
    d = bars.join(runs, ["ticker", "sess_no"], "left").withColumn("_run", F.min("_at").over(w)).where("_run is not null")
    return tidy(d.groupBy(F.concat_ws("-", "ticker", "_run").alias("sid")).agg(F.max("high").alias("interval_high"), F.count(F.lit(1)).alias("n")))


@query(_SIG + """
, h as (select s.sid, k.h, b.close / s.entry - 1 as ret from sig s cross join (select unnest([3, 5, 10]) as h) k join bars b on b.ticker = s.ticker and b.sess_no = s.sess_no + k.h), a as (select *, count(*) over (partition by sid) as n from h)
, r as (select sid, ret as base from a where h = 5 and n = 3)
select cast(h as int) as h, count(*) as n, round(avg(ret) * 100, 5) as mean_pct, round(avg(ret) / h * 100, 5) as per_day_pct, round(avg(ret - base) * 100, 5) as delta_pct, round(1.96 * stddev_samp(ret - base) / sqrt(count(*)) * 100, 5) as ci_pct from a join r using (sid) where n = 3 group by h
""")
def common_sample_horizons(spark, sf):
    bars = _bars(spark, sf)
    b = bars.select("ticker", F.col("sess_no").alias("_s"), "close")
    h = _signals(bars).select("sid", "ticker", "sess_no", "entry", F.explode(F.array(*map(F.lit, (3, 5, 10)))).alias("h")).withColumn("_s", F.col("sess_no") + F.col("h")).join(b, ["ticker", "_s"]).select("sid", "h", (F.col("close") / F.col("entry") - 1).alias("ret"))
    w = Window.partitionBy("sid")
    a = h.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_base", F.max(F.when(F.col("h") == 5, F.col("ret"))).over(w)).where("_n = 3")
    d = F.col("ret") - F.col("_base")
    return tidy(a.groupBy("h").agg(F.count(F.lit(1)).alias("n"), (F.avg("ret") * 100).alias("mean_pct"), (F.avg(F.col("ret") / F.col("h")) * 100).alias("per_day_pct"), (F.avg(d) * 100).alias("delta_pct"), (F.stddev_samp(d) * 1.96 / F.sqrt(F.count(F.lit(1))) * 100).alias("ci_pct")), 5)


@query(_SIG + """
, v as (select *, avg(volume) over (partition by ticker order by sess_no rows between 20 preceding and 1 preceding) as va from bars), l as (select sid, ticker, sess_no, sess_no + 5 as last_no, entry * 1.2 as pv from sig),
a as (select l.*, b.sess_no as s, b.close, b.volume, b.va from l join v b on b.ticker = l.ticker and b.sess_no between l.sess_no and l.last_no + 1),
w as (select sid, min(s) filter (where s > sess_no and close >= pv and volume >= 1.5 * va) as t, max(s) as e, min(close) filter (where s > sess_no) as lo, arg_min(close, s) as c0 from a group by sid),
f as (select l.*, w.t, w.e, w.lo, w.c0, b.open as fill from l left join w using (sid) left join bars b on b.ticker = l.ticker and b.sess_no = w.t + 1),
x as (select f.sid, min(b.sess_no - f.t - 1) filter (where b.low <= f.fill * 0.92) as k, max(b.close) filter (where b.sess_no = f.t + 11) as ch from f join bars b on b.ticker = f.ticker and b.sess_no between f.t + 1 and f.t + 11 where f.fill is not null group by f.sid)
select sid, case when t is not null then 'TRIGGERED' when e is null or e <= last_no then 'PENDING' when (lo / c0 - 1) * 100 <= -8 then 'BROKE_DOWN' else 'FADED' end as outcome, round(fill, 6) as fill, round(case when k is not null then -8.0 else (ch / fill - 1) * 100 end, 6) as trade_pct from f left join x using (sid)
""")
def replay_confirmed_entry(spark, sf):
    bars = _bars(spark, sf)
    listed = _signals(bars).select("sid", "ticker", "sess_no", (F.col("sess_no") + 5).alias("last_no"), (F.col("entry") * 1.2).alias("pivot"))
    return tidy(replay.buy_stop(bars, listed, horizon=10, entry="confirmed").select("sid", "outcome", "fill", "trade_pct"))


QUERIES, SQL = query.queries, query.sql
