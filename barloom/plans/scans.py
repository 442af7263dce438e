"""End-to-end scans and the smaller joins and classes they are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.calendar import trading_days
from barloom.operators import bases
from barloom.operators import indicators as ind
from barloom.operators import replay
from barloom.plans.market import _BASES, _MOMENTUM, _RATING, _RSI, BARS
from barloom.plans.registry import Registry, tidy
from barloom.session import table
from barloom.sources.bars import index_bars, published
from barloom.sources.ledgers import upsert

query, plain = Registry(BARS), Registry()


def _bars(spark, sf):
    return published(spark, sf)


def _lows(bars: DataFrame) -> DataFrame:
    """Signals: closes that are the lowest of twenty sessions."""
    lowest = F.col("close") == F.min("close").over(ind.by_session().rowsBetween(-19, 0))
    return bars.withColumn("_lowest", lowest).where("_lowest and sess_no >= 20").select(
        F.concat_ws("-", "ticker", "sess_no").alias("sid"), "ticker", "sess_no", "back", "volume", F.col("close").alias("entry"), (F.col("close") * 1.5).alias("target"), (F.col("close") * 0.6).alias("stop")
    )


def reversion_score(rsi: Column, d5: Column, d200: Column, freq: Column, threshold: float) -> Column:
    """0 to 100: depth of the RSI (40), pullback (30), trend (15) and rarity (15), each clamped; null parts give 0."""
    clamp = lambda x, most: F.coalesce(F.least(F.greatest(x, F.lit(0.0)), F.lit(float(most))), F.lit(0.0))
    return clamp(40 * (1 - rsi / max(threshold, 0.1)), 40) + clamp(30 * (-d5 / 15), 30) + clamp(15 * d200 / 30, 15) + clamp(15 * (1 - freq / 8), 15)


def reversion_signal(rsi: Column, threshold: float) -> Column:
    return F.when(rsi < threshold / 2, "🔵").when(rsi < threshold, "🟢").when(rsi < 2 * threshold, "🟡").when(rsi > 50, "🔴").when(rsi.isNotNull(), "🟡")


def pullback_class(d20: Column, rsi: Column) -> Column:
    return F.when((F.abs(d20) <= 3) & rsi.between(40, 55), "🟢").when((d20 <= -3) & (rsi < 40), "🔵").when((d20 > 25) | (rsi > 80), "🔴").when((d20 > 15) | (rsi > 70), "🟠").when(d20.isNotNull() & rsi.isNotNull(), "🟡")


_MR = _RSI.format(n=2) + """
, c as (select ticker, session, back, rsi, lag(rsi) over (partition by ticker order by session) as b from rsi), f as (select ticker, count(*) filter (where b >= 10 and rsi < 10 and back between 1 and 59) as freq from c group by ticker),
m as (select ticker, session, back, close, (close / avg(close) over (partition by ticker order by session rows 4 preceding) - 1) * 100 as d5, (close / avg(close) over (partition by ticker order by session rows 199 preceding) - 1) * 100 as d200 from bars),
s as (select m.ticker, rsi.rsi, d5, d200, freq, least(greatest(40 * (1 - rsi.rsi / 50), 0), 40) + least(greatest(30 * (-d5 / 15), 0), 30) + least(greatest(15 * d200 / 30, 0), 15) + least(greatest(15 * (1 - freq / 8), 0), 15) as score from m join rsi using (ticker, session) join f on f.ticker = m.ticker where m.back = 0)
"""


def _reversion(spark, sf, threshold: float) -> DataFrame:
    bars = _bars(spark, sf)
    dist = lambda n: (F.col("close") / ind.sma("close", n) - 1) * 100
    d = ind.with_crossings(ind.rsi(bars, 2), "rsi", 10, 60).select("ticker", "back", "rsi", F.col("crossings").alias("freq"), dist(5).alias("d5"), dist(200).alias("d200")).where("back = 0")
    return d.withColumn("score", reversion_score(F.col("rsi"), F.col("d5"), F.col("d200"), F.col("freq"), threshold))


@query(_MR + "select ticker, round(rsi, 5) as rsi, round(d5, 5) as d5, round(d200, 5) as d200, freq, round(score, 4) as score, row_number() over (order by round(score, 4) desc, round(rsi, 5), ticker) as rank from s where rsi < 100")
def mr_score(spark, sf):
    d = _reversion(spark, sf, 50).where("rsi < 100").select("ticker", F.round("rsi", 5).alias("rsi"), F.round("d5", 5).alias("d5"), F.round("d200", 5).alias("d200"), "freq", F.round("score", 4).alias("score"))
    return d.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "rsi", "ticker")))  # one row a ticker


@query(_MR + ", g as (select case when rsi < 25 then '🔵' when rsi < 50 then '🟢' when rsi < 100 then '🟡' when rsi > 50 then '🔴' when rsi is not null then '🟡' end as signal from s) select signal, count(*) as n from g group by signal")
def mr_signal_counts(spark, sf):
    return _reversion(spark, sf, 50).groupBy(reversion_signal(F.col("rsi"), 50).alias("signal")).agg(F.count(F.lit(1)).alias("n"))


@query(_RSI.format(n=14) + """
, m as (select ticker, session, (close / avg(close) over (partition by ticker order by session rows 19 preceding) - 1) * 100 as d20, back from bars)
select ticker, case when abs(d20) <= 3 and rsi between 40 and 55 then '🟢' when d20 <= -3 and rsi < 40 then '🔵' when d20 > 25 or rsi > 80 then '🔴' when d20 > 15 or rsi > 70 then '🟠' else '🟡' end as class from m join rsi using (ticker, session) where m.back = 0
""")
def pullback_classes(spark, sf):
    bars = _bars(spark, sf)
    d = ind.rsi(bars, 14).select("ticker", "back", "rsi", ((F.col("close") / ind.sma("close", 20) - 1) * 100).alias("d20")).where("back = 0")
    return d.select("ticker", pullback_class(F.col("d20"), F.col("rsi")).alias("class"))


@query("""
, a as (select *, avg(close) over (partition by ticker order by session rows 49 preceding) as ma50, avg(close) over (partition by ticker order by session rows 199 preceding) as ma200 from bars), b as (select *, (ma200 / lag(ma200, 20) over (partition by ticker order by session) - 1) * 100 as slope from a)
select ticker, sess_no >= 221 and close > ma200 and slope > -0.05 and ma50 > ma200 as passes from b where back = 0
""")
def trend_filter_lite(spark, sf):
    w = ind.by_session()
    d = _bars(spark, sf).select("ticker", "session", "sess_no", "back", "close", ind.sma("close", 50).alias("ma50"), ind.sma("close", 200).alias("ma200"))
    d = d.withColumn("slope", (F.col("ma200") / F.lag("ma200", 20).over(w) - 1) * 100).where("back = 0")
    return d.select("ticker", ((F.col("sess_no") >= 221) & (F.col("close") > F.col("ma200")) & (F.col("slope") > -0.05) & (F.col("ma50") > F.col("ma200"))).alias("passes"))


@query("""
, p as (select *, case when close = max(close) over (partition by ticker order by session rows 29 preceding) then high end as snap from bars), l as (select *, last_value(snap ignore nulls) over (partition by ticker order by session rows between unbounded preceding and 1 preceding) as latest, first_value(snap ignore nulls) over (partition by ticker order by session rows between unbounded preceding and unbounded following) as earliest from p)
select ticker, cast(session as varchar) as session, round(coalesce(latest, earliest), 6) as pivot from l
""")
def pivot_in_force(spark, sf):
    w = ind.by_session()
    d = _bars(spark, sf).withColumn("_s", F.when(F.col("close") == F.max("close").over(w.rowsBetween(-29, 0)), F.col("high")))
    latest = F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    earliest = F.first("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return tidy(d.select("ticker", "session", F.coalesce(latest, earliest).alias("pivot")))


@query("""
, d as (select date '1998-06-15' as today), l as (select ticker, arg_max(close, session) as prior_close, max(session) as s from bars, d where session < today group by ticker)
select ticker, round(prior_close, 6) as prior_close, case when s >= date '1998-06-10' then 'daily' else 'stale' end as source from l
""")
def prior_close_map(spark, sf):
    d = published(spark, sf).where("session < date'1998-06-15'").groupBy("ticker").agg(F.max_by("close", "session").alias("prior_close"), F.max("session").alias("_s"))
    return tidy(d.select("ticker", "prior_close", F.when(F.col("_s") >= F.lit("1998-06-10").cast("date"), "daily").otherwise("stale").alias("source")))


@query("""
, r as (select *, (close / lag(close, 20) over (partition by ticker order by session) - 1) * 100 as pct from bars), x as (select cast(ticker as int) % 4 = 0 as defensive, cast(ticker as int) % 4 = 1 as offensive, max(pct) filter (where back = 0) as now, max(pct) filter (where back = 5) as before from r group by ticker)
select round(avg(now) filter (where defensive) - avg(now) filter (where offensive), 6) as spread, round(avg(before) filter (where defensive) - avg(before) filter (where offensive), 6) as spread_5_ago from x
""")
def group_strength(spark, sf):
    d = _bars(spark, sf).withColumn("_p", ind.change("close", 20) * 100)
    side = lambda k, b: F.avg(F.when((F.col("ticker").cast("int") % 4 == k) & (F.col("back") == b), F.col("_p")))
    return tidy(d.agg((side(0, 0) - side(1, 0)).alias("spread"), (side(0, 5) - side(1, 5)).alias("spread_5_ago")))


@query("""
, ix as (select session, avg(close) as c from bars group by session), t as (select session, c, row_number() over (order by session) as i, count(*) over () as n, avg(c) over (order by session rows 49 preceding) as m50, avg(c) over (order by session rows 199 preceding) as m200 from ix),
b as (select avg(cast(close > ma as int)) * 100 as breadth_50_pct from (select ticker, back, close, case when sess_no >= 50 then avg(close) over (partition by ticker order by session rows 49 preceding) end as ma from bars) where back = 0)
select round(c, 4) as index_close, c > m50 as above_50, c > m200 as above_200, round((c / (select c from t t2 where t2.i = t.i - 20) - 1) * 100, 5) as change_20_pct, round(breadth_50_pct, 6) as breadth_50_pct from t, b where i = n
""")
def regime_metrics(spark, sf):
    bars = _bars(spark, sf)
    w = Window.orderBy("session")  # one row a session of the calendar
    t = index_bars(bars).select("session", F.col("index_close"), F.avg("index_close").over(w.rowsBetween(-49, 0)).alias("m50"), F.avg("index_close").over(w.rowsBetween(-199, 0)).alias("m200"), ((F.col("index_close") / F.lag("index_close", 20).over(w) - 1) * 100).alias("change_20_pct"))
    last = t.orderBy(F.col("session").desc()).limit(1).select("index_close", (F.col("index_close") > F.col("m50")).alias("above_50"), (F.col("index_close") > F.col("m200")).alias("above_200"), "change_20_pct")
    one = last.withColumn("breadth_50_pct", ind.breadth(bars).select("above_50_pct").scalar())
    return tidy(one.withColumn("index_close", F.round("index_close", 4)).withColumn("change_20_pct", F.round("change_20_pct", 5)))


@query(_MOMENTUM + _RATING.replace(", m as", ", ms as").replace("from m where back", "from ms where back") + """
, r as (select *, close / lag(close) over (partition by ticker order by session) - 1 as ret from bars), k as (select *, row_number() over (partition by ticker order by session) as i, count(*) over (partition by ticker) as n from r where back < 63 and ret is not null),
h as (select ticker, n as hn, stddev_samp(ret) filter (where i <= n // 2) * sqrt(252) * 100 as v1, stddev_samp(ret) filter (where i > n // 2) * sqrt(252) * 100 as v2 from k group by ticker, n),
p as (select ticker, score, return_pct, row_number() over (order by score desc, ticker) as score_rank from s where return_pct > 0), q as (select p.*, row_number() over (order by score_rank) as rank from p join h using (ticker) where hn < 20 or v1 < 5 or v2 / v1 >= 0.9)
select ticker, round(score, 6) as score, score_rank, rank, round(rs_rating, 6) as rs_rating from q left join rs using (ticker) where rank <= 10
""")
def momentum_scan(spark, sf):
    """Score, gate, volatility filter with a second ranking, and the rating of the top only."""
    bars = _bars(spark, sf)
    by_score = Window.orderBy(F.col("score").desc(), "ticker")  # rankings of one row a ticker
    picks = ind.window_summary(bars, 126).where("return_pct > 0").select("ticker", "score", F.row_number().over(by_score).alias("score_rank"))
    calm = ind.volatility_halves(bars, 63).where("n < 20 or v1 < 5 or v2 / v1 >= 0.9").select("ticker")
    top = picks.join(calm, "ticker").orderBy("score_rank").limit(10).withColumn("rank", F.row_number().over(Window.orderBy("score_rank")))
    return tidy(top.join(ind.relative_strength(bars).select("ticker", "rs_rating"), "ticker", "left"))


@query("""
, lows as (select *, close = min(close) over (partition by ticker order by session rows 19 preceding) as lowest from bars), sig as (select ticker || '-' || sess_no as sid, ticker, sess_no, close as entry, volume from lows where lowest and sess_no >= 20), led as (select sid, 'WON' as outcome from sig where volume > 50), l as (select max(sess_no) as latest, ticker from bars group by ticker)
select s.sid, coalesce(led.outcome, case when l.latest - s.sess_no < 20 then 'O' else 'U' end) as outcome from sig s join l using (ticker) left join led using (sid)
""")
def ledger_outcome_join(spark, sf):
    bars = _bars(spark, sf)
    sig = _lows(bars)
    led = sig.where("volume > 50").select("sid", F.lit("WON").alias("outcome"))
    return sig.join(led, "sid", "left").select("sid", F.coalesce("outcome", F.when(F.col("back") < 20, "O").otherwise("U")).alias("outcome"))


@query("""
, lows as (select *, close = min(close) over (partition by ticker order by session rows 19 preceding) as lowest from bars), sig as (select ticker || '-' || sess_no as sid, ticker, sess_no, close as entry, close * 1.5 as target, close * 0.6 as stop, volume from lows where lowest and sess_no >= 20), led as (select sid from sig where volume > 50), p as (select * from sig where sid not in (select sid from led)),
w as (select p.sid, b.sess_no - p.sess_no as k, b.high, b.low, p.target, p.stop from p join bars b on b.ticker = p.ticker and b.sess_no between p.sess_no + 1 and p.sess_no + 10), g as (select sid, min(k) filter (where high >= target) as w, min(k) filter (where low <= stop) as l, max(k) as n from w group by sid)
select sid, 'KEPT' as outcome from led union all select sid, case when n is null then 'no_bars' when g.w is not null and (l is null or g.w <= l) then 'WON' when l is not null then 'LOST' when n >= 10 then 'EXPIRED' else 'OPEN' end from p left join g using (sid)
""")
def pending_resolved(spark, sf):
    """Only signals without a ledger row are replayed, and then upserted."""
    bars = _bars(spark, sf)
    sig = _lows(bars)
    ledger = sig.where("volume > 50").select("sid", F.lit("KEPT").alias("outcome"))
    pending = sig.join(ledger.select("sid"), "sid", "left_anti")
    return upsert(ledger, replay.target_stop(bars, pending, 10).select("sid", "outcome"), ["sid"])


@plain("""
with e as (select user_id, event_id, ts, value, ts > timestamp '2024-01-20' as future from events where event_type = 'purchase'), r as (select *, row_number() over (partition by user_id, future order by ts desc, event_id desc) as k from e)
select user_id, cast(min(ts) filter (where future) as varchar) as next_at, cast(max(ts) filter (where not future) as varchar) as last_at, round(case when count(*) filter (where not future and k <= 4) = 4 then avg(value) filter (where not future and k <= 4) end, 6) as mean_surprise, round(case when count(*) filter (where not future and k <= 4) = 4 then avg(cast(value > 20 as int)) filter (where not future and k <= 4) * 100 end, 6) as beat_pct from r group by user_id
""")
def earnings_summary(spark, sf):
    now = F.lit("2024-01-20").cast("timestamp_ntz")
    e = table(spark, sf, "events").where("event_type = 'purchase'").withColumn("future", F.col("ts") > now)
    e = e.withColumn("_k", F.row_number().over(Window.partitionBy("user_id", "future").orderBy(F.col("ts").desc(), F.col("event_id").desc())))
    past, recent = ~F.col("future"), ~F.col("future") & (F.col("_k") <= 4)
    four = F.count(F.when(recent, 1)) == 4
    return tidy(e.groupBy("user_id").agg(
        F.min(F.when(F.col("future"), F.col("ts"))).alias("next_at"), F.max(F.when(past, F.col("ts"))).alias("last_at"), F.when(four, F.avg(F.when(recent, F.col("value")))).alias("mean_surprise"), F.when(four, F.avg(F.when(recent, (F.col("value") > 20).cast("int"))) * 100).alias("beat_pct"),
    ))


@query("select ticker, round(max(close) filter (where back = 0), 6) as last, round(max(close) filter (where back = 0) - max(close) filter (where back = 1), 6) as change_abs, round((max(close) filter (where back = 0) / max(close) filter (where back = 1) - 1) * 100, 6) as change_pct from bars where back < 2 group by ticker")
def quote_snapshot(spark, sf):
    g = _bars(spark, sf).where("back < 2").groupBy("ticker").agg(F.max(F.when(F.col("back") == 0, F.col("close"))).alias("last"), F.max(F.when(F.col("back") == 1, F.col("close"))).alias("_p"))
    return tidy(g.select("ticker", "last", (F.col("last") - F.col("_p")).alias("change_abs"), ((F.col("last") / F.col("_p") - 1) * 100).alias("change_pct")))


#: Zones of exchanges by a symbol's suffix; others are New York's.
EXCHANGES = {".T": "Asia/Tokyo", ".HK": "Asia/Hong_Kong", ".L": "Europe/London", ".PA": "Europe/Paris", ".DE": "Europe/Berlin", ".SA": "America/Sao_Paulo", ".AX": "Australia/Sydney"}


@plain("""
with p as (select distinct run_id, ticker, run_date from mom_history where ticker is not null and run_date is not null), z as (select *, case when ticker like '%.T' then 'Asia/Tokyo' when ticker like '%.HK' then 'Asia/Hong_Kong' when ticker like '%.L' then 'Europe/London' when ticker like '%.PA' then 'Europe/Paris' when ticker like '%.DE' then 'Europe/Berlin' when ticker like '%.SA' then 'America/Sao_Paulo' when ticker like '%.AX' then 'Australia/Sydney' else 'America/New_York' end as zone from p)
select zone, cast(cast(timezone(zone, timezone('UTC', run_date)) as date) as varchar) as local_day, count(*) as n from z group by all
""")
def exchange_days(spark, sf):
    p = table(spark, sf, "mom_history").select("run_id", "ticker", "run_date").dropna(subset=["ticker", "run_date"]).distinct()
    known = F.create_map(*[F.lit(v) for pair in EXCHANGES.items() for v in pair])
    zone = F.coalesce(F.try_element_at(known, F.regexp_extract("ticker", r"(\.[A-Z]+)$", 1)), F.lit("America/New_York"))
    d = p.withColumn("zone", zone)
    return tidy(d.groupBy("zone", F.convert_timezone(F.lit("UTC"), F.col("zone"), F.col("run_date")).cast("date").alias("local_day")).agg(F.count(F.lit(1)).alias("n")))


@plain("""
with u as (select * from (select *, row_number() over (partition by ticker order by ts desc, update_id desc) as k from sector_updates where ticker is not null and ts is not null) where k = 1), m as (select max(ts) as now from sector_updates)
select ticker, ts < now - 30 * 86400 as refresh from u, m
""")
def sector_cache_ttl(spark, sf):
    u = table(spark, sf, "sector_updates").where("ticker is not null and ts is not null").groupBy("ticker").agg(F.max("ts").alias("ts"))
    now = u.agg(F.max("ts")).scalar()
    return u.select("ticker", (F.col("ts") < now - 30 * 86400).alias("refresh"))


@plain("""
with s as (select s_suppkey, n_name as industry, r_name as sector from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey), i as (select distinct industry, sector from s)
select s.s_suppkey, i.industry as peer, i.industry = s.industry as is_self from s join i using (sector)
""")
def peer_lookup(spark, sf):
    n = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("industry"), F.col("r_name").alias("sector"))
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    i = s.select("sector", F.col("industry").alias("peer")).distinct()
    return s.join(i, "sector").select("s_suppkey", "peer", (F.col("peer") == F.col("industry")).alias("is_self"))


@plain("""
with p as (select event_id, cast(ts as date) as day, event_type from events where event_type in ('click', 'purchase')), b as (select event_id, cast(ts as date) as day, event_type from events where event_type = 'view')
select event_id, cast(day as varchar) as day, 'primary' as source from p where day % 1 is null or day <> date '2024-01-10' union all select event_id, cast(day as varchar), 'backup' from b where day not in (select day from p where day <> date '2024-01-10')
""".replace("day % 1 is null or ", ""))
def econ_with_backup(spark, sf):
    """A primary feed, with the backup's rows only for days on which the primary has none."""
    e = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"), "event_type")
    primary = e.where("event_type in ('click', 'purchase') and day <> date'2024-01-10'")
    backup = e.where("event_type = 'view'").join(primary.select("day").distinct(), "day", "left_anti")
    return tidy(primary.select("event_id", "day", F.lit("primary").alias("source")).unionByName(backup.select("event_id", "day", F.lit("backup").alias("source"))))


@plain("""
with w as (select cast(day as date) as day from (select unnest(range(date '2025-05-06', date '2025-05-20', interval 1 day)) as day) where isodow(day) < 6 order by day limit 5)
select signal_id, packet_date from (select distinct signal_id, packet_date from signals) s where try_cast(packet_date as date) in (select day from w)
""")
def spark_window(spark, sf):
    """Signals dated on the five trading days after 5 May 2025."""
    days = trading_days(spark, 2025, 2025).where("day > date'2025-05-05'").orderBy("day").limit(5)
    s = table(spark, sf, "signals").select("signal_id", "packet_date").distinct()
    return s.withColumn("day", F.col("packet_date").try_cast("date")).join(F.broadcast(days.select("day")), "day", "left_semi").select("signal_id", "packet_date")


@plain("""
with r as (select user_id, value, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events), p as (select user_id, max(value) filter (where k = 1) as now, max(value) filter (where k = 6) as before from r group by user_id)
select user_id, case when before is null then '·' when now - before > 5 then '↑' when now - before < -5 then '↓' else '→' end as arrow from p
""")
def direction_arrow(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    r = table(spark, sf, "events").where("value is not null").withColumn("_k", F.row_number().over(w)).where("_k in (1, 6)")
    p = r.groupBy("user_id").agg(F.max(F.when(F.col("_k") == 1, F.col("value"))).alias("a"), F.max(F.when(F.col("_k") == 6, F.col("value"))).alias("b"))
    step = F.col("a") - F.col("b")
    return p.select("user_id", F.when(F.col("b").isNull(), "·").when(step > 5, "↑").when(step < -5, "↓").otherwise("→").alias("arrow"))


@plain("""
with o as (select *, max(o_orderdate) over () as last from orders), w as (select o_orderkey, o_totalprice, o_orderdate, case when o_orderdate > last - interval 30 day then '1mo' when o_orderdate > last - interval 365 day then '1y' when year(o_orderdate) = year(last) then 'ytd' else 'max' end as period from o)
select period, count(*) as n, round(sum(o_totalprice), 2) as total from w group by period
""")
def period_windows(spark, sf):
    o = table(spark, sf, "orders").select("o_orderdate", "o_totalprice")
    d = o.withColumn("_l", o.agg(F.max("o_orderdate")).scalar())
    period = F.when(F.col("o_orderdate") > F.col("_l") - F.expr("interval 30 day"), "1mo").when(F.col("o_orderdate") > F.col("_l") - F.expr("interval 365 day"), "1y").when(F.year("o_orderdate") == F.year("_l"), "ytd").otherwise("max")
    return tidy(d.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2)


@plain("""
with t as (select event_id, case when event_id % 3 = 0 then '' else event_type end as a, nullif(props, '') as b, case when event_id % 2 = 0 then 'NaN' else cast(value as varchar) end as c from events)
select event_id, coalesce(nullif(nullif(trim(a), ''), 'NaN'), nullif(nullif(trim(c), ''), 'NaN'), b) as picked from t
""")
def first_populated(spark, sf):
    e = F.col("event_id")
    d = table(spark, sf, "events").select("event_id", F.when(e % 3 == 0, "").otherwise(F.col("event_type")).alias("a"), F.nullif("props", F.lit("")).alias("b"), F.when(e % 2 == 0, "NaN").otherwise(F.col("value").cast("string")).alias("c"))
    there = lambda c: F.nullif(F.nullif(F.trim(c), F.lit("")), F.lit("NaN"))
    return d.select("event_id", F.coalesce(there("a"), there("c"), "b").alias("picked"))


@query("""
, r as (select row_number() over (partition by ticker order by session) as i, * from bars), w as (select ticker, session, (lead(close, 20) over (partition by ticker order by session) / close - 1) * 100 as fwd_20 from bars),
i as (select session, avg(close) as c from bars group by session), s as (select session, case when c > avg(c) over (order by session rows 199 preceding) then 'up' else 'down' end as state from i)
select state, count(fwd_20) as n, round(count(fwd_20) / 20.0, 6) as independent_n, round(avg(fwd_20), 4) as mean_fwd, round(avg(cast(fwd_20 > 0 as int)) * 100, 6) as win_pct from w join s using (session) group by state
""")
def state_forward(spark, sf):
    bars = _bars(spark, sf)
    w = Window.orderBy("session").rowsBetween(-199, 0)  # one row a session of the calendar
    states = index_bars(bars).select("session", F.when(F.col("index_close") > F.avg("index_close").over(w), "up").otherwise("down").alias("state"))
    d = ind.forward_returns(bars, (20,)).join(states, "session")
    n = F.count("fwd_20")
    return tidy(d.groupBy("state").agg(n.alias("n"), (n / 20).alias("independent_n"), F.round(F.avg("fwd_20"), 4).alias("mean_fwd"), (F.avg((F.col("fwd_20") > 0).cast("int")) * 100).alias("win_pct")))


_SCAN = _BASES[: _BASES.index("select ticker, \"offset\"")] + ", bs as (" + _BASES[_BASES.index("select ticker, \"offset\"") :].strip() + ")" + _RATING.replace(", m as", ", ms as").replace("from m where back", "from ms where back") + """
, wd as (select *, case when sess_no >= 20 then stddev_samp(close) over w * 4 / avg(close) over w end as width from bars window w as (partition by ticker order by session rows 19 preceding)), wl as (select *, first_value(width) over (partition by ticker order by back) as last from wd where back < 126),
bb as (select ticker, case when count(width) = 126 then count(*) filter (where width < last) / 126 * 100 end as bb_pctile from wl group by ticker)
select ticker, days, round(quality, 6) as quality, round(bb_pctile, 6) as bb_pctile, round(rs_rating, 6) as rs_rating, case when breakout_day and today_ratio >= 1.5 then '🚀' when to_pivot_pct between -3 and 0 and bb_pctile < 25 and dryup < 0.95 then '🔥' when to_pivot_pct >= -10 and to_pivot_pct < -3 and bb_pctile < 30 then '⏳' else '📊' end as signal, row_number() over (order by quality desc, ticker) as rank
from bs left join bb using (ticker) left join rs using (ticker)
"""


@query(_SCAN)
def breakout_scan(spark, sf):
    """Bases with their squeeze, rating, signal class and rank; the test prices are wild, so width and gate are open."""
    bars = _bars(spark, sf)
    d = bases.detect_bases(bars, max_width=99, from_high=99).join(ind.band_percentile(bars).select("ticker", "bb_pctile"), "ticker", "left").join(ind.relative_strength(bars).select("ticker", "rs_rating"), "ticker", "left")
    p, b = F.col("to_pivot_pct"), F.col("bb_pctile")
    signal = F.when(F.col("breakout_day") & (F.col("today_ratio") >= 1.5), "🚀").when(p.between(-3, 0) & (b < 25) & (F.col("dryup") < 0.95), "🔥").when((p >= -10) & (p < -3) & (b < 30), "⏳").otherwise("📊")
    rank = F.row_number().over(Window.orderBy(F.col("quality").desc(), "ticker"))  # one row a ticker
    return tidy(d.select("ticker", "days", "quality", "bb_pctile", "rs_rating", signal.alias("signal"), rank.alias("rank")))


@plain("""
with o as (select distinct * from outcomes), s as (select count(*) as signals from (select distinct signal_id from signals)), w as (select count(*) filter (where outcome = 'OPEN') as open, count(*) filter (where outcome = 'WON') as won from o), t as (select count(distinct ticker) as tickers from appearances where ticker is not null),
u as (select max(run_day) as latest from run_days) select latest, tickers, signals, open, won from u, t, s, w
""")
def daily_packet(spark, sf):
    """One row from several sources, each a scalar subquery; a source without rows leaves its fields null or 0."""
    o = table(spark, sf, "outcomes").select("outcome_id", "outcome").distinct()
    n = lambda d: d.agg(F.count(F.lit(1))).scalar()
    return spark.range(1).select(
        table(spark, sf, "run_days").agg(F.max("run_day")).scalar().alias("latest"), n(table(spark, sf, "appearances").where("ticker is not null").select("ticker").distinct()).alias("tickers"),
        n(table(spark, sf, "signals").select("signal_id").distinct()).alias("signals"), n(o.where("outcome = 'OPEN'")).alias("open"), n(o.where("outcome = 'WON'")).alias("won"),
    )


QUERIES, SQL = query.queries | plain.queries, query.sql | plain.sql
