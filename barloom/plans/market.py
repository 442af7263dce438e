"""Queries on daily bars: indicators, gates, scores, breadth and bases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators import bases
from barloom.operators import indicators as ind
from barloom.sources.bars import index_bars, long_enough, published


def _bars(spark: SparkSession, sf: str) -> DataFrame:
    return published(spark, sf)


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, since sums depend on the order of rows, and days as text."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes])


def _last(df: DataFrame, *cols: str) -> DataFrame:
    return _r(df.where("back = 0").select("ticker", *cols))


#: Common table expressions of the oracle.
BARS = """
with trades as (select cast(l_suppkey as varchar) as ticker, cast(l_shipdate as date) as session, l_extendedprice / l_quantity as price, l_quantity, (l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) as k from lineitem),
daily as materialized (select ticker, session, arg_min(price, k) as open, max(price) as high, min(price) as low, arg_max(price, k) as close, sum(l_quantity) as volume from trades where price is not null group by all),
bars as materialized (select *, row_number() over w as sess_no, count(*) over (partition by ticker) - row_number() over w as back from daily window w as (partition by ticker order by session))
"""
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL on top of ``bars``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = BARS + sql
        return f

    return add


@query("select ticker, cast(session as varchar) as session, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, volume, sess_no, back from bars")
def daily_bars(spark, sf):
    return _r(_bars(spark, sf))


@query(", c as (select *, count(close) over (partition by ticker) as n from bars where close is not null) select ticker, count(*) as n, round(sum(close), 4) as total from c where n >= 500 group by ticker")
def length_guard(spark, sf):
    return _r(long_enough(_bars(spark, sf), "close", 500).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.sum("close").alias("total")), 4)


_MOMENTUM = """
, w as (select *, close / lag(close) over o - 1 as r, close / max(close) over (partition by ticker order by session rows unbounded preceding) - 1 as dd from bars where back < 126 window o as (partition by ticker order by session)),
g as (select ticker, count(close) as n, arg_max(close, session) as close, (arg_max(close, session) / arg_min(close, session) - 1) * 100 as return_pct, min(dd) * 100 as max_dd_pct, (arg_max(close, session) / max(close) - 1) * 100 as from_high_pct, stddev_samp(r) * sqrt(252) * 100 as ann_vol_pct from w group by ticker),
s as (select *, return_pct / greatest(abs(max_dd_pct), 1) as score from g)
"""
_ROUND = "select ticker, n, round(close, 6) as close, round(return_pct, 6) as return_pct, round(max_dd_pct, 6) as max_dd_pct, round(from_high_pct, 6) as from_high_pct, round(ann_vol_pct, 6) as ann_vol_pct, round(score, 6) as score"


@query(_MOMENTUM + _ROUND + " from s")
def momentum_score(spark, sf):
    return _r(ind.window_summary(_bars(spark, sf), 126))


@query(_MOMENTUM + "select ticker, round(score, 6) as score, rank from (select *, row_number() over (order by score desc, ticker) as rank from s where return_pct > 0 and max_dd_pct > -100) where rank <= 20")
def momentum_top(spark, sf):
    s = ind.window_summary(_bars(spark, sf), 126).where("return_pct > 0 and max_dd_pct > -100")
    top = s.orderBy(F.col("score").desc(), "ticker").limit(20)  # the ranking is over 20 rows
    return _r(top.select("ticker", "score", F.row_number().over(Window.orderBy(F.col("score").desc(), "ticker")).alias("rank")))


@query("""
, r as (select *, close / lag(close) over (partition by ticker order by session) - 1 as ret from bars),
k as (select *, row_number() over (partition by ticker order by session) as i, count(*) over (partition by ticker) as n from r where back < 63 and ret is not null),
h as (select ticker, n, stddev_samp(ret) filter (where i <= n // 2) * sqrt(252) * 100 as v1, stddev_samp(ret) filter (where i > n // 2) * sqrt(252) * 100 as v2 from k group by ticker, n)
select ticker, n, round(v1, 6) as v1, round(v2, 6) as v2, n < 20 or v1 < 5 or v2 / v1 >= 0.5 as kept from h
""")
def vol_collapse_split(spark, sf):
    h = ind.volatility_halves(_bars(spark, sf), 63)
    return _r(h.withColumn("kept", (F.col("n") < 20) | (F.col("v1") < 5) | (F.col("v2") / F.col("v1") >= 0.5)))


@query("""
, t as (select *, greatest(high - low, abs(high - lag(close) over o), abs(low - lag(close) over o)) as tr from bars window o as (partition by ticker order by session)),
a as (select *, case when sess_no > 14 then avg(tr) over (partition by ticker order by session rows 13 preceding) end as atr from t)
select ticker, cast(session as varchar) as session, round(tr, 6) as tr, round(atr, 6) as atr, round(atr / close * 100, 6) as atr_pct from a
""")
def atr14(spark, sf):
    return _r(ind.atr(_bars(spark, sf)).select("ticker", "session", "tr", "atr", "atr_pct"))


_RSI = """
, d as (select ticker, session, sess_no, back, coalesce(greatest(close - lag(close) over o, 0), 0) as g, coalesce(greatest(lag(close) over o - close, 0), 0) as l from bars window o as (partition by ticker order by session)),
e as (select a.ticker, a.session, any_value(a.back) as back, any_value(a.sess_no) as sess_no, sum(b.g * case when b.sess_no = 1 then 1 else 1.0 / {n} end * pow(1 - 1.0 / {n}, a.sess_no - b.sess_no)) as g, sum(b.l * case when b.sess_no = 1 then 1 else 1.0 / {n} end * pow(1 - 1.0 / {n}, a.sess_no - b.sess_no)) as l
  from d a join d b on a.ticker = b.ticker and b.sess_no <= a.sess_no group by a.ticker, a.session),
rsi as (select ticker, session, back, case when sess_no >= {n} then case when l = 0 then 100 else 100 - 100 / (1 + g / l) end end as rsi from e)
"""


@query(_RSI.format(n=2) + "select ticker, cast(session as varchar) as session, round(rsi, 5) as rsi from rsi")
def rsi2_wilder(spark, sf):
    return _r(ind.rsi(_bars(spark, sf), 2).select("ticker", "session", "rsi"), 5)


@query(_RSI.format(n=14) + "select ticker, cast(session as varchar) as session, round(rsi, 5) as rsi from rsi")
def rsi14_wilder(spark, sf):
    return _r(ind.rsi(_bars(spark, sf), 14).select("ticker", "session", "rsi"), 5)


@query(_RSI.format(n=2) + ", c as (select *, lag(rsi) over (partition by ticker order by session) as b from rsi) select ticker, count(*) filter (where b >= 10 and rsi < 10 and back between 1 and 59) as crossings from c group by ticker")
def crossing_count(spark, sf):
    return ind.crossings(ind.rsi(_bars(spark, sf), 2), "rsi", 10, 60)


_VOLUME = """
, f as (select *, case when close / lag(close) over o - 1 <= -0.002 and volume > lag(volume) over o then 1 else 0 end as fell from bars window o as (partition by ticker order by session)),
v as (select *, case when sess_no > 20 then volume / avg(volume) over (partition by ticker order by session rows between 20 preceding and 1 preceding) end as vol_ratio,
  case when sess_no >= 20 then avg(close * volume) over (partition by ticker order by session rows 19 preceding) / 1e6 end as dollar_vol_m,
  case when sess_no > 25 then sum(fell) over (partition by ticker order by session rows 24 preceding) end as dist_days from f)
"""


@query(_VOLUME + "select ticker, round(vol_ratio, 6) as vol_ratio, round(dollar_vol_m, 6) as dollar_vol_m, cast(dist_days as bigint) as dist_days from v where back = 0")
def volume_fields(spark, sf):
    return _last(ind.volume_fields(_bars(spark, sf)), "vol_ratio", "dollar_vol_m", "dist_days")


@query(_VOLUME + "select ticker, case when dist_days is null then null when dist_days <= 1 then 'clean' when dist_days < 4 then 'mixed' else 'loaded' end || case when vol_ratio >= 1.5 then '+surge' when vol_ratio < 0.8 then '+quiet' else '' end as tier from v where back = 0")
def entry_quality(spark, sf):
    d = ind.volume_fields(_bars(spark, sf)).where("back = 0")
    base = F.when(F.col("dist_days") <= 1, "clean").when(F.col("dist_days") < 4, "mixed").when(F.col("dist_days").isNotNull(), "loaded")
    more = F.when(F.col("vol_ratio") >= 1.5, "+surge").when(F.col("vol_ratio") < 0.8, "+quiet").otherwise("")
    return d.select("ticker", F.concat(base, more).alias("tier"))


_RATING = """
, m as (select *, 0.4 * (close / lag(close, 63) over o - 1) + 0.2 * (close / lag(close, 126) over o - 1) + 0.2 * (close / lag(close, 189) over o - 1) + 0.2 * (close / lag(close, 252) over o - 1) as strength from bars window o as (partition by ticker order by session)),
rs as (select ticker, strength, row_number() over (order by strength, ticker) / count(*) over () * 99 as rs_rating from m where back = 0 and strength is not null)
"""


@query(_RATING + "select ticker, round(strength, 6) as strength, round(rs_rating, 6) as rs_rating from rs")
def rs_rating(spark, sf):
    return _r(ind.relative_strength(_bars(spark, sf)))


@query(_RATING + """
, a as (select *, case when sess_no >= 50 then avg(close) over (partition by ticker order by session rows 49 preceding) end as ma50, case when sess_no >= 150 then avg(close) over (partition by ticker order by session rows 149 preceding) end as ma150,
  case when sess_no >= 200 then avg(close) over (partition by ticker order by session rows 199 preceding) end as ma200, min(close) over (partition by ticker order by session rows 251 preceding) as lo, max(close) over (partition by ticker order by session rows 251 preceding) as hi from bars),
b as (select *, lag(ma200, 21) over (partition by ticker order by session) as before from a),
j as (select ticker, case when sess_no < 221 then 'short' when not (close > ma150 and ma150 > ma200) then 'close_ma150_ma200' when not (ma200 > before) then 'ma200_slope' when not (ma50 > ma150 and ma150 > ma200) then 'ma_order'
  when not (close > ma50) then 'close_ma50' when (close / lo - 1) * 100 < 30 then 'near_low' when (close / hi - 1) * 100 < -25 then 'far_from_high' when coalesce(rs_rating, 0) < 70 then 'rating' end as reason from b left join rs using (ticker) where back = 0)
select ticker, reason is null as passes, reason from j
""")
def trend_template_reason(spark, sf):
    bars = _bars(spark, sf)
    return ind.trend_template(bars, ind.relative_strength(bars))


@query("""
, b as (select *, case when sess_no >= 20 then stddev_samp(close) over w * 4 / avg(close) over w end as width from bars window w as (partition by ticker order by session rows 19 preceding)),
l as (select *, first_value(width) over (partition by ticker order by back) as last from b where back < 126)
select ticker, round(any_value(last), 6) as width, round(case when count(width) = 126 then count(*) filter (where width < last) / 126 * 100 end, 6) as bb_pctile from l group by ticker
""")
def bb_width_pctile(spark, sf):
    return _r(ind.band_percentile(_bars(spark, sf)))


@query("""
, w as (select ticker, session + cast((12 - isodow(session)) % 7 as integer) as week, arg_max(close, session) as c from bars group by all),
k as (select *, row_number() over (partition by ticker order by week desc) as k from w),
g as (select ticker, count(c) as n, (max(c) - min(c)) / avg(c) * 100 as spread_pct from k where k <= 3 group by ticker)
select ticker, round(spread_pct, 6) as spread_pct, spread_pct <= 1.5 as tight from g where n = 3
""")
def three_weeks_tight(spark, sf):
    return _r(ind.tight_weeks(_bars(spark, sf)))


_INDEX = ", ix as (select session, avg(close) as index_close from bars group by session)"


@query(_INDEX + """
, q as (select *, close / index_close as q, row_number() over (partition by ticker order by session) as x from bars join ix using (session) where back < 100),
y as (select *, q / first_value(q) over (partition by ticker order by session) as y from q)
select ticker, round(regr_slope(y, x) * 500, 6) as slope_pct_per_week from y group by ticker
""")
def rs_slope(spark, sf):
    bars = _bars(spark, sf)
    return _r(ind.strength_slope(bars, index_bars(bars), 100))


@query("""
, t as (select *, max(close) over (partition by ticker order by session rows between unbounded preceding and 1 preceding) as top, avg(volume) over (partition by ticker order by session rows between 20 preceding and 1 preceding) as v from bars)
select ticker, cast(max(session) as varchar) as session, min(back) + 1 as days_since from t where back < 250 and sess_no > 50 and close >= top * 1.002 and volume >= v * 1.1 group by ticker
""")
def recent_breakout(spark, sf):
    return _r(ind.recent_breakout(_bars(spark, sf), lookback=250, surge=1.1))


_BREADTH = """
, m as (select *, case when sess_no >= 50 then avg(close) over (partition by ticker order by session rows 49 preceding) end as ma50, case when sess_no >= 200 then avg(close) over (partition by ticker order by session rows 199 preceding) end as ma200,
  case when sess_no >= 252 then max(close) over (partition by ticker order by session rows 251 preceding) end as hi, case when sess_no >= 252 then min(close) over (partition by ticker order by session rows 251 preceding) end as lo from bars)
"""


@query(_BREADTH + "select round(avg(cast(close > ma50 as int)) * 100, 6) as above_50_pct, round(avg(cast(close > ma200 as int)) * 100, 6) as above_200_pct, count(*) filter (where close >= hi) as new_highs, count(*) filter (where close < hi and close <= lo) as new_lows, count(hi) as n from m where back = 0")
def breadth(spark, sf):
    return _r(ind.breadth(_bars(spark, sf)))


@query("select ticker, cast(session as varchar) as session, round((lead(close, 5) over o / close - 1) * 100, 6) as fwd_5, round((lead(close, 10) over o / close - 1) * 100, 6) as fwd_10, round((lead(close, 20) over o / close - 1) * 100, 6) as fwd_20 from bars window o as (partition by ticker order by session)")
def forward_returns(spark, sf):
    return _r(ind.forward_returns(_bars(spark, sf)).select("ticker", "session", "fwd_5", "fwd_10", "fwd_20"))


_BASES = """
, l as (select ticker, list(close order by session) as c, list(volume order by session) as v from bars where back < 252 group by ticker having count(*) = 252),
g as (select *, c[252] as last from l where (c[252] / list_max(c) - 1) * 100 >= -99),
e as (select ticker, c, v, last, o.o as "offset", d.d as days, c[252 - o.o - d.d + 1 : 252 - o.o] as s from g, (select unnest([0, 3]) as o) o, (select unnest(range(30, 201, 5)) as d) d where d.d <= 252 - o.o - 1),
w as (select *, list_max(s) as hi, (list_max(s) - list_min(s)) / list_max(s) * 100 as width_pct, (last / list_max(s) - 1) * 100 as to_pivot_pct from e),
q as (select *, days / greatest(width_pct, 1) as quality from w where width_pct <= 99 and case when "offset" = 0 then to_pivot_pct between -25 and 0.5 else last >= hi * 1.002 end),
b as (select * from (select *, row_number() over (partition by ticker order by quality desc, "offset", days) as k from q) where k = 1)
select ticker, "offset", days, round(width_pct, 6) as width_pct, round(to_pivot_pct, 6) as to_pivot_pct, round(hi, 6) as pivot, case when "offset" = 0 then to_pivot_pct >= -0.2 else true end as breakout_day, round(quality, 6) as quality,
  round(len(list_filter(s, lambda x: abs(x / list_avg(s) - 1) * 100 <= 2)) / days * 100, 6) as smoothness_pct, round(list_avg(v[233:252]) / list_avg(v[173:232]), 6) as dryup, round(v[252] / list_avg(v[232:251]), 6) as today_ratio from b
"""


@query(_BASES)
def detect_base(spark, sf):
    # The test prices swing widely, so width and distance from the high are left open.
    return _r(bases.detect_bases(_bars(spark, sf), max_width=99, from_high=99))


@query("""
, a as (select ticker, sess_no, close, max(close) over r as hi, min(close) over r as lo, row_number() over (partition by ticker order by sess_no) as i from bars where back < 120 window r as (partition by ticker order by sess_no rows between 5 preceding and 5 following)),
k as (select *, case when close = hi and hi > lo then 'H' when close = lo and hi > lo then 'L' end as kind from a where i > 5),
n as (select *, case when kind = lag(kind) over (partition by ticker order by sess_no) then 0 else 1 end as new from k where kind is not null),
g as (select *, sum(new) over (partition by ticker order by sess_no) as g from n),
s as (select ticker, kind, g, case when kind = 'H' then max(close) else min(close) end as close, case when kind = 'H' then arg_min(sess_no, (-close, sess_no)) else arg_min(sess_no, (close, sess_no)) end as sess_no from g group by ticker, kind, g),
d as (select ticker, sess_no, kind, (close - lead(close) over (partition by ticker order by sess_no)) / close * 100 as depth from s),
p as (select ticker, sess_no, depth, lag(depth) over (partition by ticker order by sess_no) as before from d where kind = 'H' and depth is not null)
select ticker, count(*) as n, round(arg_max(depth, sess_no) / arg_min(depth, sess_no), 6) as ratio, count(*) between 2 and 6 and coalesce(bool_and(depth <= before * 1.15) filter (where before is not null), true) and arg_max(depth, sess_no) <= arg_min(depth, sess_no) * 0.5 and arg_max(depth, sess_no) <= 10 as is_vcp from p group by ticker
""")
def vcp_contractions(spark, sf):
    return _r(bases.contractions(_bars(spark, sf)).drop("depths"))


#: The score's other parts by ticker: squeeze, strength against the index and three tight weeks.
_PARTS = """
, bw as (select *, case when sess_no >= 20 then stddev_samp(close) over w * 4 / avg(close) over w end as width from bars window w as (partition by ticker order by session rows 19 preceding)),
bl as (select *, first_value(width) over (partition by ticker order by back) as last from bw where back < 126), bb as (select ticker, case when count(width) = 126 then count(*) filter (where width < last) / 126 * 100 end as bb_pctile from bl group by ticker),
ix as (select session, avg(close) as index_close from bars group by session), rq as (select *, close / index_close as q, row_number() over (partition by ticker order by session) as x from bars join ix using (session) where back < 100),
ry as (select *, q / first_value(q) over (partition by ticker order by session) as y from rq), rsl as (select ticker, regr_slope(y, x) * 500 as slope from ry group by ticker),
tw as (select ticker, session + cast((12 - isodow(session)) % 7 as integer) as week, arg_max(close, session) as c from bars group by all), tk as (select *, row_number() over (partition by ticker order by week desc) as k from tw),
tt as (select ticker, count(c) = 3 and (max(c) - min(c)) / avg(c) * 100 <= 1.5 as tight from tk where k <= 3 group by ticker)
"""
_POINTS = """
select z.ticker, round(least(100, least(greatest((w - {worst}) / (5.0 - {worst}), 0), 1) * 25 + coalesce(least(greatest((bb_pctile - 40) / -40.0, 0), 1), 0) * 20 + least(greatest((dryup - 1.10) / (0.55 - 1.10), 0), 1) * 15 + coalesce(least(greatest((slope + 0.5) / 3.0, 0), 1), 0) * 20
  + exp(-0.5 * pow((p + 2) / 4, 2)) * 15 + least(greatest((smoothness_pct - 20) / 50.0, 0), 1) * 10 + case when tight then 5 else 0 end), 4) as score from z left join bb using (ticker) left join rsl on rsl.ticker = z.ticker left join tt on tt.ticker = z.ticker
"""
_Z = 'select ticker, "offset", days, round'


def _scored(_sql: str, worst: int) -> str:
    return _PARTS + _sql.rstrip().replace(_Z, ', z as (select ticker, width_pct as w, to_pivot_pct as p, "offset", days, round', 1) + ")" + _POINTS.format(worst=worst)


def _score(bars: DataFrame, width: float, high: float) -> DataFrame:
    """Of each base: tightness 25, squeeze 20, dry-up 15, strength 20, nearness to the pivot 15, smoothness 10, and 5 for three
    tight weeks; 100 at most. What can't be measured gives nothing."""
    d = bases.detect_bases(bars, max_width=width, from_high=high).join(ind.band_percentile(bars).select("ticker", "bb_pctile"), "ticker", "left")
    d = d.join(ind.strength_slope(bars, index_bars(bars), 100), "ticker", "left").join(ind.tight_weeks(bars).select("ticker", "tight"), "ticker", "left")
    c = F.col
    parts = ind.linear(c("width_pct"), 5, width, 25) + ind.linear(c("bb_pctile"), 0, 40, 20) + ind.linear(c("dryup"), 0.55, 1.10, 15) + ind.linear(c("slope_pct_per_week"), 2.5, -0.5, 20)
    parts = parts + ind.bell(c("to_pivot_pct"), -2, 4, 15) + ind.linear(c("smoothness_pct"), 70, 20, 10) + F.when(c("tight"), 5.0).otherwise(0.0)
    return _r(d.select("ticker", F.least(parts, F.lit(100.0)).alias("score")), 4)


@query(_scored(_BASES, 99))
def base_score(spark, sf):
    return _score(_bars(spark, sf), 99, 99)


#: The test prices swing a hundredfold; a small power of them moves as prices do, so that the gates both pass and stop.
_CALM = ", wild as (select * from bars), calm as (select ticker, session, 100 * pow(open, 0.05) as open, 100 * pow(high, 0.05) as high, 100 * pow(low, 0.05) as low, 100 * pow(close, 0.05) as close, volume, sess_no, back from wild)"
_CALM_BASES = _BASES.replace("from bars", "from calm").replace(">= -99", ">= -15").replace("width_pct <= 99", "width_pct <= 25")


def _calm(spark: SparkSession, sf: str) -> DataFrame:
    return _bars(spark, sf).withColumns({c: 100 * F.pow(c, F.lit(0.05)) for c in ("open", "high", "low", "close")})


@query(_CALM + _CALM_BASES)
def detect_base_gated(spark, sf):
    return _r(bases.detect_bases(_calm(spark, sf)))


@query(_CALM + _scored(_CALM_BASES, 25).replace("from bars", "from calm"))
def base_score_gated(spark, sf):
    return _score(_calm(spark, sf), 25, 15)
