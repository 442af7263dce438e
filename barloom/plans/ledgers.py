"""Queries on ledgers: latest rows, appends, calendars, streaks, drop-outs and the regime gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.calendar import et_day, holidays, session_phase, trading_days
from barloom.operators import persistence as per
from barloom.operators.neighbours import neighbours
from barloom.plans.registry import Registry, tidy
from barloom.session import table
from barloom.sources.ledgers import append_by_day, upsert

query = Registry()
ET = "cast(timezone('America/New_York', timezone('UTC', run_date)) as date)"
_PICKS = """
with picks as (select * from (select *, row_number() over (partition by run_id, ticker order by logged_at desc, score desc, rank desc) as k from mom_history where run_id is not null and ticker is not null) where k = 1)
"""


def _picks(spark, sf):
    d = table(spark, sf, "mom_history").select("run_id", "ticker", "run_date", "rank", "score_rank", "score", "close", "logged_at").where("run_id is not null and ticker is not null")
    return per.latest(d, ["run_id", "ticker"], "logged_at", "score", "rank")


@query(_PICKS + "select run_id, count(*) as n, count(rank) as n_ranked, round(sum(close), 4) as total from picks group by run_id")
def ledger_latest(spark, sf):
    return tidy(_picks(spark, sf).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count("rank").alias("n_ranked"), F.sum("close").alias("total")), 4)


@query(f"""
with o as (select distinct * from mom_history), d as (select *, {ET} as day from o), m as (select max(day) as last from d),
i as (select run_id, ticker, day, 'new' as batch from d, m where day = last and rank <= 5), k as (select run_id, ticker, day, null as batch from d where day is null or day not in (select day from i))
select cast(day as varchar) as day, count(*) as n, count(batch) as n_new from (select * from k union all select * from i) group by day
""")
def ledger_append(spark, sf):
    d = table(spark, sf, "mom_history").select("run_id", "ticker", "run_date", "rank", "score", "logged_at").distinct()
    day = et_day("run_date")
    incoming = d.where(day == d.agg(F.max(day)).scalar()).where("rank <= 5").select("run_id", "ticker", "run_date", F.lit("new").alias("batch"))
    out = append_by_day(d.select("run_id", "ticker", "run_date"), incoming)
    return tidy(out.groupBy(et_day("run_date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count("batch").alias("n_new")))


@query("""
with o as (select distinct outcome_id, outcome, days, armed from outcomes), i as (select outcome_id, 'EXPIRED' as outcome, 5 as days from o where outcome = 'OPEN' and armed = 1)
select outcome_id, outcome, days from o where outcome_id not in (select outcome_id from i) union all select * from i
""")
def ledger_upsert(spark, sf):
    d = table(spark, sf, "outcomes").select("outcome_id", "outcome", "days", "armed").distinct()
    done = d.where("outcome = 'OPEN' and armed = 1").select("outcome_id", F.lit("EXPIRED").alias("outcome"), F.lit(5).alias("days"))
    return upsert(d.drop("armed"), done, ["outcome_id"])


_HOLIDAYS = """
with y as (select unnest(range(2018, 2031)) as y), e as (select y, y % 19 as a, y // 100 as b, y % 100 as c from y),
h as (select *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 as h from e), k as (select *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 as k from h),
n as (select y, h + k - 7 * ((a + 11 * h + 22 * k) // 451) + 114 as n from k), f as (select y, make_date(y, n // 31, n % 31 + 1) - 2 as gf from n),
nth as (select y, gf, make_date(y, 1, 1) as j1, make_date(y, 6, 19) as jt, make_date(y, 7, 4) as ind, make_date(y, 12, 25) as xm from f),
hol as (
  select case cast(isodow(j1) as int) when 7 then j1 + 1 else j1 end as day, 'new year' as holiday from nth where cast(isodow(j1) as int) <> 6 union all
  select make_date(y, 1, 1) + (8 - cast(isodow(make_date(y, 1, 1)) as int)) % 7 + 14, 'king' from nth union all select make_date(y, 2, 1) + (8 - cast(isodow(make_date(y, 2, 1)) as int)) % 7 + 14, 'presidents' from nth union all
  select gf, 'good friday' from nth union all select make_date(y, 5, 31) - (cast(isodow(make_date(y, 5, 31)) as int) - 1), 'memorial' from nth union all
  select case cast(isodow(jt) as int) when 6 then jt - 1 when 7 then jt + 1 else jt end, 'juneteenth' from nth where y >= 2022 union all select case cast(isodow(ind) as int) when 6 then ind - 1 when 7 then ind + 1 else ind end, 'independence' from nth union all
  select make_date(y, 9, 1) + (8 - cast(isodow(make_date(y, 9, 1)) as int)) % 7, 'labor' from nth union all select make_date(y, 11, 1) + (11 - cast(isodow(make_date(y, 11, 1)) as int)) % 7 + 21, 'thanksgiving' from nth union all
  select case cast(isodow(xm) as int) when 6 then xm - 1 when 7 then xm + 1 else xm end, 'christmas' from nth)
"""
_DAYS = _HOLIDAYS.replace("range(2018, 2031)", "range(2024, 2028)") + """
, d as (select cast(unnest(range(date '2024-01-01', date '2028-01-01', interval 1 day)) as date) as day), t as (select day, date_trunc('month', day) as m, cast(date_trunc('month', day) as date) + (12 - cast(isodow(date_trunc('month', day)) as int)) % 7 + 14 as third from d where cast(isodow(day) as int) < 6 and day not in (select day from hol)),
days as (select day, day = max(case when day <= third then day end) over (partition by m) as third_friday, day = max(day) over (partition by m) as month_end from t)
"""


@query(_HOLIDAYS + "select cast(day as varchar) as day, holiday from hol")
def exchange_holidays(spark, sf):
    return tidy(holidays(spark, 2018, 2030))


@query(_DAYS + "select cast(day as varchar) as day, third_friday, third_friday and month(day) % 3 = 0 as witching, month_end, month_end and month(day) % 3 = 0 as quarter_end from days")
def special_days(spark, sf):
    return tidy(trading_days(spark, 2024, 2027))


@query(_DAYS + f"select run_id, count(*) as n from mom_history where {ET} in (select day from days) group by run_id")
def pruned_to_trading_days(spark, sf):
    d = table(spark, sf, "mom_history").select("run_id", et_day("run_date").alias("day"))
    return d.join(F.broadcast(trading_days(spark, 2024, 2027)), "day", "left_semi").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query("""
with e as (select timezone('America/New_York', timezone('UTC', ts)) as t from events), m as (select hour(t) * 60 + minute(t) as m from e)
select case when m < 240 then 'overnight' when m < 480 then 'pre-dawn' when m < 570 then 'pre-open' when m < 960 then 'intraday' when m < 1200 then 'after-hours' else 'overnight' end as phase, count(*) as n from m group by 1
""")
def session_phases(spark, sf):
    t = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("ts"))
    return table(spark, sf, "events").select(session_phase(F.hour(t) * 60 + F.minute(t)).alias("phase")).groupBy("phase").agg(F.count(F.lit(1)).alias("n"))


_STREAK = _PICKS + """
, v as (select distinct ticker, cast(run_date as date) as day from picks where rank <= 30 and run_date is not null), n as (select day, row_number() over (order by day) as no from (select distinct day from v)),
g as (select ticker, day, no, no - row_number() over (partition by ticker order by no) as g from v join n using (day)), i as (select ticker, g, count(*) as c, max(no) as e, min(day) as s from g group by ticker, g), newest as (select max(no) as newest from n)
"""


@query(_STREAK + "select ticker, cast(sum(c) as bigint) as n_days, max(c) as longest, coalesce(max(case when e = newest then c end), 0) as active, cast(max(case when e = newest then s end) as varchar) as first_seen from i, newest group by ticker")
def persistence_streak(spark, sf):
    return tidy(per.streaks(_picks(spark, sf).where("rank <= 30").select("ticker", F.to_date("run_date").alias("day")), "ticker", "day"))


@query(_STREAK + "select ticker, cast(sum(c) as bigint) as n_days, max(c) as longest from i group by ticker order by n_days desc, ticker limit 20")
def appearance_counts(spark, sf):
    s = per.streaks(_picks(spark, sf).where("rank <= 30").select("ticker", F.to_date("run_date").alias("day")), "ticker", "day")
    return s.select("ticker", "n_days", "longest").orderBy(F.col("n_days").desc(), "ticker").limit(20)


_PAIR = _PICKS + """
, d as (select distinct cast(run_date as date) as day from picks order by day desc limit 2), m as (select max(day) as d1, min(day) as d0 from d),
x as (select ticker, rank, coalesce(score_rank, rank) as place, cast(run_date as date) as day, d1, d0, close, score from picks, m where cast(run_date as date) in (d1, d0) and rank <= 30),
g as (select ticker, min(rank) filter (where day = d1) as rank, min(rank) filter (where day = d0) as before, min(place) filter (where day = d0) - min(place) filter (where day = d1) as delta from x group by ticker),
p as (select *, case when before is null then 'new' when rank is null then 'dropped' else 'stayed' end as status from g)
"""


@query(_PAIR + "select ticker, status, rank, before, delta from p")
def run_pair_movers(spark, sf):
    return per.run_pair(_picks(spark, sf).withColumn("day", F.to_date("run_date")), "ticker", "day", "rank", "score_rank", 30)


@query(_PAIR + "select ticker, delta, 'up' as side from (select * from p where delta > 0 order by delta desc, ticker limit 5) union all select ticker, delta, 'down' from (select * from p where delta < 0 order by delta, ticker limit 5)")
def top_movers(spark, sf):
    p = per.run_pair(_picks(spark, sf).withColumn("day", F.to_date("run_date")), "ticker", "day", "rank", "score_rank", 30)
    up = p.where("delta > 0").orderBy(F.col("delta").desc(), "ticker").limit(5).select("ticker", "delta", F.lit("up").alias("side"))
    return up.unionByName(p.where("delta < 0").orderBy("delta", "ticker").limit(5).select("ticker", "delta", F.lit("down").alias("side")))


@query(_PAIR + """
, c as (select ticker, arg_max(close, (run_date, run_id)) filter (where close is not null and run_date is not null) as close from picks group by ticker), b as (select ticker, arg_max(close, (run_date, run_id)) filter (where close is not null and cast(run_date as date) <= d0) as was from picks, m group by ticker)
select ticker, case when (close / was - 1) * 100 >= 0.5 then 'broke_out' when (close / was - 1) * 100 < -8 then 'broke_down' else 'faded' end as reason from p left join c using (ticker) left join b using (ticker) where status = 'dropped'
""")
def dropouts_reason(spark, sf):
    picks = _picks(spark, sf).withColumn("day", F.to_date("run_date"))
    gone = per.run_pair(picks, "ticker", "day", "rank", "score_rank", 30).where("status = 'dropped'").select("ticker")
    d0 = picks.select("day").distinct().orderBy(F.col("day").desc()).limit(2).agg(F.min("day")).scalar()
    by, has = F.struct("run_date", "run_id"), F.col("close").isNotNull() & F.col("run_date").isNotNull()
    prices = picks.join(gone, "ticker", "left_semi").withColumn("_d0", d0).groupBy("ticker").agg(
        F.max_by("close", F.when(has, by)).alias("close"), F.max_by("close", F.when(has & (F.col("day") <= F.col("_d0")), by)).alias("was")
    )
    move = (F.col("close") / F.col("was") - 1) * 100
    return gone.join(prices, "ticker", "left").select("ticker", F.when(move >= 0.5, "broke_out").when(move < -8, "broke_down").otherwise("faded").alias("reason"))


_BASE = "case when regexp_matches(state, '^[^\\pL]*risk[^\\pL\\pN]{0,3}on([^\\pL]|$)', 'i') then 'RISK-ON' when regexp_matches(state, '^[^\\pL]*risk[^\\pL\\pN]{0,3}off([^\\pL]|$)', 'i') then 'RISK-OFF' when regexp_matches(state, '^[^\\pL]*caution([^\\pL]|$)', 'i') then 'CAUTION' end"
_READ = f"""
with named as (select *, {_BASE} as base from regime_history), r as (select * from (select *, row_number() over (partition by ledger_id, run_id order by run_date desc, row_no desc) as k from named where base is not null and run_id is not null and ledger_id is not null) where k = 1),
c as (select *, case when base = lag(base) over w then 0 else 1 end as new, row_number() over w as i from r window w as (partition by ledger_id order by run_id)), g as (select *, sum(new) over (partition by ledger_id order by run_id) as g from c),
s as (select *, row_number() over (partition by ledger_id, g order by run_id) as p from g), f as (select *, last_value(case when p >= 2 or i = 1 then base end ignore nulls) over (partition by ledger_id order by run_id rows unbounded preceding) as confirmed from s)
"""


def _confirmed(spark, sf):
    """The readings of the ledgers with their confirmed states, worked on in months of a ledger."""
    return per.confirmed(per.readings(table(spark, sf, "regime_history")), ["ledger_id"], "run_id", "base", segment=F.substring("run_id", 1, 6))


@query(_READ + "select ledger_id, run_id, base, confirmed from f")
def regime_confirmed(spark, sf):
    return _confirmed(spark, sf).select("ledger_id", "run_id", "base", "confirmed")


@query(_READ + """
, t as (select *, lag(base) over w as b0, lag(confirmed) over w as c0 from f window w as (partition by ledger_id order by run_id))
select ledger_id, count(*) as n, count(*) filter (where base = 'RISK-ON') as n_on, count(*) filter (where base = 'CAUTION') as n_caution, count(*) filter (where base = 'RISK-OFF') as n_off, count(*) filter (where b0 <> base) as raw_changes, count(*) filter (where c0 <> confirmed) as confirmed_changes from t group by ledger_id
""")
def state_mix(spark, sf):
    d = _confirmed(spark, sf)
    d = neighbours(d, ["ledger_id"], ["run_id"], F.substring("run_id", 1, 6), lag={"_b": "base", "_c": "confirmed"})
    n = lambda c: F.count(F.when(c, 1))
    return d.groupBy("ledger_id").agg(
        F.count(F.lit(1)).alias("n"), n(F.col("base") == "RISK-ON").alias("n_on"), n(F.col("base") == "CAUTION").alias("n_caution"), n(F.col("base") == "RISK-OFF").alias("n_off"),
        n(F.col("_b") != F.col("base")).alias("raw_changes"), n(F.col("_c") != F.col("confirmed")).alias("confirmed_changes"),
    )


@query(_READ + ", l as (select ledger_id, base, g, count(*) as len from s group by all) select base, count(*) as spells, round(avg(len), 6) as mean_len, median(len) as median_len, count(*) filter (where len = 1) as one_day from l group by base")
def state_spells(spark, sf):
    # Only readings that open a spell stay; the next one's position tells how long it was.
    d = neighbours(per.readings(table(spark, sf, "regime_history")).select("ledger_id", "run_id", "base"), ["ledger_id"], ["run_id"], F.substring("run_id", 1, 6), lag={"_b": "base"}, count="_n")
    opens = d.where(~F.col("base").eqNullSafe(F.col("_b"))).withColumnRenamed("pos", "_at")
    s = neighbours(opens, ["ledger_id"], ["run_id"], F.substring("run_id", 1, 6), lead={"_next": "_at"})
    s = s.select("base", (F.coalesce("_next", F.col("_n") + 1) - F.col("_at")).alias("len"))
    return tidy(s.groupBy("base").agg(F.count(F.lit(1)).alias("spells"), F.avg("len").alias("mean_len"), F.median("len").alias("median_len"), F.count(F.when(F.col("len") == 1, 1)).alias("one_day")))


@query(_READ + """
, x as (select ledger_id, run_id, trim(unnest(string_split(flags, ' ; '))) as flag, row_number() over () as u from r where flags is not null), y as (select split_part(flag, ':', 1) as flag, count(distinct (ledger_id, run_id)) as n from x where flag <> '' group by 1)
select flag, n, round(n / (select count(*) from r), 6) as share, n / (select count(*) from r) > 0.5 as chronic from y
""")
def flag_chronicity(spark, sf):
    r = per.readings(table(spark, sf, "regime_history"))
    total = r.agg(F.count(F.lit(1))).scalar()
    x = r.select("ledger_id", "run_id", F.explode(F.split("flags", " ; ")).alias("flag")).select("ledger_id", "run_id", F.split(F.trim("flag"), ":")[0].alias("flag")).where("flag <> ''").distinct()
    return tidy(x.groupBy("flag").agg(F.count(F.lit(1)).alias("n")).withColumn("_all", total).select("flag", "n", (F.col("n") / F.col("_all")).alias("share"), (F.col("n") / F.col("_all") > 0.5).alias("chronic")))


@query(_READ + """
, v as (select ledger_id, run_id, case when spy_vs_200_pct >= 0 then 1 when spy_vs_200_pct < 0 then -1 else 0 end as t, case when breadth_50_pct >= 60 then 1 when breadth_50_pct <= 40 then -1 else 0 end as b50, case when breadth_200_pct >= 60 then 1 when breadth_200_pct <= 40 then -1 else 0 end as b200,
  case when vix <= 17 then 1 when vix >= 25 then -1 else 0 end as v, case when credit_pct >= 0.25 then 1 when credit_pct <= -0.25 then -1 else 0 end as c,
  case when spy_vs_200_pct > 0 then cast(coalesce(breadth_50_pct < 50, false) as int) + cast(coalesce(credit_pct < -0.25, false) as int) + cast(coalesce(vix_5d_pct > 20, false) as int) else 0 end as flags, spy_vs_200_pct, breadth_50_pct from r)
select ledger_id, run_id, t + b50 + b200 + v + c as score, flags, case when coalesce(spy_vs_200_pct <= 0, false) then 'RISK-OFF' when flags >= 4 or t + b50 + b200 + v + c <= -3 then 'RISK-OFF (internals)' when flags >= 2 or t + b50 + b200 + v + c <= -2 or coalesce(breadth_50_pct < 45, false) then 'CAUTION' else 'RISK-ON' end as state from v
""")
def regime_vote(spark, sf):
    r = per.readings(table(spark, sf, "regime_history"))
    c = F.col
    trend = F.when(c("spy_vs_200_pct") >= 0, 1).when(c("spy_vs_200_pct") < 0, -1).otherwise(0)
    score = trend + per.vote(c("breadth_50_pct"), 60, 40) + per.vote(c("breadth_200_pct"), 60, 40) + per.vote(c("vix"), 17, 25, higher=False) + per.vote(c("credit_pct"), 0.25, -0.25)
    flags = F.array_compact(F.array(F.when(c("breadth_50_pct") < 50, "breadth"), F.when(c("credit_pct") < -0.25, "credit"), F.when(c("vix_5d_pct") > 20, "vix")))
    d = r.select("ledger_id", "run_id", score.alias("score"), F.when(c("spy_vs_200_pct") > 0, F.size(flags)).otherwise(0).alias("flags"), "spy_vs_200_pct", "breadth_50_pct")
    state = F.when(c("spy_vs_200_pct") <= 0, "RISK-OFF").when((c("flags") >= 4) | (c("score") <= -3), "RISK-OFF (internals)").when((c("flags") >= 2) | (c("score") <= -2) | (c("breadth_50_pct") < 45), "CAUTION").otherwise("RISK-ON")
    return d.select("ledger_id", "run_id", "score", "flags", state.alias("state"))


@query(_READ + """
, z as (select ledger_id, arg_max(base, run_id) as base, arg_max(confirmed, run_id) as confirmed, max(run_id) as run_id, arg_max(p, run_id) = 1 and count(*) > 1 as first_day_flip from f group by ledger_id)
select *, date_diff('day', strptime(run_id, '%Y%m%d'), strptime((select max(run_id) from r), '%Y%m%d')) as stale_days from z
""")
def regime_snapshot(spark, sf):
    d = _confirmed(spark, sf)
    d = d.withColumn("_flip", F.coalesce(F.col("before") != F.col("base"), F.lit(False)))
    last = d.agg(F.max("run_id")).scalar()
    g = d.groupBy("ledger_id").agg(F.max_by("base", "run_id").alias("base"), F.max_by("confirmed", "run_id").alias("confirmed"), F.max("run_id").alias("run_id"), F.max_by("_flip", "run_id").alias("first_day_flip"))
    day = lambda c: F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2)).try_cast("date")
    return g.withColumn("_newest", last).select("ledger_id", "base", "confirmed", "run_id", "first_day_flip", F.datediff(day("_newest"), day("run_id")).cast("long").alias("stale_days"))


QUERIES, SQL = query.queries, query.sql
