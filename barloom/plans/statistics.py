"""Queries on outcomes and signals: rates, strata, buckets, intervals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import stats
from barloom.plans.registry import Registry, tidy
from barloom.session import table

query = Registry("with o as (select distinct * from outcomes)")


def _outcomes(spark, sf, *columns):
    """The columns of each real row; whole rows repeat, so the id and the columns that a query needs tell them apart."""
    return table(spark, sf, "outcomes").select(*dict.fromkeys(["outcome_id", *columns])).distinct()


_RATES = "count(*) as n, count(*) filter (where outcome = 'WON') as won, count(*) filter (where outcome = 'LOST') as lost, count(*) filter (where outcome = 'EXPIRED') as expired, round(avg(days) filter (where outcome = 'WON'), 6) as mean_days, round(avg(result_pct), 6) as expectancy, round(case when count(*) filter (where outcome in ('WON', 'LOST')) > 0 then count(*) filter (where outcome = 'WON') * 100.0 / count(*) filter (where outcome in ('WON', 'LOST')) end, 6) as win_pct"


@query(f"select {_RATES} from o")
def win_rate(spark, sf):
    return tidy(stats.win_rates(_outcomes(spark, sf, "outcome", "days", "result_pct")))


@query(f"""
, s as (select o.*, unnest(list_filter(['all', case when armed = 1 then 'armed' end, case when ignited = 1 then 'ignited' end, case when quiet = 1 then 'quiet' end, 'spark:' || spark_kind], lambda x: x is not null)) as stratum from o)
select stratum, {_RATES} from s group by stratum
""")
def strata_table(spark, sf):
    c = F.col
    labels = [F.lit("all"), F.when(c("armed") == 1, "armed"), F.when(c("ignited") == 1, "ignited"), F.when(c("quiet") == 1, "quiet"), F.concat(F.lit("spark:"), c("spark_kind"))]
    return tidy(stats.win_rates(stats.strata(_outcomes(spark, sf, "outcome", "days", "result_pct", "armed", "ignited", "quiet", "spark_kind"), labels), "stratum"))


@query(f", b as (select *, case when score >= 0 and score < 40 then '[0,40)' when score >= 40 and score < 60 then '[40,60)' when score >= 60 and score < 80 then '[60,80)' when score >= 80 and score < 101 then '[80,101)' end as bucket from o) select bucket, {_RATES} from b where bucket is not null group by bucket")
def bucket_halfopen(spark, sf):
    d = _outcomes(spark, sf, "outcome", "days", "result_pct", "score").withColumn("bucket", stats.half_open(F.col("score"), [0, 40, 60, 80, 101])).where("bucket is not null")
    return tidy(stats.win_rates(d, "bucket"))


@query("select outcome, count(*) as n, round(avg(gap_result_pct - result_pct), 6) as delta, round(1.96 * stddev_samp(gap_result_pct - result_pct) / sqrt(count(*)), 6) as ci from o where gap_result_pct is not null and result_pct is not null group by outcome")
def paired_delta_ci(spark, sf):
    return tidy(stats.paired(_outcomes(spark, sf, "outcome", "result_pct", "gap_result_pct"), "gap_result_pct", "result_pct", "outcome"))


@query("""
, d as (select coalesce(sector, '?') as g, result_pct as v from o where result_pct is not null), n as (select g, count(*) as n from d group by g), j as (select d.*, case when n < 60 then 'Other' else g end as grp from d join n using (g))
select grp as "group", count(*) as n, round(avg(v), 6) as mean, round(1.96 * stddev_samp(v) / sqrt(count(*)), 6) as ci, case when grp = 'Other' then (select string_agg(g, ',' order by g) from n where n < 60) end as members from j group by grp
""")
def sector_edge(spark, sf):
    return tidy(stats.edges(_outcomes(spark, sf, "sector", "result_pct"), "sector", "result_pct", least=60))


@query("""
, s as (select score, row_number() over (order by score) - 1 as i, count(*) over () as n from o where score is not null)
select max(score) filter (where i = n // 3) as low, max(score) filter (where i = 2 * n // 3) as high from s
""")
def tercile_cuts(spark, sf):
    return stats.tercile_cuts(_outcomes(spark, sf, "score"), "score")


@query("""
, g as (select coalesce(sector, '?') as g, count(*) as n from o group by 1), k as (select *, row_number() over (order by n desc, g) as k from g)
select case when k <= 5 then g else 'Other' end as "group", cast(sum(n) as bigint) as n from k group by 1
""")
def sector_breakdown(spark, sf):
    return stats.breakdown(_outcomes(spark, sf, "sector"), "sector")


@query("""
, r as (select * from o where outcome in ('WON', 'LOST', 'EXPIRED') and fwd_ret_pct is not null), b as (select *, row_number() over (order by fwd_ret_pct desc, outcome_id) as up, row_number() over (order by fwd_ret_pct, outcome_id) as down from r)
select 'best' as part, outcome_id, fwd_ret_pct as value from b where up <= 3 union all select 'worst', outcome_id, fwd_ret_pct from b where down <= 3 union all select 'mean', null, round(avg(fwd_ret_pct), 6) from r union all select 'median', null, round(median(fwd_ret_pct), 6) from r union all select 'positive_pct', null, round(avg(cast(fwd_ret_pct > 0 as int)) * 100, 6) from r
""")
def prior_review(spark, sf):
    r = _outcomes(spark, sf, "outcome", "fwd_ret_pct").where("outcome in ('WON', 'LOST', 'EXPIRED') and fwd_ret_pct is not null").select("outcome_id", "fwd_ret_pct")
    best = r.orderBy(F.col("fwd_ret_pct").desc(), "outcome_id").limit(3).select(F.lit("best").alias("part"), "outcome_id", F.col("fwd_ret_pct").alias("value"))
    worst = r.orderBy("fwd_ret_pct", "outcome_id").limit(3).select(F.lit("worst").alias("part"), "outcome_id", F.col("fwd_ret_pct").alias("value"))
    whole = r.agg(F.avg("fwd_ret_pct").alias("mean"), F.median("fwd_ret_pct").alias("median"), (F.avg((F.col("fwd_ret_pct") > 0).cast("int")) * 100).alias("positive_pct")).unpivot([], ["mean", "median", "positive_pct"], "part", "value")
    return best.unionByName(worst).unionByName(tidy(whole).select("part", F.lit(None).cast("long").alias("outcome_id"), "value"))


_SIGNALS = ", s as (select distinct ledger_id, ticker, packet_date from signals where ledger_id is not null and ticker is not null and packet_date is not null), p as (select ledger_id, packet_date, row_number() over (partition by ledger_id order by packet_date) as no from (select distinct ledger_id, packet_date from s))"


@query(_SIGNALS + """
, d as (select *, no - row_number() over (partition by ledger_id, ticker order by no) as g from s join p using (ledger_id, packet_date))
select ledger_id, ticker, packet_date, row_number() over (partition by ledger_id, ticker, g order by no) as day_of_packet from d
""")
def packet_spells(spark, sf):
    s = table(spark, sf, "signals").select("ledger_id", "ticker", "packet_date").dropna().distinct()
    p = s.select("ledger_id", "packet_date").distinct().withColumn("no", F.row_number().over(Window.partitionBy("ledger_id").orderBy("packet_date")))
    w = Window.partitionBy("ledger_id", "ticker").orderBy("no")
    d = s.join(p, ["ledger_id", "packet_date"]).withColumn("_g", F.col("no") - F.row_number().over(w))
    return d.select("ledger_id", "ticker", "packet_date", F.row_number().over(Window.partitionBy("ledger_id", "ticker", "_g").orderBy("no")).alias("day_of_packet"))


@query("""
, e as (select distinct * from episodes where entry_rank is not null), b as (select *, case when entry_rank < 10 then '1-9' when entry_rank < 20 then '10-19' else '20+' end as band from e)
select band, count(*) as n, round(avg(tenure), 6) as mean_tenure, round(avg(cast(peak_rank <= 10 as int)) * 100, 6) as top10_pct, round(avg(htd), 6) as mean_htd, round(median(htd), 6) as median_htd, round(avg(cast(htd > 0 as int)) * 100, 6) as win_pct, round(avg(cast(left_censored as int)), 6) as censored from b group by band
""")
def episode_strata(spark, sf):
    e = table(spark, sf, "episodes").distinct().where("entry_rank is not null")
    band = F.when(F.col("entry_rank") < 10, "1-9").when(F.col("entry_rank") < 20, "10-19").otherwise("20+")
    pct = lambda c: F.avg(c.cast("int"))
    return tidy(e.groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("tenure").alias("mean_tenure"), (pct(F.col("peak_rank") <= 10) * 100).alias("top10_pct"), F.avg("htd").alias("mean_htd"), F.median("htd").alias("median_htd"), (pct(F.col("htd") > 0) * 100).alias("win_pct"), pct(F.col("left_censored")).alias("censored"),
    ))


@query("""
, a as (select distinct ticker, run_day, signal from appearances where ticker is not null and run_day is not null and signal is not null), w as (select *, case signal when '🚀' then 4 when '🔥' then 3 when '⏳' then 2 else 1 end as o from a)
select ticker, arg_min(signal, (run_day, -o)) as at_start, arg_max(signal, o) as best from w group by ticker
""")
def best_signal(spark, sf):
    a = table(spark, sf, "appearances").select("ticker", "run_day", "signal").dropna().distinct()
    o = F.when(F.col("signal") == "🚀", 4).when(F.col("signal") == "🔥", 3).when(F.col("signal") == "⏳", 2).otherwise(1)
    return a.withColumn("_o", o).groupBy("ticker").agg(F.min_by("signal", F.struct("run_day", -F.col("_o"))).alias("at_start"), F.max_by("signal", "_o").alias("best"))


QUERIES, SQL = query.queries, query.sql
