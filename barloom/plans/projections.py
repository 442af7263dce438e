"""Queries on projections, filters, joins and summaries over the star schema and the texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import coerce, predicates
from barloom.operators import cover, summaries, trees
from barloom.plans.market import BARS
from barloom.plans.registry import Registry, tidy
from barloom.session import table
from barloom.sources.bars import published

query, bar_query = Registry(), Registry(BARS)


@query("""
with t as (select event_id, event_type || '|' || cast(value as varchar) as raw, case event_id % 7 when 0 then 'NaN' when 1 then ' ' when 2 then 'n/a' when 3 then 'YES' when 4 then 'f' when 5 then '1e400' else cast(value as varchar) end as x from events)
select event_id, case when isfinite(try_cast(x as double)) then try_cast(x as double) end as as_float, case when isfinite(try_cast(x as double)) then cast(trunc(try_cast(x as double)) as bigint) end as as_int, nullif(trim(x), '') as as_str,
  case when lower(trim(x)) in ('true', '1', 'yes', 'y', 't') then true when lower(trim(x)) in ('false', '0', 'no', 'n', 'f') then false end::varchar as as_bool, case when lower(trim(x)) not in ('none', 'n/a', 'na', 'unknown', '—', '-', '') then trim(x) end as known from t
""")
def safe_coercions(spark, sf):
    k = F.col("event_id") % 7
    x = F.when(k == 0, "NaN").when(k == 1, " ").when(k == 2, "n/a").when(k == 3, "YES").when(k == 4, "f").when(k == 5, "1e400").otherwise(F.col("value").cast("string"))
    d = table(spark, sf, "events").select("event_id", x.alias("x"))
    x = F.col("x")
    return d.select("event_id", coerce.safe_float(x).alias("as_float"), coerce.safe_int(x).alias("as_int"), coerce.safe_str(x).alias("as_str"), coerce.safe_bool(x).cast("string").alias("as_bool"), coerce.no_sentinel(x).alias("known"))


@query("""
with t as (select p_partkey, case p_partkey % 5 when 0 then '--' when 1 then '$' || cast(p_size as varchar) || '.5B' when 2 then cast(p_size as varchar) || 'k' when 3 then '1,' || cast(100 + p_size as varchar) else cast(p_size as varchar) || 'M' end as x from part)
select p_partkey, coalesce(try_cast(regexp_replace(regexp_replace(x, '[$,]', '', 'g'), '[TBMKtbmk]$', '') as double) * case upper(right(x, 1)) when 'T' then 1e12 when 'B' then 1e9 when 'M' then 1e6 when 'K' then 1e3 end, try_cast(regexp_replace(x, '[$,]', '', 'g') as double)) as amount from t
""")
def magnitude_parse(spark, sf):
    k, s = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    x = F.when(k == 0, "--").when(k == 1, F.concat(F.lit("$"), s, F.lit(".5B"))).when(k == 2, F.concat(s, F.lit("k"))).when(k == 3, F.concat(F.lit("1,"), (F.col("p_size") + 100).cast("string"))).otherwise(F.concat(s, F.lit("M")))
    return table(spark, sf, "part").select("p_partkey", coerce.magnitude(x).alias("amount"))


@query("""
with t as (select o_orderkey, case o_orderkey % 4 when 0 then 'ABC' || strftime(o_orderdate, '%y%m%d') || 'C' || cast(cast(o_totalprice as bigint) as varchar) when 1 then 'ABC991399P10' when 2 then 'abc240119C5' else 'QQ240119P5' end as s from orders)
select o_orderkey, cast(try_cast('20' || substr(d, 1, 2) || '-' || substr(d, 3, 2) || '-' || substr(d, 5, 2) as date) as varchar) as expiry from (select o_orderkey, nullif(regexp_extract(s, '^[A-Z]+(\\d{6})[CP]\\d+$', 1), '') as d from t)
""")
def contract_parse(spark, sf):
    k = F.col("o_orderkey") % 4
    s = F.when(k == 0, F.concat(F.lit("ABC"), F.date_format("o_orderdate", "yyMMdd"), F.lit("C"), F.round("o_totalprice").cast("bigint").cast("string"))).when(k == 1, "ABC991399P10").when(k == 2, "abc240119C5").otherwise("QQ240119P5")
    return table(spark, sf, "orders").select("o_orderkey", coerce.contract_expiry(s).cast("string").alias("expiry"))


@query("""
with k as (select * from (values (0, 'CPI YY', 'percent'), (1, 'Services PMI', 'index_level'), (2, 'Initial Claims', 'thousands'), (3, 'Corporate Speech', null), (4, 'Real GDP', 'percent'), (5, 'M2', 'currency'), (6, 'ISM Prices MM', 'percent'), (7, 'Wage Growth', 'percent'), (8, 'Fed Funds Rate Decision', 'percent'), (9, 'Trade Balance', 'currency')) v(k, name, unit))
select name, unit, count(*) as n from events join k on event_id % 10 = k group by all
""")
def unit_rules(spark, sf):
    names = ("CPI YY", "Services PMI", "Initial Claims", "Corporate Speech", "Real GDP", "M2", "ISM Prices MM", "Wage Growth", "Fed Funds Rate Decision", "Trade Balance")
    name = F.get(F.array(*map(F.lit, names)), (F.col("event_id") % 10).cast("int"))
    return table(spark, sf, "events").select(name.alias("name")).groupBy("name", coerce.unit_of(F.col("name")).alias("unit")).agg(F.count(F.lit(1)).alias("n"))


@query("select p_partkey, case when starts_with(lower(p_name), 'red w') then 'red_w' when starts_with(lower(p_name), 'red') then 'red' when starts_with(lower(p_name), 's') then 's' end as field from part")
def label_routing(spark, sf):
    return table(spark, sf, "part").select("p_partkey", coerce.routed(F.col("p_name"), {"s": "s", "red": "red", "red w": "red_w"}).alias("field"))


@query("select doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')) as words from documents")
def word_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", coerce.word_count(F.col("text")).alias("words"))


@query("""
select event_id, 'See [' || event_type || '](u/' || user_id || ') & ' || event_id || ' €' || chr(10) || chr(10) || 'x < y' || chr(10) || chr(10) || chr(10) || '```' || chr(10) || '  if v &lt; ' || user_id || ':' || chr(10) || '    <b>' || chr(10) || '```' || chr(10) || 'end' as text from events
""")
def html_to_text(spark, sf):
    html = F.concat(F.lit('<p>See <a href="u/'), "user_id", F.lit('">'), "event_type", F.lit("</a> &amp; <b>"), "event_id", F.lit("</b> &#8364;</p><p>x &lt; y</p><pre><code>\n  if v &amp;lt; "), "user_id", F.lit(":\n    &#x3c;b>\n</code></pre>end"))
    return table(spark, sf, "events").select("event_id", coerce.plain_text(html).alias("text"))


@query("select o_orderkey, o_totalprice from orders where (o_orderstatus in ('F', 'O') and o_totalprice between 50000 and 300000) or (o_orderpriority = '1-URGENT' and not o_totalprice < 400000) order by o_totalprice desc, o_orderkey limit 100 offset 10")
def predicate_tree(spark, sf):
    tree = {"operator": "or", "operands": [
        {"operator": "and", "operands": [{"operator": "is-in", "operands": ["o_orderstatus", "F", "O"]}, {"operator": "btwn", "operands": ["o_totalprice", 50000, 300000]}]},
        {"operator": "and", "operands": [{"operator": "eq", "operands": ["o_orderpriority", "1-URGENT"]}, {"operator": "not", "operands": [{"operator": "lt", "operands": ["o_totalprice", 400000]}]}]},
    ]}
    d = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    return predicates.screened(d, tree, sort="o_totalprice", count=100, offset=10).select("o_orderkey", "o_totalprice")


@query("""
select 'since' as stage, count(*) filter (where o_orderdate >= timestamp '1998-01-01') as "left" from orders union all select 'status', count(*) filter (where o_orderdate >= timestamp '1998-01-01' and o_orderstatus = 'P') from orders
union all select 'price', count(*) filter (where o_orderdate >= timestamp '1998-01-01' and o_orderstatus = 'P' and o_totalprice > 1e9) from orders
""")
def cascade_filter(spark, sf):
    return predicates.cascade(table(spark, sf, "orders"), {"since": F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"), "status": F.col("o_orderstatus") == "P", "price": F.col("o_totalprice") > 1e9})


_CHAIN = "with c as (select p_brand as underlying, case when p_partkey % 2 = 0 then 'call' else 'put' end as leg, p_retailprice as strike, case when p_partkey % 9 <> 0 then p_size end as volume, p_size * 2 as interest, avg(p_retailprice) over (partition by p_brand) as spot from part)"


@query(_CHAIN + """
, g as (select underlying, arg_min(strike, (abs(strike - spot), strike)) filter (where leg = 'call') as atm_call, arg_min(strike, (abs(strike - spot), strike)) filter (where leg = 'put') as atm_put, sum(volume) filter (where leg = 'call') as call_volume, sum(interest) filter (where leg = 'call') as call_interest, sum(volume) filter (where leg = 'put') as put_volume, sum(interest) filter (where leg = 'put') as put_interest
  from c where strike between spot * 0.8 and spot * 1.2 group by underlying)
select underlying, atm_call, atm_put, cast(call_volume as bigint) as call_volume, cast(call_interest as bigint) as call_interest, cast(put_volume as bigint) as put_volume, cast(put_interest as bigint) as put_interest, round(put_volume / call_volume, 6) as pc_volume, round(put_interest / call_interest, 6) as pc_interest from g
""")
def options_summary(spark, sf):
    part = table(spark, sf, "part")
    spot = part.groupBy("p_brand").agg(F.avg("p_retailprice").alias("spot"))  # counted in each task first, unlike a window over a brand
    d = part.join(spot, "p_brand").select(
        F.col("p_brand").alias("underlying"), F.when(F.col("p_partkey") % 2 == 0, "call").otherwise("put").alias("leg"), F.col("p_retailprice").alias("strike"),
        F.when(F.col("p_partkey") % 9 != 0, F.col("p_size")).alias("volume"), (F.col("p_size") * 2).alias("interest"), "spot",
    )
    return tidy(summaries.option_summary(d, "spot", 20))


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("""
with g as (select year(o_orderdate) as year, count(*) filter (where o_orderpriority like '1%') as a, count(*) filter (where o_orderpriority like '2%') as b, count(*) filter (where o_orderpriority like '3%') as c, count(*) filter (where o_orderpriority like '4%') as d, count(*) filter (where o_orderpriority like '5%') as e from orders group by 1)
select year, round((a + 2 * b + 3 * c + 4 * d + 5 * e) / (a + b + c + d + e), 6) as consensus, round((a + b) * 100.0 / (a + b + c + d + e), 6) as top_two_pct from g
""")
def consensus_score(spark, sf):
    g = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).pivot("o_orderpriority", list(_PRIORITIES)).count()
    mean, share = summaries.consensus([f"`{p}`" for p in _PRIORITIES])
    return tidy(g.select("year", mean.alias("consensus"), share.alias("top_two_pct")))


@query("""
with g as (select o_orderpriority as key, strftime(date_trunc('quarter', o_orderdate), '%Y-%m') as period, sum(o_totalprice) as value from orders group by all)
select key, period, round(value, 3) as value, round(case when lag(value, 4) over o > 0 then value / lag(value, 4) over o - 1 end, 6) as growth from g window o as (partition by key order by period)
""")
def growth_yoy(spark, sf):
    g = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("key"), F.date_format(F.date_trunc("quarter", "o_orderdate"), "yyyy-MM").alias("period")).agg(F.sum("o_totalprice").alias("value"))
    return tidy(summaries.growth(g, "key", "period", "value", 4).withColumn("value", F.round("value", 3)))


@query("""
with k as (select c_mktsegment, c_name, c_acctbal, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_name) as k, sum(c_acctbal) over (partition by c_mktsegment) as t from customer where c_acctbal is not null)
select c_mktsegment, arg_min(c_name, k) as top_name, round(sum(c_acctbal), 4) as top_sum, round(sum(c_acctbal) / any_value(t) * 100, 6) as share_pct from k where k <= 5 group by 1
""")
def top5_concentration(spark, sf):
    return tidy(summaries.concentration(table(spark, sf, "customer"), "c_mktsegment", "c_name", "c_acctbal").withColumn("top_sum", F.round("top_sum", 4)))


@query("""
with g as (select user_id, event_type, count(*) as n, avg(value) as mean, min(value) as min, max(value) as max from events group by all), k as (select *, row_number() over (partition by user_id order by n desc, event_type) as k from g)
select user_id, event_type, n, round(mean, 6) as mean, min, max from k where k = 1
""")
def dominant_type(spark, sf):
    return tidy(summaries.dominant(table(spark, sf, "events"), "user_id", "event_type", "value"))


@query("""
with k as (select event_id, user_id, ts, count(*) over (partition by user_id) as total, row_number() over (partition by user_id order by event_id) as a from events)
select event_id, user_id, total, least(total, 3) as shown from k where a <= 3
""")
def head_limit(spark, sf):
    d = summaries.head_tail(table(spark, sf, "events").select("event_id", "user_id"), "user_id", "event_id", head=3)
    return d.select("event_id", "user_id", "total", F.col("shown").cast("long").alias("shown"))


@query("select event_type, hour(ts) as hour, count(*) as n, count(distinct user_id) as users from events group by all")
def timing_counts(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("""
with w as (select year(o_orderdate) as year, round(sum(o_totalprice), 3) as total, count(*) * 1.0 as n from orders group by 1), l as (select year, 'total' as metric, total as v from w union all select year, 'n', n from w)
select metric, max(v) filter (where year = 1996) as y1996, max(v) filter (where year = 1997) as y1997, max(v) filter (where year = 1998) as y1998 from l group by metric
""")
def unpivot_pivot(spark, sf):
    w = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 3).alias("total"), F.count(F.lit(1)).cast("double").alias("n"))
    p = w.unpivot(["year"], ["total", "n"], "metric", "v").groupBy("metric").pivot("year", [1996, 1997, 1998]).agg(F.max("v"))
    return p.withColumnsRenamed({str(y): f"y{y}" for y in (1996, 1997, 1998)})


@bar_query("""
, d as (select ticker, session, sum(volume) as v from bars group by all), r as (select ticker, session, v / lag(v) over (partition by ticker order by session) as ratio from d)
select ticker, cast(session as varchar) as session, round(ratio, 6) as ratio from r where ratio >= 5 or ratio <= 0.2
""")
def split_detect(spark, sf):
    return tidy(summaries.split_events(published(spark, sf), "ticker", "session", "volume", 5.0))


@bar_query("""
, g as (select ticker, count(*) as n, arg_min(close, session) as first_close, arg_max(close, session) as last_close, max(high) as high, min(low) as low, arg_min(session, (-high, session)) as high_day, arg_min(session, (low, session)) as low_day, avg(volume) as v from bars where back < 252 group by ticker)
select ticker, n, round(first_close, 6) as first_close, round(last_close, 6) as last_close, round((last_close / first_close - 1) * 100, 6) as change_pct, round(high, 6) as high, round(low, 6) as low, cast(high_day as varchar) as high_day, cast(low_day as varchar) as low_day, round(v, 4) as mean_volume from g
""")
def ohlcv_summary(spark, sf):
    d = published(spark, sf).where("back < 252")
    g = d.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("close", "session").alias("first_close"), F.max_by("close", "session").alias("last_close"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.min_by("session", F.struct(-F.col("high"), F.col("session"))).alias("high_day"), F.min_by("session", F.struct("low", "session")).alias("low_day"), F.avg("volume").alias("mean_volume"),
    )
    return tidy(g.withColumn("change_pct", (F.col("last_close") / F.col("first_close") - 1) * 100).withColumn("mean_volume", F.round("mean_volume", 4)))


@query("""
with c as (select 's' || s_suppkey as ticker, n_name as sector, s_acctbal * 1e8 as cap from supplier left join nation on s_nationkey = n_nationkey and n_regionkey <> 0), e as (select ticker as source, sector as s, cap, 1 + cast(substr(ticker, 2) as int) % 5 as day from c)
select ticker, count(*) filter (where source = ticker) as n_own, count(*) filter (where source <> ticker and sector = s) as n_sector, count(*) filter (where source <> ticker and not coalesce(sector = s, false) and e.cap >= 9e11) as n_market, min(day) filter (where source = ticker) as next_own
from c left join e on true group by ticker
""")
def catalyst_join(spark, sf):
    n = table(spark, sf, "nation").where("n_regionkey <> 0").select("n_nationkey", F.col("n_name").alias("sector"))
    c = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.concat(F.lit("s"), "s_suppkey").alias("ticker"), "sector", (F.col("s_acctbal") * 1e8).alias("cap"))
    number = F.substring("ticker", 2, 9).cast("int")
    return summaries.sparks(c.select("ticker", "sector"), c.withColumn("day", 1 + number % 5), cap=9e11)


@query("""
with m as (select distinct ticker from mom_history where rank <= 5 and ticker is not null), a as (select distinct ticker from appearances where rank <= 2 and ticker is not null)
select ticker, concat_ws('+', case when m.ticker is not null then 'momentum' end, case when a.ticker is not null then 'bases' end) as lists from m full join a using (ticker)
""")
def watchlist_merge(spark, sf):
    m, a = table(spark, sf, "mom_history").where("rank <= 5 and ticker is not null"), table(spark, sf, "appearances").where("rank <= 2 and ticker is not null")
    return summaries.merged_watchlists(m, a, ("momentum", "bases"))


@query("""
with m as (select ticker, max(score) as x from mom_history where ticker is not null and not isnan(score) group by 1), a as (select ticker, max(score) as y from appearances where ticker is not null and not isnan(score) group by 1)
select ticker, round(x - y, 6) as difference from m join a using (ticker) where abs(x - y) > 2
""")
def cross_source_check(spark, sf):
    best = lambda t: table(spark, sf, t).where("ticker is not null and not isnan(score)").groupBy("ticker").agg(F.max("score").alias("score"))
    return tidy(summaries.disagreeing(best("mom_history"), best("appearances"), "score", 2))


@query("""
with q as (select o_orderkey as ticker, o_totalprice as value from orders where o_orderstatus = 'O'), u as (select ticker, value from q order by value desc, ticker limit 8), d as (select ticker, value from q order by value, ticker limit 8)
select ticker, value, 'up' as side from u union all select ticker, value, 'down' from d where ticker not in (select ticker from u)
""")
def gappers(spark, sf):
    q = table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("ticker"), F.col("o_totalprice").alias("value"))
    return summaries.movers(q, 8, "value")


@query("""
with l as (select text, min(doc_id) as doc_id from documents where text <> '' group by text) select doc_id from l
""")
def first_wins_dedup(spark, sf):
    return table(spark, sf, "documents").where("text <> ''").groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("""
with m as (select distinct ticker from mom_history where ticker is not null), a as (select distinct ticker from appearances where ticker is not null)
select 'both' as part, count(*) as n from (select * from m intersect select * from a) union all select 'first', count(*) from (select * from m except select * from a) union all select 'second', count(*) from (select * from a except select * from m)
""")
def membership_sets(spark, sf):
    m, a = (table(spark, sf, t).where("ticker is not null").select("ticker").distinct() for t in ("mom_history", "appearances"))
    n = lambda name, d: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return n("both", m.intersect(a)).unionByName(n("first", m.join(a, "ticker", "left_anti"))).unionByName(n("second", a.join(m, "ticker", "left_anti")))


@query("""
with d as (select user_id, ts, value, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events), l as (select user_id, list(value order by k desc) as v, min(value) as lo, max(value) as hi from d where k <= 14 group by user_id)
select user_id, array_to_string(list_transform(v, lambda x: case when hi = lo then '▄' else substr('▁▂▃▄▅▆▇█', cast(least(floor((x - lo) / (hi - lo) * 8), 7) as int) + 1, 1) end), '') as line from l
""")
def rank_sparkline(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    d = table(spark, sf, "events").withColumn("_k", F.row_number().over(w)).where("_k <= 14")
    g = d.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(-F.col("_k"), "value"))).alias("v"))
    return g.select("user_id", coerce.sparkline(F.col("v.value")).alias("line"))


_TREE = "with recursive i as (select event_id as item, case when event_id % 50 = 0 then null when event_id % 5 = 0 then event_id - event_id % 50 else event_id - event_id % 5 end as parent, event_id % 10 as pos, event_type <> 'error' as live from events)"


@query(_TREE + """
, t as (select item as root, item, 0 as level, [pos] as path from i where parent is null and live union all select t.root, i.item, t.level + 1, list_append(t.path, i.pos) from t join i on i.parent = t.item and i.live where t.level < 2),
k as (select *, row_number() over (partition by root order by level, path, item) as k from t) select root, item, level, k from k where k <= 12
""")
def tree_scan(spark, sf):
    e = F.col("event_id")
    parent = F.when(e % 50 == 0, None).when(e % 5 == 0, e - e % 50).otherwise(e - e % 5)
    items = table(spark, sf, "events").select(e.alias("item"), parent.alias("parent"), (e % 10).alias("pos"), (F.col("event_type") != "error").alias("live"))
    t = trees.expand(items, 2, 12)
    return t.select("root", "item", "level", F.row_number().over(Window.partitionBy("root").orderBy("level", "path", "item")).alias("k"))


@query("""
with d as (select l_orderkey as order_id, count(*) filter (where l_partkey % 3 = 0) as a, count(*) filter (where l_partkey % 3 = 1) as b, count(*) filter (where l_partkey % 3 = 2) as c from lineitem where l_orderkey is not null group by 1),
p as (select *, unnest(range(greatest(a, b) + 1)) as p from d), t as (select *, unnest(range(greatest(a, b, c) + 1)) as t from p),
n as (select *, greatest(a - p - t, 0) as x, greatest(b - p - t, 0) as y, greatest(c - t, 0) as z from t),
w as (select order_id, 10 * x + 12 * y + 14 * z + 18 * p + 25 * t as cost, list_concat(list_concat(list_concat(list_concat(list_transform(range(x), lambda i: 'one-s0'), list_transform(range(y), lambda i: 'one-s1')), list_transform(range(z), lambda i: 'one-s2')), list_transform(range(p), lambda i: 'pair')), list_transform(range(t), lambda i: 'trio')) as picks from n)
select order_id, 1 as place, cost, array_to_string(picks, ',') as offers from (select *, row_number() over (partition by order_id order by cost, picks) as k from w) where k = 1
""")
def min_cost_cover(spark, sf):
    # An order's wants: its lines' part sizes; each order is offered singles and two bundles.
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.concat(F.lit("s"), F.col("l_partkey") % 3).alias("sku"))
    demands = lines.groupBy("order_id", "sku").agg(F.count(F.lit(1)).alias("qty"))
    bundles = [("one-s0", 10, "s0", 1), ("one-s1", 12, "s1", 1), ("one-s2", 14, "s2", 1), ("pair", 18, "s0", 1), ("pair", 18, "s1", 1), ("trio", 25, "s0", 1), ("trio", 25, "s1", 1), ("trio", 25, "s2", 1)]
    offers = demands.select("order_id").distinct().select("order_id", F.explode(F.array(*[F.struct(F.lit(o).alias("offer"), F.lit(p).alias("price"), F.lit(s).alias("sku"), F.lit(g).alias("gives")) for o, p, s, g in bundles])).alias("x")).select("order_id", "x.*")
    return cover.covers(demands, offers)


QUERIES, SQL = query.queries | bar_query.queries, query.sql | bar_query.sql
