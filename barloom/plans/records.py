"""Queries on records: run ids, ranges, screens, series, files read again, regimes, summaries and strata."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import coerce
from barloom.functions.predicates import screened
from barloom.operators import indicators as ind
from barloom.operators import records, regime, replay, stats
from barloom.operators.persistence import readings
from barloom.plans.ledgers import _PAIR, _READ, _picks
from barloom.plans.market import BARS
from barloom.plans.registry import Registry, tidy
from barloom.plans.replays import _SIG, _signals
from barloom.session import scratch, table
from barloom.sources import ledgers
from barloom.sources.bars import published, supplier_bars

query, plain = Registry(BARS), Registry()


def _bars(spark, sf):
    return published(spark, sf)


@plain("""
select run_id, strftime(timezone('America/New_York', timezone('UTC', run_date)), '%Y%m%d') as made, strftime(run_date, '%Y%m%dT%H%M%SZ') as precise, count(*) as n from mom_history where run_date is not null group by all
""")
def run_ids(spark, sf):
    d = table(spark, sf, "mom_history").where("run_date is not null")
    return d.groupBy("run_id", records.run_id(F.col("run_date")).alias("made"), records.run_id(F.col("run_date"), precise=True).alias("precise")).agg(F.count(F.lit(1)).alias("n"))


@plain("""
with a as (select o_orderkey, cast(o_orderdate as date) as d, o_orderkey % 5 as k, date '1997-01-15' as today from orders)
select o_orderkey, cast(case k when 0 then today - 30 when 1 then today else d end as varchar) as first, cast(case k when 0 then today when 1 then today + 7 when 2 then d + 7 when 3 then d + 3 else d + 20 end as varchar) as last from a
""")
def date_ranges(spark, sf):
    """Ranges asked for in the five ways there are: past days, nothing, a start, a start and an end, a start and days."""
    k, d, none = F.col("o_orderkey") % 5, F.to_date("o_orderdate"), F.lit(None)
    first, last = records.date_range(F.when(k >= 2, d), F.when(k == 3, F.date_add(d, 3)), F.when(k == 4, 20).otherwise(none.cast("int")), F.when(k == 0, 30).otherwise(none.cast("int")), F.lit("1997-01-15").cast("date"))
    return tidy(table(spark, sf, "orders").select("o_orderkey", first.alias("first"), last.alias("last")))


#: Saved screens by name, each a filter tree, and the fields they may name.
SCREENS = {
    "large": {"operator": "and", "operands": [{"operator": "gt", "operands": ["p_retailprice", 1500]}, {"operator": "btwn", "operands": ["p_size", 10, 40]}]},
    "small": {"operator": "or", "operands": [{"operator": "lt", "operands": ["p_retailprice", 1000]}, {"operator": "is-in", "operands": ["p_size", 1, 2, 3]}]},
}
FIELDS = {"p_partkey": "number of the part", "p_retailprice": "price", "p_size": "size"}


@plain("""
with l as (select p_partkey, p_retailprice, p_size, row_number() over (order by p_retailprice desc, p_partkey, p_size) as r from part where p_retailprice > 1500 and p_size between 10 and 40),
s as (select p_partkey, p_retailprice, p_size, row_number() over (order by p_retailprice desc, p_partkey, p_size) as r from part where p_retailprice < 1000 or p_size in (1, 2, 3)),
u as (select *, cast((r - 1) // 50 as int) + 1 as page from l where r <= 100 union all select *, cast((r - 1) // 50 as int) + 3 from s where r <= 100)
select p_partkey, p_retailprice, p_size, page from (select *, row_number() over (partition by p_partkey order by page) as k from u) where k = 1
""")
def screen_pages(spark, sf):
    """Two pages of 50 of each saved screen, united; a part that several have counts on the first page."""
    part = table(spark, sf, "part").select(*FIELDS)
    pages = [screened(part, SCREENS[name], sort="p_retailprice", count=50, offset=50 * i) for name in ("large", "small") for i in range(2)]
    return records.paged_union(pages, "p_partkey")


@query("""
, l as (select max(session) as now from bars), asked as (select distinct case when l_suppkey % 7 = 0 then 'no-' || l_suppkey else cast(l_suppkey as varchar) end as ticker from lineitem),
g as (select ticker, min(session) as first, max(session) as last, count(*) as n from bars where cast(ticker as int) % 5 > 0 or session < date '1995-01-01' group by ticker)
select a.ticker, cast(first as varchar) as first, cast(last as varchar) as last, coalesce(n, 0) as n, case when last is null then 'missing' when now - last > 5 then 'ended' else 'live' end as state from asked a left join g using (ticker), l
""")
def series_states(spark, sf):
    bars = supplier_bars(spark, sf)
    asked = table(spark, sf, "lineitem").select(F.when(F.col("l_suppkey") % 7 == 0, F.concat(F.lit("no-"), "l_suppkey")).otherwise(F.col("l_suppkey").cast("string")).alias("ticker"))
    kept = bars.where("cast(ticker as int) % 5 > 0 or session < date'1995-01-01'")
    return tidy(records.series_state(kept, asked, bars.agg(F.max("session")).scalar()))


@plain("select cast(n_nationkey as varchar) as symbol, n_name as sector, r_name as region from nation join region on n_regionkey = r_regionkey")
def html_constituents(spark, sf):
    """One page for each region, with a table of other columns before the one sought, read back to rows."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = F.concat(F.lit("<tr class='r'><td><a href='x'>"), "n_nationkey", F.lit("</a></td><td>note</td>\n<td> "), "n_name", F.lit("</td></tr>"))
    head = F.lit("<table><tr><th>Symbol</th></tr><tr><td>no</td></tr></table><TABLE id=c><tr><th>Symbol</th><th>Note</th><th>Sector</th></tr>")
    pages = n.groupBy(F.col("r_name").alias("region")).agg(F.concat(head, F.array_join(F.collect_list(row), ""), F.lit("</TABLE>")).alias("html"))
    return pages.select("region", F.inline(records.html_rows(F.col("html"), ["symbol", "sector"])))


@plain("""
select outcome_id, source, ticker, round(score, 6) as score, armed, null::varchar as venue from (select distinct * from outcomes)
""")
def ledger_csv_read(spark, sf):
    """A ledger written as CSV and read again by a schema with a column it lacks, another type and without some it has."""
    path = f"{scratch(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, sf, "outcomes").distinct().write.option("header", True).csv(path)
    return tidy(ledgers.read_csv(spark, path, "outcome_id long, source string, ticker string, score double, armed int, venue string", comment="#"))


@plain("""
select event_id, event_type, user_id, case when event_type not in ('click', 'view', 'purchase') then 'event_type is ' || event_type when user_id % 10 = 0 then 'value is missing' end as problem from events
""")
def json_runs_checked(spark, sf):
    """Documents written as JSON, one a line, and checked as run files are: missing fields and values outside their list."""
    path = f"{scratch(spark)}/json-{uuid.uuid4().hex}"
    e = table(spark, sf, "events").select("event_id", "event_type", "user_id", F.when(F.col("user_id") % 10 != 0, F.col("value")).alias("value"))
    e.write.json(path)
    d = ledgers.read_json_runs(spark, path, "event_id long, event_type string, user_id long, value double", ["value"], {"event_type": ["click", "view", "purchase"]}, lines=True)
    return d.select("event_id", "event_type", "user_id", F.coalesce(F.get(F.filter("problems", lambda p: p.startswith("event_type")), F.lit(0)), F.get("problems", F.lit(0))).alias("problem"))


@plain("""
with o as (select o_orderkey, o_clerk_no, t from (select o_orderkey, o_orderkey % 1000 as o_clerk_no, cast(o_orderdate as timestamp) + to_seconds(o_orderkey % 86400) as t from orders)),
n as (select max(t) as now from o), w as (select * from o, n where t > now - interval 18 hour)
select 'item ' || o_clerk_no as title, cast(max(t) as varchar) as at from w group by o_clerk_no
""")
def feed_items(spark, sf):
    """A feed written as XML items and read again: dates of RFC 822, the last 18 hours, the newest item of each title."""
    path = f"{scratch(spark)}/xml-{uuid.uuid4().hex}"
    at = F.to_timestamp_ntz(F.col("o_orderdate").cast("timestamp_ntz")) + F.make_dt_interval(secs=F.col("o_orderkey") % 86400)
    items = table(spark, sf, "orders").select(F.concat(F.lit("item "), F.col("o_orderkey") % 1000).alias("title"), F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'").alias("pubDate"))
    items.write.format("xml").option("rowTag", "item").option("rootTag", "rss").save(path)
    read = ledgers.recent_items(ledgers.read_feed(spark, path, "item", "title string, pubDate string"), "title", "pubDate", hours=18)
    return tidy(read.select("title", "at"))


@plain("""
select 'customer' as record_class, c_custkey as id, null::bigint as size from customer union all select 'part', p_partkey, p_size from part
""")
def records_read_back(spark, sf):
    """Two record lists written as one set of JSON lines with the union of their columns, and read again."""
    path = f"{scratch(spark)}/records-{uuid.uuid4().hex}"
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    ledgers.write_records({"customer": c, "part": table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))}, path, "json")
    return spark.read.schema("record_class string, id long, size long").json(path)


@plain("select s_suppkey, round(case when abs(s_acctbal) <= 1000 then s_acctbal end, 6) as clamped, round(1.0 / nullif(s_acctbal, 0), 10) as inverted, round(s_acctbal / 100.0, 8) as fraction from supplier")
def clamped_inverted(spark, sf):
    b = F.col("s_acctbal")
    return tidy(table(spark, sf, "supplier").select("s_suppkey", coerce.clamped(b).alias("clamped"), coerce.inverted(b).alias("inverted"), (b / 100.0).alias("fraction")), 10)


@plain("""
with d as (select run_id, run_date from mom_history), g as (select run_id, count(*) filter (where coalesce(run_date < timestamp '2025-06-01', false)) as gone, count(*) filter (where not coalesce(run_date < timestamp '2025-06-01', false)) as kept from d group by run_id)
select coalesce(sum(gone), 0)::bigint as rows_dropped, count(*) filter (where kept = 0) as runs_dropped, coalesce(sum(kept), 0)::bigint as rows_kept, count(*) filter (where kept > 0) as runs_kept from g
""")
def retention_report(spark, sf):
    return records.retained(table(spark, sf, "mom_history").select("run_id", "run_date"), "run_date", "run_id", F.lit("2025-06-01").cast("timestamp_ntz"))


@plain("""
with e as (select user_id, ts, case event_id % 5 when 0 then 'up' when 1 then 'down' when 2 then 'init' when 3 then 'main' else 'reit' end as kind from events), n as (select max(ts) as now from e)
select user_id, count(*) filter (where kind = 'up' and ts >= now - interval 9 day) as n_up, count(*) filter (where kind = 'down' and ts >= now - interval 9 day) as n_down, count(*) filter (where kind = 'init' and ts >= now - interval 9 day) as n_init, count(*) filter (where kind = 'main' and ts >= now - interval 9 day) as n_main, count(*) filter (where kind = 'reit' and ts >= now - interval 9 day) as n_reit,
  count(*) filter (where ts >= now - interval 9 day) as n_recent, cast(max(ts) as varchar) as latest_at, arg_min(kind, (-epoch_us(ts), kind)) as latest_kind from e, n group by user_id
""")
def rating_changes(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", F.get(F.array(*map(F.lit, ("up", "down", "init", "main", "reit"))), (F.col("event_id") % 5).cast("int")).alias("kind"))
    return tidy(records.changes_since(e.withColumn("_now", e.agg(F.max("ts")).scalar()), "user_id", "ts", "kind", F.col("_now"), 9))


@plain("""
select outcome_id, coalesce(score >= 40 and day_of_packet <= 2, false) as pocket from (select distinct outcome_id, score, day_of_packet from outcomes)
""")
def pocket_flag(spark, sf):
    d = table(spark, sf, "outcomes").select("outcome_id", "score", "day_of_packet").distinct()
    return d.select("outcome_id", F.coalesce((F.col("score") >= 40) & (F.col("day_of_packet") <= 2), F.lit(False)).alias("pocket"))


#: Sectors and their short names; others keep their first word's first six letters.
SECTORS = {"technology": "Tech", "financial services": "Fin", "financials": "Fin", "healthcare": "Health", "health care": "Health", "communication services": "Comm", "consumer cyclical": "Cycl", "consumer defensive": "Def", "basic materials": "Mat", "materials": "Mat", "industrials": "Ind", "real estate": "RE"}


@plain("""
with s as (select trim(regexp_replace(lower(sector), '\\s+', ' ', 'g')) as s from sector_updates)
select case s when 'technology' then 'Tech' when 'financial services' then 'Fin' when 'financials' then 'Fin' when 'healthcare' then 'Health' when 'health care' then 'Health' when 'communication services' then 'Comm' when 'consumer cyclical' then 'Cycl' when 'consumer defensive' then 'Def' when 'basic materials' then 'Mat' when 'materials' then 'Mat' when 'industrials' then 'Ind' when 'real estate' then 'RE'
  else upper(left(s, 1)) || substr(split_part(s, ' ', 1), 2, 5) end as short, count(*) as n from s where s is not null and s not in ('', '?') group by 1
""")
def sector_short(spark, sf):
    s = F.trim(F.regexp_replace(F.lower("sector"), r"\s+", " "))
    known = F.create_map(*[F.lit(x) for pair in SECTORS.items() for x in pair])
    word = F.split(F.col("s"), " ")[0]
    short = F.coalesce(F.try_element_at(known, F.col("s")), F.concat(F.upper(F.substring("s", 1, 1)), F.substring(word, 2, 5)))
    return table(spark, sf, "sector_updates").select(s.alias("s")).where("s is not null and s not in ('', '?')").groupBy(short.alias("short")).agg(F.count(F.lit(1)).alias("n"))


@plain("""
with s as (select distinct o_custkey as k, o_orderkey % 3 as slot, o_orderkey as choice, round(o_totalprice, 0) as price from orders where o_custkey % 3 > 0),
r as (select *, row_number() over (partition by k, slot order by price, cast(choice as varchar)) as i from s), f as (select * from r where i <= 2),
g as (select k, count(distinct slot) as m from f group by k), a as (select k, price as p, slot || '=' || choice as x from f where slot = 0), b as (select k, price as p, slot || '=' || choice as x from f where slot = 1), c as (select k, price as p, slot || '=' || choice as x from f where slot = 2),
u as (select g.k, coalesce(a.p, 0) + coalesce(b.p, 0) + coalesce(c.p, 0) as price, concat_ws(' ', a.x, b.x, c.x) as picks from g left join a on a.k = g.k left join b on b.k = g.k left join c on c.k = g.k)
select k as o_custkey, price, picks from (select *, row_number() over (partition by k order by price, picks) as i from u) where i <= 2
""")
def slot_menus(spark, sf):
    """The two cheapest ways to fill three slots of each customer."""
    o = table(spark, sf, "orders").where("o_custkey % 3 > 0").select("o_custkey", (F.col("o_orderkey") % 3).cast("string").alias("slot"), F.col("o_orderkey").cast("string").alias("choice"), F.round("o_totalprice", 0).alias("price")).distinct()
    return records.slot_choices(o, "o_custkey", "slot", "choice", "price", 2)


_REGIME = """
, m as (select ledger_id, run_id, spy_vs_200_pct as s200, spy_vs_200_pct / 2 as s50, spy_vs_200_pct / 40 - 0.02 as slope, -abs(vix_5d_pct) / 4 as high, breadth_50_pct / 10 - 5 as q50, breadth_200_pct / 10 - 5 as q200, vix / 18 as term, vix_5d_pct, credit_pct, -credit_pct + 0.1 as rot, case when mod(ledger_id, 2) = 0 then -credit_pct - 0.3 end as prior,
  breadth_50_pct, breadth_200_pct, (breadth_50_pct - 50) / 20 as rsp, (breadth_200_pct - 50) / 8 as nh, vix from r),
u as (select *, coalesce(s200 > 0 and slope > -0.05, false) as up from m),
v as (select *, case when coalesce(s200 > 0 and s50 > 0 and slope > 0, false) then 1 when coalesce(s200 <= 0 or slope <= -0.05, false) then -1 else 0 end as v1, case when coalesce(q200 > 0 and q50 > 0, false) then 1 when coalesce(q200 <= 0, false) then -1 else 0 end as v2,
  case when breadth_50_pct >= 60 then 1 when breadth_50_pct <= 40 then -1 else 0 end as v3, case when breadth_200_pct >= 60 then 1 when breadth_200_pct <= 40 then -1 else 0 end as v4, case when rsp >= 0.5 then 1 when rsp <= -0.5 then -1 else 0 end as v5, case when nh >= 1 then 1 when nh <= -1 then -1 else 0 end as v6,
  case when vix <= 17 then 1 when vix >= 25 then -1 else 0 end as v7, case when term < 0.95 then 1 when term > 1 then -1 else 0 end as v8, case when credit_pct >= 0.25 then 1 when credit_pct <= -0.25 then -1 else 0 end as v9, case when rot <= -0.5 then 1 when rot >= 0.5 then -1 else 0 end as v10,
  case when up then list_filter([case when breadth_50_pct < 50 and high >= -3 then 'breadth' end, case when rsp < -0.5 then 'narrowing' end, case when credit_pct < -0.25 then 'credit' end, case when rot > 0.5 and (prior is null or rot - prior > 0.5) then 'rotation' end, case when term > 1 then 'vix_curve' end, case when vix_5d_pct > 20 then 'vix_spike' end], lambda x: x is not null) else [] end as flags from u),
w as (select *, v1 + v2 + v3 + v4 + v5 + v6 + v7 + v8 + v9 + v10 as score, len(list_filter([v1, v2, v3, v4, v5, v6, v7, v8, v9, v10], lambda x: x = 1)) as n_bull, len(list_filter([v1, v2, v3, v4, v5, v6, v7, v8, v9, v10], lambda x: x = -1)) as n_bear, len(flags) as n_flags from v)
select ledger_id, run_id, score, n_bull, n_bear, array_to_string(flags, ',') as flags, case when not up then 'RISK-OFF' when n_flags >= 4 or score <= -3 then 'RISK-OFF (internals)' when n_flags >= 2 or score <= -2 or coalesce(breadth_50_pct < 45, false) then 'CAUTION' else 'RISK-ON' end as state from w
"""


@plain(_READ + _REGIME)
def regime_states(spark, sf):
    """All votes and flags; metrics that the ledger lacks are made from those it has."""
    r = readings(table(spark, sf, "regime_history"))
    c = F.col
    m = r.select(
        "ledger_id", "run_id", "spy_vs_200_pct", (c("spy_vs_200_pct") / 2).alias("spy_vs_50_pct"), (c("spy_vs_200_pct") / 40 - 0.02).alias("spy_slope_pct"), (-F.abs("vix_5d_pct") / 4).alias("spy_from_high_pct"),
        (c("breadth_50_pct") / 10 - 5).alias("qqq_vs_50_pct"), (c("breadth_200_pct") / 10 - 5).alias("qqq_vs_200_pct"), (c("vix") / 18).alias("vix_term"), "vix_5d_pct", "credit_pct", (-c("credit_pct") + 0.1).alias("def_off_pct"),
        F.when(c("ledger_id") % 2 == 0, -c("credit_pct") - 0.3).alias("def_off_prior_pct"), "breadth_50_pct", "breadth_200_pct", ((c("breadth_50_pct") - 50) / 20).alias("rsp_spy_pct"), ((c("breadth_200_pct") - 50) / 8).alias("nhnl_pct"), "vix",
    )
    return regime.classify(m).select("ledger_id", "run_id", "score", "n_bull", "n_bear", F.array_join("flags", ",").alias("flags"), "state")


@plain(_PAIR + """
, c as (select ticker, arg_max(close, (run_date, run_id)) filter (where close is not null and run_date is not null) as close from picks group by ticker), b as (select ticker, arg_max(close, (run_date, run_id)) filter (where close is not null and cast(run_date as date) <= d0) as was from picks, m group by ticker)
select ticker, case when ascii(right(ticker, 1)) % 4 = 0 then 'vol_collapse' when exists (select 1 from p s where s.rank is not null and left(s.ticker, 2) = left(p.ticker, 2)) then 'deduped' when (close / was - 1) * 100 >= 0.5 then 'broke_out' when (close / was - 1) * 100 < -8 then 'broke_down' else 'faded' end as reason from p left join c using (ticker) left join b using (ticker) where status = 'dropped'
""")
def dropout_reasons(spark, sf):
    """Why names dropped out, the first that holds: excluded for collapsed volatility (here by their last letter), hidden by a
    listed name of the same issuer (here the same first two letters), broken out or down, or faded."""
    from barloom.operators import persistence as per

    picks = _picks(spark, sf).withColumn("day", F.to_date("run_date"))
    pair = per.run_pair(picks, "ticker", "day", "rank", "score_rank", 30)
    d0 = picks.select("day").distinct().orderBy(F.col("day").desc()).limit(2).agg(F.min("day")).scalar()
    excluded = picks.where(F.ascii(F.right("ticker", F.lit(1))) % 4 == 0).select("ticker").distinct()
    issuers = picks.select("ticker", F.substring("ticker", 1, 2).alias("issuer")).distinct()
    reasons = per.dropout_reasons(pair, per.moves_since(picks, "ticker", "day", d0), "ticker", excluded, issuers)
    return reasons.select("ticker", "reason")


@query(_SIG + """
, q as (select s.sid, s.ticker, s.sess_no, case when s.dow = 5 then b.close * 1.3 else b.close end * 1.01 as recorded, b.close * 1.5 as target, b.close * 0.6 as stop from sig s join bars b on b.ticker = s.ticker and b.sess_no = s.sess_no - s.dow % 2),
x as (select q.*, o.close / recorded as r0, p.close / recorded as r1, o.close as c0, p.close as c1 from q left join bars o on o.ticker = q.ticker and o.sess_no = q.sess_no left join bars p on p.ticker = q.ticker and p.sess_no = q.sess_no - 1),
y as (select *, abs(r0 - 1) * 100 > 2 and coalesce(abs(r1 - 1) < abs(r0 - 1), false) as back from x), z as (select *, case when back then r1 else r0 end as ratio from y),
u as (select sid, ticker, sess_no - cast(back as int) as at, target * ratio as t, stop * ratio as s, case when ratio is null then 'no_bars' when abs(ratio - 1) * 100 > 5 then 'unit_mismatch' else 'ok' end as units from z),
e as (select u.*, b.open as entry from u left join bars b on b.ticker = u.ticker and b.sess_no = u.at + 1 where units = 'ok'),
k as (select *, case when entry is null then 'no_bars' when entry >= t or entry <= s then 'gap_skip' else 'ok' end as status from e),
h as (select k.sid, min(b.sess_no - k.at) filter (where b.high >= k.t) as w, min(b.sess_no - k.at) filter (where b.low <= k.s) as l, count(*) as n from k join bars b on b.ticker = k.ticker and b.sess_no between k.at + 1 and k.at + 10 where status = 'ok' group by k.sid)
select sid, units as outcome, null::double as entry from u where units <> 'ok' union all select k.sid, case when status <> 'ok' then status when w is not null and (l is null or w <= l) then 'WON' when l is not null then 'LOST' when n >= 10 then 'EXPIRED' else 'OPEN' end, round(entry, 6) from k left join h using (sid)
""")
def replay_next_open(spark, sf):
    """Signals recorded in other units or off by a session, moved onto the series and entered at the next open."""
    bars = _bars(spark, sf)
    s = _signals(bars)
    was = bars.select("ticker", F.col("sess_no").alias("_w"), F.col("close").alias("_c"))
    recorded = s.withColumn("_w", F.col("sess_no") - F.col("dow") % 2).join(was, ["ticker", "_w"])
    recorded = recorded.select("sid", "ticker", "sess_no", (F.when(F.col("dow") == 5, F.col("_c") * 1.3).otherwise(F.col("_c")) * 1.01).alias("recorded"), (F.col("_c") * 1.5).alias("target"), (F.col("_c") * 0.6).alias("stop"))
    moved = replay.in_series_units(bars, recorded)
    entered = replay.entered_next_open(bars, moved.where("status = 'ok'"))
    played = replay.target_stop(bars, entered.where("status = 'ok'"), 10).select("sid", F.col("outcome").alias("_o"))
    rest = entered.join(played, "sid", "left").select("sid", F.when(F.col("status") == "ok", F.col("_o")).otherwise(F.col("status")).alias("outcome"), "entry")
    return tidy(rest.unionByName(moved.where("status <> 'ok'").select("sid", F.col("status").alias("outcome"), F.lit(None).cast("double").alias("entry"))))


_RATES = "count(*) as n, round(avg(result_pct), 6) as expectancy, round(case when count(*) filter (where outcome in ('WON', 'LOST')) > 0 then count(*) filter (where outcome = 'WON') * 100.0 / count(*) filter (where outcome in ('WON', 'LOST')) end, 6) as win_pct"


@plain(f"""
with o as (select distinct outcome_id, outcome, days, result_pct, sector, regime, armed, spark_kind, ignited, score, listing_age_runs, day_of_packet from outcomes),
s as (select o.*, unnest([{{'f': 'all', 's': 'all'}}, {{'f': 'sector', 's': sector}}, {{'f': 'regime', 's': regime}}, {{'f': 'armed x ignited', 's': cast(armed as varchar) || '/' || cast(ignited as varchar)}}, {{'f': 'spark', 's': spark_kind}},
  {{'f': 'score', 's': case when score >= 0 and score < 40 then '[0,40)' when score >= 40 and score < 60 then '[40,60)' when score >= 60 and score < 101 then '[60,101)' end}}, {{'f': 'age', 's': case when listing_age_runs >= 1 and listing_age_runs < 3 then '[1,3)' when listing_age_runs >= 3 and listing_age_runs < 1000 then '[3,1000)' end}},
  {{'f': 'day', 's': case when day_of_packet <= 2 then 'early' when day_of_packet > 2 then 'late' end}}, {{'f': 'pocket', 's': case when score >= 40 and day_of_packet <= 2 then 'pocket' else 'rest' end}}]) as x from o)
select x.f as family, x.s as stratum, {_RATES} from s where x.s is not null group by all
""")
def backtest_report(spark, sf):
    """All families of strata of the outcomes in one aggregation, each row counted once in each family."""
    c = F.col
    d = table(spark, sf, "outcomes").select("outcome_id", "outcome", "days", "result_pct", "sector", "regime", "armed", "spark_kind", "ignited", "score", "listing_age_runs", "day_of_packet").distinct()
    families = {
        "all": F.lit("all"), "sector": c("sector"), "regime": c("regime"), "armed x ignited": F.concat(c("armed").cast("string"), F.lit("/"), c("ignited").cast("string")), "spark": c("spark_kind"),
        "score": stats.half_open(c("score"), [0, 40, 60, 101]), "age": stats.half_open(c("listing_age_runs"), [1, 3, 1000]), "day": F.when(c("day_of_packet") <= 2, "early").when(c("day_of_packet") > 2, "late"),
        "pocket": F.when((c("score") >= 40) & (c("day_of_packet") <= 2), "pocket").otherwise("rest"),
    }
    labels = [F.when(s.isNotNull(), F.struct(F.lit(f).alias("family"), s.alias("stratum"))) for f, s in families.items()]
    d = d.select("outcome", "days", "result_pct", F.inline(F.array_compact(F.array(*labels))))
    return tidy(stats.win_rates(d, "family", "stratum")).select("family", "stratum", "n", "expectancy", "win_pct")


@query("""
, r as (select *, close / lag(close) over (partition by ticker order by session) - 1 as ret from bars), p as (select ticker, (close / lag(close, 20) over (partition by ticker order by session) - 1) * 100 as score, back from bars), s as (select ticker, score, row_number() over (order by score desc, ticker) as score_rank from p where back = 0 and score is not null),
k as (select *, row_number() over (partition by ticker order by session) as i, count(*) over (partition by ticker) as n from r where back < 63 and ret is not null),
h as (select ticker, n, stddev_samp(ret) filter (where i <= n // 2) * sqrt(252) * 100 as v1, stddev_samp(ret) filter (where i > n // 2) * sqrt(252) * 100 as v2 from k group by ticker, n),
x as (select s.*, v1, v2, coalesce(n >= 20 and v1 >= 5 and v2 / v1 < 0.9, false) as out from s left join h using (ticker))
select ticker, score_rank, case when not out then row_number() over (partition by out order by score_rank) end as rank, case when out then score_rank end as pre_filter_rank, round(case when out then v2 / v1 end, 6) as vol_ratio from x
""")
def vol_collapse_ranks(spark, sf):
    """Names ranked by a score; those with collapsed volatility lose their rank, keep the one they had, and the others close up."""
    bars = _bars(spark, sf)
    by = Window.orderBy(F.col("score").desc(), "ticker")  # one row a ticker
    s = bars.select("ticker", "back", (ind.change("close", 20) * 100).alias("score")).where("back = 0 and score is not null").select("ticker", F.row_number().over(by).alias("score_rank"))
    d = s.join(ind.volatility_halves(bars, 63), "ticker", "left")
    out = F.coalesce((F.col("n") >= 20) & (F.col("v1") >= 5) & (F.col("v2") / F.col("v1") < 0.9), F.lit(False))
    d = d.withColumn("_out", out)
    rank = F.row_number().over(Window.partitionBy("_out").orderBy("score_rank"))  # one row a ticker
    return tidy(d.select("ticker", "score_rank", F.when(~F.col("_out"), rank).alias("rank"), F.when(F.col("_out"), F.col("score_rank")).alias("pre_filter_rank"), F.when(F.col("_out"), F.col("v2") / F.col("v1")).alias("vol_ratio")))


@query("""
, w as (select ticker, max(high) filter (where back < 252) as hi, min(low) filter (where back < 252) as lo, max(close) filter (where back = 0) as last, max(close) filter (where back = 1) as prior, avg(volume) filter (where back < 63) as v63, max(volume) filter (where back = 0) as v from bars group by ticker)
select ticker, round(last, 6) as last, round((last / prior - 1) * 100, 6) as change_pct, round((last / hi - 1) * 100, 6) as from_high_pct, round((last / lo - 1) * 100, 6) as from_low_pct, round((last - lo) / (hi - lo) * 100, 6) as range_pct, round(v / v63, 6) as volume_ratio from w where hi > lo
""")
def headline_summary(spark, sf):
    """A line for each ticker: the last close against the one before and against the year's range, and its volume."""
    g = _bars(spark, sf).where("back < 252").groupBy("ticker").agg(
        F.max("high").alias("hi"), F.min("low").alias("lo"), F.max(F.when(F.col("back") == 0, F.col("close"))).alias("last"), F.max(F.when(F.col("back") == 1, F.col("close"))).alias("prior"),
        F.avg(F.when(F.col("back") < 63, F.col("volume"))).alias("v63"), F.max(F.when(F.col("back") == 0, F.col("volume"))).alias("v"),
    )
    c = F.col
    return tidy(g.where("hi > lo").select("ticker", "last", ((c("last") / c("prior") - 1) * 100).alias("change_pct"), ((c("last") / c("hi") - 1) * 100).alias("from_high_pct"), ((c("last") / c("lo") - 1) * 100).alias("from_low_pct"), ((c("last") - c("lo")) / (c("hi") - c("lo")) * 100).alias("range_pct"), (c("v") / c("v63")).alias("volume_ratio")))


@plain("""
with l as (select l_partkey, l_suppkey, sum(l_quantity) as held, count(*) as trades, max(cast(l_shipdate as date)) as last_day, sum(case when l_returnflag = 'R' then l_quantity else 0 end) as sold, sum(case when l_returnflag = 'A' then l_quantity else 0 end) as bought from lineitem group by all),
k as (select *, row_number() over (partition by l_partkey order by held desc, l_suppkey) as i, sum(held) over (partition by l_partkey) as total from l)
select l_partkey, count(*) as holders, sum(trades)::bigint as trades, arg_min(l_suppkey, i) as top_holder, round(max(held / total) * 100, 6) as top_pct, round(sum(held / total) filter (where i <= 5) * 100, 6) as top5_pct, round(sum(bought) - sum(sold), 6) as net_bought, cast(max(last_day) as varchar) as last_day from k group by l_partkey
""")
def ownership_summary(spark, sf):
    """Holders and what insiders did, by part: how many, the greatest and the five greatest shares, net purchases, last day."""
    c = F.col
    l = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(  # noqa: E741
        F.sum("l_quantity").alias("held"), F.count(F.lit(1)).alias("trades"), F.max(F.to_date("l_shipdate")).alias("day"),
        F.sum(F.when(c("l_returnflag") == "R", c("l_quantity")).otherwise(0)).alias("sold"), F.sum(F.when(c("l_returnflag") == "A", c("l_quantity")).otherwise(0)).alias("bought"),
    )
    w = Window.partitionBy("l_partkey")
    k = l.withColumn("_i", F.row_number().over(w.orderBy(c("held").desc(), "l_suppkey"))).withColumn("_share", c("held") / F.sum("held").over(w))  # one row a holder of a part
    return tidy(k.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("holders"), F.sum("trades").alias("trades"), F.min_by("l_suppkey", "_i").alias("top_holder"), (F.max("_share") * 100).alias("top_pct"), (F.sum(F.when(c("_i") <= 5, c("_share"))) * 100).alias("top5_pct"), (F.sum("bought") - F.sum("sold")).alias("net_bought"), F.max("day").alias("last_day"),
    ))


QUERIES, SQL = query.queries | plain.queries, query.sql | plain.sql
