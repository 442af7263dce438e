"""Queries p1, p2, p3, p5 and p6 over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import micros
from barloom.functions.labels import base_state
from barloom.functions.timestamps import day_text, instant_text, normalise_times, with_source
from barloom.operators import drift, history, sessions
from barloom.operators.asof import as_known
from barloom.session import materialize, table
from barloom.streaming.sessions import replayed, stream_sessions

#: Seconds of one piece of a ticker's updates.
PIECE = 90 * 86_400


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.file_changes(table(spark, sf, "ledger_rows"))


def p1_table(spark: SparkSession, sf: str) -> DataFrame:
    return drift.unified(table(spark, sf, "ledger_rows"))


def p1_values(spark: SparkSession, sf: str) -> DataFrame:
    """p1_table without what stays rescued, of the rows that are JSON objects."""
    rows = table(spark, sf, "ledger_rows").where(F.try_parse_json("payload").isNotNull() & F.trim("payload").startswith("{"))
    return drift.unified(rows).drop("rescued")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_episodes(spark, sf).select("ticker", "start_day", "last_day", "dropout_day")


def p2_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.episodes(table(spark, sf, "appearances"), table(spark, sf, "run_days"))


def p2_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of p2_found from a replay as a stream: sessions of days behind a watermark that spans the calendar, so rows
    of any order count, closed by one event of no ticker after all others."""
    days = sessions.numbered_days(table(spark, sf, "run_days"))
    listed = table(spark, sf, "appearances")
    # A pattern, since a stream reads a single file only where a pattern names it.
    stream = spark.readStream.schema(listed.schema).parquet(f"{sf}/appearances.parque[t]").where(F.trim("ticker") != "").select("ticker", "run_day").join(days, "run_day").select("ticker", "no")
    span = sessions.numbered_days(table(spark, sf, "run_days")).count() + 10
    end = materialize(spark.createDataFrame([(" ", 3 * span)], "ticker string, no long"), "end")
    closing = spark.readStream.schema(end.schema).parquet(end.inputFiles()[0].rsplit("/", 1)[0])
    events = stream.unionByName(closing).select("ticker", F.timestamp_seconds(F.col("no") * 86_400).alias("at"))
    done = replayed(stream_sessions(events, "ticker", "at", 3 * 86_400, span * 86_400), "episodes").where("key <> ' '")
    merged = done.select(F.col("key").alias("ticker"), (F.col("started") / 86_400).cast("long").alias("first"), (F.col("ended") / 86_400).cast("long").alias("last"))
    return sessions.named_days(merged, days, 3).select("ticker", "start_day", "last_day", "dropout_day")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    zones = table(spark, sf, "feed_zones")
    readings = table(spark, sf, "readings").select(F.lit("readings").alias("tab"), F.col("reading_id").alias("row_id"), "source", "run_date", "run_day")
    outcomes = table(spark, sf, "outcomes").select(F.lit("outcomes").alias("tab"), F.col("outcome_id").alias("row_id"), "source", "packet_date")
    texts = readings.unpivot(["tab", "row_id", "source"], ["run_date", "run_day"], "field", "text").unionByName(outcomes.unpivot(["tab", "row_id", "source"], ["packet_date"], "field", "text"))
    texts = with_source(texts.where("text is not null").distinct(), zones)
    read = normalise_times(texts, "text")
    value = F.when(F.col("field") == "run_date", instant_text()).otherwise(day_text())
    return read.select("tab", "row_id", "field", value.alias("value")).where("value is not null").distinct()


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return history.versions(table(spark, sf, "sector_updates"), "ticker", "ts", "update_id", ["sector", "industry"], PIECE)


def p5_history(spark: SparkSession, sf: str) -> DataFrame:
    return history.attribute_history(table(spark, sf, "sector_updates"), "ticker", "ts", "update_id", ["sector", "industry"], PIECE)


def _in_force(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    signals = table(spark, sf, "signals").select("signal_id", "ledger_id", "packet_date", "built_at", "regime")
    copy = F.struct("ledger_id", "packet_date", "built_at", "regime")
    signals = signals.where("signal_id is not null").groupBy("signal_id").agg(F.max(copy).alias("s")).select("signal_id", "s.*")
    rows = table(spark, sf, "regime_history").select("ledger_id", "run_id", "run_date", "row_no", base_state(F.col("state")).alias("base")).where("base is not null")
    found = as_known(
        signals, rows, "ledger_id", "signal_id",
        event_known=micros(F.col("built_at")), event_valid=F.regexp_replace("packet_date", "-", "").try_cast("long"),
        known=micros(F.col("run_date")), valid=F.col("run_id").try_cast("long"), tie=F.col("row_no"), value=F.col("base"), block=300,
    )
    return signals, found


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    signals, found = _in_force(spark, sf)
    named = signals.select("signal_id", base_state(F.col("regime")).alias("named")).where("named is not null")
    return named.join(found, "signal_id").where("value is null or value <> named").select("signal_id")


def p6_in_force(spark: SparkSession, sf: str) -> DataFrame:
    return _in_force(spark, sf)[1].withColumnRenamed("value", "state_in_force")


QUERIES = {f.__name__: f for f in (p1_found, p1_table, p1_values, p2_found, p2_episodes, p2_streamed, p3_found, p5_found, p5_history, p6_found, p6_in_force)}

_EPISODES = """
with days as (select run_day, row_number() over (order by run_day) as no from (select distinct run_day from run_days)),
seen as (select distinct ticker, no from appearances join days using (run_day) where trim(ticker) <> ''),
cut as (select *, case when no - lag(no) over (partition by ticker order by no) <= 3 then 0 else 1 end as opens from seen),
numbered as (select *, sum(opens) over (partition by ticker order by no) as i from cut),
spans as (select ticker, min(no) as a, max(no) as b, count(*) as n_days from numbered group by ticker, i)
select ticker, s.run_day as start_day, l.run_day as last_day, coalesce(d.run_day, 'open') as dropout_day{more}
from spans join days s on s.no = a join days l on l.no = b left join days d on d.no = b + 3
"""
_PLAIN = "nullif(nullif(lower(regexp_replace({0}, '\\s+', '', 'g')), ''), '?')"
_VERSIONS = f"""
with last as (select * from (select *, row_number() over (partition by ticker, ts order by update_id desc) as k from sector_updates where ticker is not null and ts is not null) where k = 1),
known as (select ticker, ts, last_value({_PLAIN.format("sector")} ignore nulls) over w as sector, last_value({_PLAIN.format("industry")} ignore nulls) over w as industry
  from last window w as (partition by ticker order by ts rows unbounded preceding)),
marked as (select *, lag(sector) over w as s0, lag(industry) over w as i0 from known window w as (partition by ticker order by ts)),
starts as (select * from marked where s0 is distinct from sector or i0 is distinct from industry)
select ticker, ts as valid_from, coalesce(lead(ts) over (partition by ticker order by ts), -1) as valid_to{{more}} from starts
"""
_BASE = "case when regexp_matches({0}, '^[^\\pL]*risk[^\\pL\\pN]{{0,3}}on([^\\pL]|$)', 'i') then 'RISK-ON' when regexp_matches({0}, '^[^\\pL]*risk[^\\pL\\pN]{{0,3}}off([^\\pL]|$)', 'i') then 'RISK-OFF' when regexp_matches({0}, '^[^\\pL]*caution([^\\pL]|$)', 'i') then 'CAUTION' end"
_FORCE = f"""
with s as (select distinct signal_id, ledger_id, packet_date, built_at, regime, {_BASE.format("regime")} as named from signals),
h as (select ledger_id, run_id, run_date, row_no, {_BASE.format("state")} as base from regime_history),
f as (select signal_id, any_value(named) as named, arg_max(base, (run_id, run_date, row_no)) as base
  from s left join h on s.ledger_id = h.ledger_id and h.base is not null and h.run_date <= s.built_at and h.run_id <= replace(s.packet_date, '-', '') group by signal_id)
"""
_DRIFT = """
with recursive recs as (select distinct on (ledger_id, file_no, row_no, payload) ledger_id, cast(file_no as bigint) as file_no, row_no, payload::json as j from ledger_rows where ledger_id is not null and file_no is not null and json_valid(payload) and json_type(payload) = 'OBJECT'),
f as (select ledger_id, file_no, row_no, unnest(json_keys(j)) as field, j from recs),
v as (select ledger_id, file_no, field, json_extract(j, '$."' || field || '"') as x, json_extract_string(j, '$."' || field || '"') as t, upper(trim(json_extract_string(j, '$.run_id'))) as r, upper(trim(json_extract_string(j, '$.ticker'))) as k from f),
y as (select *, case json_type(x) when 'BOOLEAN' then 'boolean' when 'UBIGINT' then 'integer' when 'BIGINT' then 'integer' when 'DOUBLE' then 'number' when 'VARCHAR' then 'string' when 'NULL' then null else 'other' end as kind from v),
per as (select ledger_id, file_no, field, arg_max(kind, (n, kind)) filter (where kind is not null) as type from (select ledger_id, file_no, field, kind, count(*) as n from y group by all) group by all),
files as (select ledger_id, file_no, lag(file_no) over (partition by ledger_id order by file_no) as before from (select distinct ledger_id, file_no from per)),
added as (select f.ledger_id, f.file_no, f.before, p.field from files f join per p using (ledger_id, file_no) where before is not null and not exists (select 1 from per o where o.ledger_id = f.ledger_id and o.file_no = f.before and o.field = p.field)),
removed as (select f.ledger_id, f.file_no, f.before, p.field from files f join per p on p.ledger_id = f.ledger_id and p.file_no = f.before where not exists (select 1 from per o where o.ledger_id = f.ledger_id and o.file_no = f.file_no and o.field = p.field)),
c as (select *, case when lower(trim(t)) in ('true', 'yes', 'y', '1', '1.0') then '1' when lower(trim(t)) in ('false', 'no', 'n', '0', '0.0') then '0' else coalesce(cast(try_cast(replace(lower(trim(t)), ',', '.') as double) as varchar), trim(t)) end as w from y),
new as (select distinct a.ledger_id, a.file_no, a.before, a.field as new_name, c.r, c.k, c.w from added a join c using (ledger_id, file_no, field) where c.r is not null and c.k is not null),
old as (select distinct a.ledger_id, a.file_no, a.field, c.r, c.k, c.w from removed a join c on c.ledger_id = a.ledger_id and c.file_no = a.before and c.field = a.field where c.r is not null and c.k is not null),
pairs as (select n.ledger_id, n.file_no, n.before, o.field, n.new_name, count(*) filter (where n.w = o.w) as eq, count(*) filter (where n.w <> o.w or (n.w is null) <> (o.w is null)) as ne, count(*) filter (where n.w is null and o.w is null) as nu from new n join old o on o.ledger_id = n.ledger_id and o.file_no = n.file_no and o.r = n.r and o.k = n.k group by all),
good as (select *, eq / (eq + ne) as share from pairs where eq > 0 and eq / (eq + ne) >= 0.9),
ren as (select * from (select *, row_number() over (partition by ledger_id, file_no, field order by share desc, eq desc, nu desc, field, new_name) as a, row_number() over (partition by ledger_id, file_no, new_name order by share desc, eq desc, nu desc, field, new_name) as b from good) where a = 1 and b = 1),
links as (select f.ledger_id, f.file_no, f.before, p.field, p.field as was, p.type from files f join per p using (ledger_id, file_no) join per o on o.ledger_id = f.ledger_id and o.file_no = f.before and o.field = p.field
  union all select r.ledger_id, r.file_no, r.before, r.new_name, r.field, p.type from ren r join per p on p.ledger_id = r.ledger_id and p.file_no = r.file_no and p.field = r.new_name),
known as (select ledger_id, file_no, field, type from per where not exists (select 1 from links l where l.ledger_id = per.ledger_id and l.file_no = per.file_no and l.field = per.field)
  union all select l.ledger_id, l.file_no, l.field, coalesce(l.type, k.type) from known k join links l on l.ledger_id = k.ledger_id and l.before = k.file_no and l.was = k.field)
"""
_CHANGES = """
select ledger_id, file_no, 'added' as change, field, '' as new_name from added a where not exists (select 1 from ren r where r.ledger_id = a.ledger_id and r.file_no = a.file_no and r.new_name = a.field)
union all select ledger_id, file_no, 'removed', field, '' from removed a where not exists (select 1 from ren r where r.ledger_id = a.ledger_id and r.file_no = a.file_no and r.field = a.field)
union all select ledger_id, file_no, 'renamed', field, new_name from ren
union all select l.ledger_id, l.file_no, 'retyped', l.field, '' from links l join known k on k.ledger_id = l.ledger_id and k.file_no = l.before and k.field = l.was where l.type <> k.type
"""
_TARGETS = ", ".join(f"'{name}'" for name in drift.BASE_HISTORY)
_NUMBER = "try_cast(replace(lower(trim(t)), ',', '.') as double)"
_READ_AS = {"string": "t", "number": _NUMBER, "integer": f"case when {_NUMBER} = floor({_NUMBER}) then cast({_NUMBER} as bigint) end", "boolean": "case when lower(trim(t)) in ('true', 'yes', 'y', '1', '1.0') then true when lower(trim(t)) in ('false', 'no', 'n', '0', '0.0') then false end"}
_TYPED = ", ".join(f"max({_READ_AS[kind]}) filter (where canonical = '{name}') as \"{name}\"" for name, kind in drift.BASE_HISTORY.items())
_VALUES = f"""
, canon as (select ledger_id, file_no, field, case when field in ({_TARGETS}) then field end as canonical from per where not exists (select 1 from links l where l.ledger_id = per.ledger_id and l.file_no = per.file_no and l.field = per.field)
  union all select l.ledger_id, l.file_no, l.field, case when l.field in ({_TARGETS}) then l.field else k.canonical end from canon k join links l on l.ledger_id = k.ledger_id and l.before = k.file_no and l.was = k.field),
cells as (select f.ledger_id, f.file_no, f.row_no, cast(f.j as varchar) as p, n.canonical, json_extract_string(f.j, '$."' || f.field || '"') as t from f join canon n using (ledger_id, file_no, field))
select ledger_id, file_no, row_no, {_TYPED} from cells group by ledger_id, file_no, row_no, p
"""
SQL = {
    "p1_found": _DRIFT + _CHANGES,
    "p1_values": _DRIFT + _VALUES,
    "p2_found": _EPISODES.format(more=""),
    "p2_streamed": _EPISODES.format(more=""),
    "p2_episodes": _EPISODES.format(more=", n_days, b - a + 1 as span"),
    "p5_found": _VERSIONS.format(more=""),
    "p5_history": _VERSIONS.format(more=", sector, industry"),
    "p6_found": _FORCE + "select signal_id from f where named is not null and base is distinct from named",
    "p6_in_force": _FORCE + "select signal_id, base as state_in_force from f",
}
