"""Queries p4, p7, p8, p9 and p10 over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.labels import base_state
from barloom.llm import packing, pii, runs, tokens, topn
from barloom.session import materialize, table

#: Containers of p9, in tokens.
CAPACITY = 2048


def p4_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "regime_history").select("ledger_id", "run_id", "run_date", "row_no", base_state(F.col("state")).alias("base")).where("base is not null and run_id is not null")
    readings = rows.groupBy("ledger_id", "run_id").agg(F.max_by(F.struct("base", "run_date"), F.struct("run_date", "row_no")).alias("r")).select("ledger_id", "run_id", "r.base", "r.run_date")
    out = runs.collapse_runs(readings, ["ledger_id"], "run_id", "base", "run_date", F.substring("run_id", 1, 6))
    return out.withColumnsRenamed({"first": "first_run_id", "last": "last_run_id", "n_events": "n_readings"})


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_runs(spark, sf).where("n_readings >= 2").select("ledger_id", "first_run_id", "last_run_id", "n_readings")


def p7_top(spark: SparkSession, sf: str) -> DataFrame:
    picks = table(spark, sf, "mom_history").select("run_id", "ticker", "score", "rank", "logged_at").where("run_id is not null and ticker is not null")
    last = picks.groupBy("run_id", "ticker").agg(F.max_by(F.struct("score", "rank"), F.struct("logged_at", "score", "rank")).alias("p"))
    last = last.select("run_id", "ticker", "p.score", "p.rank").where("score is not null and not isnan(score)")
    return topn.top_n(last, ["run_id"], [("score", True), ("rank", False), ("ticker", False)], 10)  # the aggregation has spread them by run_id and ticker


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_top(spark, sf).select("run_id", "ticker")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """The texts again, from their ids."""
    return tokens.decoded(p8_ids(spark, sf), "doc_id", "ids")


def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(tokens.count_tokens(table(spark, sf, "documents"), "doc_id", "text"), "doc_id", "n_tokens", CAPACITY)


def p9_summary(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of p9_containers: texts in it, pieces given twice, containers over capacity, pieces out of order or
    shorter than they may be, and whether there are at most 1 % (and one) more containers than the volume needs."""
    placed = materialize(p9_containers(spark, sf), "placed")
    n = F.count(F.lit(1))
    texts = placed.groupBy("doc_id").agg(n.alias("k"), F.max("piece").alias("last"), F.count(F.when(F.col("size") == CAPACITY, 1)).alias("full"), F.countDistinct("piece").alias("pieces"))
    ok = (F.col("pieces") == F.col("k")) & (F.col("last") == F.col("k") - 1) & (F.col("full") >= F.col("last"))
    texts = texts.agg(n.alias("texts"), F.count(F.when(~ok, 1)).alias("broken"))
    rooms = placed.groupBy("container").agg(F.sum("size").alias("used"))
    rooms = rooms.agg(F.count(F.when(F.col("used") > CAPACITY, 1)).alias("over"), F.count(F.when(F.col("used") > 0, 1)).alias("c"), F.sum("used").alias("v"))
    few = F.coalesce(F.col("c") <= F.ceil(F.col("v") / CAPACITY) * 1.01 + 1, F.lit(True))
    return spark.range(1).select(*[texts.select(c).scalar().alias(c) for c in ("texts", "broken")], rooms.select("over").scalar().alias("over"), rooms.select(few).scalar().alias("few"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find_personal(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "name_lexicon"))


def p10_replaced(spark: SparkSession, sf: str) -> DataFrame:
    return pii.replaced(table(spark, sf, "documents"), "doc_id", "text", p10_found(spark, sf))


QUERIES = {f.__name__: f for f in (p4_found, p4_runs, p7_found, p7_top, p8_ids, p8_decoded, p9_containers, p9_summary, p10_found, p10_replaced)}

_BASE = "case when regexp_matches(state, '^[^\\pL]*risk[^\\pL\\pN]{0,3}on([^\\pL]|$)', 'i') then 'RISK-ON' when regexp_matches(state, '^[^\\pL]*risk[^\\pL\\pN]{0,3}off([^\\pL]|$)', 'i') then 'RISK-OFF' when regexp_matches(state, '^[^\\pL]*caution([^\\pL]|$)', 'i') then 'CAUTION' end"
_RUNS = f"""
with named as (select *, {_BASE} as base from regime_history),
kept as (select * from (select *, row_number() over (partition by ledger_id, run_id order by run_date desc, row_no desc) as k from named where base is not null and run_id is not null and ledger_id is not null) where k = 1),
cut as (select *, case when base = lag(base) over (partition by ledger_id order by run_id) then 0 else 1 end as opens from kept),
numbered as (select *, sum(opens) over (partition by ledger_id order by run_id) as i from cut),
spans as (select ledger_id, any_value(base) as base, min(run_id) as first_run_id, max(run_id) as last_run_id, count(*) as n_readings, arg_min(run_date, run_id) as started, arg_max(run_date, run_id) as ended from numbered group by ledger_id, i)
"""
_TOP = """
with kept as (select * from (select *, row_number() over (partition by run_id, ticker order by logged_at desc, score desc, rank desc) as k from mom_history where run_id is not null and ticker is not null) where k = 1),
placed as (select run_id, ticker, score, rank, row_number() over (partition by run_id order by score desc, rank asc nulls last, ticker) as place from kept where score is not null and not isnan(score))
"""
SQL = {
    "p4_found": _RUNS + "select ledger_id, first_run_id, last_run_id, n_readings from spans where n_readings >= 2",
    "p4_runs": _RUNS + "select *, (epoch_us(ended) - epoch_us(started)) / 1e6 as duration_s from spans",
    "p7_found": _TOP + "select run_id, ticker from placed where place <= 10",
    "p8_decoded": "select doc_id, coalesce(text, '') as text from documents",
    "p9_summary": "select count(distinct doc_id) as texts, 0::bigint as broken, 0::bigint as over, true as few from documents",
    "p7_top": _TOP + "select run_id, ticker, score, rank, place from placed where place <= 10",
}
