"""What persists from run to run: latest rows, streaks, deltas, drop-outs, confirmation and spells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.labels import base_state
from barloom.operators.neighbours import neighbours


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row of each key that is last by ``order``, a partial aggregation rather than a window; null keys are a key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def numbered_runs(listings: DataFrame, day: str) -> DataFrame:
    """day and its number ``no``, from 1; days of runs are as few as the calendar has."""
    return listings.where(F.col(day).isNotNull()).select(day).distinct().withColumn("no", F.row_number().over(Window.orderBy(day)).cast("long"))


def streaks(listings: DataFrame, key: str, day: str) -> DataFrame:
    """For each key: n_days, longest (consecutive run days), active (ending at the latest run day, else 0), first_seen.

    first_seen is the first day of the active streak, null without one. Days are distinct by key.
    """
    days = numbered_runs(listings, day)
    last = days.agg(F.max("no")).scalar()
    d = listings.where(F.col(key).isNotNull()).select(key, day).distinct().join(days, day)
    d = d.withColumn("_g", F.col("no") - F.row_number().over(Window.partitionBy(key).orderBy("no")))
    island = d.groupBy(key, "_g").agg(F.count(F.lit(1)).alias("_n"), F.max("no").alias("_end"), F.min(day).alias("_start")).withColumn("_last", last)
    active = F.col("_end") == F.col("_last")
    return island.groupBy(key).agg(F.sum("_n").alias("n_days"), F.max("_n").alias("longest"), F.coalesce(F.max(F.when(active, F.col("_n"))), F.lit(0)).alias("active"), F.max(F.when(active, F.col("_start"))).alias("first_seen"))


def run_pair(listings: DataFrame, key: str, day: str, rank: str, score_rank: str, top: int) -> DataFrame:
    """The last two run days compared: key, status (stayed, new, dropped), rank, before and delta (positive: climbed).

    Only ranks up to ``top`` are visible; the delta is of score_rank, and of rank where that is null.
    """
    days = listings.where(F.col(day).isNotNull()).select(day).distinct().orderBy(F.col(day).desc()).limit(2).agg(F.max(day).alias("_d1"), F.min(day).alias("_d0"))
    d = listings.join(F.broadcast(days), F.col(day).isin(F.col("_d1"), F.col("_d0"))).where(F.col(rank) <= top)
    place = F.coalesce(F.col(score_rank), F.col(rank))
    g = d.groupBy(key).agg(F.min(F.when(F.col(day) == F.col("_d1"), F.col(rank))).alias("rank"), F.min(F.when(F.col(day) == F.col("_d0"), F.col(rank))).alias("before"), (F.min(F.when(F.col(day) == F.col("_d0"), place)) - F.min(F.when(F.col(day) == F.col("_d1"), place))).alias("delta"))
    status = F.when(F.col("before").isNull(), "new").when(F.col("rank").isNull(), "dropped").otherwise("stayed")
    return g.select(key, status.alias("status"), "rank", "before", "delta")


def moves_since(prices: DataFrame, key: str, day: str, before) -> DataFrame:
    """By key: move_pct of the last known close against the last one up to the day ``before``; prices has close, run_date, run_id."""
    by, has = F.struct("run_date", "run_id"), F.col("close").isNotNull() & F.col("run_date").isNotNull()
    g = prices.withColumn("_d0", before).groupBy(key).agg(F.max_by("close", F.when(has, by)).alias("_now"), F.max_by("close", F.when(has & (F.col(day) <= F.col("_d0")), by)).alias("_was"))
    return g.select(key, ((F.col("_now") / F.col("_was") - 1) * 100).alias("move_pct"))


def dropout_reasons(pair: DataFrame, moves: DataFrame, key: str, excluded: DataFrame, issuers: DataFrame, out_pct: float = 0.5, down_pct: float = -8) -> DataFrame:
    """The names of run_pair() that dropped out, with the first reason that holds: vol_collapse (in ``excluded``), deduped
    (another name of its issuer is listed now), broke_out or broke_down (by ``moves``), else faded."""
    issuers = issuers.select(key, "issuer")
    gone = pair.where("status = 'dropped'").select(key).join(excluded.select(key, F.lit(True).alias("_excluded")), key, "left").join(moves, key, "left").join(issuers, key, "left")
    shown = pair.where("rank is not null").select(key).join(issuers, key).select("issuer", F.lit(True).alias("_shown")).distinct()
    d = gone.join(shown, "issuer", "left")
    reason = F.when(F.col("_excluded"), "vol_collapse").when(F.col("_shown"), "deduped").when(F.col("move_pct") >= out_pct, "broke_out").when(F.col("move_pct") < down_pct, "broke_down").otherwise("faded")
    return d.select(key, reason.alias("reason"))


def confirmed(readings: DataFrame, keys: list[str], order: str, state: str, n: int = 2, segment: Column | None = None) -> DataFrame:
    """Add ``confirmed``: the last state that stood for n readings in a row up to then; the first reading seeds it. Also
    ``position`` (from 1) and ``before``, the state of the reading before.

    Null states are left out. ``segment`` cuts a key's order into pieces (operators.neighbours), so that a key with most of
    the readings isn't one task; each of the n readings is a pass over the pieces.
    """
    cols, piece = readings.columns, F.col("_piece")
    d = readings.where(F.col(state).isNotNull()).withColumn("_piece", F.lit(0) if segment is None else segment)
    d = neighbours(d, keys, [order], piece, lag={"before": state}).withColumnRenamed("pos", "position")
    d = d.withColumn("_same", F.col(state).eqNullSafe(F.col("before")).cast("int"))
    for _ in range(n - 2):  # as many readings in a row as the one before has, and this one
        d = neighbours(d, keys, [order], piece, lag={"_run": "_same"}).drop("pos").withColumn("_same", F.least("_same", F.coalesce("_run", F.lit(0)))).drop("_run")
    stands = F.lit(True) if n < 2 else F.col("_same") == 1
    d = d.withColumn("_sure", F.when(stands | (F.col("position") == 1), F.col(state)))
    return neighbours(d, keys, [order], piece, carry={"confirmed": "_sure"}).select(*cols, "confirmed", "position", "before")


def vote(value: Column, bull: float, bear: float, higher: bool = True) -> Column:
    """+1, -1 or 0; null abstains with 0."""
    up, down = (value >= bull, value <= bear) if higher else (value <= bull, value >= bear)
    return F.when(up, 1).when(down, -1).otherwise(0)


def readings(history: DataFrame) -> DataFrame:
    """The counting reading of each ledger and session: ledger_id, run_id, base, and the columns of its row."""
    d = history.withColumn("base", base_state(F.col("state"))).where("base is not null and run_id is not null and ledger_id is not null")
    return latest(d, ["ledger_id", "run_id"], "run_date", "row_no")
