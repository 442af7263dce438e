"""Small operators on records: run ids, date ranges, pages of screens, the state of series, slots and headlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: sessions of a month.
SESSIONS_A_MONTH = 21


def sessions_of(months: int | Column) -> int | Column:
    """How many sessions a window of months has."""
    return months * SESSIONS_A_MONTH


def run_id(at: Column, precise: bool = False) -> Column:
    """A run's id from its UTC time: the New York date, or with ``precise`` the UTC second, so that a day can have several."""
    if precise:
        return F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), at), "yyyyMMdd")


def date_range(start: Column, end: Column, days: Column, past_days: Column, today: Column) -> tuple[Column, Column]:
    """First and last date (inclusive) of what is asked for; each of the first four may be null.

    past_days alone counts: that many before today, up to today. Otherwise it starts at ``start`` or today and ends ``days``
    later, else at ``end``, else a week later.
    """
    first = F.coalesce(start, today)
    last = F.coalesce(F.date_add(first, days), end, F.date_add(first, 7))
    return F.coalesce(F.date_sub(today, past_days), first), F.when(past_days.isNotNull(), today).otherwise(last)


def paged_union(pages: list[DataFrame], key: str) -> DataFrame:
    """The rows of pages in turn, with ``page`` from 1; of a key that several have, the first page's counts (and of one page the
    row that is least in all columns). A source that repeats a page adds nothing."""
    out = None
    for i, p in enumerate(pages):
        p = p.withColumn("page", F.lit(i + 1))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in (key, "page")]
    return out.groupBy(key).agg(F.min(F.struct("page", *rest)).alias("_r")).select(key, "_r.*")


def series_state(bars: DataFrame, asked: DataFrame, as_of: Column, stale: int = 5) -> DataFrame:
    """Of each asked ticker: first and last session, n and state: live, ended (the last bar is more than ``stale`` days before
    ``as_of``) or missing. Asked tickers that are null don't count, repeated ones count once."""
    g = bars.groupBy("ticker").agg(F.min("session").alias("first"), F.max("session").alias("last"), F.count(F.lit(1)).alias("n"))
    d = asked.where("ticker is not null").select("ticker").distinct().join(g, "ticker", "left").withColumn("_at", as_of)
    state = F.when(F.col("last").isNull(), "missing").when(F.datediff("_at", "last") > stale, "ended").otherwise("live")
    return d.select("ticker", "first", "last", F.coalesce("n", F.lit(0)).alias("n"), state.alias("state"))


def html_rows(html: Column, columns: list[str]) -> Column:
    """The body rows of a page's first table that has all ``columns`` in its head (letter case doesn't count), as an array of
    structs by those names; null if there is none. Cells are read as text."""
    text = lambda cell: F.trim(F.regexp_replace(F.regexp_replace(cell, r"(?s)<[^>]+>", ""), "&amp;", "&"))
    cells = lambda row: F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), 1), text)
    tables = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), 1), lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1), cells))
    head = lambda t: F.transform(F.get(t, F.lit(0)), F.lower)
    has = lambda t: F.size(F.array_intersect(head(t), F.array(*[F.lit(c.lower()) for c in columns]))) == len(columns)
    table = F.get(F.filter(tables, lambda t: F.coalesce(has(t), F.lit(False))), F.lit(0))
    place = [F.array_position(head(table), c.lower()).cast("int") - 1 for c in columns]
    body = F.filter(F.slice(table, 2, F.greatest(F.size(table) - 1, F.lit(0))), lambda r: F.size(r) > 0)
    return F.transform(body, lambda r: F.struct(*[F.get(r, p).alias(c) for p, c in zip(place, columns)]))


def retained(ledger: DataFrame, day: str, run: str, since: Column) -> DataFrame:
    """One row on what a retention rule drops: rows and runs dropped and kept. Rows without a day are kept."""
    gone = F.coalesce(F.col(day) < since, F.lit(False))
    n = lambda c: F.count(F.when(c, 1))
    runs = ledger.groupBy(run).agg(n(gone).alias("_gone"), n(~gone).alias("_kept"))
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return runs.agg(s("_gone").alias("rows_dropped"), n(F.col("_kept") == 0).alias("runs_dropped"), s("_kept").alias("rows_kept"), n(F.col("_kept") > 0).alias("runs_kept"))


def changes_since(events: DataFrame, key: str, at: str, kind: str, now: Column, days: int) -> DataFrame:
    """By key: how many events of each kind (up, down, init, main, reit) there were in the last ``days``, all of them, and the
    latest event's time and kind (the least of those at one time)."""
    recent = F.col(at) >= now - F.make_interval(days=F.lit(days))
    n = lambda k: F.count(F.when(recent & (F.col(kind) == k), 1)).alias(f"n_{k}")
    last = F.max(F.struct(F.col(at).alias("at")))["at"]
    g = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key)
    return g.agg(*[n(k) for k in ("up", "down", "init", "main", "reit")], F.count(F.when(recent, 1)).alias("n_recent"), last.alias("latest_at"), F.min_by(kind, F.struct(-F.unix_micros(F.col(at).cast("timestamp")), F.col(kind))).alias("latest_kind"))


def slot_choices(slots: DataFrame, key: str, slot: str, choice: str, price: str, most: int) -> DataFrame:
    """The ``most`` cheapest ways to fill all slots of each key with one choice each: key, picks (slot=choice), price.

    A key's slots are folded one after another; after each only the ``most`` cheapest partial ways stay, which no later slot
    can make wrong, as prices add up. Ties go to the smaller picks. Keys with a null slot or price there lose those choices.
    """
    d = slots.where(F.col(key).isNotNull() & F.col(slot).isNotNull() & F.col(price).isNotNull())
    w = Window.partitionBy(key, slot).orderBy(price, choice)
    d = d.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most)  # a dearer choice of a slot is in none of the cheapest
    own = d.groupBy(key, slot).agg(F.array_sort(F.collect_list(F.struct(F.col(price).cast("double").alias("price"), F.concat_ws("=", slot, choice).alias("pick")))).alias("_o"))
    own = own.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(slot).alias("s"), F.col("_o").alias("o")))).alias("_slots"))
    start = F.array(F.struct(F.lit(0.0).alias("price"), F.lit("").alias("picks")))
    fold = lambda ways, s: F.slice(
        F.array_sort(F.flatten(F.transform(ways, lambda way: F.transform(s["o"], lambda o: F.struct((way["price"] + o["price"]).alias("price"), F.ltrim(F.concat_ws(" ", way["picks"], o["pick"])).alias("picks")))))), 1, most
    )
    return own.select(key, F.inline(F.aggregate("_slots", start, fold)))
