"""Versions of slowly changing attributes, from insert-only satellites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.neighbours import neighbours
from barloom.session import materialize


def plain(value: Column, unknown: tuple[str, ...] = ("?",)) -> Column:
    """A value without letter case and white space; null for null, blank and the texts of ``unknown``."""
    bare = F.lower(F.regexp_replace(value, r"[\s\p{Z}]+", ""))
    return F.when((bare != "") & ~bare.isin(*unknown), bare)


def satellite(updates: DataFrame, key: str, at: str, attribute: str, segment: Column) -> DataFrame:
    """The insert-only satellite of one attribute: key, at, value, hash_diff, a row only where the hash changes.

    Rows whose attribute is null (unknown) append nothing, so the last known value holds.
    """
    known = updates.where(F.col(attribute).isNotNull()).select(key, at, F.col(attribute).alias("value"), F.xxhash64(attribute).alias("hash_diff"))
    seen = neighbours(known, [key], [at], segment, lag={"_before": "hash_diff"})
    return seen.where(~F.col("hash_diff").eqNullSafe(F.col("_before"))).select(key, at, "value", "hash_diff")


def versions(updates: DataFrame, key: str, at: str, write: str, attributes: list[str], segment: int, unknown: tuple[str, ...] = ("?",)) -> DataFrame:
    """Versions of (attributes...) by key: key, valid_from, valid_to (exclusive, -1 for the current one).

    Of rows with equal key and ``at`` the one with the greatest ``write`` counts. An unknown value (null, blank, or in
    ``unknown``) leaves the last known one; case and white space don't tell values apart. A key has versions from its
    first known value on; keys that never have one, and rows whose key or ``at`` is null, give none. ``at`` is a number
    and a key is worked on in pieces of ``segment`` of it.
    """
    return _periods(_satellites(updates, key, at, write, attributes, segment, unknown), key, at, segment)


def _satellites(updates: DataFrame, key: str, at: str, write: str, attributes: list[str], segment: int, unknown: tuple[str, ...]) -> dict[str, DataFrame]:
    """The satellite of each attribute. The counting rows are written once and read for each of them."""
    rows = updates.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    last = rows.groupBy(key, at).agg(F.max_by(F.struct(*[plain(F.col(a), unknown).alias(a) for a in attributes]), F.col(write)).alias("_v"))
    last = materialize(last.select(key, at, *[F.col(f"_v.{a}").alias(a) for a in attributes]), "updates")
    return {a: materialize(satellite(last, key, at, a, F.floor(F.col(at) / F.lit(segment))), "satellite") for a in attributes}


def _periods(satellites: dict[str, DataFrame], key: str, at: str, segment: int) -> DataFrame:
    """The lead-based view over satellites: a period from each change of any of them to the next."""
    piece = F.floor(F.col(at) / F.lit(segment))
    starts = materialize(reduce(DataFrame.unionByName, [s.select(key, at) for s in satellites.values()]).distinct(), "starts")
    ends = neighbours(starts, [key], [at], piece, lead={"_next": at})
    return ends.select(key, F.col(at).alias("valid_from"), F.coalesce("_next", F.lit(-1).cast("long")).alias("valid_to"))


def attribute_history(updates: DataFrame, key: str, at: str, write: str, attributes: list[str], segment: int, unknown: tuple[str, ...] = ("?",)) -> DataFrame:
    """versions() with the value of each attribute in each period, in its plain spelling; null until first known."""
    satellites = _satellites(updates, key, at, write, attributes, segment, unknown)
    none = F.lit(None).cast("string")
    changes = [s.select(key, at, *[(F.col("value") if b == a else none).alias(f"_{b}") for b in attributes]) for a, s in satellites.items()]
    # One row for each time at which any satellite has one; what the others held until then is carried along.
    starts = reduce(DataFrame.unionByName, changes).groupBy(key, at).agg(*[F.max(f"_{a}").alias(f"_{a}") for a in attributes])
    starts = materialize(starts, "starts")
    out = neighbours(starts, [key], [at], F.floor(F.col(at) / F.lit(segment)), lead={"_next": at}, carry={a: f"_{a}" for a in attributes})
    return out.select(key, F.col(at).alias("valid_from"), F.coalesce("_next", F.lit(-1).cast("long")).alias("valid_to"), *attributes)
