"""Timestamps in many written forms to one UTC instant or one local date.

An ordered cascade of anchored patterns: the first that matches the whole trimmed text reads it, strictly. All of it is
built-in expressions on zone-less values, so the session's time zone plays no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import once

#: Hours from UTC of the zone abbreviations read.
ZONE_HOURS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
    "BST": 1, "WEST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "IST": 5.5, "HKT": 8, "JST": 9, "AEST": 10, "AEDT": 11, "BRT": -3,
}
#: Month abbreviations in order.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")

_ZONE = r"(?: ?(Z|[A-Z]{2,4}|[+-]\d{2}:?\d{2}|\[[A-Za-z_]+(?:/[A-Za-z_+-]+)*\]))?"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_MONTH = r"(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)"
_MONTH_LONG = r"(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)(?:UARY|RUARY|CH|IL|E|Y|UST|T|TEMBER|OBER|EMBER)?"
_WEEKDAY = r"(?:(MON|TUE|WED|THU|FRI|SAT|SUN)(?:DAY|SDAY|NESDAY|RSDAY|URDAY)?,? )?"


@dataclass(frozen=True)
class Pattern:
    """An anchored form; ``groups`` names what each regex group holds. p and q: a slashed date's first two numbers."""

    name: str
    regex: str
    groups: tuple[str, ...]


#: In order of trial; no text matches two of them except where an earlier one is meant to win.
CASCADE = (
    Pattern("year first", rf"^(\d{{4}})[-](\d{{1,2}})[-](\d{{1,2}})(?:[T ]{_TIME}{_ZONE})?$", ("y", "mo", "d", "h", "mi", "s", "f", "z")),
    Pattern("year first, slashed", rf"^(\d{{4}})[/](\d{{1,2}})[/](\d{{1,2}})(?:[T ]{_TIME}{_ZONE})?$", ("y", "mo", "d", "h", "mi", "s", "f", "z")),
    Pattern("compact", r"^(\d{4})(\d{2})(\d{2})(?:T(\d{2})(\d{2})(\d{2})(?:[.,](\d{1,9}))?(Z|[+-]\d{2}:?\d{2})?)?$", ("y", "mo", "d", "h", "mi", "s", "f", "z")),
    Pattern("day month-name", rf"(?i)^{_WEEKDAY}(\d{{1,2}})[ -]{_MONTH_LONG}[ -](\d{{4}}|\d{{2}})(?: {_TIME}{_ZONE})?$", ("wd", "d", "mon", "y", "h", "mi", "s", "f", "z")),
    Pattern("month-name day", rf"(?i)^{_WEEKDAY}{_MONTH_LONG} (\d{{1,2}}), (\d{{4}})(?: {_TIME}(?: ?(AM|PM))?{_ZONE})?$", ("wd", "mon", "d", "y", "h", "mi", "s", "f", "ap", "z")),
    Pattern("slashed", rf"(?i)^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}})(?: {_TIME}(?: ?(AM|PM))?{_ZONE})?$", ("p", "q", "y", "h", "mi", "s", "f", "ap", "z")),
    Pattern("dotted", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}})(?: {_TIME}{_ZONE})?$", ("d", "mo", "y", "h", "mi", "s", "f", "z")),
    Pattern("epoch seconds", r"^(\d{9,10})(?:\.(\d{1,9}))?$", ("e", "f")),
    Pattern("epoch milliseconds", r"^(\d{10})(\d{3})$", ("e", "f")),
    Pattern("epoch microseconds", r"^(\d{10})(\d{6})$", ("e", "f")),
    Pattern("epoch nanoseconds", r"^(\d{10})(\d{9})$", ("e", "f")),
)
_PARTS = ("y", "mo", "mon", "d", "p", "q", "h", "mi", "s", "f", "ap", "z", "wd", "e")


def _read(text: Column, cascade: tuple[Pattern, ...]) -> Column:
    """The parts of the first pattern that matches, as an array in the order of _PARTS; a match fills all of them at once."""

    def parts(p: Pattern) -> Column:
        at = {g: i + 1 for i, g in enumerate(p.groups)}
        return F.split(F.regexp_replace(text, p.regex, "\x01".join(f"${at[g]}" if g in at else "" for g in _PARTS)), "\x01", -1)

    return F.coalesce(*[F.when(text.rlike(p.regex), parts(p)) for p in cascade])


def _utc(local: Column, zone: Column) -> Column:
    """A local time of a named zone as a UTC one: the first of two equal local times, and a skipped one moved on by the gap."""
    return F.convert_timezone(zone, F.lit("UTC"), local)


def _regions(df: DataFrame) -> list[str]:
    """The zone names that the JVM knows, some 600; another name would fail the job."""
    return sorted(df.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds().toArray())


def normalise_times(df: DataFrame, text: str, zone: str = "zone", day_first: str = "day_first", out: str = "at", cascade: tuple[Pattern, ...] = CASCADE) -> DataFrame:
    """Add struct ``out`` of ``instant`` (timestamp_ntz in UTC), ``day`` (the date written, where no time of day is) and
    ``midnight`` (the instant at which that day begins in the source's zone). A column called ``out`` gives way.

    ``zone`` and ``day_first`` name columns with the source's defaults, such as with_source() adds. All fields are null
    for null, blank and unreadable texts, impossible dates and times, weekdays that don't fit, unknown zones, texts
    without a zone whose source has none, and slashed dates that need a missing day_first. Digits finer than a microsecond are cut.
    A date without time of day gives no ``instant``.
    """
    t, z0 = F.col("_t"), F.col("_zone")
    # The rows travel as one struct, so that no column of theirs can clash with those made here.
    rows = [c for c in df.columns if c != out]
    d = df.select(F.struct(*rows).alias("_row"), F.col(zone).alias("_zone"), F.col(day_first).alias("_first"), F.regexp_replace(F.col(text), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "").alias("_text"))
    d = once(d, _t=F.col("_text"))
    d = once(d, _x=_read(t, cascade))
    d = once(d, **{f"_x_{g}": F.nullif(F.get("_x", F.lit(i)), F.lit("")) for i, g in enumerate(_PARTS)})
    x = lambda k: F.col(f"_x_{k}")
    n = lambda k: x(k).cast("int")
    year = F.when(F.length(x("y")) == 2, n("y") + 2000).otherwise(n("y"))
    mon = F.array_position(F.array(*map(F.lit, MONTHS)), F.upper(x("mon"))).cast("int")
    first = F.when(F.col("_first"), n("q")).when(~F.col("_first"), n("p"))
    second = F.when(F.col("_first"), n("p")).when(~F.col("_first"), n("q"))
    month, dom = F.coalesce(n("mo"), mon, first), F.coalesce(n("d"), second)
    hour = F.when(x("ap").isNull(), n("h")).when((n("h") >= 1) & (n("h") <= 12), n("h") % 12 + F.when(F.upper(x("ap")) == "PM", 12).otherwise(0))
    micros = F.rpad(F.substring(F.coalesce(x("f"), F.lit("0")), 1, 6), 6, "0").cast("int")
    second_ = F.coalesce(n("s"), F.lit(0))
    d = once(
        d,
        _d=F.when((year >= 1) & month.between(1, 12) & dom.between(1, 31), F.format_string("%04d-%02d-%02d", year, month, dom)),
        _h=hour,
        _s=second_,
        _us=micros,
    )
    day = F.expr("try_cast(_d as date)")
    d = once(d, _day=F.when(x("wd").isNull() | (F.upper(F.date_format(day, "EEE")) == F.upper(x("wd"))), day))
    fine = F.col("_day").isNotNull() & F.col("_h").between(0, 23) & n("mi").between(0, 59) & F.col("_s").between(0, 59)
    local = F.expr("cast(_day as timestamp_ntz) + make_dt_interval(0, _h, cast(_x_mi as int), _s + cast(_us as decimal(10,0)) * cast(0.000001 as decimal(7,6)))")
    offset = F.regexp_replace(x("z"), ":", "")
    sign = F.when(offset.startswith("-"), -1).otherwise(1)
    minutes = F.when(
        offset.rlike(r"^[+-]\d{4}$") & (F.substring(offset, 2, 2).cast("int") <= 18) & (F.substring(offset, 4, 2).cast("int") <= 59),
        sign * (F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, 4, 2).cast("int")),
    )
    named = F.create_map(*[F.lit(v) for name, h in ZONE_HOURS.items() for v in (name, int(h * 60))])
    minutes = F.coalesce(minutes, F.try_element_at(named, F.upper(x("z"))))
    region = F.when(x("z").isNull(), z0).when(x("z").startswith("["), F.expr("substring(_x_z, 2, length(_x_z) - 2)"))
    region = F.when(region.isin(*_regions(df)), region)
    d = once(d, _local=F.when(fine, local), _min=minutes, _region=region)
    at_offset = F.expr("_local - make_dt_interval(0, 0, _min, 0)")
    epoch = F.expr("timestamp_ntz '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(_x_e as decimal(12,0)) + cast(_us as decimal(10,0)) * cast(0.000001 as decimal(7,6)))")
    instant = F.when(x("e").isNotNull(), epoch).when(F.col("_min").isNotNull(), at_offset).when(F.col("_region").isNotNull(), _utc(F.col("_local"), F.col("_region")))
    d = once(d, _at=instant, _only=F.when(x("h").isNull() & x("e").isNull(), F.col("_day")))
    midnight = F.when(F.col("_region").isNotNull(), _utc(F.col("_only").cast("timestamp_ntz"), F.col("_region")))
    return d.select("_row.*", F.struct(F.col("_at").alias("instant"), F.col("_only").alias("day"), midnight.alias("midnight")).alias(out))


def with_source(df: DataFrame, sources: DataFrame, key: str = "source") -> DataFrame:
    """Add ``zone`` and ``day_first`` of each row's source; null where the source is null or unknown. Columns of these
    names give way."""
    df = df.drop("zone", "day_first", "_src")
    side = sources.select(F.col(key).alias("_src"), "zone", "day_first").where("_src is not null").dropDuplicates(["_src"])
    return df.join(side, df[key] == F.col("_src"), "left").drop("_src")


def instant_text(at: str = "at") -> Column:
    """The instant as yyyy-MM-ddTHH:mm:ss.SSSSSSZ in UTC; a date alone means its midnight in the source's zone."""
    return F.date_format(F.coalesce(F.col(f"{at}.instant"), F.col(f"{at}.midnight")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def day_text(at: str = "at", zone: str = "America/New_York") -> Column:
    """The date written, or of a value with a time of day the date of its instant in ``zone``."""
    there = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(f"{at}.instant")).cast("date")
    return F.date_format(F.coalesce(F.col(f"{at}.day"), there), "yyyy-MM-dd")
