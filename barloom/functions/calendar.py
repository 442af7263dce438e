"""Exchange days: holidays by rule, special days and the phase of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar (Meeus' rule, whole-number steps)."""
    div = lambda a, b: F.floor(a / b)
    a, b, c = year % 19, div(year, 100), year % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    m = div(a + 11 * h + 22 * k, 451)
    n = h + k - 7 * m + 114
    return F.make_date(year, div(n, 31).cast("int"), (n % 31 + 1).cast("int"))


def nearest_workday(day: Column) -> Column:
    return F.when(F.weekday(day) == 5, F.date_sub(day, 1)).when(F.weekday(day) == 6, F.date_add(day, 1)).otherwise(day)


def nth_weekday(year: Column, month: int, name: str, n: int) -> Column:
    return F.date_add(F.next_day(F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1), name), 7 * (n - 1))


def holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """day, holiday of the New York exchange's ten regular holidays, as observed. New Year on a Saturday isn't observed."""
    y = F.col("y")
    fixed = lambda m, d: F.make_date(y, F.lit(m), F.lit(d))
    new_year = F.when(F.weekday(fixed(1, 1)) == 6, fixed(1, 2)).when(F.weekday(fixed(1, 1)) != 5, fixed(1, 1))
    rules = {
        "new year": new_year,
        "king": nth_weekday(y, 1, "MON", 3),
        "presidents": nth_weekday(y, 2, "MON", 3),
        "good friday": F.date_sub(easter(y), 2),
        "memorial": F.date_sub(F.next_day(F.make_date(y, F.lit(5), F.lit(31)), "MON"), 7),
        "juneteenth": F.when(y >= 2022, nearest_workday(fixed(6, 19))),
        "independence": nearest_workday(fixed(7, 4)),
        "labor": nth_weekday(y, 9, "MON", 1),
        "thanksgiving": nth_weekday(y, 11, "THU", 4),
        "christmas": nearest_workday(fixed(12, 25)),
    }
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("y"))
    return years.select(F.explode(F.array(*[F.struct(d.alias("day"), F.lit(n).alias("holiday")) for n, d in rules.items()])).alias("x")).select("x.*").where("day is not null")


def trading_days(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """day, third_friday, witching, month_end, quarter_end of each trading day. The third Friday moves before a holiday."""
    span = spark.sql(f"select explode(sequence(date'{first_year}-01-01', date'{last_year}-12-31')) as day").where("weekday(day) < 5")
    days = span.join(F.broadcast(holidays(spark, first_year, last_year).select("day")), "day", "left_anti")
    third = F.date_add(F.next_day(F.date_sub(F.trunc("day", "month"), 1), "FRI"), 14)
    w = Window.partitionBy(F.trunc("day", "month"))
    is_third = F.col("day") == F.max(F.when(F.col("day") <= third, F.col("day"))).over(w)
    month_end = F.col("day") == F.max("day").over(w)
    return days.select("day", is_third.alias("third_friday"), (is_third & (F.month("day") % 3 == 0)).alias("witching"), month_end.alias("month_end"), (month_end & (F.month("day") % 3 == 0)).alias("quarter_end"))


def session_phase(minutes: Column) -> Column:
    """Phase of the New York day by minutes since midnight."""
    return F.when(minutes < 240, "overnight").when(minutes < 480, "pre-dawn").when(minutes < 570, "pre-open").when(minutes < 960, "intraday").when(minutes < 1200, "after-hours").otherwise("overnight")


def et_day(at: str) -> Column:
    """The New York date of a UTC instant."""
    return F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col(at)).cast("date")
