"""Ledgers: reading their files, and appending, replacing and upserting rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.calendar import et_day


def read_csv(spark: SparkSession, path: str, schema: str, comment: str | None = None) -> DataFrame:
    """A ledger's CSV by column name; columns that the file lacks are null, others are left out, bad values are null."""
    options = {"header": True, "mode": "PERMISSIVE"} | ({"comment": comment} if comment else {})
    raw = spark.read.options(**options).csv(path)
    want = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return raw.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in want])


def read_json_runs(spark: SparkSession, path: str, schema: str, required: list[str], enums: dict[str, list[str]], lines: bool = False) -> DataFrame:
    """One JSON document a file, or with ``lines`` a line, with ``problems``: missing required fields, values outside their enum, broken files."""
    d = spark.read.schema(schema + ", _corrupt_record string").option("multiLine", not lines).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    checks = [F.when(F.col("_corrupt_record").isNotNull(), "not a JSON document")]
    checks += [F.when(F.col("_corrupt_record").isNull() & F.col(c).isNull(), f"{c} is missing") for c in required]
    checks += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*v), F.concat(F.lit(f"{c} is "), F.col(c))) for c, v in enums.items()]
    return d.select("*", F.array_compact(F.array(*checks)).alias("problems")).drop("_corrupt_record")


def read_feed(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Items of RSS or Atom files."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def recent_items(items: DataFrame, title: str, date: str, hours: int) -> DataFrame:
    """The newest item of each title with its time ``at`` (UTC), of the last ``hours`` before the newest of all. Dates are
    RFC 822 (with GMT, UT, Z, a zone of North America or an offset); items without a readable one don't count."""
    #: The zones that RFC 822 names, in hours from UTC.
    zones = {"GMT": "+0000", "UT": "+0000", "UTC": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}
    bare = F.regexp_replace(F.trim(date), r"^[A-Za-z]{3},\s*", "")
    zone = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in zones.items() for x in pair]), F.upper(F.regexp_extract(bare, r"([A-Za-z]+)$", 1))), F.nullif(F.regexp_extract(bare, r"([+-]\d{4})$", 1), F.lit("")))
    local = F.try_to_timestamp(F.regexp_extract(bare, r"^(\d{1,2} [A-Za-z]{3} \d{4} \d\d:\d\d:\d\d)", 1), F.lit("d MMM yyyy HH:mm:ss"))
    minutes = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1) * (F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, 4, 2).cast("int"))
    d = items.withColumn("at", local.cast("timestamp_ntz") - F.make_dt_interval(mins=minutes)).where("at is not null")
    d = d.withColumn("_newest", d.agg(F.max("at")).scalar()).where(F.col("at") > F.col("_newest") - F.make_dt_interval(hours=F.lit(hours)))
    return d.groupBy(title).agg(F.max("at").alias("at"))


def append_by_day(existing: DataFrame, incoming: DataFrame, run_date: str = "run_date", allow_same_day: bool = False) -> DataFrame:
    """existing with incoming: rows of a New York date that incoming has are replaced, whatever their time.

    Columns that one side lacks are null there and trail. An empty incoming changes nothing. With allow_same_day both
    stay. The dates of incoming are few, so they are a broadcast semi-join's side.
    """
    if not allow_same_day:
        days = incoming.select(et_day(run_date).alias("_day")).distinct()
        existing = existing.withColumn("_day", et_day(run_date)).join(days, "_day", "left_anti").drop("_day")
    return existing.unionByName(incoming, allowMissingColumns=True)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """existing with incoming, whose rows replace those of equal keys; incoming should have a key once. Twice is once."""
    return existing.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming, allowMissingColumns=True)


def publish(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Write df as parquet: beside the old files and then in their place, or by dynamic overwrite of its partitions."""
    spark = df.sparkSession
    if partition:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        return
    new = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(new)
    jvm = spark.sparkContext._jvm
    old, fresh = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(new)
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # The old files stay until the new ones are in their place: a failure in between leaves one of the two whole.
    aside = jvm.org.apache.hadoop.fs.Path(f"{new}.old")
    had = fs.exists(old) and fs.rename(old, aside)
    if not fs.rename(fresh, old):
        if had:
            fs.rename(aside, old)
        raise OSError(f"can't put {new} in the place of {path}")
    if had:
        fs.delete(aside, True)


def write_records(tables: dict[str, DataFrame], path: str, form: str = "csv") -> None:
    """Several record lists as one file set, a row a record, with ``record_class`` and the union of their columns."""
    out = None
    for name, df in tables.items():
        df = df.withColumn("record_class", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    writer = out.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.json(path)
