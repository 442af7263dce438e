"""Ingestion of records whose fields drift, with a rescue column, and the report of every change between files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import once
from barloom.session import materialize

#: The target of base-breakout history: field and kind.
BASE_HISTORY = {
    "run_id": "string", "ticker": "string", "rank": "integer", "base_score": "number", "signal": "string", "pivot_price": "number",
    "close": "number", "score_rank": "integer", "vcp_ratio": "number", "vcp_is_vcp": "boolean", "atr": "number",
}
_SQL = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}
#: Texts read as booleans when a rescued value is replayed.
TRUE, FALSE = ("true", "yes", "y", "1", "1.0"), ("false", "no", "n", "0", "0.0")


def _is(name: str, kind: str | None = None) -> Callable[[Column], Column]:
    return lambda x: (x["key"] == name) & (F.lit(True) if kind is None else x["kind"] == kind)


def _unless(name: str, cast: Column) -> Callable[[Column], Column]:
    """Entries of other fields, and of this one where it has a value that couldn't be cast."""
    return lambda x: (x["key"] != name) | (cast.isNull() & (x["value"] != "null"))


def _kind(t: Column) -> Column:
    """boolean, integer, number, string or other of a variant by its schema; null for JSON null."""
    return F.when(t == "VOID", F.lit(None)).when(t == "BOOLEAN", "boolean").when(t == "BIGINT", "integer").when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "number").when(t == "STRING", "string").otherwise("other")


def comparable(text: Column) -> Column:
    """A scalar's text in a form that doesn't depend on its type: 2, 2.0, "2" and " 2,0" are equal, as are true, "Y" and 1."""
    bare = F.lower(F.trim(text))
    number = F.regexp_replace(bare, ",", ".").try_cast("double")
    return F.when(bare.isin(*TRUE), F.lit("1.0")).when(bare.isin(*FALSE), F.lit("0.0")).when(number.isNotNull(), number.cast("string")).otherwise(F.trim(text))


def _json(x: Column) -> Column:
    """A variant's JSON; a number with a decimal point keeps one."""
    text = F.to_json(x["value"])
    return F.when((x["kind"] == "number") & text.rlike(r"^-?\d+$"), F.concat(text, F.lit(".0"))).otherwise(text)


def ingest(records: DataFrame, payload: str, target: dict[str, str]) -> DataFrame:
    """Enforce ``target`` on JSON records: its typed columns, ``_rescued``, ``_keys`` and ``_kinds``, beside the columns of
    records.

    A value that has exactly its field's kind goes into the typed column. Anything else, be it an unknown field, another
    kind, even a castable one, or a nested value, stays in ``_rescued``, a map from the field to its JSON. ``_keys`` has
    the record's fields, so a missing one and a null differ, and ``_kinds`` their kinds (key, kind; null for a null). A payload that is null or no JSON object has null columns,
    an empty ``_rescued``, ``_keys`` and ``_kinds``, and true in ``_corrupt``. Columns of records named like a target field give way
    to the typed one.
    """
    kept = [c for c in records.columns if c not in target and c not in ("_rescued", "_keys", "_kinds", "_corrupt", payload)]
    d = once(records.select(*kept, payload), _map=F.from_json(payload, "map<string,variant>", {"mode": "PERMISSIVE"}))
    # In two steps, as an expression used many times in a lambda is worked out as often.
    schemas = F.transform(F.map_entries("_map"), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"), F.schema_of_variant(x["value"]).alias("t")))
    kinds = F.transform(schemas, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"), _kind(x["t"]).alias("kind")))
    d = once(d, _entries=F.coalesce(kinds, F.array().cast("array<struct<key:string,value:variant,kind:string>>")))
    d = once(d, _kind_of=F.map_from_entries(F.array_distinct(F.transform("_entries", lambda x: F.struct(x["key"], x["kind"])))))
    wanted = F.create_map(*[F.lit(x) for pair in target.items() for x in pair])
    stays = lambda x: x["kind"].isNotNull() & ~x["kind"].eqNullSafe(F.try_element_at(wanted, x["key"]))
    unknown = lambda x: ~x["key"].isin(*target)
    json = F.transform(F.filter("_entries", lambda x: stays(x) | unknown(x)), lambda x: F.struct(x["key"].alias("key"), _json(x).alias("value")))
    typed = []
    for name, kind in target.items():
        own = F.try_element_at("_map", F.lit(name))
        typed.append(F.when(F.try_element_at("_kind_of", F.lit(name)) == kind, F.try_variant_get(own, "$", _SQL[kind])).alias(name))
    return d.select(
        *kept,
        *typed,
        F.map_from_entries(F.array_distinct(json)).alias("_rescued"),
        F.array_distinct(F.transform("_entries", lambda x: x["key"])).alias("_keys"),
        F.array_distinct(F.transform("_entries", lambda x: F.struct(x["key"].alias("key"), x["kind"].alias("kind")))).alias("_kinds"),
        (F.size("_entries") == 0).alias("_corrupt"),
    )


def observations(ingested: DataFrame, target: dict[str, str], by: list[str], fields: str) -> DataFrame:
    """A row for each of the ``fields`` (an array column) that an ingested record has: by..., field, text. From typed columns
    and rescued values; text is null where the value is."""
    texts = F.create_map(*[x for f in target for x in (F.lit(f), F.col(f).cast("string"))])
    d = once(ingested.select(*dict.fromkeys([*by, fields, "_rescued", "_keys", *target])), _texts=texts)
    # The maps of a record stay behind: only each field's own values go into its row.
    own = F.transform(F.array_intersect("_keys", fields), lambda k: F.struct(k.alias("field"), F.try_element_at("_rescued", k).alias("_json"), F.try_element_at("_texts", k).alias("_typed")))
    d = d.select(*by, F.inline(own))
    json, typed = F.col("_json"), F.col("_typed")
    text = F.when(json.isNull(), typed).when(json == "null", None).when(F.substring(json, 1, 1) == '"', F.variant_get(F.try_parse_json(json), "$", "string")).otherwise(json)
    return d.select(*by, "field", text.alias("text"))


FILE = ["ledger_id", "file_no"]


def file_changes(records: DataFrame, target: dict[str, str] = BASE_HISTORY, payload: str = "payload", agree: float = 0.9, record_key: tuple[str, ...] = ("run_id", "ticker")) -> DataFrame:
    """Every change between a ledger's successive files: ledger_id, file_no, change, field, new_name.

    ``added`` and ``removed``: the field is only in this file or only in the one before. ``renamed``: a removed field's
    values go on under an added name: among the records that both files have (the repeated run; records are told apart by
    ``record_key``, fields whose letter case doesn't count), at least ``agree`` of the values compared are equal whatever
    their type, and nulls fall on the same records; each name takes part in one rename at most, the best first.
    ``retyped``: a field carried on, under either name, whose type differs from its last known one; a file's type is that
    of most of its non-null values, and a file without any keeps the last known type.

    Records that are null or no JSON object, or have a null ledger_id or file_no, say nothing; repeated records count as
    often as they come, which no share depends on. The first file of a ledger has no changes. Files with equal numbers
    are one file.
    """
    return _report(_ingested(records, target, payload), target, agree, record_key)


def _ingested(records: DataFrame, target: dict[str, str], payload: str, *more: str) -> DataFrame:
    """The ingested records, written once: each payload is parsed a single time."""
    rows = records.where("ledger_id is not null and file_no is not null").select("ledger_id", F.col("file_no").cast("long").alias("file_no"), *more, payload)
    return materialize(ingest(rows.distinct() if more else rows, payload, target), "ingested")


def _report(ingested: DataFrame, target: dict[str, str], agree: float, record_key: tuple[str, ...]) -> DataFrame:
    """file_changes() of ingested records. Kinds are counted by file and field in each task first; then a file is one row,
    with the types of its fields and of those of the file before it."""
    kinds = ("boolean", "integer", "number", "string", "other")
    per = ingested.select(*FILE, F.inline("_kinds")).groupBy(*FILE, "key").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in kinds])
    most = F.greatest(*[F.struct(F.col(k).alias("n"), F.lit(k).alias("k")) for k in kinds])
    types = per.groupBy(*FILE).agg(F.map_from_entries(F.collect_list(F.struct("key", F.when(most["n"] > 0, most["k"])))).alias("now"))  # a file's fields
    w = Window.partitionBy("ledger_id").orderBy("file_no")  # a row for each file of a ledger
    files = types.withColumn("before", F.lag("file_no").over(w)).withColumn("old", F.lag("now").over(w)).where("before is not null")
    names = lambda c: F.map_keys(c)
    files = files.withColumn("added", F.array_except(names("now"), names("old"))).withColumn("removed", F.array_except(names("old"), names("now")))
    files = materialize(files, "files")
    renamed = materialize(_renames(ingested, files, target, agree, record_key), "renames")
    # Fields that go on, under either name, with their types here and in the file before.
    kept = files.select(*FILE, "before", F.explode(F.array_intersect(names("now"), names("old"))).alias("field"), "now", "old").withColumn("was", F.col("field"))
    moved = renamed.join(files.select(*FILE, "before", "now", "old"), FILE).withColumnsRenamed({"field": "was", "new_name": "field"})
    cols = [*FILE, "before", "field", "was", F.try_element_at("now", F.col("field")).alias("type"), F.try_element_at("old", F.col("was")).alias("last")]
    links = materialize(kept.select(cols).unionByName(moved.select(cols)), "links")
    asks = links.where("type is not null and last is null")
    retyped = links.where("type <> last").unionByName(_with_last_known(asks, links.where("type is null")).where("type <> last"))
    changes = lambda d, change, field, new="": d.select(*FILE, F.lit(change).alias("change"), field, (F.col(new) if new else F.lit("")).alias("new_name"))
    by_file = renamed.groupBy(*FILE).agg(F.collect_list("field").alias("gone"), F.collect_list("new_name").alias("come"))
    rest = files.select(*FILE, "added", "removed").join(by_file, FILE, "left")
    rest = rest.select(*FILE, *[F.array_except(c, F.coalesce(x, F.array().cast("array<string>"))).alias(c) for c, x in (("added", "come"), ("removed", "gone"))])
    out = changes(rest.select(*FILE, F.explode("added").alias("field")), "added", "field")
    out = out.unionByName(changes(rest.select(*FILE, F.explode("removed").alias("field")), "removed", "field"))
    return out.unionByName(changes(renamed, "renamed", "field", "new_name")).unionByName(changes(retyped, "retyped", "field"))


def _renames(ingested: DataFrame, files: DataFrame, target: dict[str, str], agree: float, record_key: tuple[str, ...]) -> DataFrame:
    """ledger_id, file_no, field, new_name: the removed and added fields whose values agree on the records of both files. Only
    these fields of files that have both are taken out of the records."""
    some = files.where((F.size("added") > 0) & (F.size("removed") > 0)).select(*FILE, "before", "added", "removed")
    # A record's key may itself have drifted to another type; then it is among the rescued values.
    key = [f"_key{i}" for i in range(len(record_key))]
    own = [F.coalesce(F.col(c).cast("string") if c in target else F.lit(None).cast("string"), F.regexp_replace(F.try_element_at("_rescued", F.lit(c)), r'^"|"$', "")) for c in record_key]
    keyed = ingested.select("*", *[F.upper(F.trim(c)).alias(k) for k, c in zip(key, own)])
    for k in key:
        keyed = keyed.where(F.col(k).isNotNull())
    record = [*FILE, *key]
    value = comparable(F.col("text"))
    new = observations(keyed.join(some.select(*FILE, "added"), FILE), target, record, "added").select(*record, F.col("field").alias("new_name"), value.alias("_new")).distinct()
    was = keyed.withColumnRenamed("file_no", "before").join(some.select(*FILE, "before", "removed"), ["ledger_id", "before"])
    was = observations(was, target, record, "removed").select(*record, "field", value.alias("_old")).distinct()
    pairs = new.join(was, record).groupBy(*FILE, "field", "new_name").agg(
        F.count(F.when(F.col("_new") == F.col("_old"), 1)).alias("equal"),
        F.count(F.when(F.col("_new") != F.col("_old"), 1)).alias("unequal"),
        F.count(F.when(F.col("_new").isNull() & F.col("_old").isNull(), 1)).alias("nulls"),
        F.count(F.when(F.col("_new").isNull() != F.col("_old").isNull(), 1)).alias("one_null"),
    )
    share = F.col("equal") / (F.col("equal") + F.col("unequal") + F.col("one_null"))
    pairs = pairs.where(F.col("equal") > 0).withColumn("_share", share).where(F.col("_share") >= agree)
    # Each name once: pairs that are the best of both their names, a file's fields being few.
    best = [F.col("_share").desc(), F.col("equal").desc(), F.col("nulls").desc(), "field", "new_name"]
    pairs = pairs.withColumn("_a", F.row_number().over(Window.partitionBy(*FILE, "field").orderBy(*best))).withColumn("_b", F.row_number().over(Window.partitionBy(*FILE, "new_name").orderBy(*best)))
    return pairs.where("_a = 1 and _b = 1").select(*FILE, "field", "new_name")


def _with_last_known(asks: DataFrame, unknown: DataFrame) -> DataFrame:
    """Links whose earlier field has no type in its file, with the type it last had in ``last``; without them where it never had
    one. ``unknown`` are the links of fields without a type: they are followed back by doubling pointers until none moves."""
    at = ["ledger_id", "before", "was"]
    front = unknown.select("ledger_id", F.col("file_no").alias("f"), F.col("field").alias("n"), "before", "was", "last")
    known = front.where("last is not null").select("ledger_id", "f", "n", "last")
    front = front.where("last is null").drop("last")
    done = known
    while not front.isEmpty():
        to = known.select("ledger_id", F.col("f").alias("before"), F.col("n").alias("was"), "last")
        onward = front.select("ledger_id", F.col("f").alias("before"), F.col("n").alias("was"), F.col("before").alias("pf"), F.col("was").alias("pn"))
        looked = materialize(front.join(to, at, "left").join(onward, at, "left"), "looked")
        found = looked.where("last is not null").select("ledger_id", "f", "n", "last")
        done = known = materialize(done.unionByName(found), "known")
        front = looked.where("last is null and pf is not null").select("ledger_id", "f", "n", F.col("pf").alias("before"), F.col("pn").alias("was"))
    return asks.drop("last").join(done.select("ledger_id", F.col("f").alias("before"), F.col("n").alias("was"), "last"), at)


def unified(records: DataFrame, target: dict[str, str] = BASE_HISTORY, payload: str = "payload", approved: tuple[str, ...] | None = None, record_key: tuple[str, ...] = ("run_id", "ticker")) -> DataFrame:
    """One table of all files: ledger_id, file_no, row_no, the typed columns and what remains in ``rescued`` (JSON text).

    Fields that files renamed are promoted: each later name that leads back to a target field through the report's
    renames takes that field's column (``approved`` limits the target fields that may be promoted). Rescued values are
    then replayed into the typed columns: numbers written as text, also with a decimal comma, and booleans in words.
    What still doesn't fit stays rescued, and its typed column null. Rows that are repeated whole are in it once.
    """
    d = _ingested(records, target, payload, "row_no")
    changes = materialize(_report(d, target, 0.9, record_key), "changes")
    names = _canonical(changes, d, target, approved)
    of = names.groupBy(*FILE).agg(F.map_from_entries(F.collect_list(F.struct("name", "canonical"))).alias("_names"))  # the few renamed fields of a file
    d = d.join(of, FILE, "left")
    renamed = F.transform(F.map_entries("_rescued"), lambda x: F.struct(F.coalesce(F.try_element_at("_names", x["key"]), x["key"]).alias("key"), x["value"].alias("value")))
    d = d.select("*", F.inline(F.array(F.struct(renamed.alias("_r"))))).drop("_names", "_rescued", "_keys", "_kinds", "_corrupt")
    typed, left = [], F.col("_r")
    for name, kind in target.items():
        raw = F.try_element_at(F.filter("_r", _is(name)), F.lit(1))["value"]
        text = F.regexp_replace(raw, r'^"|"$', "")
        word = F.lower(F.trim(text))
        if kind == "boolean":
            cast = F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False)
        elif kind == "string":
            cast = F.when(raw != "null", text)
        else:
            cast = F.regexp_replace(word, ",", ".").try_cast("double")
            cast = cast if kind == "number" else F.when(cast == F.floor(cast), cast.cast("bigint"))
        typed.append(F.coalesce(F.col(name), cast).alias(name))
        left = F.filter(left, _unless(name, cast))
    return d.select(*FILE, "row_no", *typed, F.when(F.size(left) > 0, F.to_json(F.map_from_entries(left))).alias("rescued"))


def _canonical(changes: DataFrame, records: DataFrame, target: dict[str, str], approved: tuple[str, ...] | None) -> DataFrame:
    """ledger_id, file_no, name, canonical: what each file's renamed fields are called in the target.

    A rename holds for its file and the later ones, up to the file in which the new name goes or is renamed again. A name
    that was renamed in turn is followed back to the target by doubling pointers.
    """
    renames = changes.where("change = 'renamed'").where(~F.col("new_name").isin(*target))
    ends = changes.where("change in ('removed', 'renamed')").select(F.col("ledger_id").alias("_l"), F.col("file_no").alias("_end"), F.col("field").alias("_name"))
    spans = renames.join(ends, (F.col("ledger_id") == F.col("_l")) & (F.col("new_name") == F.col("_name")) & (F.col("_end") > F.col("file_no")), "left")
    spans = spans.groupBy(*FILE, "field", "new_name").agg(F.min("_end").alias("_end")).withColumnRenamed("file_no", "_from")
    allowed = [t for t in target if approved is None or t in approved]
    spans = materialize(spans.withColumn("canonical", F.when(F.col("field").isin(*allowed), F.col("field"))), "spans")
    node = ["ledger_id", "_from", "name", "_end", "canonical"]
    step = spans.select("ledger_id", "_from", F.col("new_name").alias("name"), "_end", "canonical", F.col("_from").alias("pf"), F.col("field").alias("pn"))
    out, front = step.where("canonical is not null").select(node), step.where("canonical is null")
    # A span goes on from the one that ends where it starts, under the name it renames.
    while not front.isEmpty():
        ended = out.select(node).withColumns({"pf": F.lit(None).cast("long"), "pn": F.lit(None).cast("string")}).unionByName(front)
        ended = ended.select("ledger_id", F.col("_end").alias("pf"), F.col("name").alias("pn"), F.col("canonical").alias("_c"), F.col("pf").alias("qf"), F.col("pn").alias("qn"))
        looked = materialize(front.drop("canonical").join(ended, ["ledger_id", "pf", "pn"]), "looked")
        out = materialize(out.unionByName(looked.where("_c is not null").withColumnRenamed("_c", "canonical").select(node)), "names")
        front = looked.where("_c is null").select("ledger_id", "_from", "name", "_end", F.col("_c").alias("canonical"), F.col("qf").alias("pf"), F.col("qn").alias("pn"))
    last = records.groupBy("ledger_id").agg(F.max("file_no").alias("_last"))
    out = out.join(last, "ledger_id").withColumn("_until", F.coalesce(F.col("_end") - 1, F.col("_last")))
    return out.select("ledger_id", F.explode(F.sequence("_from", F.greatest("_from", "_until"))).alias("file_no"), "name", "canonical").dropDuplicates(["ledger_id", "file_no", "name"])
