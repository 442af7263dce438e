"""The core operators on hand-made frames and against brute force."""

import json
import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions.labels import base_state
from barloom.functions.timestamps import day_text, instant_text, normalise_times, with_source
from barloom.operators import drift, history, sessions
from barloom.operators import asof
from barloom.operators.asof import PersistentTree, as_known
from barloom.operators.neighbours import neighbours
from tests.conftest import rows


def test_base_state(spark):
    texts = ["RISK-ON", "**caution**", "🟡 Risk off - VIX", "RISKOFF!", "RISK–OFF, not yet RISK-ON", "no reading", "", None, "RISK_ON", "riskonly", "cautious"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(base_state(F.col("t"))).collect()]
    assert got == ["RISK-ON", "CAUTION", "RISK-OFF", "RISK-OFF", "RISK-OFF", None, None, None, "RISK-ON", None, None]


def test_neighbours_cross_segments(spark):
    rng = random.Random(1)
    data = [(k, o, rng.choice("ab")) for k in "xyz" for o in rng.sample(range(100), 40)] + [(None, 1, "a")]
    d = neighbours(spark.createDataFrame(data, "k string, o int, v string"), ["k"], ["o"], F.floor(F.col("o") / 7), lag={"p": "v"}, lead={"n": "o"})
    want = []
    for k in "xyz":
        own = sorted((o, v) for kk, o, v in data if kk == k)
        for i, (o, v) in enumerate(own):
            want.append((k, o, v, i + 1, own[i - 1][1] if i else None, own[i + 1][0] if i + 1 < len(own) else None))
    assert rows(d) == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_neighbours_last_and_carry(spark):
    rng = random.Random(2)
    data = [(k, o, rng.choice(["a", "b", None, None])) for k in "xy" for o in rng.sample(range(100), 40)]
    d = neighbours(spark.createDataFrame(data, "k string, o int, v string"), ["k"], ["o"], F.floor(F.col("o") / 7), last={"end": "o", "end_v": "v"}, carry={"c": "v"})
    want = []
    for k in "xy":
        own, held = sorted((o, v) for kk, o, v in data if kk == k), None
        for i, (o, v) in enumerate(own):
            held = v if v is not None else held
            want.append((k, o, v, i + 1, *own[-1], held))
    assert rows(d) == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_hot_key_is_cut(spark):
    """A key with nine tenths of the rows: no group of the as-of join holds more than a few times its share."""
    rng = random.Random(9)
    key = lambda: 1 if rng.random() < 0.9 else rng.randrange(2, 9)
    hist = [(key(), rng.randrange(1000), rng.randrange(40), i, rng.choice("abc")) for i in range(3000)]
    events = [(i, key(), rng.randrange(1000), rng.randrange(50)) for i in range(1000)]
    h = spark.createDataFrame(hist, "k long, known long, valid long, tie long, v string")
    e = spark.createDataFrame(events, "id long, k long, kn long, va long")
    sizes = spark.sparkContext.accumulator(0)
    search, asof._search = asof._search, None
    try:

        def counted(batch):
            sizes.add(1)
            if batch.num_rows > 1500:
                raise ValueError(f"a group of {batch.num_rows} rows")
            return search(batch)

        asof._search = counted
        got = dict(map(tuple, as_known(e, h, "k", "id", F.col("kn"), F.col("va"), F.col("known"), F.col("valid"), F.col("tie"), F.col("v"), 30, 200).collect()))
    finally:
        asof._search = search
    for i, k, kn, va in events:
        best = max(((x[2], x[1], x[3], x[4]) for x in hist if x[0] == k and x[1] <= kn and x[2] <= va), default=(None,) * 4)[3]
        assert got[i] == best, (i, k, kn, va)
    assert sizes.value > 10


def brute_sessions(points, gap):
    out = []
    for p, n in sorted(points.items()):
        if out and p <= out[-1][1] + gap:
            out[-1] = (out[-1][0], p, out[-1][2] + n)
        else:
            out.append((p, p, n))
    return out


@pytest.mark.parametrize("width", [1, 5, 1000])
def test_merge_sessions(spark, width):
    rng = random.Random(width)
    data = [("hot", rng.randrange(400)) for _ in range(150)] + [(f"k{i % 9}", rng.randrange(300)) for i in range(90)] + [(None, 3), ("k1", None)]
    got = rows(sessions.merge_sessions(spark.createDataFrame(data, "k string, p long"), ["k"], "p", 3, width))
    want = []
    for k in {k for k, _ in data if k}:
        points = {}
        for kk, p in data:
            if kk == k and p is not None:
                points[p] = points.get(p, 0) + 1
        want += [(k, a, b, b - a, n) for a, b, n in brute_sessions(points, 3)]
    assert got == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_episodes_edges(spark):
    days = spark.createDataFrame([(f"202501{d:02d}", None) for d in range(1, 21)] * 2, "run_day string, session date")
    listed = [("A", "20250101"), ("A", "20250104"), ("A", "20250108"), ("A", "20250120"), ("A", "20250120"), (None, "20250101"), (" ", "20250101"), ("B", None), ("B", "20991231")]
    got = rows(sessions.episodes(spark.createDataFrame(listed, "ticker string, run_day string").withColumn("no", F.lit(1)), days).select("ticker", "start_day", "last_day", "dropout_day", "n_days", "span"))
    # between the 1st and 4th two days are missed, between the 4th and 8th three
    assert got == [("A", "20250101", "20250104", "20250107", 2, 4), ("A", "20250108", "20250108", "20250111", 1, 1), ("A", "20250120", "20250120", "open", 1, 1)]
    assert rows(sessions.episodes(spark.createDataFrame([], "ticker string, run_day string"), days)) == []


ZONES = [("ny", "America/New_York", False), ("ldn", "Europe/London", True), ("tyo", "Asia/Tokyo", False), ("odd", "Mars/Phobos", True)]
TIMES = [
    ("ny", "2025-03-09 02:30:00", "2025-03-09T07:30:00.000000Z", "2025-03-09"),  # skipped hour moves on
    ("ny", "2025-11-02 01:30:00", "2025-11-02T05:30:00.000000Z", "2025-11-02"),  # the first of two
    ("ldn", "03/04/2025 12:00", "2025-04-03T11:00:00.000000Z", "2025-04-03"),
    ("ny", "03/04/2025 12:00", "2025-03-04T17:00:00.000000Z", "2025-03-04"),
    ("ny", "1.2.2025 03:04:05", "2025-02-01T08:04:05.000000Z", "2025-02-01"),
    ("tyo", "12/31/25 12:05:09 AM", "2025-12-30T15:05:09.000000Z", "2025-12-30"),
    ("tyo", "Apr 3, 2025 4:16 PM EDT", "2025-04-03T20:16:00.000000Z", "2025-04-03"),
    ("ny", "2025-01-02T03:04:05.123456789Z", "2025-01-02T03:04:05.123456Z", "2025-01-01"),
    ("ny", "2025-01-02 03:04:05,5 +0530", "2025-01-01T21:34:05.500000Z", "2025-01-01"),
    ("ny", "2025-01-02T03:04:05[Asia/Tokyo]", "2025-01-01T18:04:05.000000Z", "2025-01-01"),
    ("ny", " 1735851307549\n", "2025-01-02T20:55:07.549000Z", "2025-01-02"),
    ("ny", "1735851307.5", "2025-01-02T20:55:07.500000Z", "2025-01-02"),
    ("ny", "20250102T230454Z", "2025-01-02T23:04:54.000000Z", "2025-01-02"),
    ("ny", "Fri, 01 May 2026 00:53:51 GMT", "2026-05-01T00:53:51.000000Z", "2026-04-30"),
    ("ny", "Thu, 01 May 2026 00:53:51 GMT", None, None),  # a Friday
    ("ny", "2025-02-30 10:00:00", None, None),
    ("ny", "2025-01-02 24:00:00", None, None),
    ("ny", "2025-01-02 10:60:00", None, None),
    ("ny", "13/13/2025", None, None),
    ("nowhere", "2025-01-02 10:00:00", None, None),
    ("nowhere", "01/02/2025", None, None),
    (None, "2025-01-02T10:00:00Z", "2025-01-02T10:00:00.000000Z", "2025-01-02"),
    ("ny", "yesterday", None, None),
    ("ny", "", None, None),
    ("ny", None, None, None),
    ("ny", "2025-01-02 10:00:00 XYZ", None, None),
    ("ny", "2025-01-02T10:00:00[Mars/Phobos]", None, None),
    ("odd", "2.1.2025", None, "2025-01-02"),
    ("odd", "2025-01-02 10:00:00", None, None),  # a source with an unknown zone
    ("ldn", "1-APR-25", "2025-03-31T23:00:00.000000Z", "2025-04-01"),
    ("ny", "Sunday, March 2 2025", None, None),
    ("ny", "x" * 100_000, None, None),
]


def test_times(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")  # it must play no part
    try:
        d = spark.createDataFrame([(i, s, t) for i, (s, t, _, _) in enumerate(TIMES)], "i int, source string, t string").withColumns({c: F.lit(1) for c in ("at", "_t", "_x", "_zone", "zone", "_row", "_src")})
        d = normalise_times(with_source(d, spark.createDataFrame(ZONES, "source string, zone string, day_first boolean")), "t")
        got = [(r["i"], r["a"], r["d"]) for r in d.select("i", instant_text().alias("a"), day_text().alias("d")).orderBy("i").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [(i, a, b) for i, (_, _, a, b) in enumerate(TIMES)]


def test_times_against_zoneinfo(spark):
    rng = random.Random(4)
    want, data = [], []
    for i in range(300):
        zone = rng.choice(["America/New_York", "Europe/London", "Australia/Sydney", "America/Sao_Paulo", "Asia/Kolkata"])
        local = datetime(2025, 1, 1) + timedelta(minutes=30 * rng.randrange(2 * 24 * 365))
        at = local.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(timezone.utc)
        data.append((i, local.strftime("%Y-%m-%d %H:%M:%S"), zone, False))
        want.append((i, at.strftime("%Y-%m-%dT%H:%M:%S.000000Z")))
    d = normalise_times(spark.createDataFrame(data, "i int, t string, zone string, day_first boolean"), "t")
    assert [tuple(r) for r in d.select("i", instant_text()).orderBy("i").collect()] == want


def test_versions(spark):
    data = [
        ("A", 10, 1, "Tech", "Chips"), ("A", 20, 2, " tech ", "CHIPS"), ("A", 30, 3, None, "?"), ("A", 40, 4, "Energy", None), ("A", 40, 5, "Tech", ""), ("A", 5, 6, "?", None),
        ("A", 50, 7, "Tech", "Soft ware"), ("B", 1, 8, None, " "), (None, 1, 9, "x", "y"), ("C", None, 10, "x", "y"), ("C", 7, 11, None, "z"), ("C", 9, 12, "q", None),
    ]
    d = spark.createDataFrame(data, "ticker string, ts long, u long, sector string, industry string").withColumn("pos", F.lit(0))
    assert rows(history.versions(d, "ticker", "ts", "u", ["sector", "industry"], 15)) == [("A", 10, 50), ("A", 50, -1), ("C", 7, 9), ("C", 9, -1)]
    full = rows(history.attribute_history(d, "ticker", "ts", "u", ["sector", "industry"], 15))
    assert full == [("A", 10, 50, "tech", "chips"), ("A", 50, -1, "tech", "software"), ("C", 7, 9, None, "z"), ("C", 9, -1, "q", "z")]
    assert rows(history.versions(d.limit(0), "ticker", "ts", "u", ["sector", "industry"], 15)) == []


def test_persistent_tree():
    rng = np.random.default_rng(3)
    for n, size in ((1, 1), (7, 3), (200, 37), (64, 64)):
        ranks = rng.integers(0, size, n)
        tree = PersistentTree(ranks, size)
        version, rank = rng.integers(0, n + 1, 300), rng.integers(-1, size, 300)
        got = tree.floor(version, rank)
        for v, r, g in zip(version, rank, got):
            best = max(((ranks[i], i) for i in range(v) if ranks[i] <= r), default=(None, -1))[1]
            assert g == best


@pytest.mark.parametrize("rows_a_task", [3, 100_000])
def test_as_known(spark, rows_a_task):
    rng = random.Random(7)
    hist = [(rng.choice([1, 1, 1, 2]), rng.randrange(50), rng.randrange(60), i, rng.choice("abc")) for i in range(150)] + [(None, 1, 1, 900, "x"), (1, None, 1, 901, "x")]
    events = [(i, rng.choice([1, 1, 2, 3, None]), rng.randrange(60), rng.randrange(70)) for i in range(200)] + [(999, 1, None, 5)]
    h = spark.createDataFrame(hist, "k long, known long, valid long, tie long, v string")
    e = spark.createDataFrame(events, "id long, k long, kn long, va long").withColumn("value", F.lit("clash"))
    got = dict(map(tuple, as_known(e, h, "k", "id", F.col("kn"), F.col("va"), F.col("known"), F.col("valid"), F.col("tie"), F.col("v"), 10, rows_a_task).collect()))
    for i, k, kn, va in events:
        best = max(((x[2], x[1], x[3], x[4]) for x in hist if k is not None and kn is not None and x[0] == k and x[1] is not None and x[1] <= kn and x[2] <= va), default=(None,) * 4)[3]
        assert got[i] == best, (i, k, kn, va)


def ledger(files):
    """(ledger, file number, records) to rows."""
    return [(led, no, f"f{no}", i, json.dumps(r) if isinstance(r, dict) else r) for led, no, records in files for i, r in enumerate(records)]


def test_drift(spark):
    run = [{"run_id": "2", "ticker": t, "close": 1.5 + i, "score_rank": i + 1, "vcp_is_vcp": i % 2 == 0, "gone": None} for i, t in enumerate("ABCD")]
    second = [{"run_id": "2", "ticker": t.lower(), "px": f"{1.5 + i}".replace(".", ","), "score_rank": float(i + 1), "vcp_is_vcp": None, "decoy": 3.5 - i} for i, t in enumerate("ABCD")]
    third = [{"run_id": "3", "ticker": "A", "px": 2.5, "score_rank": 4.0, "vcp_is_vcp": True}, "no json", None]
    d = spark.createDataFrame(ledger([(1, 1, run + run[:1]), (1, 3, second), (1, 4, third), (2, 9, run)]), "ledger_id long, file_no int, file_name string, row_no int, payload string").withColumn("field", F.lit("clash"))
    got = rows(drift.file_changes(d))
    assert got == sorted(
        [(1, 3, "renamed", "close", "px"), (1, 3, "removed", "gone", ""), (1, 3, "added", "decoy", ""), (1, 3, "retyped", "px", ""), (1, 3, "retyped", "score_rank", ""), (1, 4, "removed", "decoy", ""), (1, 4, "retyped", "px", "")],
        key=lambda r: tuple((x is None, str(x)) for x in r),
    )  # vcp_is_vcp is all null in file 3 and boolean again in file 4: no change
    table = {(r["ledger_id"], r["file_no"], r["row_no"]): r for r in drift.unified(d).collect()}
    assert [table[1, 3, i]["close"] for i in range(4)] == [1.5, 2.5, 3.5, 4.5] and table[1, 4, 0]["close"] == 2.5
    assert table[1, 3, 1]["score_rank"] == 2 and json.loads(table[1, 3, 0]["rescued"]) == {"decoy": "3.5"}
    assert len(table) == d.count()
    assert rows(drift.file_changes(d.limit(0))) == []


def brute_changes(files, key):
    """The report of one ledger from its files (number, records), by the words of the docstring."""
    kind = lambda v: "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "number" if isinstance(v, float) else "string"
    kinds = ["boolean", "integer", "number", "string"]
    out, last, before = [], {}, None
    for no, records in sorted(files):
        fields = {f for r in records for f in r}
        now = {}
        for f in fields:
            seen = [kind(r[f]) for r in records if r.get(f) is not None]
            now[f] = max(kinds, key=lambda k: (seen.count(k), k)) if seen else None
        types = dict(now)
        if before is not None:
            old_fields, old_records, old_last = before
            added, removed = fields - old_fields, old_fields - fields
            ident = lambda r: tuple(str(r[k]).strip().upper() for k in key)
            pairs = []
            for a in added:
                for b in removed:
                    met = [(r[a], q[b]) for r in records for q in old_records if a in r and b in q and ident(r) == ident(q)]
                    equal = sum(x is not None and y is not None and float(x) == float(y) for x, y in met)
                    unequal = sum(x is not None and y is not None and float(x) != float(y) for x, y in met)
                    one = sum((x is None) != (y is None) for x, y in met)
                    if equal and equal / (equal + unequal + one) >= 0.9:
                        pairs.append((a, b))
            assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)  # made without rivals
            was = {a: b for a, b in pairs}
            out += [(no, "added", a, "") for a in added - set(was)] + [(no, "removed", b, "") for b in removed - set(was.values())] + [(no, "renamed", b, a) for a, b in pairs]
            for f in (fields & old_fields) | set(was):
                known = old_last.get(was.get(f, f))
                if types[f] is None:
                    types[f] = known
                elif known is not None and types[f] != known:
                    out.append((no, "retyped", f, ""))
        last = types
        before = (fields, records, last)
    return out


def test_drift_against_brute_force(spark):
    """Random ledgers of other field names than the history's, with chains of renames and fields that are null for many files."""
    rng = random.Random(21)
    target = {"day": "string", "sym": "string", "level": "number", "place": "integer"}
    files, want = [], []
    for led in range(8):
        names = {"level": "level", "place": "place", "flag": "flag"}
        kinds = {"level": float, "place": int, "flag": int}
        empty, made, previous = {}, [], []
        for no in range(1, 9):
            for field in names:
                if rng.random() < 0.4:
                    names[field] = f"{field}_{no}"
                if rng.random() < 0.2:
                    kinds[field] = rng.choice([float, int, str])
                empty[field] = rng.random() < 0.35
            rows_ = []
            for day in (no - 1, no):
                for i in range(6):
                    value = {f: 100.0 * (1 + list(names).index(f)) + 10 * day + i for f in names}
                    record = {"day": f"d{day}", "sym": f"s{i}" if rng.random() < 0.5 else f"S{i}"}
                    for f, n in names.items():
                        # The repeated run keeps its values; a field without values in a file is null in it.
                        record[n] = None if empty[f] else (kinds[f](value[f]) if kinds[f] is not str else f"{value[f]}")
                    rows_.append(record)
            made.append((2 * no, rows_))
        files += [(led, no, records) for no, records in made]
        want += [(led, *c) for c in brute_changes(made, ("day", "sym"))]
    rng.shuffle(files)
    d = spark.createDataFrame(ledger(files), "ledger_id long, file_no int, file_name string, row_no int, payload string")
    key = lambda r: tuple(map(str, r))
    got = [tuple(r) for r in drift.file_changes(d, target, record_key=("day", "sym")).collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and {r[2] for r in want} == {"added", "removed", "renamed", "retyped"}
    table = {(r["ledger_id"], r["file_no"], r["row_no"]): r for r in drift.unified(d, target, record_key=("day", "sym")).collect()}
    assert len(table) == d.count()
    for led, no, records in files:
        for i, record in enumerate(records):
            assert table[led, no, i]["day"] == record["day"]


def test_long_chains_of_renames(spark):
    names = ["close", *[f"c{i}" for i in range(1, 12)]]
    made = [(1, no, [{"run_id": str(r), "ticker": t, names[no]: 10.0 * r + i} for r in (no, no + 1) for i, t in enumerate("AB")]) for no in range(len(names))]
    d = spark.createDataFrame(ledger(made), "ledger_id long, file_no int, file_name string, row_no int, payload string")
    assert all(r["close"] is not None and r["rescued"] is None for r in drift.unified(d).collect())
    empty = [(1, no, [{"run_id": str(r), "ticker": "A", "close": (1 if no == 0 else "x") if no in (0, 11) else None} for r in (no, no + 1)]) for no in range(12)]
    d = spark.createDataFrame(ledger(empty), "ledger_id long, file_no int, file_name string, row_no int, payload string")
    assert rows(drift.file_changes(d)) == [(1, 11, "retyped", "close", "")]


def test_drift_ingest_keeps_everything(spark):
    d = spark.createDataFrame([(1, '{"a": 1, "b": "x", "c": [1], "d": null, "e": 2.0}'), (2, "[1]"), (3, ""), (4, None)], "i int, p string")
    got = {r["i"]: r for r in drift.ingest(d, "p", {"a": "integer", "b": "number"}).collect()}
    assert got[1]["a"] == 1 and got[1]["b"] is None and got[1]["_rescued"] == {"b": '"x"', "c": "[1]", "d": "null", "e": "2.0"}
    assert sorted(got[1]["_keys"]) == list("abcde")
    assert all(got[i]["_corrupt"] and got[i]["a"] is None for i in (2, 3, 4))
