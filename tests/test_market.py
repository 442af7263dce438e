"""Bars, ledgers, replay and statistics on hand-made frames and naive loops."""

import random
from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import coerce, predicates
from barloom.functions.calendar import holidays, trading_days
from barloom.operators import cover, persistence, replay, stats, summaries, trees
from barloom.operators import indicators as ind
from barloom.sources import ledgers
from barloom.sources.bars import bars_from_trades, numbered
from tests.conftest import rows


def make_bars(spark, paths, start=date(2025, 1, 6)):
    """paths: ticker to a list of (open, high, low, close); volume 100."""
    data = [(t, start + timedelta(days=i), *map(float, p), 100.0) for t, ps in paths.items() for i, p in enumerate(ps)]
    return numbered(spark.createDataFrame(data, "ticker string, session date, open double, high double, low double, close double, volume double"))


def test_bars(spark):
    d = spark.createDataFrame([("A", "2025-01-02 10:00:00", 2, 5.0, 1.0), ("A", "2025-01-02 11:00:00", 3, 7.0, 2.0), ("A", "2025-01-02 09:00:00", 1, 6.0, 4.0), (None, "2025-01-02 09:00:00", 1, 6.0, 4.0), ("A", None, 1, 6.0, 4.0), ("A", "2025-01-03 09:00:00", 1, None, 4.0)], "t string, at string, k int, p double, q double")
    got = rows(bars_from_trades(d.withColumn("at", F.col("at").cast("timestamp_ntz")).withColumn("high", F.lit(1)), "t", "at", "p", "q", ["k"]))
    assert got == [("A", date(2025, 1, 2), 6.0, 7.0, 5.0, 7.0, 7.0)]


def test_rsi_and_atr(spark):
    rng = random.Random(2)
    closes = [100 + rng.uniform(-5, 5) for _ in range(60)]
    long = [100 + rng.uniform(-5, 5) for _ in range(900)]  # over many blocks
    two = [r["rsi"] for r in ind.rsi(make_bars(spark, {"L": [(c, c, c, c) for c in long]}), 14).orderBy("session").collect()]
    rise = fall = 0.0
    for i in range(1, 900):
        step = long[i] - long[i - 1]
        rise, fall = rise * 13 / 14 + max(step, 0) / 14, fall * 13 / 14 + max(-step, 0) / 14
        assert i < 13 or abs(two[i] - rise / (rise + fall) * 100) < 1e-9
    bars = make_bars(spark, {"A": [(c, c + 1, c - 2, c) for c in closes], "F": [(5, 5, 5, 5)] * 20})
    got = {(r["ticker"], i): r["rsi"] for t in "AF" for i, r in enumerate(ind.rsi(bars, 14).where(F.col("ticker") == t).orderBy("session").collect())}
    up = down = 0.0
    for i, c in enumerate(closes):
        step = c - closes[i - 1] if i else 0.0
        up, down = (max(step, 0.0), max(-step, 0.0)) if not i else (up * 13 / 14 + max(step, 0) / 14, down * 13 / 14 + max(-step, 0) / 14)
        assert got["A", i] is None if i < 13 else abs(got["A", i] - (100 - 100 / (1 + up / down))) < 1e-9
    assert got["F", 12] is None and got["F", 13] == 100
    a = [r for r in ind.atr(bars).where("ticker = 'A'").orderBy("session").collect()]
    assert a[0]["tr"] == pytest.approx(3) and a[13]["atr"] is None
    trs = [max(3.0, abs(closes[i] + 1 - closes[i - 1]), abs(closes[i] - 2 - closes[i - 1])) for i in range(46, 60)]
    assert a[59]["atr"] == pytest.approx(sum(trs) / 14)


def test_replay_rules(spark):
    flat = [(100, 101, 99, 100)] * 3
    bars = make_bars(spark, {
        "won": flat + [(100, 111, 99, 105)], "lost": flat + [(100, 101, 89, 95)], "both": flat + [(100, 111, 89, 100)], "gap": flat + [(115, 116, 112, 113)], "gapdown": flat + [(80, 85, 79, 82)], "flat": flat * 4, "open": flat,
    })
    sig = spark.createDataFrame([(t, t, 1, 100.0, 110.0, 90.0) for t in ("won", "lost", "both", "gap", "gapdown", "flat", "open", "absent")], "sid string, ticker string, sess_no int, entry double, target double, stop double")
    got = {r["sid"]: (r["outcome"], r["days"], r["result_pct"] and round(r["result_pct"], 6), r["ambiguous"]) for r in replay.target_stop(bars, sig, 5).collect()}
    assert got["won"] == ("WON", 3, 10, False) and got["lost"] == ("LOST", 3, -10, False) and got["both"] == ("WON", 3, 10, True)
    assert got["flat"][:3] == ("EXPIRED", 5, 0) and got["open"][0] == "OPEN" and got["absent"][0] == "no_bars"
    gaps = {r["sid"]: round(r["result_pct"], 6) for r in replay.target_stop(bars, sig.where("ticker in ('gap', 'gapdown')"), 5, gaps=True).collect()}
    assert gaps == {"gap": 15, "gapdown": -20}


def test_buy_stop(spark):
    quiet = [(100, 101, 99, 100)]
    bars = make_bars(spark, {"hit": quiet * 2 + [(104, 106, 103, 105)] + [(105, 106, 104, 105)] * 3, "stopped": quiet * 2 + [(104, 106, 80, 105), (95, 96, 90, 92)] + quiet * 2, "faded": quiet * 8, "down": quiet * 2 + [(80, 81, 79, 80)] * 6, "pending": quiet * 3})
    listed = spark.createDataFrame([(t, t, 1, 3, 103.0) for t in ("hit", "stopped", "faded", "down", "pending")], "sid string, ticker string, sess_no int, last_no int, pivot double")
    got = {r["sid"]: (r["outcome"], r["trigger_day"], r["fill"], r["trade_pct"] and round(r["trade_pct"], 4)) for r in replay.buy_stop(bars, listed, horizon=3).collect()}
    assert got["hit"] == ("TRIGGERED", 2, 104.0, round((105 / 104 - 1) * 100, 4))
    assert got["stopped"] == ("TRIGGERED", 2, 104.0, -8.0)  # the trigger day's low doesn't count, the next one's does
    assert got["faded"][0] == "FADED" and got["down"][0] == "BROKE_DOWN" and got["pending"][0] == "PENDING"


def test_confirmed_against_loop(spark):
    rng = random.Random(5)
    data = [(k, f"{i:04d}", rng.choice("ab")) for k in range(3) for i in range(40)]
    got = {(r["k"], r["o"]): r["confirmed"] for r in persistence.confirmed(spark.createDataFrame(data, "k int, o string, s string"), ["k"], "o", "s", 2).collect()}
    for k in range(3):
        held, last, run = None, None, 0
        for kk, o, s in sorted(data):
            if kk == k:
                run = run + 1 if s == last else 1
                last = s
                if held is None or run >= 2:
                    held = s
                assert got[k, o] == held


def test_streaks_and_pairs(spark):
    d = spark.createDataFrame([("A", 1), ("A", 2), ("A", 4), ("B", 4), ("B", 4), ("C", 1), (None, 3), ("D", None)], "t string, day int")
    assert rows(persistence.streaks(d, "t", "day")) == [("A", 3, 2, 1, 4), ("B", 1, 1, 1, 4), ("C", 1, 1, 0, None)]
    p = spark.createDataFrame([("A", 1, 2, 5), ("A", 2, 1, 3), ("B", 2, 2, None), ("C", 1, 1, 1), ("D", 2, 99, 1)], "t string, day int, rank int, sr int")
    assert rows(persistence.run_pair(p, "t", "day", "rank", "sr", 30)) == [("A", "stayed", 1, 2, 2), ("B", "new", 2, None, None), ("C", "dropped", None, 1, None)]


def test_appends(spark):
    old = spark.createDataFrame([("a", "2025-03-09 04:30:00"), ("b", "2025-03-09 06:00:00"), ("c", None)], "t string, run_date string").withColumn("run_date", F.col("run_date").cast("timestamp_ntz"))
    new = spark.createDataFrame([("n", "2025-03-10 02:00:00", 7)], "t string, run_date string, extra int").withColumn("run_date", F.col("run_date").cast("timestamp_ntz"))
    # the ninth of March in New York is 05:00 UTC that day to 04:00 UTC the next
    assert [r[0] for r in rows(ledgers.append_by_day(old, new))] == ["a", "c", "n"]
    assert ledgers.append_by_day(old, new.limit(0)).count() == 3 and ledgers.append_by_day(old, new, allow_same_day=True).count() == 4
    once = ledgers.upsert(old, new.withColumn("t", F.lit("b")), ["t"])
    assert rows(once) == rows(ledgers.upsert(once, new.withColumn("t", F.lit("b")), ["t"]))


def test_files(spark, tmp_path):
    (tmp_path / "h.csv").write_text("# note\nticker,rank,junk\nA,1,x\nB,bad,y\n")
    assert rows(ledgers.read_csv(spark, str(tmp_path / "h.csv"), "ticker string, rank int, score double", comment="#")) == [("A", 1, None), ("B", None, None)]
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs/a.json").write_text('{"run_date": "2025-01-02",\n "role": "core"}')
    (tmp_path / "runs/b.json").write_text('{"role": "odd"}')
    (tmp_path / "runs/c.json").write_text("{broken")
    d = ledgers.read_json_runs(spark, str(tmp_path / "runs"), "run_date string, role string", ["run_date"], {"role": ["core"]})
    assert sorted(map(tuple, (r["problems"] for r in d.collect()))) == [(), ("not a JSON document",), ("run_date is missing", "role is odd")]
    (tmp_path / "f.xml").write_text("<rss><item><title>a</title><pubDate>x</pubDate></item><item><title>b</title></item></rss>")
    assert rows(ledgers.read_feed(spark, str(tmp_path / "f.xml"), "item", "title string")) == [("a",), ("b",)]
    ledgers.publish(spark.range(5).toDF("x"), str(tmp_path / "t"))
    ledgers.publish(spark.range(3).toDF("x"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    part = lambda n: spark.range(n).select("id", (F.col("id") % 2).alias("p"))
    ledgers.publish(part(6), str(tmp_path / "p"), "p")
    ledgers.publish(part(10).where("p = 1"), str(tmp_path / "p"), "p")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3 + 5
    ledgers.write_records({"a": spark.range(2).toDF("x"), "b": spark.range(1).toDF("y")}, str(tmp_path / "c"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "c")).groupBy("record_class").count()) == [("a", 2), ("b", 1)]


def test_calendar(spark):
    got = {(str(r["day"]), r["holiday"]) for r in holidays(spark, 2021, 2026).collect()}
    for day, name in (("2025-04-18", "good friday"), ("2026-04-03", "good friday"), ("2021-12-24", "christmas"), ("2025-11-27", "thanksgiving"), ("2022-06-20", "juneteenth"), ("2026-07-03", "independence"), ("2023-01-02", "new year")):
        assert (day, name) in got
    assert not any(n == "juneteenth" and d < "2022" for d, n in got) and not any(n == "new year" and d.startswith("2021-12") for d, n in got)
    # by rule: the closure of 9 January 2025 was no regular holiday
    t = {str(r["day"]): r for r in trading_days(spark, 2025, 2025).collect()}
    assert len(t) == 251 and t["2025-03-21"]["witching"] and t["2025-04-17"]["third_friday"] and t["2025-08-29"]["month_end"]


def test_statistics(spark):
    d = spark.createDataFrame([("a", 1.0)] * 12 + [("b", 3.0), (None, 4.0), ("c", None)], "g string, v double")
    e = {r["group"]: (r["n"], r["mean"], r["members"]) for r in stats.edges(d, "g", "v").collect()}
    assert e == {"a": (12, 1.0, None), "Other": (2, 3.5, "?,b")}
    cuts = stats.tercile_cuts(spark.createDataFrame([(float(x),) for x in [1, 1, 1, 1, 5, 6, 7, 8, 9, 10]], "v double"), "v").first()
    assert tuple(cuts) == (1.0, 7.0) and tuple(stats.tercile_cuts(d.limit(3), "v").first()) == (None, None)
    b = d.select(stats.half_open(F.col("v"), [0, 1, 4]).alias("b")).groupBy("b").count()
    assert rows(b) == [("[1,4)", 13), (None, 2)]


def test_predicates(spark):
    d = spark.createDataFrame([(1, "a"), (5, "b"), (None, "c")], "x int, s string")
    assert rows(predicates.screened(d, '{"operator": "or", "operands": [{"operator": "gte", "operands": ["x", 5]}, {"operator": "is-in", "operands": ["s", "c"]}]}')) == [(5, "b"), (None, "c")]
    for bad in ("{", '{"operator": "gt", "operands": ["nope", 1]}', '{"operator": "odd", "operands": ["x", 1]}', '{"operator": "btwn", "operands": ["x", 1]}', "[]", '{"operator": "and", "operands": []}'):
        with pytest.raises(predicates.PredicateError):
            predicates.compiled(bad, d.columns)
    assert rows(predicates.cascade(d, {"s": F.col("s") != "a", "x": F.col("x") > 9})) == [("s", 2), ("x", 0)]


def test_coercions(spark):
    d = spark.createDataFrame([("1.9",), ("-1.9",), ("inf",), ("NaN",), (" Yes ",), ("",), (None,), ("1e300",)], "x string")
    got = [tuple(r) for r in d.select(coerce.safe_float(F.col("x")), coerce.safe_int(F.col("x")), coerce.safe_bool(F.col("x")), coerce.safe_str(F.col("x"))).collect()]
    assert got == [(1.9, 1, None, "1.9"), (-1.9, -1, None, "-1.9"), (None, None, None, "inf"), (None, None, None, "NaN"), (None, None, True, "Yes"), (None, None, None, None), (None, None, None, None), (1e300, None, None, "1e300")]
    line = spark.createDataFrame([([1.0, None, 9.0, 5.0],), ([3.0, 3.0],), ([],), (None,)], "v array<double>").select(coerce.sparkline(F.col("v"))).collect()
    assert [r[0] for r in line] == ["▁·█▅", "▄▄", "", None]


def test_cover():
    rng = random.Random(1)
    for _ in range(30):
        want = {s: rng.randrange(0, 4) for s in "xyz"}
        offers = [(f"o{i}", rng.randrange(1, 20), {s: rng.randrange(0, 3) for s in "xyz"}) for i in range(4)]
        got = cover.cheapest_cover(want, offers)
        best = None
        from itertools import product

        for n in product(range(5), repeat=4):
            if all(sum(k * o[2][s] for k, o in zip(n, offers)) >= want[s] for s in want):
                cost = sum(k * o[1] for k, o in zip(n, offers))
                best = cost if best is None else min(best, cost)
        assert (got[0][0] if got else None) == best or best is None and not got


def test_covers_and_trees(spark):
    d = spark.createDataFrame([(1, "x", 2), (2, "q", 1), (None, "x", 1)], "order_id long, sku string, qty int")
    o = spark.createDataFrame([(1, "a", 5, "x", 1), (1, "b", 8, "x", 2)], "order_id long, offer string, price int, sku string, gives int")
    assert rows(cover.covers(d, o, best=2)) == [(1, 1, 8, "b"), (1, 2, 10, "a,a")]
    items = spark.createDataFrame([(1, None, 0, True), (2, 1, 1, True), (3, 1, 0, True), (4, 2, 0, True), (5, 3, 0, False), (6, 5, 0, True), (7, None, 0, None)], "item long, parent long, pos int, live boolean")
    assert rows(trees.expand(items, 3, 3).select("root", "item", "level")) == [(1, 1, 0), (1, 2, 1), (1, 3, 1), (7, 7, 0)]


def test_summaries(spark):
    c = spark.createDataFrame([("U", "call", 95.0, None, 1, 100.0), ("U", "call", 105.0, None, 2, 100.0), ("U", "put", 99.0, 4, 0, 100.0)], "underlying string, leg string, strike double, volume int, interest int, spot double")
    r = summaries.option_summary(c, "spot").first()
    assert (r["atm_call"], r["atm_put"], r["call_volume"], r["pc_volume"], r["pc_interest"]) == (95.0, 99.0, None, None, 0.0)
    q = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", None)], "ticker string, v double")
    assert rows(summaries.movers(q, 5, "v")) == [("a", 3.0, "up"), ("b", 1.0, "up")]


def test_streaming(spark, tmp_path):
    from barloom.streaming.sessions import deduplicated, pending_signals, stream_sessions, windowed_counts

    (tmp_path / "in").mkdir()

    def batch(n, data):
        pd.DataFrame(data, columns=["k", "at"]).assign(at=lambda d: pd.to_datetime(d["at"] + 1000, unit="s")).to_parquet(tmp_path / f"in/{n}.parquet", coerce_timestamps="us")

    batch(0, [("a", 0), ("a", 5), ("b", 3), (None, 4)])
    batch(1, [("a", 20), ("a", 12)])  # the late 12 joins both
    batch(2, [("z", 200)])
    batch(3, [("z", 400), ("a", 1)])  # too late
    source = lambda: spark.readStream.schema("k string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return rows(spark.table(name))

    got = run(stream_sessions(source(), "k", "at", 8, 30), "s1")
    assert got[:2] == [("a", 1000.0, 1020.0, 4), ("b", 1003.0, 1003.0, 1)] and ("z", 1200.0, 1200.0, 1) in got
    assert [r[2] for r in run(windowed_counts(source().where("k = 'a'"), "k", "at", "10 seconds", "30 seconds"), "s2")][:1] in ([2], [])
    for zone, name in (("America/New_York", "s1n"), ("Asia/Kolkata", "s1k")):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert run(stream_sessions(source(), "k", "at", 8, 30), name) == got
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert len(run(deduplicated(source(), ["k"], "at", "1000 seconds").select("k"), "s3")) == 4
    schema = "ticker string, kind string, sess_no long, sid string, target double, stop double, high double, low double"
    bar = lambda n, high, low: ("T", "bar", n, None, None, None, high, low)
    signal = lambda sid, target: ("T", "signal", 1, sid, target, 5.0, None, None)
    for part in ([bar(3, 10.0, 8.0), signal("s", 12.0), signal("w", 11.0)], [bar(2, 11.0, 7.0)]):  # the bar of the day before comes later
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "sig"))
    d = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "sig"))
    assert run(pending_signals(d, 2), "s4") == [("s", "EXPIRED", 2), ("w", "WON", 1)]
    spark.createDataFrame([signal("g", 50.0), bar(3, 9.0, 8.0), bar(8, 9.0, 8.0)], schema).coalesce(1).write.parquet(str(tmp_path / "gap"))  # no bar of session 2 ever
    d = spark.readStream.schema(schema).parquet(str(tmp_path / "gap"))
    assert run(pending_signals(d, 2), "s5") == [("g", "EXPIRED", 2)] and run(pending_signals(d, 2, late=9), "s6") == []


def test_snapshots(spark, tmp_path):
    from barloom.sources.snapshots import Patience, SnapshotSource, read_patiently

    (tmp_path / "A.json").write_text('{"last":   1.5}')
    (tmp_path / "C.json").write_text("{broken")
    spark.dataSource.register(SnapshotSource)
    got = spark.read.format("snapshots").option("symbols", "A, B,C,A").option("group", 2).option("patience", "0").load(str(tmp_path))
    assert [(r["symbol"], r["payload"], r["reason"], r["tries"]) for r in got.orderBy("symbol").collect()] == [("A", '{"last": 1.5}', None, 1), ("B", None, "missing", 1), ("C", None, "malformed", 1)]
    assert spark.read.format("snapshots").option("symbols", " ").load(str(tmp_path)).count() == 0
    waits, left = [], [TimeoutError("slow"), ConnectionError("reset")]

    def flaky():
        if left:
            raise left.pop()
        return "7"

    assert read_patiently(flaky, Patience(10, seed=1, sleep=waits.append)) == ("7", None, None, 3)
    assert len(waits) == 2 and 0 <= waits[0] <= 1 and 0 <= waits[1] <= 2

    def never():
        raise TimeoutError("slow")

    given_up = read_patiently(never, Patience(5, seed=1, sleep=waits.append))
    assert given_up.reason == "unreachable" and sum(waits[2:]) <= 5
    assert read_patiently(lambda: 1 / 0, Patience(5)).reason == "unexpected"
