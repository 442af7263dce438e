"""Regime states and the record operators on hand-made rows: nulls, ties, repeats and empty tables."""

from datetime import date, datetime

from pyspark.sql import functions as F

from barloom.functions import coerce
from barloom.operators import persistence as per
from barloom.operators import records, regime, replay, stats, summaries
from barloom.sources import ledgers
from tests.conftest import rows
from tests.test_market import make_bars

HEALTHY = {
    "spy_vs_50_pct": 2.0, "spy_vs_200_pct": 6.0, "spy_slope_pct": 0.5, "spy_from_high_pct": -4.0, "qqq_vs_50_pct": 2.0, "qqq_vs_200_pct": 7.0, "breadth_50_pct": 68.0, "breadth_200_pct": 66.0, "rsp_spy_pct": 1.0,
    "nhnl_pct": 12.0, "vix": 14.0, "vix_term": 0.88, "credit_pct": 0.6, "def_off_pct": -1.5, "def_off_prior_pct": None, "vix_5d_pct": -3.0,
}
NEUTRAL = {"qqq_vs_50_pct": -1.0, "breadth_50_pct": 52.0, "breadth_200_pct": 52.0, "nhnl_pct": 0.0, "rsp_spy_pct": 0.0, "vix": 20.0, "vix_term": 0.97, "credit_pct": 0.0, "def_off_pct": 0.0}
#: What differs from a healthy market, and the state, flags and (if given) score that follow.
MARKETS = [
    ({}, "RISK-ON", set(), 10),
    ({"spy_vs_200_pct": -2.0}, "RISK-OFF", set(), None),
    ({"spy_slope_pct": -0.2, "rsp_spy_pct": -2.0}, "RISK-OFF", set(), None),  # flags need an uptrend
    ({"spy_from_high_pct": -1.0, "breadth_50_pct": 42.0}, "CAUTION", {"breadth"}, None),
    ({"rsp_spy_pct": -2.0}, "RISK-ON", {"narrowing"}, None),
    ({"rsp_spy_pct": -2.0, "credit_pct": -1.0}, "CAUTION", {"narrowing", "credit"}, None),
    ({"credit_pct": -1.0, "def_off_pct": 2.0}, "CAUTION", {"credit", "rotation"}, None),
    ({"vix": 28.0, "vix_term": 1.08}, "RISK-ON", {"vix_curve"}, None),
    ({"vix_5d_pct": 30.0}, "RISK-ON", {"vix_spike"}, None),
    ({"spy_from_high_pct": -1.0, "breadth_50_pct": 40.0, "rsp_spy_pct": -2.0, "credit_pct": -1.0, "def_off_pct": 2.0, "vix": 26.0, "vix_term": 1.05}, "RISK-OFF (internals)", {"breadth", "narrowing", "credit", "rotation", "vix_curve"}, None),
    (NEUTRAL, "RISK-ON", set(), 1),
    ({"breadth_50_pct": 44.0}, "CAUTION", set(), None),  # weak breadth alone, far from the high
    (NEUTRAL | {"qqq_vs_200_pct": -3.0, "breadth_50_pct": 55.0, "breadth_200_pct": 38.0, "nhnl_pct": -18.0}, "CAUTION", set(), -2),
    ({"def_off_pct": 4.0, "def_off_prior_pct": 3.8}, "RISK-ON", set(), None),
    ({"def_off_pct": 4.0, "def_off_prior_pct": 2.0}, "RISK-ON", {"rotation"}, None),
    ({"def_off_pct": 0.4, "def_off_prior_pct": -2.0}, "RISK-ON", set(), None),
    ({"def_off_pct": 4.0}, "RISK-ON", {"rotation"}, None),
    (dict.fromkeys(HEALTHY), "RISK-OFF", set(), 0),  # nothing known
    ({"vix": None, "vix_term": None, "qqq_vs_200_pct": None}, "RISK-ON", set(), 7),
]


def test_regime(spark):
    data = [(i, *(HEALTHY | over).values()) for i, (over, *_) in enumerate(MARKETS)]
    d = spark.createDataFrame(data, "i int, " + ", ".join(f"{c} double" for c in HEALTHY)).withColumn("state", F.lit("clash"))
    got = {r["i"]: r for r in regime.classify(d).collect()}
    for i, (over, state, flags, score) in enumerate(MARKETS):
        r = got[i]
        assert (r["state"], set(r["flags"]), r["n_flags"]) == (state, flags, len(flags)), over
        assert score is None or r["score"] == score == r["n_bull"] - r["n_bear"]
    assert len(got[0]["votes"]) == 10
    bare = regime.classify(spark.createDataFrame([(1, 5.0, 1.0)], "i int, spy_vs_200_pct double, spy_slope_pct double")).first()
    assert bare["state"] == "RISK-ON" and bare["score"] == 0
    assert regime.classify(d.limit(0)).count() == 0


def test_run_ids_and_ranges(spark):
    at = F.lit("2025-07-01 02:30:00").cast("timestamp_ntz")
    day = lambda x: F.lit(x).cast("date")
    none, today = F.lit(None).cast("int"), day("2025-03-10")
    ranges = [records.date_range(*x, today) for x in ((day(None), day(None), none, F.lit(5)), (day(None), day(None), none, none), (day("2025-01-01"), day("2025-02-01"), none, none), (day("2025-01-01"), day("2025-02-01"), F.lit(2), none))]
    got = spark.range(1).select(records.run_id(at), records.run_id(at, True), records.run_id(F.lit(None).cast("timestamp_ntz")), *[c for r in ranges for c in r]).first()
    assert tuple(got)[:3] == ("20250630", "20250701T023000Z", None)
    assert tuple(got)[3:] == (date(2025, 3, 5), date(2025, 3, 10), date(2025, 3, 10), date(2025, 3, 17), date(2025, 1, 1), date(2025, 2, 1), date(2025, 1, 1), date(2025, 1, 3))
    assert records.sessions_of(6) == 126


def test_pages_and_series(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "k string, v int")
    b = spark.createDataFrame([("y", 9), ("z", 4), ("z", 3)], "k string, v int")
    assert rows(records.paged_union([a, b, a], "k")) == [("x", 1, 1), ("y", 1, 2), ("z", 2, 3), (None, 1, 3)]
    bars = make_bars(spark, {"A": [(1, 1, 1, 1)] * 9, "B": [(1, 1, 1, 1)] * 2})
    asked = spark.createDataFrame([("A",), ("A",), ("B",), ("C",), (None,)], "ticker string")
    got = rows(records.series_state(bars, asked, bars.agg(F.max("session")).scalar()).select("ticker", "n", "state"))
    assert got == [("A", 9, "live"), ("B", 2, "ended"), ("C", 0, "missing")]
    assert rows(records.series_state(bars.limit(0), asked, F.lit("2025-01-01").cast("date")).select("state")) == [("missing",)] * 3


def test_html(spark):
    page = "<table><tr><th>X</th></tr></table><TABLE class=a><tr><th>Symbol</th><th>Name</th><th>GICS Sector</th></tr>\n<tr><td><a href=x>A.B</a></td><td>n</td><td>Oil &amp; Gas</td></tr><tr></tr><tr><td>C</td></tr></TABLE>"
    d = spark.createDataFrame([(page,), ("none",), ("",), (None,)], "h string").select(records.html_rows(F.col("h"), ["symbol", "gics sector"]).alias("r"))
    got = [None if r["r"] is None else [tuple(x) for x in r["r"]] for r in d.collect()]
    assert got == [[("A.B", "Oil & Gas"), ("C", None)], None, None, None]
    texts = ["<p>a &amp;lt; &#8364; &#x27;b&#39;</p><p>x</p><pre><code>\n  if a &lt; b:\n    <i>go</i>\n</code></pre>tail <a rel=n href=\"u\">t</a>", "plain", "", None, "&#xZZ; & &#9999999; &#55296;"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "h string").select(coerce.plain_text(F.col("h"))).collect()]
    assert got == ["a &lt; € 'b'\n\nx\n\n\n```\n  if a < b:\n    <i>go</i>\n```\ntail [t](u)", "plain", "", None, "&#xZZ; & \ufffd \ufffd"]
    names = ["CPI MM", "Corporate Index", "Corporate", "M2", "GDP", "Initial Jobless Claims", "Fed Funds Rate Decision", None, ""]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(coerce.unit_of(F.col("n"))).collect()]
    assert got == ["percent", "index_level", None, "currency", "percent", "thousands", "percent", None, None]


def test_feed_items(spark):
    dates = ["Fri, 01 May 2026 10:00:00 GMT", "Fri, 01 May 2026 08:30:00 EDT", "1 May 2026 11:00:00 +0200", "Thu, 30 Apr 2026 10:00:00 GMT", "yesterday", None]
    d = spark.createDataFrame([("a" if i < 2 else f"t{i}", t) for i, t in enumerate(dates)], "title string, pubDate string")
    assert rows(ledgers.recent_items(d, "title", "pubDate", 18)) == [("a", datetime(2026, 5, 1, 12, 30)), ("t2", datetime(2026, 5, 1, 9, 0))]
    assert ledgers.recent_items(d.limit(0), "title", "pubDate", 18).count() == 0


def test_slots_and_changes(spark):
    d = spark.createDataFrame([(1, "a", "x", 2.0), (1, "a", "y", 1.0), (1, "b", "u", 5.0), (1, "b", "v", 5.5), (1, "b", "w", 50.0), (2, "a", "x", 1.0), (2, None, "x", 1.0), (None, "a", "x", 1.0), (3, "a", "x", None)], "k int, s string, c string, p double")
    got = records.slot_choices(d, "k", "s", "c", "p", 3).select("k", "price", "picks")
    assert rows(got) == [(1, 6.0, "a=y b=u"), (1, 6.5, "a=y b=v"), (1, 7.0, "a=x b=u"), (2, 1.0, "a=x")]
    e = spark.createDataFrame([("A", datetime(2025, 1, 9), "up"), ("A", datetime(2025, 1, 9), "down"), ("A", datetime(2025, 1, 1), "up"), ("A", None, "up"), (None, datetime(2025, 1, 9), "up")], "k string, at timestamp_ntz, kind string")
    got = records.changes_since(e, "k", "at", "kind", F.lit("2025-01-10").cast("timestamp_ntz"), 5).collect()
    assert [(r["k"], r["n_up"], r["n_down"], r["n_recent"], r["latest_kind"]) for r in got] == [("A", 1, 1, 2, "down")]


def test_dropouts(spark):
    pair = spark.createDataFrame([("V", "dropped", None), ("D", "dropped", None), ("U", "dropped", None), ("L", "dropped", None), ("F", "dropped", None), ("N", "dropped", None), ("K", "stayed", 1)], "t string, status string, rank int")
    moves = spark.createDataFrame([("V", 9.0), ("D", 9.0), ("U", 0.5), ("L", -8.1), ("F", -8.0)], "t string, move_pct double")
    issuers = spark.createDataFrame([("D", "i1"), ("K", "i1"), ("U", "i2")], "t string, issuer string")
    got = per.dropout_reasons(pair, moves, "t", spark.createDataFrame([("V",)], "t string"), issuers)
    assert rows(got) == [("D", "deduped"), ("F", "faded"), ("L", "broke_down"), ("N", "faded"), ("U", "broke_out"), ("V", "vol_collapse")]


def test_units_and_next_open(spark):
    bars = make_bars(spark, {"A": [(100, 101, 99, 100), (104, 106, 103, 105), (90, 130, 80, 120)]})
    s = spark.createDataFrame([("own", "A", 2, 105.0, 120.0, 80.0), ("half", "A", 2, 104.0, 120.0, 80.0), ("prior", "A", 2, 100.0, 120.0, 80.0), ("off", "A", 2, 50.0, 60.0, 40.0), ("none", "A", 9, 50.0, 60.0, 40.0)], "sid string, ticker string, sess_no int, recorded double, target double, stop double")
    got = {r["sid"]: r for r in replay.in_series_units(bars, s).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"own": "ok", "half": "ok", "prior": "ok", "off": "unit_mismatch", "none": "no_bars"}
    assert got["prior"]["sess_no"] == 1 and got["prior"]["entry"] == 100 and abs(got["half"]["target"] - 120 * 105 / 104) < 1e-9 and got["off"]["target"] is None
    entered = {r["sid"]: (r["status"], r["entry"]) for r in replay.entered_next_open(bars, replay.in_series_units(bars, s.withColumn("stop", F.when(F.col("sid") == "half", 95.0).otherwise(F.col("stop"))))).collect()}
    assert entered["own"] == ("ok", 90.0) and entered["half"] == ("gap_skip", 90.0) and entered["none"] == ("no_bars", None) and entered["prior"] == ("ok", 104.0)


def test_sparks_against_pairs(spark):
    candidates = [(f"t{i}", ["a", "b", None][i % 3]) for i in range(9)]
    events = [(f"t{i % 7}", ["a", "b", None, "a"][i % 4], float(i % 5), i) for i in range(20)]
    got = {r["ticker"]: tuple(r)[1:] for r in summaries.sparks(spark.createDataFrame(candidates, "ticker string, sector string"), spark.createDataFrame(events, "ticker string, sector string, cap double, day int"), cap=3).collect()}
    for t, s in candidates:
        own = [e for e in events if e[0] == t]
        sector = [e for e in events if e[0] != t and s is not None and e[1] == s]
        market = [e for e in events if e[0] != t and not (s is not None and e[1] == s) and e[2] >= 3]
        assert got[t] == (len(own), len(sector), len(market), min((e[3] for e in own), default=None)), t


def test_terciles_over_ranges(spark):
    values = [float(i * 7 % 101) for i in range(400)] + [None] * 5
    got = stats.tercile_cuts(spark.createDataFrame([(v,) for v in values], "v double").repartition(5), "v").first()
    own = sorted(v for v in values if v is not None)
    assert tuple(got) == (own[len(own) // 3], own[2 * len(own) // 3])
    assert tuple(stats.tercile_cuts(spark.createDataFrame([(1.0,)] * 8, "v double"), "v").first()) == (None, None)


def test_publish_keeps_one_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5):
        ledgers.publish(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]
