"""Streams: sessions by merging interval state, event-time windows, and signals that wait for their bars."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.functions.columns import micros
from barloom.session import scratch, ship


def merged(intervals: list[list[int]], events: list[int], gap: int) -> list[list[int]]:
    """Sorted, disjoint [first, last, count] intervals with events merged in; each event opens [t, t + gap]."""
    parts = sorted([list(x) for x in intervals] + [[t, t, 1] for t in events])
    out: list[list[int]] = []
    for a, b, n in parts:
        if out and a <= out[-1][1] + gap:
            out[-1] = [out[-1][0], max(out[-1][1], b), out[-1][2] + n]
        else:
            out.append([a, b, n])
    return out


def stream_sessions(events: DataFrame, key: str, at: str, gap_s: float, late_s: float) -> DataFrame:
    """Final sessions of a stream: key (as text), started, ended (seconds since 1970, UTC), n_events.

    A key's state is its open intervals. A late event merges with the intervals it touches, or joins two of them, as
    long as the watermark (``late_s`` behind the latest event) hasn't passed it; then its session is emitted once and its
    state dropped. Events with a null key or time, and those behind the watermark, don't count. Times are instants, counted
    in microseconds before Python sees them, so the session's zone plays no part; a zone-less time is taken as UTC.
    """
    kind = dict(events.dtypes)[at]
    d = events.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    number = F.unix_micros(F.col(at)) if kind == "timestamp" else micros(F.col(at))
    d = d.select(F.col(key).cast("string").alias("key"), number.alias("us")).withColumn("at", F.timestamp_micros("us")).withWatermark("at", f"{late_s} seconds")
    gap = round(gap_s * 1e6)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [list(x) for x in zip(*state.get)] if state.exists else []
        mark = state.getCurrentWatermarkMs() * 1000
        times: list[int] = []
        if not state.hasTimedOut:
            for b in batches:
                times += [t for t in b["us"].tolist() if t >= mark]
        held = merged(held, times, gap)
        done = [x for x in held if x[1] + gap < mark]
        held = [x for x in held if x[1] + gap >= mark]
        if held:
            state.update(tuple([int(v) for v in col] for col in zip(*held)))
            state.setTimeoutTimestamp(max(min(x[1] for x in held) + gap, mark) // 1000 + 1)
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame({"key": [k[0]] * len(done), "started": [x[0] / 1e6 for x in done], "ended": [x[1] / 1e6 for x in done], "n_events": [x[2] for x in done]})

    ship(events.sparkSession)
    return d.groupBy("key").applyInPandasWithState(
        step, "key string, started double, ended double, n_events long", "firsts array<long>, lasts array<long>, counts array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def replayed(stream: DataFrame, label: str) -> DataFrame:
    """All that a stream over finite sources appends, run to its end and written to the shared folder."""
    spark = stream.sparkSession
    folder = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def windowed_counts(events: DataFrame, key: str, at: str, width: str, late: str) -> DataFrame:
    """Counts by key and event-time window, final once the watermark has passed the window."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def deduplicated(events: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """The first arrival of each key within the watermark; later copies are dropped."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def pending_signals(rows: DataFrame, horizon: int, late: int = 5, idle: str | None = None) -> DataFrame:
    """Signals and bars of one stream to outcomes: sid, outcome, days, emitted as soon as they are decided.

    rows: ticker, kind (signal, bar), sess_no, sid, target, stop, high, low. A bar may come before or after others, and
    twice; the target wins a day that has both. A signal expires when the bars of all ``horizon`` sessions after it are
    there. A session whose bar doesn't come is given up once bars have come ``late`` sessions after the horizon, and counts
    as one without a hit. A ticker that is silent for ``idle`` of processing time, if given, gives its undecided signals as OPEN
    and is forgotten (such a stream never ends, so it can't be one that only takes what is available now). So the state is the bars of at most ``horizon + late`` sessions before the newest, and undecided signals.
    """
    wait = pd.Timedelta(idle) if idle else None

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sids, nos, targets, stops, bar_nos, highs, lows = (list(x) for x in (state.get if state.exists else ([], [], [], [], [], [], [])))
        bars = {int(n): (h, lo) for n, h, lo in zip(bar_nos, highs, lows)}
        if state.hasTimedOut:
            state.remove()
            if sids:
                yield pd.DataFrame({"sid": sids, "outcome": ["OPEN"] * len(sids), "days": [None] * len(sids)})
            return
        signals = {s: (int(n), t, x) for s, n, t, x in zip(sids, nos, targets, stops)}
        for b in batches:
            for r in b.itertuples():
                if r.kind == "signal":
                    signals[r.sid] = (int(r.sess_no), r.target, r.stop)
                else:
                    bars[int(r.sess_no)] = (r.high, r.low)
        out = []
        newest = max(bars, default=0)
        for sid, (no, target, stop) in list(signals.items()):
            verdict = None
            for d in range(1, horizon + 1):
                if no + d not in bars and newest < no + horizon + late:
                    break
                high, low = bars.get(no + d, (float("-inf"), float("inf")))
                if high >= target:
                    verdict = ("WON", d)
                elif low <= stop:
                    verdict = ("LOST", d)
                elif d == horizon:
                    verdict = ("EXPIRED", d)
                if verdict:
                    break
            if verdict:
                out.append((sid, *verdict))
                del signals[sid]
        bars = {n: v for n, v in bars.items() if n > newest - horizon - late}
        order = sorted(signals.items())
        kept = sorted(bars.items())
        state.update(([s for s, _ in order], [float(v[0]) for _, v in order], [float(v[1]) for _, v in order], [float(v[2]) for _, v in order], [float(n) for n, _ in kept], [float(v[0]) for _, v in kept], [float(v[1]) for _, v in kept]))
        if wait:
            state.setTimeoutDuration(int(wait.total_seconds() * 1000))
        if out:
            yield pd.DataFrame(out, columns=["sid", "outcome", "days"])

    ship(rows.sparkSession)
    return rows.where("ticker is not null").groupBy("ticker").applyInPandasWithState(
        step, "sid string, outcome string, days int",
        "sids array<string>, nos array<double>, targets array<double>, stops array<double>, bar_nos array<double>, highs array<double>, lows array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout,
    )
