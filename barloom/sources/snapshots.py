"""Snapshots of symbols as a Spark data source: one JSON document a symbol; what can't be read becomes a row with its reason.

Register with ``spark.dataSource.register(SnapshotSource)`` and read with
``spark.read.format("snapshots").option("symbols", "A,B").load(folder)``. The documents lie in a folder of any file system
that pyarrow knows, ``A.json`` and so on; a reader that asks a service overrides ``SnapshotReader.document``.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Reading(NamedTuple):
    """What became of a symbol; ``reason`` is None, missing, malformed, unreachable or unexpected."""

    payload: str | None
    reason: str | None
    detail: str | None
    tries: int


class Patience:
    """The time that a partition's symbols may wait in all, so that an outage can't hold a task for long.

    Waits are drawn evenly up to a limit that grows with the tries (full jitter), so that tasks don't return in step.
    """

    def __init__(self, seconds: float, first: float = 0.5, seed: int | None = None, sleep: Callable[[float], None] = time.sleep):
        self.left, self.first, self.sleep, self.random = seconds, first, sleep, random.Random(seed)

    def wait(self, tries: int) -> bool:
        """Wait before the next try; False, at once, if the time is used up."""
        pause = self.random.uniform(0, self.first * 2.0**tries)
        if pause > self.left or self.left <= 0:
            return False
        self.left -= pause
        self.sleep(pause)
        return True


def read_patiently(document: Callable[[], str], patience: Patience) -> Reading:
    """The document as compact JSON. Only failures of the way to it are tried again: what isn't there, isn't JSON or fails for
    a reason nobody foresaw won't get better."""
    tries = 0
    while True:
        tries += 1
        try:
            return Reading(json.dumps(json.loads(document())), None, None, tries)
        except (FileNotFoundError, KeyError) as e:
            return Reading(None, "missing", repr(e), tries)
        except ValueError as e:
            return Reading(None, "malformed", repr(e), tries)
        except OSError as e:
            if not patience.wait(tries):
                return Reading(None, "unreachable", repr(e), tries)
        except Exception as e:  # noqa: BLE001 - a symbol's failure is a row, not the job's end
            return Reading(None, "unexpected", repr(e), tries)


class SnapshotSource(DataSource):
    """symbol, payload (JSON text or null), reason, detail, tries; a partition for each group of symbols.

    Options: symbols (by commas; repeated ones count once), group (symbols of a partition), patience (seconds).
    """

    @classmethod
    def name(cls) -> str:
        return "snapshots"

    def schema(self) -> str:
        return "symbol string, payload string, reason string, detail string, tries int"

    def reader(self, schema) -> DataSourceReader:
        return SnapshotReader(self.options)


class SnapshotReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options.get("path", "").rstrip("/")
        self.symbols = list(dict.fromkeys(filter(None, map(str.strip, options.get("symbols", "").split(",")))))
        self.group, self.patience = max(1, int(options.get("group", "50"))), float(options.get("patience", "30"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.symbols[i : i + self.group]) for i in range(0, max(1, len(self.symbols)), self.group)]

    def document(self, symbol: str) -> str:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)
        with system.open_input_stream(f"{folder}/{symbol}.json") as f:
            return f.read().decode("utf-8")

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        patience = Patience(self.patience)
        for symbol in partition.value:
            yield symbol, *read_patiently(lambda s=symbol: self.document(s), patience)
