"""Snapshots of investigations as a stateful stream: entries in map state, and a timer for those that stall."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.snapshots import RUNNING, STALLED, writes
from .jobs import STALL_MS

OUTPUT = "inv long, part string, key string, field string, value string, seq long"
#: Keyed state is kept in RocksDB: only entries that events write are read and written.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Snapshot(StatefulProcessor):
    """Entries of one investigation; gives those that a batch changes.

    An entry's value is that of its largest seq, whatever the order in which events
    come; an investigation without an event for ``stall_ms`` of processing time
    fails, unless it has ended.
    """

    def __init__(self, stall_ms: int | None):
        self.stall_ms = stall_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "part string, key string, field string", "value string, seq long")
        # First evidence, last error and its first word of whether that came with evidence.
        self.marks = handle.getValueState("marks", "evidence long, failed long, ended boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        evidence, failed, ended = self.marks.get() if self.marks.exists() else (None, None, False)
        began, before, out = not self.marks.exists(), (evidence, failed), {}
        for frame in rows:
            for part, name, field, value, seq in zip(frame["part"], frame["key"], frame["field"], frame["value"], frame["seq"]):
                if part is None or pd.isna(part):
                    continue
                value, seq = None if pd.isna(value) else value, int(seq)
                if part == "evidence":
                    evidence = seq if evidence is None else min(evidence, seq)
                elif part == "error" and field == "code":
                    failed = seq if failed is None else max(failed, seq)
                elif part == "phase":
                    ended = True
                place = (part, name, field)
                old = self.entries.getValue(place) if self.entries.containsKey(place) else None
                if old is None or (seq < old[1] if part == "id" else seq > old[1]):
                    self.entries.updateValue(place, (value, seq))
                    out[place] = (value, seq)
        if failed is not None and (evidence, failed) != before:
            out["error", "", "partial"] = (str(evidence is not None and evidence < failed).lower(), failed)
        if began and not ended:
            out["phase", "", ""] = (RUNNING, None)
        self.marks.update((evidence, failed, ended))
        if self.stall_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if not ended:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stall_ms)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        evidence, failed, ended = self.marks.get()
        if not ended:
            self.marks.update((evidence, failed, True))
            yield self._frame(key, {
                ("phase", "", ""): ("failed", None), ("error", "", "code"): (STALLED, None), ("error", "", "partial"): (str(evidence is not None).lower(), None),
            })

    def close(self) -> None:
        pass

    @staticmethod
    def _frame(key, out: dict) -> pd.DataFrame:
        rows = [(key[0], *place, value, seq) for place, (value, seq) in out.items()]
        frame = pd.DataFrame(rows, columns=["inv", "part", "key", "field", "value", "seq"])
        return frame.astype({"seq": "Int64"})


def snapshots(stream: DataFrame, stall_ms: int | None = STALL_MS) -> DataFrame:
    """Changed entries (inv, part, key, field, value, seq) after each batch of events, as operators.snapshots gives them in the end.

    Without ``stall_ms`` there are no timers; a query with timers goes on when its
    input is at an end, whatever its trigger.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    written = writes(stream.withColumn("seq", stream["seq"].cast("long")), keep_silent=True)
    return written.groupBy("inv").transformWithStateInPandas(Snapshot(stall_ms), OUTPUT, "Append", "None" if stall_ms is None else "ProcessingTime")
