"""Keyed state over the event log: steps that outlive a batch, and runs' status as it goes on.

Both processors keep one small value a run, whatever the number of events, and
give the rows that a batch adds.  Rows of one batch are taken in order of time
and event id; files should come in order of time, as a log's do.  Null runs are
a run of their own; null events change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What the state store of these processors needs to be set to.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
STEPS = "run_id long, event_id long, ended_by string, duration_ms long, failed boolean"
CHANGES = "run_id long, event_id long, status string, n_events long"


def _in_order(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    rows = pd.concat(list(parts), ignore_index=True)
    return rows.sort_values(["at", "event_id"], kind="stable")


class Steps(StatefulProcessor):
    """Pairs each start with the run's next end; a later start takes the place of one that is still open."""

    def __init__(self, starts: str, ends: tuple[str, ...], failures: tuple[str, ...]):
        self.starts, self.ends, self.failures = starts, ends, failures

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "event_id long, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        begun = self.open.get() if self.open.exists() else None
        done = []
        for event_id, at, event in _in_order(rows)[["event_id", "at", "event"]].itertuples(index=False):
            if event == self.starts:
                begun = (int(event_id), int(at))
            elif event in self.ends and begun is not None:
                done.append((key[0], begun[0], event, (int(at) - begun[1]) // 1000, event in self.failures))
                begun = None
        if begun is None:
            self.open.clear()
        else:
            self.open.update(tuple(begun))
        yield pd.DataFrame(done, columns=["run_id", "event_id", "ended_by", "duration_ms", "failed"])

    def close(self) -> None:
        pass


class Status(StatefulProcessor):
    """A row whenever a run's status changes: running until it completes or fails, and running again after a new start."""

    def __init__(self, completed: str, failed: str):
        self.of = {completed: "completed", failed: "failed"}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "status string, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, n = self.last.get() if self.last.exists() else ("not_started", 0)
        changes = []
        for event_id, event in _in_order(rows)[["event_id", "event"]].itertuples(index=False):
            if event is None:
                continue
            n += 1
            now = self.of.get(event, "running")
            if now != status:
                status = now
                changes.append((key[0], int(event_id), status, n))
        self.last.update((status, int(n)))
        yield pd.DataFrame(changes, columns=["run_id", "event_id", "status", "n_events"])

    def close(self) -> None:
        pass


def steps(events: DataFrame, starts: str, ends: tuple[str, ...], failures: tuple[str, ...] = ()) -> DataFrame:
    """run_id, event_id, ended_by, duration_ms, failed of every step of a stream (run_id, event_id, at in microseconds, event)."""
    return events.groupBy("run_id").transformWithStateInPandas(Steps(starts, ends, failures), STEPS, "append", "None")


def status_changes(events: DataFrame, completed: str, failed: str) -> DataFrame:
    """run_id, event_id, status, n_events at every change of a run's status."""
    return events.groupBy("run_id").transformWithStateInPandas(Status(completed, failed), CHANGES, "append", "None")
