"""Narrative runs as a state machine in a stream.

A theme's documents join its most similar run, if one of its ``RECENT`` latest open ones is similar enough, and else
begin a new one.  A run is active, cools after ``COOLING`` hours without a document and closes after
``CLOSING``; a document brings a cooling run back.  The state of a theme is a map of its open runs and a counter; a timer
for the next change of any run cools and closes them as event time goes on, so the state leaves when a theme is
quiet.

Documents of a theme are taken in the order of time and id within a batch; a document later than the watermark is
dropped by Spark's rule.  Time is event time: a run's age at a document counts by that document's time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

# Fixed values
SIMILAR, RATE, RECENT = 0.78, 0.2, 5
COOLING, CLOSING = 2, 24
HOUR = 3600.0
ACTIVE, COOL, CLOSED = "active", "cooling", "closed"
EVENTS = "theme_id long, doc_id long, at timestamp, run long, status string, doc_count long, what string"
RUN = "status string, centroid array<double>, started_at double, last_at double, doc_count long"


def status_at(last: float, now: float) -> str:
    """What a run without a document since last is at now."""
    return CLOSED if now - last > CLOSING * HOUR else COOL if now - last > COOLING * HOUR else ACTIVE


def nearest_run(runs: dict[int, dict], vector: np.ndarray, now: float) -> int | None:
    """The most similar of the latest open runs; of equal ones the later run."""
    best, chosen = SIMILAR, None
    for k, r in sorted(runs.items(), key=lambda x: (-x[1]["last_at"], x[0]))[:RECENT]:
        if status_at(r["last_at"], now) == CLOSED:
            continue
        c = np.asarray(r["centroid"])
        norms = np.linalg.norm(c) * np.linalg.norm(vector)
        s = float(c @ vector / norms) if norms else 0.0
        if s > best or (s == best and chosen is None):
            best, chosen = s, k
    return chosen


def joined(run: dict | None, vector: np.ndarray, now: float) -> dict:
    """A run after a document, or a new one."""
    if run is None:
        return {"status": ACTIVE, "centroid": vector.tolist(), "started_at": now, "last_at": now, "doc_count": 1}
    centre = (1 - RATE) * np.asarray(run["centroid"]) + RATE * vector
    return run | {"status": ACTIVE, "centroid": centre.tolist(), "last_at": max(now, run["last_at"]), "doc_count": run["doc_count"] + 1}


class NarrativeRuns(StatefulProcessor):
    """State of a theme: its open runs by number, and the number of the next one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getMapState("runs", "run long", RUN)
        self.next = handle.getValueState("next", "run long")

    def _open(self) -> dict[int, dict]:
        names = ("status", "centroid", "started_at", "last_at", "doc_count")
        return {k[0]: dict(zip(names, v, strict=True)) for k, v in self.runs.iterator()}

    def _put(self, key: int, run: dict) -> None:
        self.runs.updateValue((key,), (run["status"], [float(x) for x in run["centroid"]], run["started_at"], run["last_at"], run["doc_count"]))

    def _aged(self, theme: int, runs: dict[int, dict], now: float) -> list[tuple]:
        """Cools and closes what has been quiet; the changes."""
        told = []
        for k, r in sorted(runs.items()):
            status = status_at(r["last_at"], now)
            if status != r["status"] and (status == CLOSED or r["status"] == ACTIVE):
                told.append((theme, None, r["last_at"] + (CLOSING if status == CLOSED else COOLING) * HOUR, k, status, r["doc_count"], "aged"))
                if status == CLOSED:
                    self.runs.removeKey((k,))
                    del runs[k]
                else:
                    r["status"] = status
                    self._put(k, r)
        return told

    def _timer(self, runs: dict[int, dict]) -> None:
        """One timer: for the next change of any run."""
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        due = [r["last_at"] + (CLOSING if r["status"] == COOL else COOLING) * HOUR for r in runs.values()]
        if due:
            self.handle.registerTimer(int(min(due) * 1000) + 1)

    @staticmethod
    def _frame(told: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(told, columns=["theme_id", "doc_id", "at", "run", "status", "doc_count", "what"])
        out["at"] = pd.to_datetime(out["at"], unit="s")
        return out.astype({"doc_id": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs, told = self._open(), []
        number = self.next.get()[0] if self.next.exists() else 0
        frame = pd.concat([*rows]).sort_values(["at", "doc_id"], kind="stable")
        for doc, at, vector in zip(frame["doc_id"].tolist(), frame["at"].map(pd.Timestamp.timestamp).tolist(), frame["embedding"].tolist(), strict=True):
            v = np.asarray(vector, float)
            told += self._aged(key[0], runs, at)
            k = nearest_run(runs, v, at)
            if k is None:
                k, number = number, number + 1
            what = "joined" if k in runs else "begun"
            runs[k] = joined(runs.get(k), v, at)
            self._put(k, runs[k])
            told.append((key[0], int(doc), at, k, ACTIVE, runs[k]["doc_count"], what))
        self.next.update((number,))
        self._timer(runs)
        yield self._frame(told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        runs = self._open()
        told = self._aged(key[0], runs, expiredTimerInfo.getExpiryTimeInMs() / 1000)
        self._timer(runs)
        if told:
            yield self._frame(told)

    def close(self) -> None:
        pass


def narrative_runs(docs: DataFrame, late: str = "10 minutes") -> DataFrame:
    """What happens to runs: theme_id, doc_id (null for ageing), at, run, status, doc_count, what (begun, joined, aged) of a stream (theme_id, doc_id, at, embedding).

    The session needs the RocksDB state store (``STATE_STORE``).
    """
    rows = docs.filter("theme_id is not null and at is not null and doc_id is not null and size(embedding) > 0").withWatermark("at", late)
    return rows.groupBy("theme_id").transformWithStateInPandas(NarrativeRuns(), StructType.fromDDL(EVENTS), "Append", "EventTime").select("theme_id", "doc_id", F.col("at"), "run", "status", "doc_count", "what")


STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
