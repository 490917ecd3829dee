"""Streams with state of their own: the newest fingerprints of a mailbox, and harvests at most once an hour.

State is kept by Spark's RocksDB store, which transformWithState needs: set
spark.sql.streaming.stateStore.providerClass to ROCKSDB before the first run. It restarts from the checkpoint.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NEWEST = 5000


class _Newest(StatefulProcessor):
    """held: fingerprint -> its number; queue: number -> fingerprint; ends: the least number held and the next one."""

    def __init__(self, fp, order, cap):
        self.fp, self.order, self.cap = fp, list(order), cap

    def init(self, handle):
        self.held = handle.getMapState("held", "fp string", "n long")
        self.queue = handle.getMapState("queue", "n long", "fp string")
        self.ends = handle.getValueState("ends", "first long, next long")

    def handleInputRows(self, key, rows, timerValues):
        first, following = self.ends.get() if self.ends.exists() else (0, 0)
        part = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        keep = []
        for fp in part[self.fp]:
            if fp is None or fp != fp or fp == "":
                keep.append(True)
                continue
            new = not self.held.containsKey((fp,))
            keep.append(new)
            if new:
                self.held.updateValue((fp,), (following,))
                self.queue.updateValue((following,), (fp,))
                following += 1
                if following - first > self.cap:
                    self.held.removeKey(tuple(self.queue.getValue((first,))))
                    self.queue.removeKey((first,))
                    first += 1
        self.ends.update((first, following))
        yield part[keep]

    def close(self):
        pass


def unseen_newest(stream, key, fp="fp", order=("ts",), cap=NEWEST):
    """Rows whose fingerprint isn't among the `cap` that were last added to those of their key; rows without one pass.

    A fingerprint is added when it passes, and goes when `cap` newer ones have been added: a repeat doesn't renew it.
    Rows of a batch are taken in order; over any split into batches in that order the result is that of
    ingest.unseen_newest. key: column names, such as a mailbox; a key's rows of one batch are held in one task, its
    state is `cap` fingerprints.
    """
    key = [key] if isinstance(key, str) else list(key)
    return stream.groupBy(*key).transformWithStateInPandas(_Newest(fp, order, cap), stream.schema, "Append", "None")


class _Harvest(StatefulProcessor):
    """waiting: turns that came since the last harvest; at: when that was (ms)."""

    def __init__(self, key, schema, order, gap_ms, time, names):
        self.key, self.schema, self.order, self.gap, self.time, self.names = key, schema, order, gap_ms, time, names

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.at = handle.getValueState("at", "ms long")

    def _given(self, key, rows, now):
        out = pd.DataFrame(rows, columns=self.names).sort_values(self.order, kind="stable")
        out.insert(0, self.key, key[0])
        out["harvest_at"] = pd.to_datetime(now, unit="ms")
        return out

    def handleInputRows(self, key, rows, timerValues):
        new = [tuple(r) for part in rows for r in part[self.names].astype(object).itertuples(index=False)]
        now = max(int(r[self.names.index(self.time)].timestamp() * 1000) for r in new) if self.time else timerValues.getCurrentProcessingTimeInMs()
        last = self.at.get()[0] if self.at.exists() else None
        if last is None or now - last >= self.gap:
            new = [*(tuple(r) for r in self.waiting.get()), *new] if self.waiting.exists() else new
            self.waiting.clear()
            self.at.update((now,))
            yield self._given(key, new, now)
            return
        if not self.waiting.exists():
            self.handle.registerTimer(last + self.gap)
        self.waiting.appendList(new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.waiting.exists():  # else a batch came when the hour was over already, and took them along
            rows, now = [tuple(r) for r in self.waiting.get()], expiredTimerInfo.getExpiryTimeInMs()
            self.waiting.clear()
            self.at.update((now,))
            yield self._given(key, rows, now)

    def close(self):
        pass


def harvests(turns, key="session", order="turn", least_seconds=3600, time=None):
    """Turns (key, order, ...) with harvest_at, as they are due: a session's first at once, then what came since, at most once an hour.

    What comes within the hour waits in the session's state until a timer fires at its end, or until the next turn after
    it: every turn is given once, also over restarts. The clock is that of processing; with `time`, a timestamp column
    with a watermark, it is that of events (and what comes later than the watermark is lost, as in any such stream).
    """
    rest = StructType([f for f in turns.schema.fields if f.name != key])
    names = rest.names
    out = StructType([turns.schema[key], *rest.fields]).add("harvest_at", "timestamp")
    mode = "EventTime" if time else "ProcessingTime"
    return turns.groupBy(key).transformWithStateInPandas(_Harvest(key, rest, order, least_seconds * 1000, time, names), out, "Append", mode)
