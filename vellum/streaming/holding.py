"""Children held until their parent comes: state per parent key, with timers.

A child waits under the key of its parent. When the parent arrives, all that wait are
linked, and so is each child that comes later; a child that nobody claims within
``EXPIRY_DAYS`` of its own first sight expires. A failed attempt counts as a retry,
and the second one, or one with the reason of the last, blocks the child.

Events have ``key``, ``ts``, ``kind`` (child, parent, failure), ``child`` and
``reason``. Rows come out as (key, child, status, retries): linked, expired, blocked.
Timers follow event time, so a late row that the watermark has passed is dropped by
Spark before it gets here. A child seen twice keeps its first sight; a failure of an
unknown child, and rows without a key, do nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EXPIRY_DAYS = 180
_DAY = 86_400_000
OUT = "key string, child string, status string, retries int"


class Holding(StatefulProcessor):
    """State: whether the parent is there, and per waiting child when it was first seen, its retries and last reason."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parent = handle.getValueState("parent", "seen boolean")
        self.waiting = handle.getMapState("waiting", "child string", "since long, retries int, reason string")

    def _row(self, key, child, status, retries) -> tuple:
        return key[0], child, status, retries

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        events = pd.concat(list(rows)).sort_values(["ts", "kind", "child"], kind="stable")
        for e in events.itertuples(index=False):
            at = int(pd.Timestamp(e.ts).timestamp() * 1000)
            if e.kind == "parent":
                self.parent.update((True,))
                waiting = sorted((k[0], v[1]) for k, v in self.waiting.iterator())
                out += [self._row(key, child, "linked", retries) for child, retries in waiting]
                for child, _ in waiting:
                    self.waiting.removeKey((child,))
            elif e.kind == "child" and not self.waiting.containsKey((e.child,)):
                if self.parent.exists():
                    out.append(self._row(key, e.child, "linked", 0))
                else:
                    self.waiting.updateValue((e.child,), (at, 0, ""))
                    self.handle.registerTimer(at + EXPIRY_DAYS * _DAY)
            elif e.kind == "failure" and self.waiting.containsKey((e.child,)):
                since, retries, last = self.waiting.getValue((e.child,))
                reason = e.reason or ""
                if retries >= 1 and ((reason and reason == last) or retries >= 2):
                    out.append(self._row(key, e.child, "blocked", retries))
                    self.waiting.removeKey((e.child,))
                else:
                    self.waiting.updateValue((e.child,), (since, retries + 1, reason))
        yield pd.DataFrame(out, columns=["key", "child", "status", "retries"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        gone = sorted((k[0], v[1]) for k, v in self.waiting.iterator() if v[0] + EXPIRY_DAYS * _DAY <= due)
        for child, _ in gone:
            self.waiting.removeKey((child,))
        yield pd.DataFrame([self._row(key, child, "expired", retries) for child, retries in gone], columns=["key", "child", "status", "retries"])

    def close(self) -> None:
        pass


def held(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The outcomes of a stream of events; append mode, with the RocksDB state store."""
    keyed = events.filter(F.col("key").isNotNull()).withWatermark("ts", late)
    return keyed.groupBy("key").transformWithStateInPandas(Holding(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
