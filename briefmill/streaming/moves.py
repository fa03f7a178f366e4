"""Records of files by content, through moves and copies, and claims of work: stream plans that also run over static rows."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from briefmill.sources import stored

#: state with maps and timers needs this store
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "hash string, ts timestamp, path string, old_path string, status string, why string"


COLUMNS = ["hash", "ts", "path", "old_path", "status", "why"]


class Content:
    """One content: the path, status and filing of its record, and the paths at which it lies, with the time since when."""

    def __init__(self, name: str, held: str | None = None) -> None:
        self.name = name
        self.path, self.status, self.filed, self.live = json.loads(held) if held else (None, None, False, {})

    def held(self) -> str:
        return json.dumps([self.path, self.status, self.filed, self.live])

    def lost(self) -> bool:
        """Whether the record's path is gone while the content lies elsewhere."""
        return self.path is not None and self.path not in self.live and bool(self.live)

    def move(self, path: str, ts) -> tuple:
        if self.status == "ERROR":
            self.status = "QUEUED" if self.filed else "DISCOVERED"
        old, self.path = self.path, path
        return self.name, ts, path, old, self.status, "moved"

    def heal(self, ts) -> list[tuple]:
        return [self.move(min(self.live, key=lambda p: (self.live[p], p)), ts)] if self.lost() else []

    def take(self, kind: str, path: str, ts) -> list[tuple]:
        if kind == "gone":
            self.live.pop(path, None)
        elif kind == "add":
            self.live.setdefault(path, ts.isoformat())
            if self.path is None:
                self.path, self.status = path, "DISCOVERED"
                return [(self.name, ts, path, None, "DISCOVERED", "new")]
            if self.path != path and self.path not in self.live:
                return [self.move(path, ts)]
        elif self.path is not None:
            self.filed |= kind == "filed"
            self.status = "ERROR" if kind == "error" else self.status
        return []


class _Stateful(StatefulProcessor):
    """A content in the state of its hash; a timer heals what no later file does."""

    def __init__(self, grace: dt.timedelta) -> None:
        self.grace = grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("content", "held string")

    def _content(self, key) -> Content:
        return Content(key[0], self.state.get()[0] if self.state.exists() else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        content, out = self._content(key), []
        for e in pd.concat(list(rows)).sort_values(["ts", "seq"]).itertuples():  # of one content in one batch of the stream
            out += content.take(e.kind, e.path, e.ts)
        self.state.update((content.held(),))
        if content.lost():
            self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs(), 0) + int(self.grace.total_seconds() * 1000))
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        content = self._content(key)
        out = content.heal(pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"))
        self.state.update((content.held(),))
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in the order of (hash, ts, seq): the content at hand is all that is kept."""
    content = None
    for batch in batches:
        out = []
        for e in batch.itertuples():
            if content is None or content.name != e.hash:
                content = Content(e.hash)
            out += content.take(e.kind, e.path, e.ts)
        yield pd.DataFrame(out, columns=COLUMNS)


def tracked(events: DataFrame, grace: dt.timedelta = dt.timedelta(minutes=5)) -> DataFrame:
    """Changes of records from (hash, path, kind, ts, seq), where kind is add, gone, error or filed: ``hash``, ``ts``,
    ``path``, ``old_path``, ``status``, ``why`` (new or moved).

    The first path of a content makes its record. A copy elsewhere changes nothing while the record's path is there; once
    that is gone, the next path at which the content turns up takes the record over, or after ``grace`` the oldest
    that is left. A record that moves keeps its status; one in error is queued again if it was filed, else discovered.
    Copies that come first and go again are so healed, as are renames. Events of a content in one batch are taken by
    (ts, seq); replays of events that are done change nothing. A stream needs the state store ``STORE`` and a watermark
    on ``ts``. Static rows are sorted within their partitions and walked, with one content in memory; there is no later time
    that would end a grace.
    """
    rows = events.select("hash", "path", "kind", "ts", F.col("seq").cast("long").alias("seq")).where("hash is not null and path is not null")
    if events.isStreaming:
        return rows.groupBy("hash").transformWithStateInPandas(_Stateful(grace), OUT, "append", "eventtime")
    return rows.repartition("hash").sortWithinPartitions("hash", "ts", "seq").mapInPandas(_walk, OUT)


def claim(asks: DataFrame, known: DataFrame, lease_seconds: int = 600) -> DataFrame:
    """``known`` (id, status, owner, until) once the workers of ``asks`` (id, worker, at) have claimed: the first to ask, of
    equal times the smaller name, has an id that is QUEUED, or RUNNING with a lease that ended by then.

    Guarded by the state that was read, so asks that are replayed against the result change nothing before the
    lease ends. Ids that are null, unknown or in other states are no one's.
    """
    fits = asks.join(known.select("id", "status", "until"), "id").where((F.col("status") == "QUEUED") | ((F.col("status") == "RUNNING") & (F.col("until") <= F.col("at"))))
    first = fits.groupBy("id").agg(F.min(F.struct("at", "worker")).alias("w"))
    until = F.timestamp_seconds(F.unix_micros(F.col("w.at").cast("timestamp")) / 1e6 + lease_seconds).cast(known.schema["until"].dataType)
    return stored.stamped(known, first.select("id", F.lit("RUNNING").alias("status"), F.col("w.worker").alias("owner"), until.alias("until")), "id")
