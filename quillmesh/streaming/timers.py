"""Stream forms with timers and expiring state: debounce with deletions, and sessions of tool calls.

Both keep a row of state for what is open, not arrays for each key that are rewritten with every batch. They need the RocksDB state store,
see use_rocksdb.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillmesh.streaming.awareness import MOST_NOVEL, MOST_TOTAL, NOTE_FROM, OUT, WARN_FROM

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Debounce(StatefulProcessor):
    """Open events of a path by time and id, and one timer: for when the first of them is settled.

    An event is settled once the watermark has passed its gap, as nothing can come between any more. It fires unless another follows
    within the gap. An unlink is told at once, and stays open like the others, so that late changes before it are dropped.
    """

    def __init__(self, key: str, kind: str, gap_us: int):
        self.key, self.kind, self.gap = key, kind, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "us long, event_id long", "kind string")

    def _timer(self, events: list[tuple[int, int]]) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if events:
            self.handle.registerTimer(-(-(events[0][0] + self.gap) // 1000))

    def _events(self) -> list[tuple[int, int]]:
        return sorted(tuple(k) for k in self.open.keys())

    def _rows(self, key: tuple, told: list[tuple[int, str]]) -> Iterator[pd.DataFrame]:
        if told:
            yield pd.DataFrame({self.key: [key[0]] * len(told), "event_id": [e for e, _ in told], "action": [a for _, a in told]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        told = []
        for frame in rows:
            for us, event_id, kind in zip(frame["us"], frame["event_id"], frame["kind"], strict=True):
                self.open.updateValue((int(us), int(event_id)), (kind,))
                if kind == "unlink":
                    told.append((int(event_id), "removed"))
        self._timer(self._events())
        yield from self._rows(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events, told, passed = self._events(), [], timerValues.getCurrentWatermarkInMs() * 1000
        settled = [e for e in events if e[0] + self.gap <= passed]
        for i, e in enumerate(settled):
            follows = events[i + 1][0] - e[0] < self.gap if i + 1 < len(events) else False
            if not follows and self.open.getValue(e)[0] != "unlink":
                told.append((e[1], "indexed"))
        for e in settled:
            self.open.removeKey(e)
        self._timer(events[len(settled) :])
        yield from self._rows(key, told)

    def close(self) -> None:
        pass


def debounce_stream(events: DataFrame, key: str, gap_seconds: float, kind: str = "string") -> DataFrame:
    """What debounce_unlink tells of a batch, for a stream of key, event_id, kind and ts with a watermark on ts. kind: the key's type."""
    open_events = events.selectExpr(key, "event_id", "kind", "ts", "unix_micros(cast(ts as timestamp)) AS us")
    processor = _Debounce(key, kind, round(gap_seconds * 1e6))
    return open_events.groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, event_id long, action string", "append", "eventTime")


class _Calls(StatefulProcessor):
    """Counters of a session, and a row for each of its calls, which is forgotten when it wasn't made for ttl_ms.

    A synchronization begins a new epoch: what was answered before it is no answer any more, but stays known as seen.
    """

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", "total long, novel long, epoch long", self.ttl)
        self.calls = handle.getMapState("calls", "pair string", "epoch long, ended boolean", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        total, novel, epoch = self.counters.get() if self.counters.exists() else (0, 0, 0)
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples(index=False):
            target = None if pd.isna(r.target) else r.target
            pair = (f"{r.tool}|{target or ''}",)
            known = self.calls.getValue(pair) if self.calls.containsKey(pair) else None
            if r.is_sync:
                epoch, state = epoch + 1, "sync"
                self.calls.updateValue(pair, known or (-1, False))
            elif known and known[0] == epoch:
                state = "finalize" if known[1] else "cache_hit"
            else:
                total += 1
                novel += known is None and target is not None
                ended = total > MOST_TOTAL or novel > MOST_NOVEL
                state = "finalize" if ended else "synthesize_warning" if novel > WARN_FROM else "synthesize_note" if novel > NOTE_FROM else "explore"
                self.calls.updateValue(pair, (epoch, ended))
            out.append((key[0], r.event_id, total, novel, state))
        self.counters.update((total, novel, epoch))
        yield pd.DataFrame(out, columns=["session", "event_id", "total", "novel", "state"])

    def close(self) -> None:
        pass


def label_sessions(calls: DataFrame, ttl_ms: int = 86_400_000) -> DataFrame:
    """What label_calls tells of a batch, for a stream; what a session hasn't touched for ttl_ms is forgotten."""
    return calls.groupBy("session").transformWithStateInPandas(_Calls(ttl_ms), OUT, "append", "processingTime")
