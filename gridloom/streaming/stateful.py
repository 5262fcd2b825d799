"""Streaming forms: frame pairs, change detection, periods and per-point state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class FrameRing:
    """Two active frames and at most one read ahead, by index; `load` fetches a frame."""

    def __init__(self, load: Callable[[int], object], preload: bool = True):
        self.load, self.ahead, self.slots = load, preload, {}
        self.active: tuple[int, int] | None = None

    def update(self, first: int, second: int, following: int | None = None) -> bool:
        """Makes first and second active; whether anything changed."""
        changed = self.active != (first, second)
        if changed:
            self.slots = {k: v for k, v in self.slots.items() if k in (first, second, following)}
            for k in (first, second):
                if k not in self.slots:
                    self.slots[k] = self.load(k)
            self.active = (first, second)
        if self.ahead and following is not None and following not in self.slots:
            self.slots[following] = self.load(following)
        return changed

    def pair(self) -> tuple[object, object]:
        return self.slots[self.active[0]], self.slots[self.active[1]]


def tumbling(events: DataFrame, ts: str, period: str, late: str, by: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates by tumbling window with a watermark; the same on a batch or a stream."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, period), *by).agg(*aggregates).withColumn("start", F.col("window.start")).drop("window")


def due(step: Column, every: int) -> Column:
    """Whether period-gated work falls on this step."""
    return step % every == 0


def changed_frames(events: DataFrame, key: str, frame: str) -> DataFrame:
    """Rows whose frame differs from the one the key had before (stateful, for streams in order)."""

    def run(k: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for d in rows:
            keep = []
            for v in d[frame]:
                keep.append(v != last)
                last = v
            yield d[keep]
        if last is not None:
            state.update((int(last),))

    return events.groupBy(key).applyInPandasWithState(run, events.schema, "last long", "append", "NoTimeout")


def running_state(events: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total, peak) after each micro-batch: state that persists across batches by key."""
    schema = f"{key} {dict(events.dtypes)[key]}, n long, total double, peak double"

    def run(k: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total, peak = state.get if state.exists else (0, 0.0, float("-inf"))
        for d in rows:
            v = d[value].dropna()
            n, total = n + len(v), total + float(v.sum())
            peak = max(peak, float(v.max())) if len(v) else peak
        state.update((n, total, peak))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total], "peak": [peak]})

    return events.groupBy(key).applyInPandasWithState(run, schema, "n long, total double, peak double", "update", "NoTimeout")


class Commands:
    """Commands of a polled text file: 'terminate [frame]', 'sort', 'render'; unknown ones are ignored."""

    def __init__(self):
        self.stop_at: int | None = None
        self.pending: set[str] = set()

    def feed(self, text: str, now: int) -> None:
        for line in text.splitlines():
            word, *rest = line.split() or [""]
            if word == "terminate":
                self.stop_at = int(rest[0]) if rest and rest[0].isdigit() else now
            elif word in ("sort", "render"):
                self.pending.add(word)

    def stops(self, frame: int) -> bool:
        return self.stop_at is not None and frame >= self.stop_at
