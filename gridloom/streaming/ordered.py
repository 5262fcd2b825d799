"""Changes of frame in the order of event time, for streams whose rows come late and out of order.

Rows wait in state until the watermark has passed them; a timeout for the earliest one then releases them in the order of
time, and those come out whose frame differs from the one before. So a stream gives what a batch fold over
the ordered rows gives, in whatever order and batches the rows come, as long as they are at most `late` behind.
A key that has had no row for `idle` of event time forgets its frame.

Python is called for a shard of keys, not for a key: Spark takes some milliseconds for each call, whatever it does. A batch
rewrites the state of the shards it touches, which is their waiting rows and one row a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_COLUMNS = ["key", "us", "frame"]
_STATE = "waiting binary, last binary"  # rows of _COLUMNS in Arrow's stream format; of the released ones the last of each key


def _pack(rows: pd.DataFrame) -> bytes | None:
    if rows.empty:
        return None
    table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(packed: bytes | None) -> list[pd.DataFrame]:
    return [pa.ipc.open_stream(packed).read_pandas()] if packed else []


def _changes(idle_us: int | None) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The rows of a shard that the watermark has passed and whose frame is new; the others wait."""

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, last = map(_unpack, state.get if state.exists else (None, None))
        if not state.hasTimedOut:
            waiting += [d[_COLUMNS] for d in batches]
        rows = pd.concat([*waiting, *(d[:0] for d in last)], ignore_index=True)  # of idle keys alone, no rows
        passed = max(state.getCurrentWatermarkMs(), -1) * 1000
        due = rows["us"].to_numpy() <= passed
        left = rows[~due]
        if due.any():
            # a key's last released row stands before its due ones
            d = pd.concat([*last, rows[due]], ignore_index=True)
            was = np.arange(len(d)) < len(d) - int(due.sum())
            key, us, frame = pd.factorize(d["key"])[0], d["us"].to_numpy(), d["frame"].to_numpy()
            order = np.lexsort((frame, us, ~was, key))
            key, us, frame = key[order], us[order], frame[order]
            first = np.append(True, key[1:] != key[:-1])
            new = first | np.append(True, frame[1:] != frame[:-1])
            if idle_us is not None:
                new |= np.append(True, np.diff(us) > idle_us)
            yield d.take(order[new & ~was[order]])
            last = [d.take(order[np.append(first[1:], True)])]
        kept = pd.concat(last, ignore_index=True) if last else left[:0]
        if idle_us is not None:
            kept = kept[kept["us"] + idle_us > passed]
        if left.empty and kept.empty:
            state.remove()
            return
        state.update((_pack(left), _pack(kept)))
        ends = ([] if left.empty else [left["us"].min()]) + ([] if kept.empty or idle_us is None else [kept["us"].min() + idle_us])
        if ends:  # a timeout runs out when the watermark is above it, not at it
            state.setTimeoutTimestamp(max(-(-int(min(ends)) // 1000) - 1, 1))

    return run


def ordered_changes(events: DataFrame, key: str, ts: str, frame: str, late: str, idle_seconds: float | None = None, shards: int = 1024) -> DataFrame:
    """(key, ts, frame) of rows whose frame differs from that of the key's row before in time; rows at one time go by frame.

    A stream's state goes to the session's store; RocksDB's (`PROVIDER`, `ROCKSDB`) holds it on disk. A row comes out once the watermark, which is `late` behind the
    latest row, has passed it; later ones than that are left out, as in all of Spark's windows. Rows without key, time
    or frame are left out. On a batch, all rows are ordered by windows, with the same result.
    Keys are of atomic types; all keys of one of the `shards` wait together, whose number stays the same over a checkpoint's life.
    """
    rows = events.select(F.col(key).alias("key"), F.col(ts).alias("at"), F.col(frame).cast("long").alias("frame")).dropna()
    kind = dict(rows.dtypes)["key"]
    if not events.isStreaming:
        w = Window.partitionBy("key").orderBy("at", "frame")
        before, gap = F.lag("frame").over(w), F.unix_micros(F.col("at")) - F.unix_micros(F.lag("at").over(w))
        new = before.isNull() | (before != F.col("frame"))
        if idle_seconds is not None:
            new |= gap > F.lit(int(idle_seconds * 1_000_000))
        rows = rows.withColumn("_new", new).filter("_new")
    else:
        rows = rows.withWatermark("at", late).withColumns({"us": F.unix_micros("at"), "shard": F.pmod(F.hash("key"), F.lit(shards))})
        idle = None if idle_seconds is None else int(idle_seconds * 1_000_000)
        rows = rows.groupBy("shard").applyInPandasWithState(_changes(idle), f"key {kind}, us long, frame long", _STATE, "Append", GroupStateTimeout.EventTimeTimeout)
        rows = rows.withColumn("at", F.timestamp_micros("us"))
    return rows.select(F.col("key").alias(key), F.col("at").alias(ts), F.col("frame").alias(frame))
