"""Streams in the order of their times, with state that ends: gaps, fused attitudes and nearest pairs.

Rows may come in any order within the watermark. Each key's rows wait in its state until the watermark has passed them; a
timer then takes them in the order of their times, so a stream gives what the batch operator gives on the same rows. A
second timer ends a key that has had no row for `idle_ms` of event time and leaves nothing of it behind; a key that comes
back later starts anew. Rows behind the watermark are left out, and so are those with a null key or time.

Waiting rows are one value of Arrow bytes for each batch of a key, as a value and a call for each row would cost more than
the work. Nearest pairs have no other state, so many keys share one: a key of its own costs as much as thousands of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from isochron.operators import fusion


class Ordered(StatefulProcessor):
    """Holds rows until the watermark has passed them, `wait_ms` more if a row needs later ones, then hands them on in order."""

    def __init__(self, key: str, columns: T.StructType, state: str, idle_ms: int, wait_ms: int = 0) -> None:
        self.key, self.columns, self.state, self.idle_ms, self.wait_ms = key, columns, state, idle_ms, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.known = handle.getValueState("known", self.state)
        self.latest = handle.getValueState("latest", "ms long, due long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows))
        got = got[got["ts_ns"].notna()]
        if len(got):
            self.waiting.appendList([(_packed(got[self.columns.names]),)])
            last, due = self.latest.get() or (-(1 << 62), 0)
            last = max(last, int(got["ts_ns"].max()) // 1_000_000)
            # One timer is open at a time: the first row that waits, then the next, at last the end of the key.
            wanted = self._after(timerValues, int(got["ts_ns"].min()) // 1_000_000 + self.wait_ms + 1)
            if not due or wanted < due:
                if due:
                    self.handle.deleteTimer(due)
                self.handle.registerTimer(wanted)
                due = wanted
            self.latest.update((last, due))
        return iter([])

    def _after(self, timerValues: TimerValues, ms: int) -> int:
        return max(ms, timerValues.getCurrentWatermarkInMs() + 1)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = [_unpacked(r[0]) for r in self.waiting.get()]
        rows = pd.concat(held, ignore_index=True) if held else pd.DataFrame([], columns=self.columns.names)
        last, _ = self.latest.get()
        ready = rows["ts_ns"].astype("int64") // 1_000_000 + self.wait_ms < mark if len(rows) else np.zeros(0, bool)
        before = self.known.get()
        out, after, kept = self.step(key, rows[ready] if len(rows) else rows, rows[~ready] if len(rows) else rows, before, mark)
        if after is not None:
            self.known.update(after)
        if len(kept):
            self.waiting.put([(_packed(kept[self.columns.names]),)])
            due = max(int(kept["ts_ns"].min()) // 1_000_000 + self.wait_ms + 1, mark + 1)
        else:
            self.waiting.clear()
            due = last + self.idle_ms
            if due <= mark:  # nothing for so long: the key is forgotten
                self.known.clear()
                self.latest.clear()
                if len(out):
                    yield out
                return
        self.handle.registerTimer(due)
        self.latest.update((last, due))
        if len(out):
            yield out

    def step(self, key: Any, ready: pd.DataFrame, later: pd.DataFrame, before: Row | None, mark: int) -> tuple[pd.DataFrame, tuple | None, pd.DataFrame]:
        """(output, new state, rows that go on waiting) of the rows that the watermark has passed."""
        raise NotImplementedError


def _packed(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_all().to_pandas()


class Gaps(Ordered):
    def __init__(self, key: str, columns: T.StructType, idle_ms: int, threshold_ns: int) -> None:
        super().__init__(key, columns, "last_ns long", idle_ms)
        self.threshold_ns = threshold_ns

    def step(self, key: Any, ready: pd.DataFrame, later: pd.DataFrame, before: Row | None, mark: int) -> tuple[pd.DataFrame, tuple | None, pd.DataFrame]:
        times = np.sort(ready["ts_ns"].to_numpy("int64"))
        times = times if before is None else np.concatenate([[before[0]], times])
        wide = np.flatnonzero(np.diff(times) > self.threshold_ns)
        out = pd.DataFrame({self.key: [key[0]] * len(wide), "before_ns": times[wide], "after_ns": times[wide + 1]})
        return out, (int(times[-1]),) if len(times) else None, later


class Fused(Ordered):
    NAMES = ("ax", "ay", "az", "gx", "gy", "gz")

    def __init__(self, key: str, columns: T.StructType, idle_ms: int, gain: float) -> None:
        super().__init__(key, columns, "last_ns long, qx double, qy double, qz double, qw double", idle_ms)
        self.gain = gain

    def step(self, key: Any, ready: pd.DataFrame, later: pd.DataFrame, before: Row | None, mark: int) -> tuple[pd.DataFrame, tuple | None, pd.DataFrame]:
        rows = ready.sort_values(["ts_ns", *self.NAMES])
        t, values = rows["ts_ns"].to_numpy("int64"), np.nan_to_num(rows[list(self.NAMES)].to_numpy(float))
        if not len(t):
            return pd.DataFrame(), None, later
        q = fusion.gradient_filter(t, values[:, :3], values[:, 3:], self.gain, None if before is None else (int(before[0]), np.array(before[1:])))
        out = pd.DataFrame({self.key: [key[0]] * len(t), "ts_ns": t, **{c: q[:, k] for k, c in enumerate(fusion.TURN)}})
        return out, (int(t[-1]), *map(float, q[-1])), later


class Nearest(Ordered):
    """Left rows (side 0) with the right one (side 1) of their key nearest in time, within the gate; a group holds many keys."""

    def __init__(self, key: str, columns: T.StructType, idle_ms: int, gate_ns: int) -> None:
        # A left row waits until all right rows within the gate behind it have come.
        super().__init__(key, columns, "unused boolean", idle_ms, -(-gate_ns // 1_000_000))
        self.gate_ns = gate_ns

    def step(self, key: Any, ready: pd.DataFrame, later: pd.DataFrame, before: Row | None, mark: int) -> tuple[pd.DataFrame, tuple | None, pd.DataFrame]:
        rows = pd.concat([x for x in (ready, later) if len(x)]) if len(ready) or len(later) else ready
        # Keys and times by rank, so that one number stands for both.
        rows = rows.assign(code=pd.factorize(rows[self.key])[0], place=np.unique(rows["ts_ns"].to_numpy("int64"), return_inverse=True)[1])
        rows["place"] += rows["code"].astype("int64") * len(rows)
        left = rows[: len(ready)]
        left = left[left["side"] == 0].sort_values("place", kind="stable")
        right = rows[rows["side"] == 1].sort_values(["place", "value"]).drop_duplicates("place")
        t, s = left["ts_ns"].to_numpy("int64"), right["ts_ns"].to_numpy("int64")
        at = np.searchsorted(right["place"].to_numpy("int64"), left["place"].to_numpy("int64"), "right")
        if len(s):
            low, high = np.clip(at - 1, 0, None), np.clip(at, None, len(s) - 1)
            own, of = left["code"].to_numpy(), right["code"].to_numpy()
            behind = np.where((at > 0) & (of[low] == own), t - s[low], np.iinfo(np.int64).max)
            ahead = np.where((at < len(s)) & (of[high] == own), s[high] - t, np.iinfo(np.int64).max)
            pick, far = np.where(behind <= ahead, low, high), np.minimum(behind, ahead)
            met = far <= self.gate_ns
            match, value = np.where(met, s[pick], 0), right["value"].to_numpy()[pick]
        else:
            met, match, value = np.zeros(len(t), bool), np.zeros(len(t), "int64"), np.zeros(len(t))
        out = pd.DataFrame({self.key: left[self.key].to_numpy(), "ts_ns": t, "left_value": left["value"].to_numpy(), "match_ns": pd.array(match, "Int64"), "match_value": value})
        out.loc[~met, "match_ns"] = pd.NA
        out.loc[~met, "match_value"] = None
        # A right row is of use to left rows up to the gate after it, which may come until the watermark is there.
        spent = ready[(ready["side"] == 1) & (ready["ts_ns"].astype("int64") + self.gate_ns >= mark * 1_000_000)] if len(ready) else ready
        kept = pd.concat([x for x in (later, spent) if len(x)]) if len(later) or len(spent) else later
        return out, None, kept


#: Groups of keys that nearest pairs are found in; each holds its keys' waiting rows while it is worked on.
GROUPS = 1_024


def _processed(rows: DataFrame, key: str, processor: Ordered, schema: str) -> DataFrame:
    # State of several variables and timers needs this store.
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def _columns(rows: DataFrame, names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, rows.schema[n].dataType) for n in names])


def gap_stream(rows: DataFrame, key: str, threshold_ns: int, idle_ms: int = 600_000) -> DataFrame:
    """(key, before_ns, after_ns) of each step over the threshold; rows: key, ts_ns, event_time with its watermark."""
    kind = rows.schema[key].dataType.simpleString()
    rows = rows.filter(F.col(key).isNotNull()).select(key, "ts_ns", "event_time")
    return _processed(rows, key, Gaps(key, _columns(rows, ["ts_ns"]), idle_ms, threshold_ns), f"{key} {kind}, before_ns long, after_ns long")


def fused_stream(rows: DataFrame, key: str, gain: float = fusion.GAIN, idle_ms: int = 600_000) -> DataFrame:
    """Attitudes of samples (key, ts_ns, ax..az, gx..gz, event_time with its watermark) as the watermark passes them."""
    kind = rows.schema[key].dataType.simpleString()
    names = ["ts_ns", *Fused.NAMES]
    rows = rows.filter(F.col(key).isNotNull()).select(key, *names, "event_time")
    return _processed(rows, key, Fused(key, _columns(rows, names), idle_ms, gain), f"{key} {kind}, ts_ns long, qx double, qy double, qz double, qw double")


def nearest_stream(left: DataFrame, right: DataFrame, key: str, value: str, gate_ns: int, idle_ms: int = 600_000) -> DataFrame:
    """Each left row with the nearest right one within the gate, else nulls, once no nearer one can come.

    Both: key, ts_ns, value (doubles) and event_time with a watermark. Of right rows of one time the smallest value counts.
    """
    kind = left.schema[key].dataType.simpleString()
    known = F.col(key).isNotNull() & F.col("ts_ns").isNotNull()
    group = F.pmod(F.xxhash64(key), F.lit(GROUPS)).alias("nearest_group")
    one = lambda rows, side: rows.filter(known).select(group, key, "ts_ns", F.col(value).cast("double").alias("value"), F.lit(side).alias("side"), "event_time")
    rows = one(left, 0).unionByName(one(right, 1))
    processor = Nearest(key, _columns(rows, [key, "ts_ns", "value", "side"]), idle_ms, gate_ns)
    return _processed(rows, "nearest_group", processor, f"{key} {kind}, ts_ns long, left_value double, match_ns long, match_value double")
