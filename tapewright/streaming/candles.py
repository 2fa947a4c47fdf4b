"""Live candles on a stream: what each interval came to, and late candles aside."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegralType, LongType, StructField, StructType

from tapewright.functions.scalars import SECOND, floor_us
from tapewright.streaming.detect import use_rocksdb
from tapewright.streaming.lanes import LANES, arrays, lane_of, pack_type, packed


def _unpacked(first: Sequence, arrays: list, whole: bool) -> np.ndarray | pd.api.extensions.ExtensionArray:
    kinds = {x.dtype.kind if isinstance(x, np.ndarray) and x.ndim == 1 else "O" for x in arrays}
    if None not in first and kinds <= {"i"} | (set() if whole else {"b", "f"}):
        return np.concatenate([np.array(first, arrays[0].dtype), *arrays])
    if whole:  # with a null an array comes as floats, which state would take for nulls
        return pd.concat([pd.Series(x, dtype="Int64") for x in (first, *arrays)]).array
    return pd.Series([*first, *chain.from_iterable(arrays)]).array


def _plain(x):
    """A value as state takes it."""
    if isinstance(x, Row):
        return {k: _plain(v) for k, v in x.asDict().items()}
    if isinstance(x, (list, np.ndarray)):
        return [_plain(v) for v in x]
    return None if x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x else x


class OpenIntervals(StatefulProcessor):
    """State of a lane, arrays with an element for each instrument: its id, its latest interval and the last
    candle of that, whether the clock closed it, and how many candles it got."""

    def __init__(self, names: list[str], state: StructType, length: int, grace: int | None):
        self.names, self.state, self.length, self.grace = names, state, length, grace
        self.whole = {f.name for f in state if isinstance(f.dataType.elementType, IntegralType)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", self.state)

    def _timer(self, bucket: int) -> int:
        return (bucket + self.length + self.grace) // 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        packs = [f for f in rows if len(f)]
        if not packs:
            return
        columns = ["instrument_id", "tw_bucket", *self.names]
        *held, held_closed, held_n = self.open.get() or [[]] * (len(columns) + 2)
        old = len(held_n)
        d = {c: _unpacked(first, [x for f in packs for x in f[c]], c in self.whole) for c, first in zip(columns, held)}
        # by instrument, what the state holds first, then as they arrived
        code = pd.factorize(d["instrument_id"], use_na_sentinel=False)[0]
        order = np.append(np.arange(old), old + d["seq"][old:].argsort(kind="stable"))
        order = order[code[order].argsort(kind="stable")]
        closed, n = np.zeros(len(order), bool), np.ones(len(order), np.int64)
        closed[:old], n[:old] = held_closed, held_n
        d, code, closed, n = {c: x[order] for c, x in d.items()}, code[order], closed[order], n[order]
        # late: a later interval of the instrument came before, or the clock closed its own
        place = 2 * len(order) * code + 2 * np.unique(d["tw_bucket"], return_inverse=True)[1]
        late = place < np.append(-1, np.maximum.accumulate(place + closed)[:-1])
        # of those in time, whose places never fall: the last of each interval stands for all
        kept = np.flatnonzero(~late)
        ends = np.flatnonzero(np.diff(place[kept], append=-1))
        last = kept[ends]
        n[last] = np.diff(np.cumsum(n[kept])[ends], prepend=0)
        newest = np.diff(code[last], append=-1) != 0
        now = last[newest]
        if (order[now] >= old).any():
            self.open.update((*(_plain(d[c][now].tolist()) for c in columns), closed[now].tolist(), n[now].tolist()))
            if self.grace is not None:
                was = {b for b, over in zip(held[1], held_closed) if not over}
                waits = set(d["tw_bucket"][now][~closed[now]].tolist())
                for b in was - waits:
                    self.handle.deleteTimer(self._timer(b))
                for b in waits - was:
                    self.handle.registerTimer(self._timer(b))
        done = late
        done[last[~newest]] = True
        done &= ~closed
        if done.any():
            is_late = np.ones(len(order), bool)
            is_late[last] = False
            found = {c: d[c][done] for c in columns}
            yield pd.DataFrame({"instrument_id": found.pop("instrument_id"), "bucket_us": found.pop("tw_bucket"), **found, "n": n[done], "late": is_late[done]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.open.get()
        if held is None:
            return
        *candles, closed, n = _plain(list(held))
        passed = 1000 + expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.length - self.grace
        due = [not over and b <= passed for b, over in zip(candles[1], closed)]
        if any(due):
            self.open.update((*candles, [over or x for over, x in zip(closed, due)], n))
            out = [(*row, False) for x, *row in zip(due, *candles, n) if x]
            yield pd.DataFrame(out, columns=["instrument_id", "bucket_us", *self.names, "n", "late"])

    def close(self) -> None:
        pass


def live_candles(candles: DataFrame, interval_seconds: int, grace_seconds: int | None = None) -> DataFrame:
    """Of a stream of live candles (instrument_id, us, seq, ..; ``seq`` is the order of arrival): a row for each
    interval once it is over, with its last candle and ``n``, the number of candles it got, and a row with
    ``late`` for each candle that comes after its interval was over. An interval is over when a candle of a later one
    arrives and, with ``grace_seconds``, once the clock passed its end by so much; such a stream wakes up
    by itself, so it wants a trigger that doesn't end with the input. A watermark on the candles' times
    would drop the late ones before they could be told. Append mode. Names of columns begin with a letter."""
    use_rocksdb(candles.sparkSession)
    bucket = floor_us(F.col("us"), interval_seconds * SECOND).cast("bigint")
    names = [c for c in candles.columns if c != "instrument_id"]
    kinds = [candles.schema[c] for c in names]
    out = StructType([candles.schema["instrument_id"], StructField("bucket_us", LongType()), *kinds, StructField("n", LongType()), StructField("late", BooleanType())])
    inner = [candles.schema["instrument_id"], StructField("tw_bucket", LongType()), *kinds]
    state = StructType(arrays([*inner, StructField("tw_closed", BooleanType()), StructField("tw_n", LongType())]))
    grace = None if grace_seconds is None else grace_seconds * SECOND
    own = OpenIntervals(names, state, interval_seconds * SECOND, grace)
    d = candles.filter("instrument_id is not null and us is not null").select(lane_of(LANES), "instrument_id", bucket.alias("tw_bucket"), *names)
    lanes = d.mapInArrow(packed, pack_type(inner)).groupBy("tw_lane")
    return lanes.transformWithStateInPandas(own, out, "append", "none" if grace is None else "processingTime")
