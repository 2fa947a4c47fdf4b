"""Moving-average order signals on candles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tapewright.functions.scalars import DAY
from tapewright.operators import windows as W


def ma_features(candles: DataFrame, short_seconds: int, long_seconds: int, std_seconds: int) -> DataFrame:
    """price, ma_short, ma_long, std, ma_long_start per candle (the row's time is now)."""
    c = F.col("close")
    return candles.select(
        "instrument_id", "us", c.alias("price"), W.moving_average(c, short_seconds).alias("ma_short"), W.moving_average(c, long_seconds).alias("ma_long"),
        W.moving_std(c, std_seconds).alias("std"), W.first_candle_before(c, short_seconds).alias("ma_long_start"),
    )


def ma_open_signals(features: DataFrame) -> DataFrame:
    """Trend and price within one deviation: may_long, may_short. Null start: neither."""
    s, m, o = F.col("ma_short"), F.col("ma_long"), F.col("ma_long_start")
    near = F.abs((F.col("price") - m) / m) < F.col("std")
    no = lambda c: F.coalesce(c, F.lit(False))
    return features.withColumns({"may_long": no((s > m) & (m > o) & near), "may_short": no((s < m) & (m < o) & near)})


def ma_close_signals(features: DataFrame, far: float = 10.0, against: float = 3.0) -> DataFrame:
    """Price far with the position or against it: end_long, end_short, apart from the
    rule that opening the other side closes this one."""
    p, m, d = F.col("price"), F.col("ma_long"), F.col("std")
    return features.withColumns({
        "end_long": (p > m + far * d) | (p < m - against * d),
        "end_short": (p < m - far * d) | (p > m + against * d),
    })


def _transitions() -> np.ndarray:
    """For each of 16 inputs (may open long, short; ends long, short as bits) what becomes of
    each of the four states (long open, short open as bits)."""
    out = np.zeros((16, 4), np.int8)
    for code in range(16):
        for state in range(4):
            (go_long, go_short, end_long, end_short), (long, short) = ([bool(x >> k & 1) for k in range(n)] for x, n in ((code, 4), (state, 2)))
            open_long, open_short = not long and go_long, not short and go_short
            stays_long, stays_short = long and not (end_long or open_short), short and not (end_short or open_long)
            out[code, state] = (stays_long or open_long) | (stays_short or open_short) << 1
    return out


TRANSITIONS = _transitions()


def composed(maps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of rows of maps from four states to four, each row's composition with all before it back
    to the last row that is ``first``, by doubling."""
    out, k = maps.copy(), 1
    start = np.maximum.accumulate(np.where(first, np.arange(len(maps)), 0))
    while k < len(maps):
        reach = np.flatnonzero(np.arange(len(maps)) - k >= start)
        if not len(reach):
            break
        out[reach] = np.take_along_axis(out[reach], out[reach - k].astype(np.intp), axis=1)
        k *= 2
    return out


def _moves(code: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
    """Openings and closings (long, short each) of rows with these inputs and states before them."""
    bit = lambda x, n: (x >> n & 1).astype(bool)
    open_long, open_short = ~bit(state, 0) & bit(code, 0), ~bit(state, 1) & bit(code, 1)
    return open_long, open_short, bit(state, 0) & (bit(code, 2) | open_short), bit(state, 1) & (bit(code, 3) | open_long)


def _latest(moved: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each row, the latest one up to it back to the last ``first`` row that moved the position, or -1."""
    n = np.arange(len(moved))
    last = np.maximum.accumulate(np.where(moved, n, -1))
    return np.where(last >= np.maximum.accumulate(np.where(first, n, 0)), last, -1)


def open_sides(rows: DataFrame, block_us: int) -> DataFrame:
    """``rows (instrument_id, us, lots, code, ..)``, without ``lots`` taken as none, with ``state``: which sides are open before each
    row (bit 0 long, bit 1 short), and ``position``: the lots of the last opening before it, 0 after a closing
    and at first. ``code`` has the four inputs of a row as bits.

    What a candle does to the two open flags is a map from four states to four. Rows are dealt by instrument
    and block of time; a block's composed map, with the position that each entry state leads to (null: the one at
    entry), is one row, composing the blocks gives each one's state at
    entry, and a second pass composes rows from there. No step is row by row and an
    instrument's rows need not share a task. Both passes read the rows as they were dealt once, so
    what ``rows`` are made from runs once."""
    keys, own = ["instrument_id", "__block"], list(rows.columns)
    d = rows if "lots" in own else rows.withColumn("lots", F.lit(0).cast("bigint"))
    d = d.withColumn("__block", F.floor(F.col("us") / F.lit(block_us)).cast("bigint"))
    # what the join below would filter by, so that both passes want the same rows and share their exchange
    d = d.filter("instrument_id is not null and __block is not null").repartition(*keys)

    def runs(b: pa.RecordBatch) -> np.ndarray:
        who, block = b.column("instrument_id").dictionary_encode().indices.to_numpy(), b.column("__block").to_numpy()
        return np.append(True, (np.diff(who) != 0) | (np.diff(block) != 0))[: b.num_rows]

    def block_of(b: pa.RecordBatch, k: int) -> tuple:
        return tuple(b.column(c)[k].as_py() for c in keys)

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, position = None, None, None

        def described(rows_: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows_], t) for k, t in enumerate(kinds)], [*keys, "map", "positions"])

        for b in batches:
            if not b.num_rows:
                continue
            first, code, lots = runs(b), b.column("code").to_numpy(), b.column("lots").to_numpy()
            goes_on = held == block_of(b, 0)
            done = [] if held is None or goes_on else [(*held, state.tolist(), position)]
            maps = TRANSITIONS[code]
            if goes_on:
                maps[0] = maps[0][state]
            after = composed(maps, first)
            before = np.concatenate([after[:1], after[:-1]])
            before[first] = np.arange(4)
            if goes_on:
                before[0] = state
            ends = np.flatnonzero(np.append(first[1:], True))
            found = []
            for x in range(4):  # by state at entry
                open_long, open_short, close_long, close_short = _moves(code, before[:, x])
                opened = open_long | open_short
                at = _latest(opened | close_long | close_short, first)[ends]
                values = np.where(opened, lots, 0)[np.maximum(at, 0)]
                found.append([int(v) if k >= 0 else None for v, k in zip(values, at)])
                if goes_on and at[0] < 0:
                    found[-1][0] = position[x]
            done += [(*block_of(b, int(e)), after[e].tolist(), [f[k] for f in found]) for k, e in enumerate(ends)]
            held, state, position = done[-1][:2], after[-1].astype(np.intp), done[-1][3]
            yield described(done[:-1])
        if held is not None:
            yield described([(*held, state.tolist(), position)])

    def entry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, position = None, 0, 0
        for b in batches:
            out = []
            for who, m, p in zip(*(b.column(c).to_pylist() for c in ("instrument_id", "map", "positions"))):
                if who != held:
                    held, state, position = who, 0, 0
                out.append((state, position))
                state, position = m[state], position if p[state] is None else p[state]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.int64())))], [*keys, "state", "position"])

    maps = d.sortWithinPartitions(*keys, "us").mapInArrow(summary, "instrument_id string, __block bigint, map array<int>, positions array<bigint>")
    entries = maps.repartition("instrument_id").sortWithinPartitions(*keys).mapInArrow(entry, "instrument_id string, __block bigint, state int, position bigint")  # a row a block

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, position = None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            first, code, lots = runs(b), b.column("code").to_numpy(), b.column("lots").to_numpy()
            states, positions = (b.column(c).to_numpy().copy() for c in ("state", "position"))
            if held == block_of(b, 0):  # a block goes on from the batch before
                states[0], positions[0] = state, position
            start = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
            after = composed(TRANSITIONS[code], first)[np.arange(len(code)), states[start]]
            before = np.append(0, after[:-1])
            before[first] = states[first]
            open_long, open_short, close_long, close_short = _moves(code, before)
            opened = open_long | open_short
            at = _latest(opened | close_long | close_short, first)
            then = np.where(at >= 0, np.where(opened, lots, 0)[np.maximum(at, 0)], positions[start])
            earlier = np.append(0, then[:-1])
            earlier[first] = positions[first]
            held, state, position = block_of(b, b.num_rows - 1), int(after[-1]), int(then[-1])
            kept = [*(b.column(c) for c in own), pa.array(before.astype(np.int32)), pa.array(earlier.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(kept, [*own, "state", "position"])

    schema = StructType([*rows.schema.fields, StructField("state", IntegerType()), StructField("position", LongType())])
    # the rows stay where they were dealt, a block's entry comes to them
    return d.join(entries.hint("merge"), keys).sortWithinPartitions(*keys, "us").mapInArrow(replay, schema)


def ma_order_signals(features: DataFrame, balance: str = "balance", block_us: int = 64 * DAY) -> DataFrame:
    """Orders in time order, every one taken as executed: at each candle an opening comes
    if the side is closed and money buys a lot, a closing if the side is open and its rule or an opening of the
    other side says so. The position is the lots of the last opening. Which sides are open, and the position at a closing, come from
    ``open_sides``; orders of a candle are columns of it. ``block_us`` is the length of time a task takes of an
    instrument. Candles with a null instrument or time are left out."""
    d = ma_close_signals(ma_open_signals(features)).filter("instrument_id is not null and us is not null")
    lots = F.coalesce(F.when(F.col("price") > 0, F.floor(F.col(balance) / F.col("price"))), F.lit(0)).cast("bigint")
    d = d.select("instrument_id", "us", lots.alias("lots"), "may_long", "may_short", "end_long", "end_short")
    yes = lambda c, n: F.when(c, 1 << n).otherwise(0)
    code = yes(F.col("may_long") & (F.col("lots") > 0), 0) + yes(F.col("may_short") & (F.col("lots") > 0), 1) + yes(F.col("end_long"), 2) + yes(F.col("end_short"), 3)
    d = open_sides(d.select("instrument_id", "us", "lots", code.cast("int").alias("code")), block_us)
    bit = lambda c, n: F.col(c).bitwiseAND(F.lit(1 << n)) != 0
    d = d.withColumns({"open_long": ~bit("state", 0) & bit("code", 0), "open_short": ~bit("state", 1) & bit("code", 1)})
    d = d.withColumns({"close_long": bit("state", 0) & (bit("code", 2) | F.col("open_short")), "close_short": bit("state", 1) & (bit("code", 3) | F.col("open_long"))})
    order = lambda on, action, side, lots: F.when(F.col(on), F.struct(F.lit(action).alias("action"), F.lit(side).alias("direction"), F.col(lots).alias("lots")))
    orders = F.array_compact(F.array(
        order("open_long", "open", "long", "lots"), order("open_short", "open", "short", "lots"),
        order("close_long", "close", "long", "position"), order("close_short", "close", "short", "position"),
    ))
    return d.select("instrument_id", "us", F.explode(orders).alias("o")).select("instrument_id", "us", "o.action", "o.direction", "o.lots")


def closing_before_opening(orders: DataFrame) -> DataFrame:
    return orders.orderBy("us", F.when(F.col("action") == "close", 0).otherwise(1), "instrument_id", "direction")
