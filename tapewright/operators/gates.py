"""Greedy gates: accept an eligible row if none of its key was accepted yet or the
last accepted one is at least an interval ago.

This is no window frame: whether a row passes depends on which earlier ones did.
Rows are dealt by key, sorted, and streamed in Arrow batches; the gate jumps from
one accepted row to the next by binary search and carries one time per gate over
batch borders, so memory is a batch, not a key. Several gates share one pass, and
a gate may be opened by the outcome of earlier gates.

A key of many rows need not stay in one task. With ``block_us`` its rows are dealt in
blocks of that length of time. What a block does to a gate is a step function from the time the gate last
accepted before the block to the time it last accepts in it: only rows of the block's first interval can be
its first accepted ones, each leads to one last row, found by pointer jumping, and equal outcomes are
one step. A first pass makes these functions, a row a block; composing them in the order of the
blocks gives each block its entry times, and a second pass over the rows starts from these. No pause
in the rows is needed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

_BLOCK, _KIND = "__block", "__kind"


@dataclass(frozen=True)
class Gate:
    name: str
    interval: str
    #: a boolean column, or names of earlier gates, any of which opens this one
    eligible: str | tuple[str, ...]
    #: a boolean column that has to hold as well
    enabled: str | None = None


def _accept(times: np.ndarray, interval: int, last: int | None) -> tuple[np.ndarray, int | None]:
    out = np.zeros(len(times), bool)
    k = 0 if last is None else int(np.searchsorted(times, last + interval, "left"))
    while k < len(times):
        out[k] = True
        last = int(times[k])
        k = k + 1 if interval <= 0 else max(k + 1, int(np.searchsorted(times, last + interval, "left")))
    return out, last


def step_function(times: np.ndarray, interval: int) -> tuple[np.ndarray, np.ndarray]:
    """``(until, exit)``: a gate that may accept from time x on, x at most an interval after the
    first of the rising ``times``, last accepts at ``exit[k]`` for the first k with until[k] >= x."""
    n = len(times)
    after = np.searchsorted(times, times + interval, "left") if interval > 0 else np.arange(1, n + 1)
    last = np.where(after < n, after, np.arange(n))
    while True:  # pointers to the next accepted row, doubled until none moves
        jumped = last[last]
        if (jumped == last).all():
            break
        last = jumped
    first = slice(0, int(np.searchsorted(times, times[0] + max(interval, 0), "right")) + 1)
    until, exit_ = times[first], times[last[first]]
    ends = np.append(exit_[1:] != exit_[:-1], True)
    return until[ends], exit_[ends]


def _runs(b: pa.RecordBatch, keys: Sequence[str]) -> Iterator[tuple[tuple, int, int]]:
    """``(key, start, end)`` of runs of equal keys."""
    rows = list(zip(*(b.column(k).to_pylist() for k in keys)))
    cuts = [0, *(i for i in range(1, len(rows)) if rows[i] != rows[i - 1]), len(rows)]
    return ((rows[s], s, e) for s, e in zip(cuts, cuts[1:]) if e > s)


def _flags(b: pa.RecordBatch, name: str | None) -> np.ndarray | bool:
    return True if name is None else b.column(name).fill_null(False).to_numpy(zero_copy_only=False)


def _entries(df: DataFrame, keys: list[str], order: list[str], gates: Sequence[Gate]) -> DataFrame:
    """``(keys.., __block, __entry_gate..)``: when each gate last accepted before a block."""
    flags = dict.fromkeys(c for g in gates for c in (g.eligible, g.enabled) if c)
    needed = df.select(*keys, _BLOCK, order[0], *dict.fromkeys(g.interval for g in gates), *flags)
    kinds = [df.schema[k] for k in keys]
    functions = StructType([*kinds, *StructType.fromDDL(f"{_BLOCK} bigint, interval array<bigint>, until array<array<bigint>>, exit array<array<bigint>>").fields])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, intervals = None, [], []

        def row() -> pa.RecordBatch:
            steps = []
            for n, p in enumerate(parts):
                times = np.concatenate(p)
                steps.append(step_function(times, intervals[n]) if len(times) else ([], []))
            values = [*held, intervals, [list(s[0]) for s in steps], [list(s[1]) for s in steps]]
            types = [*first.types[: len(keys) + 1], pa.list_(pa.int64()), *[pa.list_(pa.list_(pa.int64()))] * 2]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], functions.names)

        first = None
        for b in batches:
            first = first or b.schema
            times = b.column(order[0]).to_numpy(zero_copy_only=False)
            ok = [_flags(b, g.eligible) & _flags(b, g.enabled) for g in gates]
            for key, s, e in _runs(b, [*keys, _BLOCK]):
                if key != held:
                    if held is not None:
                        yield row()
                    held, parts, intervals = key, [[] for _ in gates], [b.column(g.interval)[s].as_py() for g in gates]
                for n in range(len(gates)):
                    parts[n].append(times[s:e][ok[n][s:e]])
        if held is not None:
            yield row()

    steps = needed.repartition(*keys, _BLOCK).sortWithinPartitions(*keys, _BLOCK, order[0]).mapInArrow(describe, functions)
    names = [f"__entry_{g.name}" for g in gates]
    schema = StructType([*kinds, *StructType.fromDDL(", ".join([f"{_BLOCK} bigint", *(f"{n} bigint" for n in names)])).fields])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, []
        for b in batches:
            out = []
            for n, row in enumerate(b.to_pylist()):
                key = tuple(row[k] for k in keys)
                if key != held:
                    held, last = key, [None] * len(gates)
                out.append(list(last))
                for g, (interval, until, exit_) in enumerate(zip(row["interval"], row["until"], row["exit"])):
                    k = 0 if last[g] is None else int(np.searchsorted(until, last[g] + interval, "left"))
                    if k < len(until):
                        last[g] = exit_[k]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in (*keys, _BLOCK)), *(pa.array([r[g] for r in out], pa.int64()) for g in range(len(gates)))], schema.names)

    # a row a block: composing a key's blocks is one short scan
    return steps.repartition(*keys).sortWithinPartitions(*keys, _BLOCK).mapInArrow(compose, schema)


def greedy_gate(df: DataFrame, keys: Sequence[str], order: Sequence[str], gates: Sequence[Gate], block_us: int | None = None) -> DataFrame:
    """``df`` with a boolean column per gate. ``order`` starts with the time, a bigint;
    intervals are bigint columns, constant within a key. Null eligibility is false. With
    ``block_us`` keys are cut into blocks of that length, which changes no outcome; the plan of
    ``df`` is then run twice. Without it a key is one task, right for keys of few rows."""
    keys, order, gates = list(keys), list(order), tuple(gates)
    if block_us:
        own = [g for g in gates if isinstance(g.eligible, str)]
        out = _pass(df, keys, order, own, block_us) if own else df
        for g in gates:
            if g not in own:  # on what the gates before it came to
                opened = F.lit(False)
                for x in g.eligible:
                    opened = opened | F.col(x)
                out = _pass(out.withColumn("__opened", opened), keys, order, [Gate(g.name, g.interval, "__opened", g.enabled)], block_us).drop("__opened")
        return out.select(*df.columns, *(g.name for g in gates))
    return _pass(df, keys, order, gates, None)


def _pass(df: DataFrame, keys: list[str], order: list[str], gates: Sequence[Gate], block_us: int | None) -> DataFrame:
    entry = {g.name: f"__entry_{g.name}" for g in gates}
    rows, dealt = df, keys
    if block_us:
        df = df.withColumn(_BLOCK, F.floor(F.col(order[0]) / F.lit(block_us)).cast("bigint"))
        dealt = [*keys, _BLOCK]
        # a block's entry times come as its first row
        rows = df.withColumn(_KIND, F.lit(1)).unionByName(_entries(df, keys, order, gates).withColumn(_KIND, F.lit(0)), allowMissingColumns=True)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        last: dict[str, int | None] = {}
        for b in batches:
            if not b.num_rows:
                continue
            # only keys, times and flags are looked at; other columns pass through as they are
            time = b.column(order[0]).to_numpy(zero_copy_only=False)
            kind = b.column(_KIND).to_numpy() if block_us else None
            out = {g.name: np.zeros(b.num_rows, bool) for g in gates}
            columns = {c: _flags(b, c) for g in gates for c in (g.eligible, g.enabled) if isinstance(c, str)}
            for key, s, e in _runs(b, dealt):
                if key != held:
                    held, last = key, {}
                if block_us and kind[s] == 0:
                    last = {g.name: b.column(entry[g.name])[s].as_py() for g in gates}
                    s += 1
                if s == e:
                    continue
                for g in gates:
                    ok = columns[g.eligible][s:e] if isinstance(g.eligible, str) else np.logical_or.reduce([out[x][s:e] for x in g.eligible])
                    if g.enabled:
                        ok = ok & columns[g.enabled][s:e]
                    at = np.flatnonzero(ok)
                    if len(at):
                        accepted, last[g.name] = _accept(time[s:e][at].astype(np.int64), b.column(g.interval)[s].as_py(), last.get(g.name))
                        out[g.name][s + at[accepted]] = True
            done = pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *map(pa.array, out.values())], [*names, *out])
            yield done.filter(pa.array(kind == 1)) if block_us else done

    schema = StructType([*df.schema.fields, *(StructField(g.name, BooleanType()) for g in gates)])
    first = [_KIND] if block_us else []
    return rows.repartition(*dealt).sortWithinPartitions(*dealt, *first, *order).mapInArrow(run, schema).drop(_BLOCK)
