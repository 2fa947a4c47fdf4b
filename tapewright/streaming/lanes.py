"""Instruments in groups for a stateful processor, whose calls and rows have their price each."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: Groups that instruments are dealt over for the state, as each call of a stateful processor has its price.
LANES = 4096
#: Rows a packed row has at most (Spark sends 10,000 rows at once to the state), and bytes of rows packed at once.
PACK, PACK_BYTES = 64, 32 << 20


def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a lane that come together as one row of arrays: Spark hands rows to a stateful
    processor one by one."""
    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += batch.nbytes
        if size >= PACK_BYTES:
            yield from _pack(pa.Table.from_batches(waiting))
            waiting, size = [], 0
    if waiting:
        yield from _pack(pa.Table.from_batches(waiting))


def _pack(table: pa.Table) -> list[pa.RecordBatch]:
    lanes = table["tw_lane"].to_numpy()
    order = np.argsort(lanes, kind="stable")
    at, first = np.arange(len(lanes)), np.diff(lanes[order], prepend=-1) != 0
    starts = np.flatnonzero((at - np.maximum.accumulate(np.where(first, at, 0))) % PACK == 0)
    table, bounds = table.take(order), pa.array(np.append(starts, len(lanes)), pa.int32())
    column = lambda c: table[c].take(starts) if c == "tw_lane" else pa.ListArray.from_arrays(bounds, table[c].combine_chunks())
    return pa.table({c: column(c) for c in table.column_names}).to_batches() if len(lanes) else []


def lane_of(lanes: int) -> Column:
    return F.pmod(F.xxhash64("instrument_id"), F.lit(lanes)).cast("int").alias("tw_lane")


def arrays(fields: Iterable[StructField]) -> list[StructField]:
    return [StructField(f.name, ArrayType(f.dataType)) for f in fields]


def pack_type(fields: Iterable[StructField]) -> StructType:
    """Of what ``packed`` gives for rows of a lane's number and ``fields``."""
    return StructType([StructField("tw_lane", IntegerType()), *arrays(fields)])
