"""Sums of matrices over tasks, by blocks of rows: what the driver gets is one matrix, whose size the caller bounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def summed(rows: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], shape: tuple[int, int], kind: str = "float64", per_block: int = 1 << 16) -> np.ndarray:
    """The sum of all matrices (of this shape) that part yields in each task. Blocks without a number other than 0 aren't sent; those of a
    number are added one after the other where they meet, so no task holds more than a block of the sum."""
    high, wide = shape
    step = max(1, per_block // max(wide, 1))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for matrix in part(batches):
            for at in range(0, high, step):
                block = np.ascontiguousarray(matrix[at : at + step], dtype=kind)
                if block.any():
                    yield pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int32()), "data": pa.array([block.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        out = lambda: pa.RecordBatch.from_pydict({"block": pa.array([now], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.frombuffer(data.as_buffer(), kind)
                if block == now:
                    total = total + found
                else:
                    if now is not None:
                        yield out()
                    now, total = block, found.copy()
        if now is not None:
            yield out()

    schema = "block int, data binary"
    got = rows.mapInArrow(send, schema).repartition("block").sortWithinPartitions("block").mapInArrow(add, schema).collect()
    out = np.zeros(shape, dtype=kind)
    for block, data in got:
        out[block : block + step] = np.frombuffer(bytes(data), kind).reshape(-1, wide)
    return out
