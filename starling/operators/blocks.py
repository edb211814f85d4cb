"""Sums of large matrices over tasks: blocks of rows travel as binary values and are added up block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of one block.
ROWS = 1 << 10
KINDS = "part int, block int, sums binary"


def _row(part: int, block: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([values.tobytes()], pa.binary())], names=["part", "block", "sums"])


def cut(part: int, total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The blocks of a task's matrix that are not all zero."""
    for at in range(0, len(total), ROWS):
        if total[at : at + ROWS].any():
            yield _row(part, at // ROWS, total[at : at + ROWS])


def summed(blocks: DataFrame, parts: int, height: int, width: int) -> np.ndarray:
    """(part, height, width) sums of all tasks' blocks: added up in tasks, one block of each place reaches the driver."""

    def added(batches):
        now, total = None, None
        for batch in batches:
            for part, block, sums in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist(), batch.column("sums"), strict=True):
                own = np.frombuffer(sums.as_buffer(), float)
                if (part, block) == now:
                    total += own
                    continue
                if now is not None:
                    yield _row(*now, total)
                now, total = (part, block), own.copy()
        if now is not None:
            yield _row(*now, total)

    out = np.zeros((parts, height, width))
    for r in blocks.repartition("part", "block").sortWithinPartitions("part", "block").mapInArrow(added, KINDS).collect():  # parts * height * width numbers at most
        own = np.frombuffer(r["sums"]).reshape(-1, width)
        out[r["part"], r["block"] * ROWS : r["block"] * ROWS + len(own)] = own
    return out
