"""Documents packed into blocks: many texts in one row, their bytes compressed together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from procmon.llm.common import batches, text_bytes
from procmon.llm.ngrams import short_batches


def pack(docs: DataFrame, block_bytes: int) -> DataFrame:
    """One row per block: its number, the other columns as arrays, the ends of the texts, the bytes (`packed`).

    Blocks of about `block_bytes` are formed where the documents are read; a longer text is a block of its own.
    Numbers depend on the task, so the result is to be written once and read back. The column `text` has no nulls.
    """
    short_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != "text"]
    fields = ", ".join(f"`{c}` array<{docs.schema[c].dataType.simpleString()}>" for c in names)

    def rows(found):
        first = TaskContext.get().partitionId() << 32
        for number, table in enumerate(batches(found, block_bytes), first):
            data, at = text_bytes(table.column("text"))
            one = pa.array([0, table.num_rows], pa.int32())
            listed = [pa.ListArray.from_arrays(one, pa.concat_arrays(table.column(c).chunks)) for c in names]
            ends = pa.ListArray.from_arrays(one, pa.array(at[1:]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), *listed, ends, pa.array([zstandard.compress(data.tobytes(), 3)])], ["block", *names, "ends", "packed"]
            )

    return docs.select(*names, "text").mapInArrow(rows, f"block long, {fields}, ends array<long>, packed binary")


def texts(batch, row: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts of one block of a batch or table."""
    at = np.concatenate([[0], np.asarray(batch.column("ends")[row].values, np.int64)])
    data = zstandard.decompress(batch.column("packed")[row].as_py(), max(1, int(at[-1])))
    return np.frombuffer(data, np.uint8), at


def column(batch, row: int, name: str) -> pa.Array:
    return batch.column(name)[row].values
