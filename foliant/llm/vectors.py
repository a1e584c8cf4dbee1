"""Whole-number vectors: components scaled and floored, packed as bytes that Arrow functions read without copying."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import slices

#: Whole components are held at most this large, so that sums of products of 64 components fit in 64 bits.
MOST = 1 << 26


def whole(vectors: DataFrame, id_column: str, column: str, scale: int, dims: int | None = None, width: int | None = None) -> DataFrame:
    """(id, v): floor(scale * x) of each component as packed 32-bit numbers.

    Null vectors and vectors with a null or non-finite component don't come; neither do, with ``dims``, vectors of
    another length. With ``width`` shorter vectors are filled with zeros. Components beyond ``MOST`` are held there.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4096):
                lists = part.column(1).cast(pa.large_list(pa.float64()))
                at = np.concatenate([[0], np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))])
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes NaN
                bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
                size = np.diff(at)
                keep = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[at[1:]] == bad[at[:-1]])
                if dims is not None:
                    keep &= size == dims
                with np.errstate(invalid="ignore", over="ignore"):
                    scaled = np.clip(np.floor(scale * flat), -MOST, MOST)
                numbers = np.nan_to_num(scaled).astype("<i4")
                fill = width or 0
                packed = [np.pad(x, (0, max(0, fill - len(x)))).tobytes() for x in (numbers[at[k] : at[k + 1]] for k in np.flatnonzero(keep))]
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(keep)), pa.array(packed, pa.binary())], names=["id", "v"])

    return vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column)).mapInArrow(pack, "id long, v binary")


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Packed vectors of one length as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), width)
