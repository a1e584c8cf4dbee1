"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.lineage import cut, shared_folder  # noqa: F401  other modules take them from here


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string() if pa.types.is_large_string(column.type) else pa.string())
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """True where crc32 of the id's decimal text leaves this remainder; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of at most this many rows, so that long texts don't pile up."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def sized(frame: DataFrame, rows: int) -> DataFrame:
    """A cut table, marked for broadcast only if it is counted to have at most this many (narrow) rows."""
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame


def free(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened alike until none of them is taken."""
    taken, tail = {c.lower() for c in columns}, ""
    while any(f"{n}{tail}".lower() in taken for n in names):
        tail += "_"
    return [f"{n}{tail}" for n in names]


def bounded(rows: DataFrame, most: int, seed: int, *key: str) -> DataFrame:
    """About ``most`` rows (never over twice that), by a hash of their key; all rows if there are no more.

    The share is set by the table's count, so only rows of the sample leave their tasks.
    """
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 30)) < int(most / n * (1 << 30))).limit(2 * most)
