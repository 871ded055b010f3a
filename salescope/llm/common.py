"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salescope.session import checkpoint_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written once to the shared folder and read from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as decimal text, modulo ``n`` (null id: null)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A string column of an Arrow batch as UTF-8 bytes; null reads as empty."""
    return [t or b"" for t in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def parts(batches: Iterable[pa.RecordBatch], column: str, size: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of Arrow batches of about ``size`` bytes of text, with their texts: a task holds few texts as Python
    objects at a time, however many rows a batch has."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            piece = batch.slice(start, stop - start)
            yield piece, texts(piece, column)
            start = stop
    pa.default_memory_pool().release_unused()  # the worker process stays for later tasks


def with_columns(df: DataFrame, column: str, fields: list[tuple[str, str]],
                 start: Callable[[], Callable[[list[bytes]], Iterable[Iterable]]], *, keep: bool = True) -> DataFrame:
    """Append columns computed from the whole text of each row, in Arrow batches.

    ``start()`` runs once per task and gives the function from a batch's texts (UTF-8 bytes) to one
    sequence per new column. Other columns pass through unchanged; an existing column named like a
    new one (compared without case, as Spark does) is replaced. Without ``keep`` the text stays behind:
    it is not sent back from the worker.
    """
    new = {name.lower() for name, _ in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new or f.name == column]
    if column.lower() in new:
        raise ValueError(f"the text column {column!r} cannot be replaced")
    passed = [i for i, f in enumerate(kept) if keep or f.name != column]
    schema = T.StructType([*(kept[i] for i in passed), *(T.StructField(n, T._parse_datatype_string(t)) for n, t in fields)])
    source = df.select(*(F.col(f"`{f.name}`") for f in kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        fn = start()
        types = [to_arrow_type(schema[name].dataType) for name, _ in fields]
        for batch, own in parts(batches, column):
            made = fn(own)
            arrays = [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in passed), *arrays], schema.names)

    return source.mapInArrow(run, schema)


def groups(batch: list[bytes], size: int = 1_000_000):
    """Runs of texts of about ``size`` bytes."""
    at, held = 0, 0
    for i, t in enumerate(batch):
        held += len(t)
        if held >= size:
            yield batch[at:i + 1]
            at, held = i + 1, 0
    if at < len(batch):
        yield batch[at:]
