"""Shared by the operators: bounded Arrow batches, names that cannot clash, reliable checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text bytes handed to a compute function at once; one longer text comes alone.
BATCH_BYTES = 1 << 19


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of `df` is called so."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without(docs: DataFrame, names: Sequence[str]) -> DataFrame:
    """`docs` without its columns of these names, in any case."""
    gone = {name.lower() for name in names}
    return docs.drop(*(c for c in docs.columns if c.lower() in gone))


def bounded(batch: pa.RecordBatch, texts: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` text bytes (or list entries) each, at least one row."""
    length = pc.list_value_length if pa.types.is_list(batch.column(texts).type) else pc.binary_length
    sizes = pc.fill_null(length(batch.column(texts)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def extend(
    docs: DataFrame, fields: Sequence[T.StructField], compute: Callable[[pa.Array], Sequence],
    text: str = "text", limit: int = BATCH_BYTES,
) -> DataFrame:
    """All columns of `docs` and more that `compute` makes from an Arrow array of texts.

    Rows stay where they are: no shuffle, and memory is bounded by `limit` or the longest text. As with `withColumn`, columns
    of `docs` that are called like new ones give way to them.
    """
    docs = without(docs, [f.name for f in fields])
    index = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, *fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, index, limit):
                made = compute(part.column(index))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=names)

    return docs.mapInArrow(run, schema)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo `folds`; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array and the bounds of each (null: empty)."""
    values = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = int(offsets[0])
    return raw[first : int(offsets[-1])], offsets - first


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
