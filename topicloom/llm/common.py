"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.plans.execution import materialise

__all__ = ["arrow_rows", "held_out", "id_crc", "materialise", "table", "text_or_empty"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def id_crc(name: str = "doc_id"):
    """CRC-32 of the id written as text, unsigned; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


def held_out(divisor: int, remainder: int, name: str = "doc_id"):
    return id_crc(name) % divisor == remainder


def python_id_crc(doc_id) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def slices(batch: pa.RecordBatch, column: int, size: int = 12 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have at most ``size`` bytes, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def arrow_rows(df: DataFrame, rows_of: Callable[[pa.RecordBatch], pa.RecordBatch], schema, size: int = 4 << 20) -> DataFrame:
    """Map every Arrow batch of ``df``; the number of rows may change.

    A function never sees more than ``size`` bytes of the first text column at once (but at least one row), so the
    memory of a task follows that size and the longest text, not the number of rows in a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [i for i, f in enumerate(batch.schema) if pa.types.is_string(f.type) or pa.types.is_binary(f.type)]
            yield from map(rows_of, slices(batch, texts[0], size) if texts else [batch] * (batch.num_rows > 0))

    return df.mapInArrow(run, schema)
