"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, shared_folder

__all__ = ["SPACE", "by_bytes", "cut", "let", "read", "word_bytes", "words", "written"]

SPACE = r"[\x20\x09-\x0D]+"
_PLAIN = bytes(ord(chr(i).lower()) if chr(i).isalnum() else 32 for i in range(128)) + bytes(range(128, 256))


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def written(df: DataFrame) -> DataFrame:
    """As ``cut``, but as Parquet, which takes less room where keys repeat from row to row."""
    path = f"{shared_folder(df.sparkSession)}/written/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_bytes(text: str | None) -> list[bytes]:
    """Words as UTF-8, A-Z in small letters: runs of ASCII letters and digits and of all characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def by_bytes(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of one column each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    edges = [0, *(np.flatnonzero(np.diff(sizes // most)) + 1).tolist(), batch.num_rows]
    for at, stop in zip(edges, edges[1:]):
        if stop > at:
            yield batch.slice(at, stop - at)
