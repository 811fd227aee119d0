"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from types import MappingProxyType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pricepanel.session import scratch

#: Prefix of working columns, so that columns of the input never clash.
OWN = "_llm_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, and a lost
    executor costs nothing that is already written."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def digest(column: str | Column) -> Column:
    """128 bits of a value as two longs; equal values give equal digests, and
    distinct ones collide with a chance of about n^2 / 2^129."""
    col = F.col(column) if isinstance(column, str) else column
    hexed = F.md5(F.coalesce(col, F.lit("")).cast("binary"))
    part = lambda at: F.conv(F.substring(hexed, at, 15), 16, 10).cast("long")
    return F.struct(part(1).alias("hi"), part(16).alias("lo"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to few rows, so that Python objects of few texts exist at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def split_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words of some texts between ASCII white space, which of them each
    word is, one text after the other, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    real = pc.not_equal(flat, "")  # white space at the ends leaves empty strings
    row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    sizes = np.bincount(row[real.to_numpy(zero_copy_only=False)], minlength=len(texts))
    found = flat.filter(real).dictionary_encode()
    return found.dictionary.cast(pa.binary()).to_pylist(), found.indices.to_numpy(), sizes


def joined(raw: list[bytes], which: np.ndarray, sizes: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of different words, each given as bytes of ``kind``, strung together in
    the order of ``which``; and where the values of each text end, 0 in front."""
    lengths = np.fromiter(map(len, raw), np.int64, len(raw)) // np.dtype(kind).itemsize
    whole = np.frombuffer(b"".join(raw), kind)
    n = lengths[which]
    ends = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat((np.cumsum(lengths) - lengths)[which] - ends[:-1], n) + np.arange(ends[-1])
    return whole[at], ends[np.concatenate([[0], np.cumsum(sizes)])]


def record(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


NOTHING = MappingProxyType({})
