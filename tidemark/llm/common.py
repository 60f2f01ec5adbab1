"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.materialize import materialize

#: Words of the contracts: runs of bytes other than space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Write to the shared checkpoint folder and read back (cuts lineage; the
    reread table has its own exchange in a later join, so AQE can split it).
    ``outer``: the table outlives the innermost ``scratch_scope``."""
    return materialize(df, name, outer)


def utf8(column: str) -> Column:
    """The bytes of a text column; ``bytes.lower().split()`` in Python is then
    exactly A-Z lower-casing and the words of ``WORD``."""
    return F.col(column).cast("binary")


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; a null id counts as
    the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal ``keys`` as one table each.  The input is
    sorted by the keys inside its partition; the caller bounds group sizes."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        ks = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
        start = 0
        for i, k in enumerate(ks):
            if k == last:
                continue
            if i > start:
                held.append(b.slice(start, i - start))
            if held:
                yield pa.Table.from_batches(held)
            held, start, last = [], i, k
        held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)
