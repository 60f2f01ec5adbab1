"""Cut lineage by writing a table to the shared checkpoint folder.

Used where one intermediate result feeds several branches of a plan (the
declaration index feeds public methods, affected methods and context
assembly): it is computed once, written with Spark's task-retry-safe commit
protocol, and read back with column pruning.  What the write has shuffled is
deleted when it ends: a later step reads the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.session import scratch_path, shuffles_freed


def materialize(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name, outer)
    with shuffles_freed(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
