"""Skew-safe "neighbour in key order" plans.

``lag``/``lead`` over ``Window.partitionBy(key)`` sends every row of a key to
one task.  When one path, repository or user holds a third of all rows that
task is the whole job.  The plans here count the rows of each key first.  Keys
with more than a quarter of an even share of a task (``hot_keys``: a bounded
number of them) are split into buckets of the order column, cut at quantiles of
that column over all rows, so every bucket holds about the same number of rows
whatever the values are and a hot key is spread over as many tasks as there are
buckets; any other key is one bucket, and has no edges:

1. ``lag``/``lead`` inside ``(key, bucket)`` (a bounded group);
2. one row per ``(key, bucket)`` of the hot keys with the last (first) row of
   the bucket, computed with ``max_by``/``min_by`` - a partial aggregate,
   combined map-side before the shuffle;
3. ``lag``/``lead`` of that small table over the buckets of each key carries
   the neighbour across bucket edges;
4. a join on ``(key, bucket)`` - the big side is already hash-partitioned on
   those columns by step 1, so only the small edge table moves.

Without hot keys step 1 is the whole plan.

The result is identical to the plain window: a row's neighbour is the nearest
row of the same key in ``(order, tiebreak)`` order.  Null keys are keys like
others (keys are compared as one struct, in which nulls are equal), and a null
order comes first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bucket_of(df: DataFrame, order: str, buckets: int | None = None) -> Column:
    """Number of the quantile cuts of ``order`` at or below a row's value.
    The cuts (one per shuffle partition) come from one pass over that column
    alone; they only steer the work, never the result."""
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dtype = df.schema[order].dataType
    value = F.col(order)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        value = F.unix_micros(value.cast("timestamp"))
    cuts = df.agg(F.percentile_approx(value, [i / n for i in range(1, n)], 1000)).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or []))
    if not cuts:
        return F.lit(0)
    # a binary search: the number of cuts grows with the data, the cost of a row
    # must not.  The value goes in as an element: the optimizer does not see columns
    # that stand in a lambda's body, and would infer a filter on the edges from it
    edges = F.array(*(F.lit(c) for c in cuts))
    halvings = F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))))
    step = lambda v: lambda at, h: F.when((at + h <= len(cuts)) & (F.get(edges, at + h - 1) <= v), at + h).otherwise(at)
    found = F.transform(F.array(value), lambda v: F.aggregate(halvings, F.lit(0), step(v)))
    return F.coalesce(F.get(found, 0), F.lit(0))


def hot_keys(df: DataFrame, keys: Sequence[str], buckets: int) -> list[Row]:
    """Keys with more than a quarter of the rows that one of ``buckets`` tasks
    has on average; at most four times ``buckets`` of them."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_tm_n"))
    total, most = counts.agg(F.sum("_tm_n"), F.max("_tm_n")).first()
    share = (total or 0) / (4 * buckets)
    if buckets < 2 or (most or 0) <= share:
        return []
    return counts.where(F.col("_tm_n") > F.lit(share)).select(*keys).collect()


def with_neighbour(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str],
                   tiebreak: Sequence[str] = (), direction: str = "prev",
                   prefix: str | None = None, buckets: int | None = None,
                   found_col: str | None = None) -> DataFrame:
    """Add ``{prefix}{v}`` for each ``v`` in ``values``: the value on the
    previous (``direction='prev'``) or next row of the same key.

    ``found_col`` (optional) names a boolean column that is true when a
    neighbour exists, so a genuine null value can be told from "no row".
    """
    keys = list(keys)
    values = list(values)
    prefix = prefix if prefix is not None else ("prev_" if direction == "prev" else "next_")
    ordering = [order, *tiebreak]
    fields = [*ordering, *[v for v in values if v not in ordering]]
    payload = F.struct(*[F.col(c).alias(c) for c in fields])
    okey = F.struct(*[F.col(c) for c in ordering])

    beside = F.lag if direction == "prev" else F.lead
    hot = hot_keys(df, keys, buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def with_found(rows: DataFrame, nb: Column, *helpers: str) -> DataFrame:
        out = rows
        for v in values:
            out = out.withColumn(f"{prefix}{v}", nb[v])
        if found_col:
            out = out.withColumn(found_col, nb.isNotNull())
        return out.drop(*helpers)

    if not hot:
        rows = df.withColumn("_tm_in", beside(payload).over(Window.partitionBy(*keys).orderBy(*ordering)))
        return with_found(rows, F.col("_tm_in"), "_tm_in")

    k, b = "_tm_key", "_tm_bucket"
    is_hot = reduce(or_, (reduce(and_, (F.col(c).eqNullSafe(F.lit(r[c])) for c in keys)) for r in hot))
    base = df.withColumn(k, F.struct(*keys)).withColumn(b, F.when(is_hot, bucket_of(df, order, buckets)).otherwise(F.lit(0)))

    # 1. neighbour inside the bucket
    rows = base.withColumn("_tm_in", beside(payload).over(Window.partitionBy(k, b).orderBy(*ordering)))

    # 2. one edge row per (key, bucket): last row for prev, first row for next
    pick = F.max_by if direction == "prev" else F.min_by
    edges = base.where(is_hot).groupBy(k, b).agg(pick(payload, okey).alias("_tm_edge"))

    # 3. carry edges across buckets (small table: one row per key-bucket)
    we = Window.partitionBy(k).orderBy(b)
    edges = edges.select(F.col(k).alias("_tm_ek"), F.col(b).alias("_tm_eb"), beside("_tm_edge").over(we).alias("_tm_carry"))

    # 4. stitch
    joined = rows.join(edges, (F.col(k) == F.col("_tm_ek")) & (F.col(b) == F.col("_tm_eb")), "left").drop("_tm_ek", "_tm_eb")
    return with_found(joined, F.coalesce(F.col("_tm_in"), F.col("_tm_carry")), "_tm_in", "_tm_carry", b, k)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                   values: Sequence[str], newest: bool = True) -> DataFrame:
    """One row per key: the row with the greatest (or least) order tuple.

    ``max_by`` over a struct is a partial aggregate, so a hot key is
    combined map-side instead of being sorted in one task as a
    ``row_number()`` window would be.
    """
    okey = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    payload = F.struct(*[F.col(v).alias(v) for v in values])
    pick = F.max_by if newest else F.min_by
    return (df.groupBy(*keys).agg(pick(payload, okey).alias("_tm_row"))
              .select(*keys, *[F.col("_tm_row")[v].alias(v) for v in values]))
