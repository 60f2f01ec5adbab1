"""Proportional stratified interleaving into shards.

Rows of each source are shuffled by a seeded hash and ranked; the fractional
rank (rank - 1/2) / (rows of the source) spreads every source evenly over
[0, 1].  Sorting all rows by it and cutting the order into equal runs gives
shards that each hold the mixture of the whole, with row counts at most one
apart (law ``rows``).

Both orders are global ranks computed without a single-task window: rows are
range-partitioned and sorted on narrow columns (the text itself is not moved),
written once with their position in their partition, and offset by the row
counts of the partitions before.  A source with a third of all rows spans many
range partitions.

Edge cases: null text has size 1 (no bytes, plus 1) and the crc32 of nothing;
null is a source of its own; a null doc_id is shuffled by its text's crc32;
repeated rows take neighbouring ranks; an empty table gives an empty table;
fewer rows than shards leave some shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

SEED = "shard-1"


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``at``, the 0-based position of each row in the order.  The
    position within a sorted range partition comes from
    ``monotonically_increasing_id`` (partition number in the upper bits), the
    partition's offset from a running sum over one row per partition."""
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order)
                       .withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), f"{name}-offsets")
    return (placed.withColumn("part", part).join(offsets, "part")
                  .withColumn("at", F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "offset"))


def stratified_shards(docs: DataFrame, shards: int = 16, seed: str = SEED) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` -> doc_id, source, size, text_crc32,
    shard, slot (gapless from 0 within the shard); one row per row."""
    who = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("crc:"), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))))
    rows = written(docs.select("doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
                               F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
                               F.md5(F.concat(F.lit(seed + ":"), who).cast("binary")).alias("h")), "shard-rows")
    ties = [F.col("h"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    ranked = global_rank(rows, [F.col("source").asc_nulls_last(), *ties], "shard-by-source")

    before = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    n = rows.groupBy("source").agg(F.count("*").alias("n"))
    starts = written(n.select(F.col("source").alias("of"), "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
                              F.sum("n").over(Window.partitionBy()).alias("total")), "shard-sources")
    spread = ranked.join(starts, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    spread = spread.withColumn("fraction", (2 * (F.col("at") - F.col("start")) + 1) / (2 * F.col("n"))).drop("at", "start", "n")

    placed = global_rank(spread, [F.col("fraction"), F.col("h"), F.col("source").asc_nulls_last(), *ties[1:]], "shard-order")
    # shard k starts at ceil(k * total / shards)
    return (placed.withColumn("shard", F.expr(f"cast(at * {shards} div total as int)"))
                  .withColumn("slot", F.expr(f"at - (shard * total + {shards - 1}) div {shards}"))
                  .select("doc_id", "source", "size", "text_crc32", "shard", "slot"))


SQL = """
WITH c AS (  -- the table of CRC-32, from its polynomial
  SELECT list(v ORDER BY i) AS crc FROM (
    SELECT i, list_reduce([i] || range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v
    FROM (SELECT unnest(range(256)) AS i))
), d AS (
  SELECT doc_id, source, CAST(coalesce(octet_length(encode(text)), 0) + 1 AS BIGINT) AS size, md5('shard-1:' || doc_id) AS h,
         xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)),
                         lambda a, b: xor(a >> 8, crc[CAST((xor(a, b) & 255) + 1 AS BIGINT)])), 4294967295) AS text_crc32
  FROM documents, c
), r AS (
  SELECT *, (2 * (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, text_crc32, size) - 1) + 1) / (2 * count(*) OVER (PARTITION BY source)) AS fraction
  FROM d
), g AS (
  SELECT *, row_number() OVER (ORDER BY fraction, h, source NULLS LAST, doc_id, text_crc32, size) - 1 AS pos, count(*) OVER () AS total FROM r
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(pos * 16 // total AS INTEGER) AS shard,
       pos - ((pos * 16 // total) * total + 15) // 16 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM g
"""
