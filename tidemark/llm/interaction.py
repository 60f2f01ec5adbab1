"""Audit of how filters interact: who removes what, in every order.

Five filters are tried on every document; what matters of a document is the
set of filters it fails.  ``v(S)``, the removal game, is the number of
documents that fail a filter of the coalition ``S``.  From the 32 values of a
part, by recursion over coalitions, comes the Hart-Mas-Colell potential

    P(empty) = 0,    P(S) = (v(S) + sum over i in S of P(S - i)) / |S|,

and a filter's Shapley value is P(all) - P(all - filter).  Over all 120 orders
a filter removes 120 times that; 120 * P(S) is a whole number for every S, so
the recursion stays in integers.  The step of filter i after the filters S
removes v(S + i) - v(S) documents; the same differences over the documents of
good and of toxic label give what a step loses of them.

Documents are reduced to one narrow row each in one pass over the texts
(written once), these to counts per part and failed set by a partial
aggregate; only those counts - at most 32 rows per part - meet the recursion,
one row per part, in parallel over parts.  Filter E (the text of a smaller
doc_id) is a minimum per text hash and a join on (hash, doc_id): the many rows
of one text differ in doc_id, so they do not meet in one task.

Edge cases: null text is the empty text (and equal to it); a null lang is the
part '' together with an empty lang; a null doc_id is smaller than nothing and
nothing is smaller than it, so it neither fails E nor makes others fail, and
it has no label; repeated rows count each, and none of the rows with the
smallest doc_id of a text fails E; repeated labels of a document count as good
(toxic) if any is; null labels are neither; a text without words does not fail
B, an empty one does not fail C; an empty table gives no parts and no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import UPPER, WORD, batch, written

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1


# -- the filters -------------------------------------------------------------

def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text (not null) fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    chars = F.length(text)
    fails = [n < 200,
             100 * F.size(F.array_distinct(words)) < 50 * n,
             100 * (chars - F.length(F.translate(text, UPPER, ""))) > 3 * chars,
             text.rlike(r"[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def failures(docs: DataFrame) -> DataFrame:
    """(part, doc_id, failed) per row of ``docs``; ``failed`` has one bit per
    filter."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.sha2(text.cast("binary"), 256).alias("h"), text_failures(text).alias("failed"))
    rows = written(rows, "interaction-rows")
    first = rows.where("doc_id is not null").groupBy("h").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    late = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["h", "doc_id"], "left").select("part", "doc_id", (F.col("failed") + F.when(late, 16).otherwise(0)).cast("int").alias("failed"))


def counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, n, good, toxic): documents per part and failed set."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    return failed.join(marks, "doc_id", "left").groupBy("part", "failed").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


# -- the game ----------------------------------------------------------------

def removal_game(by_failed: list[int]) -> list[int]:
    """v(S) for all coalitions from the number of documents per failed set."""
    return [sum(n for failed, n in enumerate(by_failed) if failed & s) for s in range(ALL + 1)]


def potentials(v: list[int]) -> list[int]:
    """120 * P(S) for all coalitions; the division is exact."""
    scale, p = factorial(len(FILTERS)), [0] * len(v)
    for s in range(1, len(v)):
        members = [i for i in range(len(FILTERS)) if s >> i & 1]
        p[s] = (scale * v[s] + sum(p[s ^ 1 << i] for i in members)) // len(members)
    return p


def steps(n: list[int], good: list[int], toxic: list[int]) -> Iterator[tuple]:
    """All steps of all orders of one part; the arguments are indexed by
    failed set."""
    v, g, t = removal_game(n), removal_game(good), removal_game(toxic)
    p, total = potentials(v), sum(n)
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = v[after] - v[before]
            yield (name, step, total - v[after], removed, v[1 << i] - removed, n[1 << i], g[after] - g[before],
                   t[after] - t[before], p[ALL] - p[ALL ^ 1 << i])
            before = after


COLUMNS = ("filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs(doc_id, text, lang, ...)``, ``labels(doc_id, quality, toxic)``
    -> 600 rows per part."""
    sets = F.collect_list(F.struct("failed", "n", "good", "toxic"))        # at most 32
    parts = counts(failures(docs), labels).groupBy("part").agg(sets.alias("sets"))
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in COLUMNS[2:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, found in zip(b.column("part").to_pylist(), b.column("sets").to_pylist(), strict=True):
                by = {x["failed"]: x for x in found}
                rows = list(steps(*([by[s][c] if s in by else 0 for s in range(ALL + 1)] for c in ("n", "good", "toxic"))))
                yield batch(schema, [[part] * len(rows), *zip(*rows)])

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COLUMNS[2:]))


SQL = """
WITH d AS (
  SELECT coalesce(lang, '') AS part, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), m AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS failed
  FROM d LEFT JOIN m ON m.doc_id = d.doc_id
), c AS (
  SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, failed
), l AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS filter, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)
), h AS (
  SELECT s.*, c.part, c.n, c.good, c.toxic, contains(failed, filter) AS fails,
         translate(failed, before, '') <> failed AS gone, failed = filter AS only_
  FROM s, c
), r AS (
  SELECT part, filter_order, step, filter, CAST(coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (only_), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM h GROUP BY part, filter_order, step, filter
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM r
"""
