"""Mixing sources to target weights.

Tokens are summed per source; every source gets a target share of all tokens
by weight, at most ``cap`` times its own size, and what a capped source cannot
take is shared again by weight.  A source's repetition rate is target / size;
each of its documents is emitted floor(rate) times, plus one more copy with
probability rate - floor(rate) by a seeded hash.

Sizes have long tails, so draws that know nothing of each other miss a small
source's target by far.  Here the documents of a source are stratified by size
(strata a sixth of a natural logarithm wide).  From the largest stratum down,
the number of extra copies is what the fraction asks for up to here, less what
the strata above took, in mean sizes, rounded by a seeded hash of the source;
the documents with the smallest seeded hashes take them.  The cut of a stratum
is thus one number, found by a global rank over narrow rows, and documents meet
a table of (source, stratum, cut) - at most some 120 rows per source.

The targets have a closed form: with sources in order of size / weight, let
``level`` be (all tokens - caps of the sources before) / (weights from here
on).  It rises as long as sources are capped and never after, so its maximum
is the final tokens per unit of weight, and target = min(cap, level * weight).
That is a window over one row per source; Spark broadcasts the written tables
when they are small enough.

Edge cases: null text has size 0; null is a source of its own, after all
others; a source of size 0 has target 0 and rate 0, its documents are not
taken; in a stratum of documents without words none gets an extra copy; a null
doc_id draws from its text; repeated rows draw alike, so all or none of them
get the extra copy; a very long text is a stratum of its own or shares one with
its like; an empty table gives an empty table; columns of any name pass
through ``emit``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, written
from tidemark.llm.sharding import global_rank


@dataclass(frozen=True)
class Mix:
    """``weights`` are dealt to the sources in code-point order, repeating."""

    weights: tuple[int, ...] = (5, 2, 1)
    cap: int = 3
    seed: str = "mix-1"


def words(text: str) -> Column:
    return F.when(F.col(text).isNull(), 0).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def draw(doc_id: str, text: str, seed: str) -> Column:
    """A number in [0, 1) from the seed and the id: 52 bits of an MD5."""
    who = F.coalesce(F.col(doc_id).cast("string"), F.md5(F.col(text).cast("binary")), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), who).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def stratum(size: str) -> Column:
    return F.floor(6 * F.log(F.greatest(F.col(size), F.lit(1)))).cast("int")


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(source, size) rows -> (source, source_size, target)."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ws = F.array(*(F.lit(w) for w in mix.weights))
    s = total.withColumn("weight", F.element_at(ws, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(mix.weights))) + 1).cast("int")))
    scarce = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, rest = scarce.rowsBetween(Window.unboundedPreceding, -1), scarce.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - mix.cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    s = s.withColumn("level", left.cast("double") / F.sum("weight").over(rest))
    s = s.withColumn("level", F.max("level").over(everything))
    return s.select("source", "source_size", F.least(F.col("level") * F.col("weight"), (mix.cap * F.col("source_size")).cast("double")).alias("target"))


def cuts(measured: DataFrame, mix: Mix) -> DataFrame:
    """(source, stratum, source_size, target, whole, cut): documents of the
    stratum get ``whole`` copies, and one more with a draw up to ``cut`` (null:
    none).  ``measured(source, size, draw)`` is written already."""
    t = written(targets(measured.select("source", "size"), mix), "mixture-targets").withColumnRenamed("source", "of")
    rows = measured.withColumn("stratum", stratum("size"))
    strata = rows.groupBy("source", "stratum").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    in_order = F.array_sort(F.collect_list(F.struct((-F.col("stratum")).alias("down"), "n", "words")))       # at most some 120
    s = strata.groupBy("source").agg(in_order.alias("strata")).join(t, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    s = s.withColumn("whole", F.floor(rate).cast("long")).withColumn("part", rate - F.floor(rate))
    s = s.withColumn("u", draw("source", "source", mix.seed + "|"))

    def step(acc, x):
        upto = acc["upto"] + x["words"]
        mean = x["words"].cast("double") / x["n"]
        wish = F.floor((F.col("part") * upto - acc["got"]) / mean + F.col("u")).cast("long")
        k = F.when(x["words"] > 0, F.least(x["n"], F.greatest(F.lit(0).cast("long"), wish))).otherwise(F.lit(0).cast("long"))
        row = F.struct((-x["down"]).alias("stratum"), x["n"].alias("n"), k.alias("k"))
        return F.struct(upto.alias("upto"), (acc["got"] + k * mean).alias("got"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0.0).alias("got"), F.array().cast("array<struct<stratum:int,n:long,k:long>>").alias("rows"))
    s = s.select("source", "source_size", "target", "whole", F.explode(F.aggregate("strata", start, step, lambda a: a["rows"])).alias("x")).select("*", "x.*").drop("x")
    # places of the strata in the order of (source, stratum, draw)
    before = Window.orderBy(F.col("source").asc_nulls_last(), "stratum").rowsBetween(Window.unboundedPreceding, -1)
    s = written(s.withColumn("last", F.coalesce(F.sum("n").over(before), F.lit(0)) + F.col("k") - 1), "mixture-strata")
    ranked = global_rank(rows.select("source", "stratum", "draw"), [F.col("source").asc_nulls_last(), F.col("stratum"), F.col("draw")], "mixture-draws")
    cut = ranked.select(F.col("at").alias("last"), F.col("draw").alias("cut")).join(s.where("k > 0").select("last"), "last", "left_semi")
    return written(s.join(cut, (s["last"] == cut["last"]) & (s["k"] > 0), "left").select("source", "stratum", "source_size", "target", "whole", "cut"), "mixture-cuts")


def plan(measured: DataFrame, narrow: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``measured(source, size, draw, ...)`` (names are the operator's own) ->
    with source_size, target and copies; ``narrow``: the same rows' source,
    size and draw, written."""
    c = cuts(narrow, mix).withColumnRenamed("source", "of").withColumnRenamed("stratum", "of_stratum")
    j = measured.join(c, F.col("source").eqNullSafe(F.col("of")) & (stratum("size") == F.col("of_stratum")))
    copies = F.col("whole") + F.coalesce(F.col("draw") <= F.col("cut"), F.lit(False)).cast("long")
    return j.withColumn("copies", copies).drop("of", "of_stratum", "whole", "cut")


def measure(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(row, source, size, draw): ``row`` holds all columns of ``docs``, so
    their names cannot clash with the operator's."""
    return docs.select(F.struct("*").alias("row"), F.col("source").alias("source"), words("text").alias("size"),
                       draw("doc_id", "text", mix.seed).alias("draw"))


def emit(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, one row per copy taken."""
    m = measure(docs, mix)
    planned = plan(m, written(m.select("source", "size", "draw"), "mixture-sizes"), mix).where("copies > 0")
    return planned.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def mixed_sizes(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per document: doc_id, size, source_size, target (of its source), copies
    and taken (size * copies)."""
    m = written(measure(docs, mix).select("row.doc_id", "source", "size", "draw"), "mixture-sizes")
    return plan(m, m.select("source", "size", "draw"), mix).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS draw
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (
           ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM s
), t AS (
  SELECT source, source_size, least(max(level) OVER () * weight, CAST(3 * source_size AS DOUBLE)) AS target FROM l
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         CAST('0x' || substr(md5('mix-1|:' || coalesce(source, '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM t
), e AS (
  SELECT *, CAST(floor(6 * ln(greatest(size, 1))) AS INTEGER) AS stratum FROM d
), b AS (
  SELECT e.source, stratum, count(*) AS n, CAST(sum(size) AS BIGINT) AS words, any_value(rate - floor(rate)) AS part, any_value(u) AS u,
         CAST(sum(sum(size)) OVER (PARTITION BY e.source ORDER BY stratum DESC) AS BIGINT) AS upto,
         row_number() OVER (PARTITION BY e.source ORDER BY stratum DESC) AS step, CAST(sum(size) AS DOUBLE) / count(*) AS mean
  FROM e JOIN r ON e.source IS NOT DISTINCT FROM r.source GROUP BY e.source, stratum
), f AS (
  SELECT source, stratum, step, CASE WHEN words > 0 THEN least(n, greatest(0, CAST(floor((part * upto - 0.0) / mean + u) AS BIGINT))) ELSE 0 END AS k,
         0.0 + (CASE WHEN words > 0 THEN least(n, greatest(0, CAST(floor((part * upto - 0.0) / mean + u) AS BIGINT))) ELSE 0 END) * mean AS got FROM b WHERE step = 1
  UNION ALL
  SELECT b.source, b.stratum, b.step, CASE WHEN words > 0 THEN least(n, greatest(0, CAST(floor((part * upto - got) / mean + u) AS BIGINT))) ELSE 0 END,
         got + (CASE WHEN words > 0 THEN least(n, greatest(0, CAST(floor((part * upto - got) / mean + u) AS BIGINT))) ELSE 0 END) * mean
  FROM f JOIN b ON f.source IS NOT DISTINCT FROM b.source AND b.step = f.step + 1
), g AS (
  SELECT e.*, f.k, row_number() OVER (PARTITION BY e.source, e.stratum ORDER BY draw) AS place
  FROM e JOIN f ON e.source IS NOT DISTINCT FROM f.source AND e.stratum = f.stratum
), c AS (
  SELECT g.*, r.source_size, r.target, CAST(floor(rate) AS BIGINT)
         + CASE WHEN draw <= max(CASE WHEN place <= k THEN draw END) OVER (PARTITION BY g.source, g.stratum) THEN 1 ELSE 0 END AS copies
  FROM g JOIN r ON g.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM c
"""
