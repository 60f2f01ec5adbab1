"""Merkle manifest of a dataset, with checkpoint-and-recompute proofs.

Every row is a leaf, the leaves of one language are the bottom of one tree,
and the subroots of all languages are the bottom of the tree that ends in the
root.  While a tree has several nodes on a level, every ``fanout`` consecutive
ones become one node of the next level.

Only every ``stride``-th level is stored: the leaves, then one node per
``fanout ** stride`` leaves, and so on.  ``build`` makes the next stored level
from the last one, one aligned subtree (at most ``fanout ** stride`` nodes) at
a time, and keeps none of the levels between.  ``proofs`` walks the stored
levels downwards: a task gets the stored nodes of one aligned subtree and the
proof of the subtree's own top, regenerates the interior nodes, emits for every
stored node its siblings up to the top followed by the top's proof, and
discards the interior again.

Positions come from a global rank over narrow rows, so a language with a third
of all rows spans many range partitions; subtrees are dealt by (tree, block).
A stored level is a written table, so a lost executor costs one level at most.
Driver loops are over stored levels (a logarithm of the rows).

Edge cases: a null field is written ``-``, an empty text ``0:``; null is a
language of its own, before all others; a null doc_id comes before all others
of its language; rows of one doc_id are ordered by their leaves, so repeated
rows are neighbours with equal leaves; an empty table gives no rows and no
root; a single row is leaf, subroot and root at once, its proof is empty.
Columns other than those of the leaf are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import ascii_lower, batch, grouped, written
from tidemark.llm.sharding import global_rank

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"
ARROW_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


@dataclass(frozen=True)
class Shape:
    """``fanout`` nodes make one; every ``stride``-th level is stored."""

    fanout: int = 8
    stride: int = 3

    @property
    def span(self) -> int:
        return self.fanout ** self.stride


@dataclass(frozen=True)
class Forest:
    """Trees as stored levels (tree, pos, n, digest, row): ``n`` is the number
    of nodes of the tree on that level; a tree that has come down to one node
    stays as it is on the levels above.  ``row`` is the caller's payload of
    the bottom level, null above."""

    levels: list[DataFrame]
    shape: Shape

    @property
    def tops(self) -> DataFrame:
        return self.levels[-1]


@dataclass(frozen=True)
class Manifest:
    """``languages``: trees by language; ``over``: the tree of their subroots;
    ``names(tree, lang)``; ``root``: None for an empty table."""

    languages: Forest
    over: Forest
    names: DataFrame
    root: str | None


# -- hashes ------------------------------------------------------------------

def sealed(value: Column) -> Column:
    """H of a text: lower-case hex SHA-256 of its UTF-8 bytes."""
    return F.sha2(value.cast("binary"), 256)


def leaf_of(fields: Sequence[Column]) -> Column:
    def one(c: Column) -> Column:
        s = c.cast("string")
        return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))
    return sealed(F.concat(*(one(c) for c in fields)))


def combined(digests: Sequence[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def interior(stored: list[str], n: int, shape: Shape) -> list[list[str]]:
    """The levels of one aligned subtree from its stored nodes up to its top:
    ``stride`` steps, or down to one node where the subtree is all of a tree
    of ``n`` nodes."""
    levels = [stored]
    while len(levels) <= shape.stride and (n > shape.span or len(levels[-1]) > 1):
        below = levels[-1]
        levels.append([combined(below[i:i + shape.fanout]) for i in range(0, len(below), shape.fanout)])
    return levels


def siblings(levels: list[list[str]], at: int, fanout: int) -> list[dict[str, str]]:
    """The other nodes of every run from stored node ``at`` up to the top."""
    out = []
    for level in levels[:-1]:
        first = at - at % fanout
        out.append({"left": "".join(level[first:at]), "right": "".join(level[at + 1:first + fanout])})
        at //= fanout
    return out


# -- levels ------------------------------------------------------------------

def _block(shape: Shape) -> Column:
    return F.expr(f"pos div {shape.span}").alias("block")


def _raised(nodes: DataFrame, shape: Shape) -> DataFrame:
    """The next stored level."""
    schema = pa.schema([("tree", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for g in grouped(batches, ["tree", "block"]):
            tree, block, n = (g.column(c)[0].as_py() for c in ("tree", "block", "n"))
            top = interior(g.column("digest").to_pylist(), n, shape)[-1][0]
            made.append((tree, block, -(-n // shape.span), top))
            if len(made) == 1000:
                yield batch(schema, zip(*made))
                made = []
        if made:
            yield batch(schema, zip(*made))

    dealt = nodes.select("tree", _block(shape), "pos", "n", "digest").repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    return dealt.mapInArrow(run, "tree long, pos long, n long, digest string")


def grow(bottom: DataFrame, name: str, shape: Shape) -> Forest:
    """``bottom(tree, pos, n, digest, row)`` -> its stored levels."""
    levels = [bottom]
    while (levels[-1].agg(F.max("n")).first()[0] or 1) > 1:
        levels.append(written(_raised(levels[-1], shape), f"{name}-{len(levels)}"))
    return Forest(levels, shape)


def _with_paths(nodes: DataFrame, tops: DataFrame, shape: Shape) -> DataFrame:
    """``nodes`` of one stored level and ``tops(tree, pos, path)`` of the next
    -> (tree, pos, digest, row, path): siblings of every node up to its tree's
    top, then whatever the path of the top holds.  The top's path travels
    once per subtree."""
    row_type = nodes.schema["row"].dataType if "row" in nodes.columns else T.StringType()
    rows = nodes if "row" in nodes.columns else nodes.withColumn("row", F.lit(None).cast("string"))
    rows = rows.select("tree", _block(shape), "pos", "n", "digest", "row", F.lit(None).cast(PATH).alias("path"))
    heads = tops.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"),
                        F.lit("").alias("digest"), F.lit(None).cast(row_type).alias("row"), "path")
    out = T.StructType([T.StructField("tree", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("digest", T.StringType()),
                        T.StructField("row", row_type), T.StructField("path", T._parse_datatype_string(PATH))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, ["tree", "block"]):
            over, stored = g.column("path")[0].as_py(), g.slice(1).combine_chunks()
            levels = interior(stored.column("digest").to_pylist(), stored.column("n")[0].as_py(), shape)
            paths = [siblings(levels, at, shape.fanout) + over for at in range(stored.num_rows)]
            cols = [stored.column(c).combine_chunks() for c in ("tree", "pos", "digest", "row")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(paths, ARROW_PATH)], names=["tree", "pos", "digest", "row", "path"])

    dealt = rows.unionByName(heads).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    return dealt.mapInArrow(run, out)


def _descend(forest: Forest, tops: DataFrame, name: str) -> DataFrame:
    """Proofs of the bottom nodes; ``tops(tree, pos, path)`` are the paths of
    the trees' single top nodes."""
    for k in range(len(forest.levels) - 2, -1, -1):
        found = _with_paths(forest.levels[k], tops, forest.shape)
        tops = written(found.select("tree", "pos", "path"), f"{name}-paths-{k}") if k else found
    if len(forest.levels) == 1:                 # nothing but single nodes
        rows = forest.levels[0].join(tops.select("tree", "path"), "tree")
        tops = rows.select("tree", "pos", "digest", "row", "path")
    return tops


# -- the operator ------------------------------------------------------------

def build(docs: DataFrame, shape: Shape = Shape(), payload: dict[str, Column] | None = None) -> Manifest:
    """Manifest of ``docs(doc_id, source, lang, n_chars, text, ...)``;
    ``payload``: more columns to keep beside doc_id and leaf for ``proofs``."""
    kept = [c.alias(n) for n, c in (payload or {}).items()]
    rows = written(docs.select("lang", "doc_id", leaf_of([F.col(f) for f in FIELDS]).alias("leaf"), *kept), "merkle-rows")
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()]
    ranked = global_rank(rows, order, "merkle-leaves")

    by_lang = Window.orderBy(F.col("lang").asc_nulls_first())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    langs = written(counts.select(F.col("lang").alias("of"), "n", (F.row_number().over(by_lang) - 1).cast("long").alias("tree"),
                                  F.coalesce(F.sum("n").over(by_lang.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start")), "merkle-langs")
    leaves = ranked.join(langs, F.col("lang").eqNullSafe(F.col("of"))).select(
        "tree", (F.col("at") - F.col("start")).alias("pos"), "n", F.col("leaf").alias("digest"),
        F.struct("doc_id", *(payload or {})).alias("row"))
    languages = grow(leaves, "merkle-level", shape)

    n = langs.agg(F.count("*")).first()[0]
    subroots = languages.tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n).cast("long").alias("n"),
                                     "digest", F.lit(None).cast("string").alias("row"))
    over = grow(subroots, "merkle-over", shape)
    top = over.tops.select("digest").first()
    return Manifest(languages, over, langs.select("tree", F.col("of").alias("lang")), top[0] if top else None)


def proofs(manifest: Manifest) -> DataFrame:
    """(lang, pos, leaf, row, subroot, root, path) per row; ``path`` holds the
    hex digests left and right of the row's node, level by level up to the
    root."""
    m = manifest
    none = m.over.tops.select("tree", "pos", F.array().cast(PATH).alias("path"))
    tops = written(_descend(m.over, none, "merkle-over").select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", "digest"), "merkle-tops")
    found = _descend(m.languages, tops.select("tree", "pos", "path"), "merkle")
    known = tops.select("tree", F.col("digest").alias("subroot")).join(m.names, "tree")
    return found.join(F.broadcast(known) if _small(m) else known, "tree").select(
        "lang", "pos", F.col("digest").alias("leaf"), "row", "subroot", F.lit(m.root).cast("string").alias("root"), "path")


def _small(m: Manifest) -> bool:
    """Whether the table of languages is of a size to broadcast (10,000 rows
    of about 200 bytes)."""
    return m.names.limit(10_001).count() <= 10_000


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(path, leaf, lambda acc, s: sealed(F.concat(s["left"], acc, s["right"])))


def proof_digest(path: Column) -> Column:
    return sealed(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def verification(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, and what a check of
    a partly tampered copy finds: folded_root (from the row's leaf in the
    copy and the original proof) and verified.  The copy has A-Z of the text
    lower-cased where 3 divides the crc32 of the decimal doc_id; a row
    without an id is not tampered with."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(tampered, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    copy = leaf_of([F.col(f) for f in FIELDS if f != "text"] + [text])
    p = proofs(build(docs, shape, {"copy": copy}))
    p = p.select(F.col("row")["doc_id"].alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                 fold(F.col("row")["copy"], F.col("path")).alias("folded_root"))
    return p.withColumn("verified", F.col("folded_root") == F.col("root"))


SQL = """
WITH RECURSIVE c AS (  -- the table of CRC-32, from its polynomial
  SELECT list(v ORDER BY i) AS crc FROM (
    SELECT i, list_reduce([i] || range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v
    FROM (SELECT unnest(range(256)) AS i))
), f AS (
  SELECT doc_id, lang, text,
         list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)],
                        lambda v: CASE WHEN v IS NULL THEN '-' ELSE CAST(octet_length(encode(v)) AS VARCHAR) || ':' || v END) AS head,
         CASE WHEN xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS BIGINT)),
                       lambda a, b: xor(a >> 8, crc[CAST((xor(a, b) & 255) + 1 AS BIGINT)])), 4294967295) % 3 = 0
              THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS copied
  FROM documents, c
), d AS (
  SELECT doc_id, lang, sha256(array_to_string(head, '') || CASE WHEN text IS NULL THEN '-' ELSE CAST(octet_length(encode(text)) AS VARCHAR) || ':' || text END) AS leaf,
         sha256(array_to_string(head, '') || CASE WHEN copied IS NULL THEN '-' ELSE CAST(octet_length(encode(copied)) AS VARCHAR) || ':' || copied END) AS copy
  FROM f
), l AS (
  SELECT doc_id, leaf, copy, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d
), up AS (
  SELECT tree, CAST(0 AS BIGINT) AS lvl, pos, n, leaf AS h FROM l
  UNION ALL
  SELECT tree, lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, lvl, pos // 8, n
), sub AS (
  SELECT tree, h AS subroot FROM up WHERE n = 1
), over_ AS (
  SELECT CAST(0 AS BIGINT) AS lvl, tree AS pos, count(*) OVER () AS n, subroot AS h FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM over_ WHERE n > 1 GROUP BY lvl, pos // 8, n
), s AS (
  SELECT tree, lvl, pos, coalesce(string_agg(h, '') OVER (PARTITION BY tree, lvl, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
         coalesce(string_agg(h, '') OVER (PARTITION BY tree, lvl, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS z FROM up WHERE n > 1
), s2 AS (
  SELECT lvl, pos, coalesce(string_agg(h, '') OVER (PARTITION BY lvl, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
         coalesce(string_agg(h, '') OVER (PARTITION BY lvl, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS z FROM over_ WHERE n > 1
), steps AS (
  SELECT l.tree, l.pos, s.lvl AS step, s.a, s.z FROM l JOIN s ON s.tree = l.tree AND s.pos = l.pos >> CAST(3 * s.lvl AS INTEGER)
  UNION ALL
  SELECT l.tree, l.pos, 1000 + s2.lvl, s2.a, s2.z FROM l JOIN s2 ON s2.pos = l.tree >> CAST(3 * s2.lvl AS INTEGER)
), p AS (
  SELECT tree, pos, string_agg(a || z, '' ORDER BY step) AS sib, list(a || '|' || z ORDER BY step) AS steps FROM steps GROUP BY tree, pos
), o AS (
  SELECT doc_id, leaf, subroot, (SELECT h FROM over_ WHERE n = 1) AS root, sha256(coalesce(sib, '')) AS proof_sha256,
         list_reduce([copy] || coalesce(steps, []), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) AS folded_root
  FROM l JOIN sub USING (tree) LEFT JOIN p USING (tree, pos)
)
SELECT *, folded_root = root AS verified FROM o
"""
