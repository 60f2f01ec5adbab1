"""Positional line diff of very long files by blocks of lines.

``functions.text.changed_line_numbers`` compares two texts inside one row.
Here every text is cut once into blocks of lines.  Pairs of texts meet on
``(text, block)`` with hashes only; just the blocks that differ fetch their
lines, so no row holds both texts and a long file is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import split_lines
from tidemark.plans.materialize import materialize

BLOCK_LINES = 1024


def line_blocks(texts: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """``texts(id, content)`` -> (id, block, digest, lines): the lines of block
    ``block`` (from 0) and a digest that is equal for equal lines.  A null or
    empty text has one empty line."""
    t = texts.select("id", split_lines("content").alias("all_lines"))
    t = t.select("id", "all_lines", F.ceil(F.size("all_lines") / block_lines).cast("int").alias("n"))
    cut = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda b: F.slice("all_lines", b * block_lines + 1, F.lit(block_lines)))
    b = t.select("id", F.posexplode(cut).alias("block", "lines"))
    # lines hold no line feed: joined with one, and with their number, they are told apart
    digest = F.concat(F.size("lines").cast("string"), F.lit(":"), F.md5(F.concat_ws("\n", "lines")))
    return b.select("id", "block", digest.alias("digest"), "lines")


def changed_line_blocks(pairs: DataFrame, texts: DataFrame, keys: Sequence[str], block_lines: int = BLOCK_LINES) -> DataFrame:
    """J6 for ``pairs(keys..., old_id, new_id)`` of ``texts(id, content)``, ids
    unique: (keys..., block, changed_lines), one row per block of the new text
    that holds a changed line, with its 1-based line numbers in the file.

    A null ``old_id``, like an id that is not among the texts, is an empty
    text; a pair without a new text has no rows.  Pairs with a null
    ``old_id`` are kept out of the joins on it, so that first versions are no
    hot key.
    """
    keys = list(keys)
    blocks = materialize(line_blocks(texts, block_lines), "line-blocks")
    digests = blocks.select("id", "block", "digest")
    p = pairs.select(*keys, "old_id", "new_id").where("new_id is not null")
    new = p.join(digests.withColumnRenamed("id", "new_id"), "new_id")
    old = digests.select(F.col("id").alias("old_id"), "block", F.col("digest").alias("old_digest"))
    later = new.where("old_id is not null").join(old, ["old_id", "block"], "left").where("old_digest is null or old_digest <> digest")
    first = new.where("old_id is null").withColumn("old_digest", F.lit(None).cast("string"))
    columns = [*keys, "old_id", "new_id", "block", "old_digest"]
    differ = materialize(later.select(*columns).unionByName(first.select(*columns)), "differing-blocks")

    new_lines = blocks.select(F.col("id").alias("new_id"), "block", F.col("lines").alias("new_lines"))
    old_lines = blocks.select(F.col("id").alias("old_id"), "block", F.col("lines").alias("old_lines"))
    d = differ.join(new_lines, ["new_id", "block"])
    with_old = d.where("old_digest is not null").join(old_lines, ["old_id", "block"])
    # every text has a block 0, so without one the old text is empty: one empty line
    nothing = F.when(F.col("block") == 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    columns = [*keys, "block", "new_lines"]
    both = with_old.select(*columns, "old_lines") \
        .unionByName(d.where("old_digest is null").select(*columns, nothing.alias("old_lines")))
    changed = F.filter(F.sequence(F.lit(1), F.size("new_lines")),
                       lambda i: ~F.try_element_at("old_lines", i).eqNullSafe(F.try_element_at("new_lines", i)))
    out = both.select(*keys, "block", F.transform(changed, lambda i: i + F.col("block") * block_lines).alias("changed_lines"))
    return out.where(F.size("changed_lines") > 0)


def whole_files(blocks: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The numbers of ``changed_line_blocks`` as one ascending array per pair,
    empty where nothing changed (numbers only, no text)."""
    keys = list(keys)
    by_block = F.array_sort(F.collect_list(F.struct("block", "changed_lines")))
    a = blocks.groupBy(*keys).agg(F.flatten(F.transform(by_block, lambda x: x["changed_lines"])).alias("changed_lines"))
    return pairs.select(*keys).join(a, keys, "left").select(*keys, F.coalesce("changed_lines", F.array().cast("array<int>")).alias("changed_lines"))
