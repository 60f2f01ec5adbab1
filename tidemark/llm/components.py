"""Connected components of a link table, by alternating stars.

Every round rewrites each link to point at the smallest known neighbour
(large star, then small star) until nothing changes; links and labels stay in
distributed tables, and each half round is written to the shared folder, so a
lost executor costs one half round.  The neighbour minimum is a partial
aggregate, and its join can be split by AQE where a hub has a third of all
links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.session import scratch_scope


def own_exchange(key: str):
    """``key``, as a sum that hides how the table is partitioned already: a
    join on it then gets an exchange of its own on this side too, and AQE can
    split a hot key of the other side."""
    return (F.col(key) + F.lit(0).cast("long")).alias(key)


def _star(links: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m): m is the smallest of u and its neighbours v."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(own_exchange("u"), F.least("u", "m").alias("m"))
    return links.join(least, "u")


def _state(links: DataFrame):
    return links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """``links(a, b)`` (longs, any direction, repeats allowed; rows with a null
    end and self links are ignored) -> ``(node, component)`` for every node
    with a link; ``component`` is the smallest node reachable.  An empty table
    gives an empty table."""
    with scratch_scope(links.sparkSession):
        e = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        e = written(e, f"{name}-links")
        state = _state(e)
        while state[0]:
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            # every u here has only smaller neighbours v
            s = _star(written(large, f"{name}-large"))
            small = (s.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .unionByName(s.select("u", F.col("m").alias("v"))).distinct())
            e = written(small, f"{name}-small")
            was, state = state, _state(e)
            if state == was:
                break
        # stars: every node points at its centre
        roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        return written(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), name, outer=True)
