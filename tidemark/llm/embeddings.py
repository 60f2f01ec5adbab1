"""Embedding near-duplicates by PCA-ordered tiles.

1. Equal vectors become one class with a multiplicity, so copies are never
   compared with each other; the classes are scaled to length 1.
2. The directions of the second-moment matrix, summed over all vectors, rotate
   the coordinates so that the leading ones carry most of every product.
3. Classes are ordered by their first coordinate and cut into blocks of
   ``block`` rows; a block is one row that holds its ids and its matrix.  Two
   blocks meet in a tile unless their leading coordinates are too far apart
   for any pair (unit vectors with cosine t are at most sqrt(2 - 2t) apart).
   Matrices are never shuffled, as every block meets many others: in a round
   some blocks (``held`` bytes) are broadcast and all others scanned in place,
   each block taking the tiles of about half of the blocks it meets.
4. In a tile the first ``step`` coordinates of all pairs are multiplied; a
   pair goes on only while the product so far plus the product of the suffix
   norms (Cauchy-Schwarz) can reach the threshold.  What is left is computed
   in double precision from the original components and decided there.
5. A tile returns a link count per class and ties every linked class to the
   first of its group in the tile, not the links: output is linear in the rows
   of a tile however large a group of near copies is.  Components follow.

Pruning leaves a slack of 1e-3 for single-precision products; the decision
itself has no tolerance.

Edge cases: null vectors, zero vectors and vectors with null or non-finite
components link with nothing (components from 1e150 on count as
non-finite, vectors all below 1e-150 as zero); vectors
of different lengths never link with each other; a null vec_id takes part but
is never a component id of others; a group of null ids only has a null
component and is kept; repeated rows count as other vectors.
"""

from __future__ import annotations

import math
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import batch, written
from tidemark.llm.components import connected_components
from tidemark.session import scratch_path, scratch_scope, shuffles_freed


@dataclass(frozen=True)
class Params:
    """``lead``: leading coordinates whose ranges are kept per block; ``held``:
    bytes of the blocks that are broadcast at a time."""

    threshold: float = 0.9
    block: int = 4096
    piece: int = 1024
    step: int = 16
    lead: int = 4
    slack: float = 1e-3
    held: int = 1 << 25


STAND_IN = 1 << 62


def _spectra(classes: DataFrame) -> dict[int, np.ndarray]:
    """Per vector length the principal directions, leading first.  Every batch
    adds its moment matrix (d x d), which Spark sums cell by cell."""
    schema = pa.schema([("dims", pa.int32()), ("cell", pa.int32()), ("v", pa.float64())])

    def moments(batches):
        for b in batches:
            rows = b.column("v").to_pylist()
            for d in {len(r) for r in rows}:
                x = np.array([r for r in rows if len(r) == d], np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                yield batch(schema, [np.full(d * d, d, np.int32), np.arange(d * d, dtype=np.int32), (x.T @ x).ravel()])

    cells = classes.select("v").mapInArrow(moments, "dims int, cell int, v double").groupBy("dims", "cell").agg(F.sum("v").alias("v"))
    got = cells.orderBy("dims", "cell").collect()                       # d * d numbers per vector length
    out = {}
    for d in {r["dims"] for r in got}:
        m = np.array([r["v"] for r in got if r["dims"] == d]).reshape(d, d)
        out[d] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()
    return out


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For positions 0..n-1 the smallest position reachable over links (a, b)."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[a], low[b])
        was = low.copy()
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        low = low[low]
        if np.array_equal(low, was):
            return low


def linked(x, xr, y, yr, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the pairs with cosine >= threshold.  ``x``, ``y``:
    original components in double; ``xr``, ``yr``: rotated unit vectors in
    single precision, leading coordinates first."""
    d, k = xr.shape[1], min(p.step, xr.shape[1])
    sx, sy = (np.sqrt(np.maximum(0, (z[:, k:].astype(np.float64) ** 2).sum(axis=1))).astype(np.float32) for z in (xr, yr))
    product = xr[:, :k] @ yr[:, :k].T
    i, j = np.nonzero(product >= np.float32(p.threshold - p.slack) - np.outer(sx, sy))
    at = product[i, j]
    while k < d and len(i):
        m = min(k + p.step, d)
        at = at + np.einsum("ij,ij->i", xr[i, k:m], yr[j, k:m])
        k = m
        sx, sy = (np.sqrt(np.maximum(0, (z[:, k:].astype(np.float64) ** 2).sum(axis=1))) for z in (xr, yr))
        on = at >= p.threshold - p.slack - sx[i] * sy[j]
        i, j, at = i[on], j[on], at[on]
    if not len(i):
        return i, j
    dot = np.einsum("ij,ij->i", x[i], y[j])
    size = np.sqrt(np.einsum("ij,ij->i", x, x))[i] * np.sqrt(np.einsum("ij,ij->i", y, y))[j]
    on = dot >= p.threshold * size
    return i[on], j[on]


def block_rows(dims: int, p: Params) -> int:
    """``p.block``, or fewer where vectors are so long that a block would pass 16 MB."""
    return max(1, min(p.block, (1 << 24) // (8 * dims)))


def _blocks(classes: DataFrame, spectra: dict[int, np.ndarray], p: Params) -> DataFrame:
    """(dims, block, ids, counts, m, low, high): matrices of at most
    ``p.block`` rows, in order of the first principal coordinate."""
    first = {d: w[:, 0] for d, w in spectra.items()}
    schema = pa.schema([("dims", pa.int32()), ("key", pa.float64())])

    def project(batches):
        for b in batches:
            rows = b.column("v").to_pylist()
            key = [float(np.dot(r, first[len(r)]) / np.linalg.norm(r)) for r in map(np.asarray, rows)]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("n"), b.column("v"), pa.array([len(r) for r in rows], pa.int32()),
                                              pa.array(key, pa.float64())], names=["node", "n", "v", "dims", "key"])

    keyed = classes.select("node", "n", "v").mapInArrow(project, "node long, n long, v array<double>, dims int, key double")
    out = pa.schema([("dims", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("m", pa.binary()),
                     ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])

    def pack(batches):
        held: dict[int, list] = {}

        def flush(d):
            rows = held.pop(d)
            m = np.array([r[2] for r in rows], np.float64)
            lead = (m / np.linalg.norm(m, axis=1, keepdims=True)) @ spectra[d][:, :p.lead]
            return batch(out, [[d], [np.array([r[0] for r in rows], "<i8").tobytes()], [np.array([r[1] for r in rows], "<i8").tobytes()],
                               [m.tobytes()], [lead.min(axis=0)], [lead.max(axis=0)]])

        for b in batches:
            for node, n, v, d in zip(*(b.column(c).to_pylist() for c in ("node", "n", "v", "dims")), strict=True):
                held.setdefault(d, []).append((node, n, v))
                if len(held[d]) == block_rows(d, p):
                    yield flush(d)
        for d in list(held):
            yield flush(d)

    ordered = keyed.repartitionByRange("dims", "key").sortWithinPartitions("dims", "key", "node")
    packed = ordered.mapInArrow(pack, "dims int, ids binary, counts binary, m binary, low array<double>, high array<double>")
    # a file per block, so that a scan can deal them one by one
    path = scratch_path(classes.sparkSession, "embedding-blocks")
    with shuffles_freed(classes.sparkSession):
        packed.withColumn("block", F.monotonically_increasing_id()).write.option("maxRecordsPerFile", 1).parquet(path)
    return classes.sparkSession.read.parquet(path)


@contextmanager
def _many_splits(spark: SparkSession):
    """Scans planned inside are cut into several splits per core: tiles take minutes, not bytes."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def rounds(sizes: list[tuple[int, int]], held: int) -> list[list[int]]:
    """Blocks, of (block, bytes), in lists of at most ``held`` bytes (or of one block)."""
    out, room = [], 0
    for block, size in sizes:
        if not out or size > room:
            out.append([])
            room = held
        out[-1].append(block)
        room -= size
    return out


def near_duplicates(vectors: DataFrame, p: Params = Params()) -> DataFrame:
    """``vectors(vec_id, embedding, ...)`` -> vec_id, n_links (other vectors
    with cosine >= threshold), component_id (smallest vec_id reachable, itself
    included), kept (vec_id = component_id); one row per row."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    ok = F.coalesce(F.forall(v, lambda x: F.coalesce(F.abs(x) < 1e150, F.lit(False))) & F.exists(v, lambda x: F.abs(x) > 1e-150), F.lit(False))
    stand_in = F.lit(STAND_IN) + F.xxhash64(F.col("embedding").cast("string")).bitwiseAND(F.lit(STAND_IN - 1))
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), stand_in).alias("node"), F.when(ok, v).alias("v"))
    rows = written(rows.withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(F.col("v").cast("string"), 256))), "embedding-rows")
    spark = vectors.sparkSession
    with scratch_scope(spark):
        classes = written(rows.where("v is not null").groupBy("key").agg(F.min("node").alias("node"), F.count("*").alias("n"), F.first("v").alias("v")),
                          "embedding-classes")
        spectra = _spectra(classes)
        blocks = _blocks(classes, spectra, p)
        far = 2 - 2 * (p.threshold - p.slack)                              # squared distance of a linked pair at most
        ranges = blocks.select("dims", "block", "low", "high")
        a, b = (ranges.select("dims", *(F.col(c).alias(c + s) for c in ("block", "low", "high"))) for s in ("_a", "_b"))
        gap = F.aggregate(F.zip_with(F.zip_with("low_a", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high_a", lambda x, y: x - y),
                                     lambda x, y: F.greatest(x, y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x * x)
        # blocks (not vectors) meet through cells of the first coordinate as wide as a linked pair can be apart
        cell = lambda c, by: F.floor(F.element_at(c, 1) / math.sqrt(far)).cast("int") + by
        a = a.withColumn("cell", F.explode(F.sequence(cell("low_a", 0), cell("high_a", 0))))
        b = b.withColumn("cell", F.explode(F.sequence(cell("low_b", -1), cell("high_b", 1))))
        tiles = a.join(b, ["dims", "cell"]).where("block_a <= block_b").where(gap <= far).select("block_a", "block_b").distinct()
        # every second tile the other way round: in each round all blocks have tiles, not only those before the broadcast ones
        order = blocks.select("block", (F.length("m") + F.length("ids") + F.length("counts")).alias("size")).orderBy("block").collect()   # two numbers per block
        place = spark.createDataFrame([(r["block"], k) for k, r in enumerate(order)], "block long, k int")
        for s in ("_a", "_b"):
            tiles = tiles.join(place.select(F.col("block").alias("block" + s), F.col("k").alias("k" + s)), "block" + s)
        turned = F.pmod(F.col("k_a") + F.col("k_b"), F.lit(2)) == 1
        tiles = written(tiles.select(F.when(turned, F.col("block_b")).otherwise(F.col("block_a")).alias("block_a"),
                                     F.when(turned, F.col("block_a")).otherwise(F.col("block_b")).alias("block_b")), "embedding-tiles")
        half = [blocks.select(*(F.col(c).alias(c + s) for c in ("block", "dims", "ids", "counts", "m"))) for s in ("_a", "_b")]
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

        def compare(batches):
            """(a, null, n): n linked vectors found for a; (a, b, null): a tie."""
            for t in batches:
                for r in t.to_pylist():
                    d = r["dims_a"]
                    (ia, ca, xa), (ib, cb, xb) = ((np.frombuffer(r["ids" + s], "<i8"), np.frombuffer(r["counts" + s], "<i8"),
                                                   np.frombuffer(r["m" + s], np.float64).reshape(-1, d)) for s in ("_a", "_b"))
                    ra, rb = ((x / np.linalg.norm(x, axis=1, keepdims=True) @ spectra[d]).astype(np.float32) for x in (xa, xb))
                    same = r["block_a"] == r["block_b"]
                    na, nb, ends = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64), []
                    for s in range(0, len(ia), p.piece):
                        for u in range(s if same else 0, len(ib), p.piece):
                            i, j = linked(xa[s:s + p.piece], ra[s:s + p.piece], xb[u:u + p.piece], rb[u:u + p.piece], p)
                            i, j = i + s, j + u
                            if same:
                                i, j = i[i < j], j[i < j]
                            if not len(i):
                                continue
                            na += np.bincount(i, cb[j], len(ia)).astype(np.int64)
                            nb += np.bincount(j, ca[i], len(ib)).astype(np.int64)
                            # one link from every linked vector to the root of its group in this piece
                            ids = np.concatenate([ia[s:s + p.piece], ib[u:u + p.piece]])
                            cut = len(ia[s:s + p.piece])
                            low = roots(i - s, j - u + cut, len(ids))
                            tied = np.flatnonzero(low != np.arange(len(ids)))
                            ends.append((ids[tied], ids[low[tied]]))
                    for ids, n in ((ia, na), (ib, nb)):
                        hit = np.flatnonzero(n)
                        yield batch(schema, [ids[hit], pa.nulls(len(hit), pa.int64()), n[hit]])
                    for x, y in ends:
                        yield batch(schema, [x, y, pa.nulls(len(x), pa.int64())])

        path = scratch_path(spark, "embedding-links")
        for some in rounds([(r["block"], r["size"]) for r in order], p.held):
            here = F.broadcast(tiles.where(F.col("block_b").isin(some)))
            met = half[0].join(here, "block_a").join(F.broadcast(half[1].where(F.col("block_b").isin(some))), "block_b")
            with _many_splits(spark), shuffles_freed(spark):
                met.mapInArrow(compare, "a long, b long, n long").write.mode("append").parquet(path)
        found = spark.read.schema("a long, b long, n long").parquet(path) if order else spark.createDataFrame([], "a long, b long, n long")
        counts = written(found.where("n is not null").groupBy("a").agg(F.sum("n").alias("n")), "embedding-counts")
        comps = connected_components(found.where("b is not null").select("a", "b"), "embedding-cc")
        label = classes.select("key", "node", F.col("n").alias("copies")) \
            .join(counts.withColumnRenamed("a", "node"), "node", "left").join(comps, "node", "left")
        label = written(label.select("key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                                     F.coalesce("component", "node").alias("component")), "embedding-labels", outer=True)
    out = rows.select("node", "key").join(label, "key", "left")
    component = F.coalesce("component", "node")
    return out.select(F.when(F.col("node") < STAND_IN, F.col("node")).alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.when(component < STAND_IN, component).alias("component_id"), (F.col("node") == component).alias("kept"))
