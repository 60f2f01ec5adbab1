"""Near-duplicate documents: MinHash bands, sequential Bayesian verification,
exact confirmation, components.

1. ``sketch``: per document the distinct word shingles as 64-bit hashes, the
   size of the set, a 128-bit key of the set and a signature of
   ``bands * rows`` minima.
2. Documents with equal sets become one class, a node of the link graph with
   a number of its own.
3. Classes that agree on a band share a bucket.  Round 1 pairs every class
   with the smallest class of each of its buckets only (linear in the bucket).
4. Bayesian check: signature batches of ``batch`` hashes are compared one
   after the other; after each, a pair goes when the posterior probability
   (uniform prior) that its similarity reaches the threshold is under
   ``miss``.  Survivors are confirmed on the full sets.
5. Components of the confirmed links.  Round 2 revisits the buckets that
   still hold several components and compares only classes of different
   components, in blocks of bounded size: the same check, the same
   confirmation, inside the task.  Copies of one group, which round 1 has
   joined, are never compared pairwise, and no table of pairs is written.

So every pair that shares a band is either confirmed, rejected by the
Bayesian bound, rejected exactly, or already in one component.  With 32 bands
of 4 rows a pair at similarity 0.8 shares no band with probability 5e-8.

Edge cases: null or wordless text has the empty set (``n_shingles`` 0) and is
linked with nothing; with fewer words than ``shingle_words`` the whole
sequence is the one shingle; repeated rows get equal results; rows of one
doc_id with different texts are judged by their own text: links and components
are between texts, and a component is named by its smallest doc_id only at the
end, so two components may bear one name, and of each one row's text is kept
(by ``deduplicated``: the smallest id, of its texts one); a null doc_id takes
part but never becomes the component id of others: a group of only null ids
has a null component_id, and its rows with one of its texts are kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch, grouped, utf8, written
from tidemark.llm.components import connected_components, own_exchange
from tidemark.session import scratch_scope


@dataclass(frozen=True)
class Params:
    """``percent``: links have 100 * intersection >= percent * union.
    ``miss``: posterior probability under which a pair is dropped early.
    ``block``: classes of one bucket compared in one piece in round 2."""

    shingle_words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    batch: int = 32
    miss: float = 1e-6
    block: int = 512
    seed: int = 20

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


# -- shingles and signatures (inside tasks) ---------------------------------

CACHED_WORDS = 500_000          # words whose hash a task keeps; only speed depends on it
CHUNK = 1024                    # shingles hashed in one piece


class WordHashes(dict):
    def __missing__(self, word):
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    k = min(k, n)
    out = h[:n - k + 1] + np.uint64(k)
    for j in range(1, k):
        out = mix(out) + h[j:n - k + 1 + j]
    return np.unique(mix(out))


def multipliers(p: Params) -> np.ndarray:
    rng = np.random.default_rng(p.seed)
    return rng.integers(0, 2**63, p.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(s: np.ndarray, mult: np.ndarray) -> bytes:
    out = np.full(len(mult), np.iinfo(np.uint64).max)
    for i in range(0, len(s), CHUNK):
        np.minimum(out, (s[i:i + CHUNK, None] * mult).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype("<u4").tobytes()


SKETCH = "node long, h long, n_shingles long, set_key binary, sig binary"


def sketch(nodes: DataFrame, p: Params) -> DataFrame:
    """(node, h, n_shingles, set_key, sig); key and signature are null for the
    empty set."""
    schema = pa.schema([("node", pa.int64()), ("h", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("sig", pa.binary())])

    def run(batches):
        mult, hashes = multipliers(p), WordHashes()
        for b in batches:
            n, keys, sigs = [], [], []
            for text in b.column("text"):
                s = shingle_set(text.as_py(), p.shingle_words, hashes)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s, mult) if len(s) else None)
            yield batch(schema, [b.column("node"), b.column("h"), n, keys, sigs])

    return nodes.select("node", "h", utf8("text").alias("text")).mapInArrow(run, SKETCH)


# -- verification -----------------------------------------------------------

def least_matches(p: Params) -> list[tuple[int, int]]:
    """(hashes seen, fewest equal ones with which a pair goes on).  The
    posterior of similarity s after m of n equal hashes is Beta(m+1, n-m+1);
    P(s >= t) is P(Binomial(n+1, t) <= m)."""
    t, out = p.percent / 100, []
    for n in range(p.batch, p.hashes + 1, p.batch):
        tail, m = 0.0, -1
        while True:
            tail += math.comb(n + 1, m + 1) * t ** (m + 1) * (1 - t) ** (n - m)
            if tail >= p.miss or m + 1 > n:
                break
            m += 1
        out.append((n, m + 1))
    return out


def matrix(sigs, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), "<u4").reshape(-1, width)


def surviving(x: np.ndarray, y: np.ndarray, looks: list[tuple[int, int]]) -> np.ndarray:
    """Positions of the signature pairs (rows of x, y) that pass every look."""
    alive, equal, seen = np.arange(len(x)), np.zeros(len(x), np.int32), 0
    for n, least in looks:
        equal = equal + (x[alive, seen:n] == y[alive, seen:n]).sum(axis=1, dtype=np.int32)
        on = equal >= least
        alive, equal, seen = alive[on], equal[on], n
        if not len(alive):
            break
    return alive


def bayes_filter(pairs: DataFrame, sigs: DataFrame, p: Params) -> DataFrame:
    """Pairs (a, b) that the sequential check lets through."""
    schema, looks, width = pa.schema([("a", pa.int64()), ("b", pa.int64())]), least_matches(p), p.hashes

    def run(batches):
        for b in batches:
            if b.num_rows:
                keep = surviving(matrix(b.column("sa").to_pylist(), width), matrix(b.column("sb").to_pylist(), width), looks)
                yield batch(schema, [b.column("a").take(pa.array(keep)), b.column("b").take(pa.array(keep))])

    return (pairs.join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
                 .join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
                 .select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"))


def similar(x: np.ndarray, y: np.ndarray, p: Params) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= p.percent * (len(both) - common)


def confirm(pairs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        hashes, last, left = WordHashes(), None, None
        for b in batches:
            out = []
            for a, c, ta, tb in zip(*(b.column(n).to_pylist() for n in ("a", "b", "ta", "tb")), strict=True):
                if a != last:
                    last, left = a, shingle_set(ta, p.shingle_words, hashes)
                if similar(left, shingle_set(tb, p.shingle_words, hashes), p):
                    out.append((a, c))
            yield batch(schema, zip(*out) if out else ([], []))

    return (pairs.join(texts.select(F.col("node").alias("b"), utf8("text").alias("tb")), "b")
                 .join(texts.select(F.col("node").alias("a"), utf8("text").alias("ta")), "a")
                 .select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"))


def cross_component_links(members: DataFrame, p: Params) -> DataFrame:
    """Round 2.  ``members(key, band, leader, size, node, component, sig,
    text)`` of buckets with several components -> links between components.
    A bucket is cut into blocks of ``p.block`` classes and a task holds two
    blocks at a time.  Pairs with the leader were compared in round 1, a pair
    that shares an earlier band is left to that band, and components that one
    link has joined are not compared again.  Only links leave the task, at
    most one per component and pair of blocks."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / p.block)).cast("int")
    schema, looks, width, rows = pa.schema([("a", pa.int64()), ("b", pa.int64())]), least_matches(p), p.hashes, p.rows
    own = F.pmod(F.xxhash64("node", "key"), blocks.cast("long")).cast("int")
    dealt = (members.where("node <> leader").withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .select("key", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     "own", "node", "component", "sig", utf8("text").alias("text")))

    def run(batches):
        hashes = WordHashes()
        for g in grouped(batches, ["key", "i", "j"]):
            own_, node, comp = (g.column(c).to_numpy().copy() for c in ("own", "node", "component"))
            if len(node) < 2 or (comp == comp[0]).all():
                continue
            i, j, band = g.column("i")[0].as_py(), g.column("j")[0].as_py(), g.column("band")[0].as_py()
            sig, texts, sets, out = matrix(g.column("sig").to_pylist(), width), g.column("text"), {}, []

            def full(k):
                if k not in sets:
                    sets[k] = shingle_set(texts[k].as_py(), p.shingle_words, hashes)
                return sets[k]

            left = np.flatnonzero(own_ == i)
            right = left if i == j else np.flatnonzero(own_ == j)
            for at in left.tolist():
                to = right[comp[right] != comp[at]]
                if i == j:
                    to = to[to > at]
                if band and len(to):
                    same = (sig[to, :band * rows] == sig[at, :band * rows]).reshape(len(to), band, rows).all(axis=2).any(axis=1)
                    to = to[~same]
                if len(to):
                    to = to[surviving(np.broadcast_to(sig[at], (len(to), width)), sig[to], looks)]
                for k in to.tolist():
                    if comp[k] != comp[at] and similar(full(at), full(k), p):
                        out.append((int(node[at]), int(node[k])))
                        comp[comp == comp[k]] = comp[at]
            if out:
                yield batch(schema, zip(*out))

    return (dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
                 .mapInArrow(run, "a long, b long"))


# -- the operator -----------------------------------------------------------

#: Nodes from here on stand in for documents without an id.
STAND_IN = 1 << 62


def with_node(docs: DataFrame) -> DataFrame:
    """(node, h, text): the id, or for a null id a stand-in above every id,
    made from the text; a hash of the text."""
    return docs.select(node_of("doc_id", "text").alias("node"), F.xxhash64("text").alias("h"), "text")


def node_of(doc_id: str, text: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(STAND_IN) + F.xxhash64(text).bitwiseAND(F.lit(STAND_IN - 1)))


def components(docs: DataFrame, p: Params) -> DataFrame:
    """(node, h, n_shingles, group, component) per row of ``docs``: ``group``
    is the number of the component (null for the empty set), ``component`` its
    smallest node."""
    nodes = with_node(docs)
    t = written(sketch(nodes, p), "minhash-sketch")
    with scratch_scope(docs.sparkSession):          # of all this only the labels are read again
        # a class is numbered as it is written; the text of one of its rows stands for it
        classes = written(t.where("set_key is not null").groupBy("set_key")
                           .agg(F.min(F.struct("node", "h")).alias("of"), F.first("sig").alias("sig"))
                           .select(F.monotonically_increasing_id().alias("node"), "set_key", F.col("of.node").alias("doc"), F.col("of.h").alias("h"), "sig"),
                          "minhash-classes")
        sigs = classes.select("node", "sig")

        keys = F.transform(F.sequence(F.lit(0), F.lit(p.bands - 1)),
                           lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.substring("sig", i * (4 * p.rows) + 1, F.lit(4 * p.rows))).alias("key")))
        banded = classes.select("node", F.explode(keys).alias("x")).select("node", "x.band", "x.key")
        buckets = (banded.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("size"), F.min("band").alias("band"))
                         .where("size > 1").select(own_exchange("key"), "leader", "size", "band"))
        members = written(banded.select("key", "node").join(buckets, "key"), "minhash-members")
        wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "doc", "h")
        texts = written(nodes.withColumnRenamed("node", "doc").join(wanted, ["doc", "h"]).select("node", "text").dropDuplicates(["node"]), "minhash-texts")

        star = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
        first = written(confirm(bayes_filter(star, sigs, p), texts, p), "minhash-links")
        found = connected_components(first, "minhash-cc1")

        labelled = written(members.where("size > 2 and node <> leader").join(found, "node", "left")
                                  .withColumn("component", F.coalesce("component", "node")), "minhash-labelled")
        mixed = (labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"))
                         .where("x <> y").select(own_exchange("key")))
        open_ = labelled.join(mixed, "key", "left_semi").join(sigs, "node").join(texts, "node")
        second = written(cross_component_links(open_, p), "minhash-links2")

        # round 2 joins components: the same again, one level up
        up = connected_components(_relabelled(_relabelled(second, found, "a"), found, "b"), "minhash-cc2")
        final = found.unionByName(up.select("node", F.col("node").alias("component"))).dropDuplicates(["node"]) \
                     .join(up.select(F.col("node").alias("component"), F.col("component").alias("over")), "component", "left") \
                     .select("node", F.coalesce("over", "component").alias("component"))
        grouped_ = written(classes.select("set_key", "node", "doc").join(final, "node", "left")
                                  .select("set_key", "doc", F.coalesce("component", "node").alias("group")), "minhash-groups")
        least = grouped_.groupBy("group").agg(F.min("doc").alias("component")).select(own_exchange("group"), "component")
        label = written(grouped_.join(least, "group").select("set_key", "group", "component"), "minhash-label", outer=True)
    out = t.select("node", "h", "n_shingles", "set_key").join(label, "set_key", "left")
    return out.select("node", "h", "n_shingles", "group", F.coalesce("component", "node").alias("component"))


def _relabelled(links: DataFrame, found: DataFrame, end: str) -> DataFrame:
    label = found.select(F.col("node").alias(end), F.col("component").alias("to"))
    return links.join(label, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> one row per row of ``docs``: doc_id,
    n_shingles, component_id (smallest doc_id reachable over links, itself
    included) and kept (doc_id = component_id).  Other columns are not read."""
    node, component = F.col("node"), F.col("component")
    return components(docs, p).select(F.when(node < STAND_IN, node).alias("doc_id"), "n_shingles",
                                      F.when(component < STAND_IN, component).alias("component_id"), (node == component).alias("kept"))


def deduplicated(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``docs`` with one document of each group, all columns as
    they are; of repeated rows (same id, same text) one stays."""
    with scratch_scope(docs.sparkSession):
        c = written(components(docs, p).select("node", "h", "group"), "minhash-judged")
        best = c.where("group is not null").groupBy("group").agg(F.min(F.struct("node", "h")).alias("of")).select("of.node", "of.h")
        stay = written(best.unionByName(c.where("group is null").select("node", "h")).distinct(), "minhash-stay", outer=True)
    rows = docs.select(F.struct("*").alias("row"), node_of("doc_id", "text").alias("node"), F.xxhash64("text").alias("h"))
    return rows.join(stay, ["node", "h"], "left_semi").dropDuplicates(["node", "h"]).select("row.*")
