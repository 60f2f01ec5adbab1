"""Token-id output in packed rows.

Texts are encoded with a public byte-level vocabulary (its file is a
parameter), an end-of-text id is appended, and documents longer than a row are
cut into pieces without loss.  Pieces are packed into rows of ``length`` ids
by best fit decreasing: longest first, each into the fullest open row that
still holds it, found by a search over a segment tree of capacities.

Packing runs on pools of at most ``pool`` pieces: pieces are dealt by a hash
of document and piece, ordered inside their partition, and packed pool by
pool, so memory is bounded whatever a document, source or group of copies
holds, and a task that runs again gives the same rows.

Every output row is one packed row: ``ids`` (the matrix row, ``length``
little-endian uint16 or uint32, padded), ``n_tokens``, ``cu_seqlens``
(cumulative segment lengths from 0), ``resets`` (positions at which position
ids start again at 0, the segments' starts), and per segment the document,
its piece number and its first token in the document.  ``unpack`` inverts it.

Edge cases: null text gives no segment; empty text gives the end-of-text id
alone; a null doc_id is kept as null; repeated rows give repeated segments;
an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import heapq
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Splitting pattern of the vocabulary: a fixed value of the tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Params:
    """``vocabulary``: a file of base64 tokens and ranks, read on the driver
    and sent to the tasks; ``end``: the end-of-text id."""

    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    end: int = 50256
    length: int = 2048
    pool: int = 8192

    @property
    def dtype(self) -> str:
        return "<u2" if self.end < 1 << 16 else "<u4"


class Capacities:
    """Segment tree over capacities 0..length: how many open rows have each
    free capacity.  ``best(n)`` is the smallest capacity >= n in use."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, by: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def best(self, n: int) -> int | None:
        i = n + self.size
        if self.count[i]:
            return n
        while i > 1:                       # climb until a right sibling is in use
            if not i & 1 and self.count[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self.size:               # its leftmost leaf in use
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of positions into ``sizes``; equal sizes keep their order, equal
    capacities go to the oldest row."""
    tree, open_, rows, free = Capacities(length), {}, [], []
    for k in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        n = sizes[k]
        c = tree.best(n)
        if c is None:
            row = len(rows)
            rows.append([]), free.append(length)
        else:
            row = heapq.heappop(open_[c])
            tree.add(c, -1)
        rows[row].append(k)
        free[row] -= n
        if free[row]:
            heapq.heappush(open_.setdefault(free[row], []), row)
            tree.add(free[row], 1)
    return rows


def vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def encoder(ranks: dict[bytes, int]):
    import tiktoken
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: The splitting pattern backtracks over white space, so longer runs of it are
#: cut into stretches of this length, which are encoded one by one.
SPACES = re.compile(r"\s{10000}")


def encode(e, text: str) -> list[int]:
    out, at = [], 0
    for m in SPACES.finditer(text):
        out += e.encode_ordinary(text[at:m.end()])
        at = m.end()
    return out + e.encode_ordinary(text[at:])


PIECES = "doc_id long, piece int, first long, n int, ids binary"


def tokenized(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, piece, first, n, ids): pieces of at most ``length`` ids."""
    # one vocabulary file, a few MB; a worker keeps a broadcast value from task
    # to task, and in it the encoder it has built
    held = docs.sparkSession.sparkContext.broadcast({"ranks": vocabulary(p.vocabulary)})
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("first", pa.int64()), ("n", pa.int32()), ("ids", pa.binary())])

    def run(batches):
        e = held.value.get("encoder") or held.value.setdefault("encoder", encoder(held.value["ranks"]))
        for b in batches:
            out: list[tuple] = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                t = text.as_py()
                if t is None:
                    continue
                ids = np.array(encode(e, t) + [p.end], p.dtype)
                for k, at in enumerate(range(0, len(ids), p.length)):
                    part = ids[at:at + p.length]
                    out.append((doc_id, k, at, len(part), part.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


PACKED = ("ids binary, n_tokens int, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, pieces array<int>, firsts array<long>")


def pack(pieces: DataFrame, p: Params = Params(), tasks: int | None = None) -> DataFrame:
    """Pieces -> packed rows (see the module's text)."""
    schema = pa.schema([("ids", pa.binary()), ("n_tokens", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())), ("resets", pa.list_(pa.int32())),
                        ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("firsts", pa.list_(pa.int64()))])

    def rows(pool):
        for row in best_fit_decreasing([r[3] for r in pool], p.length):
            ends = np.cumsum([pool[k][3] for k in row])
            ids = b"".join(pool[k][4] for k in row)
            pad = np.full(p.length - int(ends[-1]), p.end, p.dtype).tobytes()
            cu = [0, *ends.tolist()]
            yield ids + pad, cu[-1], cu, cu[:-1], [pool[k][0] for k in row], [pool[k][1] for k in row], [pool[k][2] for k in row]

    def run(batches):
        def emit(pool):
            out = list(rows(pool))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)

        pool: list[tuple] = []
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "piece", "first", "n", "ids")), strict=True):
                pool.append(r)
                if len(pool) == p.pool:
                    yield emit(pool)
                    pool = []
        if pool:
            yield emit(pool)

    salted = pieces.withColumn("h", F.xxhash64("doc_id", "piece", "ids"))
    dealt = salted.repartition(tasks, "h") if tasks else salted.repartition("h")
    return dealt.sortWithinPartitions("h", "doc_id", "piece").select("doc_id", "piece", "first", "n", "ids").mapInArrow(run, PACKED)


def packed_rows(docs: DataFrame, p: Params = Params()) -> DataFrame:
    return pack(tokenized(docs, p), p)


def unpack(packed: DataFrame, p: Params = Params()) -> DataFrame:
    """Packed rows -> (doc_id, piece, first, n, ids), the inverse of ``pack``."""
    width = np.dtype(p.dtype).itemsize
    x = F.explode(F.expr(f"""transform(sequence(0, size(resets) - 1), i -> struct(doc_ids[i] as doc_id, pieces[i] as piece, firsts[i] as first,
        cu_seqlens[i + 1] - cu_seqlens[i] as n, substring(ids, cu_seqlens[i] * {width} + 1, (cu_seqlens[i + 1] - cu_seqlens[i]) * {width}) as ids))"""))
    return packed.select(x.alias("x")).select("x.*")


def write_matrices(packed: DataFrame, root: str, rows_per_file: int = 16384) -> None:
    """Packed rows as Parquet files of ``rows_per_file`` rows: concatenated,
    the ``ids`` of a file are its id matrix, row by row."""
    packed.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(root)


def read_matrices(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)


def fill(packed: DataFrame, p: Params = Params()) -> DataFrame:
    """Rows, tokens and the part of all places that tokens fill."""
    return packed.agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"),
                      (F.sum("n_tokens") / (F.count("*") * p.length)).alias("filled"))
