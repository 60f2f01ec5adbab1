import hashlib
import zlib
from collections import Counter

from tests.llm.conftest import LONG
from tidemark.llm import sharding as S


def brute(rows, shards):
    data = []
    for d, t, s in rows:
        crc = zlib.crc32((t or "").encode())
        who = str(d) if d is not None else f"crc:{crc}"
        data.append(((s is None, s or ""), hashlib.md5(f"shard-1:{who}".encode()).hexdigest(), (d is not None, d or 0), crc, len((t or "").encode()) + 1))
    data.sort()
    n = Counter(r[0] for r in data)
    seen, spread = Counter(), []
    for r in data:
        spread.append(((2 * seen[r[0]] + 1) / (2 * n[r[0]]), r[1], r[0], r))
        seen[r[0]] += 1
    spread.sort()
    total = len(spread)
    return sorted((at * shards // total, at - -(-(at * shards // total) * total // shards), r[3], r[4]) for at, (*_, r) in enumerate(spread))


def test_against_brute_force(spark, docs):
    rows = [(i, f"text {i % 90} " * (i % 5), ["a", "b", "c", None][(i % 11) // 3]) for i in range(500)]
    rows += [(None, "null id", "a"), (7, "again", "b"), (7, "again", "b"), (501, None, "c"), (502, LONG, "c")]
    got = S.stratified_shards(docs(rows), 16).collect()
    assert sorted((r["shard"], r["slot"], r["text_crc32"], r["size"]) for r in got) == brute(rows, 16)
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for k in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sizes[k]))
    of = {(r[0], r[1]): r[2] for r in rows}
    assert of
    per = Counter((r["shard"], r["source"]) for r in got)
    for source in ("a", "b", "c", None):
        counts = [per[k, source] for k in range(16)]
        assert max(counts) - min(counts) <= 2


def test_fewer_rows_than_shards_and_none(spark, docs):
    assert S.stratified_shards(docs([])).count() == 0
    got = S.stratified_shards(docs([(1, "a", "x"), (2, "b", "x"), (3, "c", "y")]), 16).collect()
    assert sorted(r["slot"] for r in got) == [0, 0, 0] and len({r["shard"] for r in got}) == 3
