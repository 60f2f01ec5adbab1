import hashlib
import math

from pyspark.sql import functions as F
from tests.llm.conftest import LONG

from tidemark.llm import mixture as X


def brute(rows, weights=(5, 2, 1), cap=3):
    """Targets by resharing until no source is above its cap."""
    size = {}
    for _, text, source in rows:
        size[source] = size.get(source, 0) + len((text or "").encode().split())
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), sum(size.values())
    while True:
        left = total - sum(cap * size[s] for s in capped)
        free = sum(w[s] for s in names if s not in capped)
        target = {s: cap * size[s] if s in capped else left * w[s] / free for s in names}
        over = {s for s in names if s not in capped and target[s] > cap * size[s]}
        if not over:
            return size, target
        capped |= over


def rows(n=300):
    out = []
    for i in range(n):
        source = ["big", "b", "a", "tiny", None, "z", "empty"][min(6, i % 23 // 3)]
        out.append((i, " ".join(["w"] * (0 if source == "empty" else (i * 7) % 40 + (200 if source == "big" else 1))), source))
    return out


def number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / (1 << 52)


def brute_copies(rows):
    """Strata of size from the largest down; in each the smallest draws."""
    size, target = brute(rows)
    words = lambda t: len((t or "").encode().split())
    out = {}
    for s in size:
        mine = [(d, words(t)) for d, t, source in rows if source == s]
        rate = target[s] / size[s] if size[s] else 0
        upto, got, by = 0, 0.0, {}
        for d, n in mine:
            by.setdefault(math.floor(6 * math.log(max(n, 1))), []).append((number(f"mix-1:{d}"), d, n))
        for k in sorted(by, reverse=True):
            total = sum(n for *_, n in by[k])
            upto += total
            mean = total / len(by[k])
            extra = min(len(by[k]), max(0, math.floor(((rate - int(rate)) * upto - got) / mean + number(f"mix-1|:{s or ''}")))) if total else 0
            got += extra * mean
            out |= {d: int(rate) + (i < extra) for i, (_, d, _) in enumerate(sorted(by[k]))}
    return out


def test_targets_and_copies_against_brute_force(spark, docs):
    data = rows()
    size, target = brute(data)
    got = X.mixed_sizes(docs(data)).collect()
    assert len(got) == len(data)
    source, copies = {d: s for d, _, s in data}, brute_copies(data)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == size[s] and abs(r["target"] - target[s]) < 1e-6
        assert r["copies"] == copies[r["doc_id"]] <= 3 and r["copies"] - int(target[s] / size[s] if size[s] else 0) in (0, 1)
        assert r["taken"] == r["size"] * r["copies"]


def test_every_source_comes_near_its_target(spark):
    from tidemark.llm.queries import QUERIES
    for sf, off in (("sf0.1", 0.05), ("sf0.01", 0.10)):
        per = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "source").join(
            QUERIES["op7_mixture"](spark, f"/root/testdata/{sf}"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
        assert all(abs(r["taken"] / r["target"] - 1) < off for r in per.collect() if r["target"])


def test_a_seed_gives_every_document_its_chance(spark, docs):
    data = [(i, "w " * (1 + i % 90), "abc"[i % 3]) for i in range(240)]
    n = {d: 0 for d, *_ in data}
    for seed in range(12):
        for r in X.mixed_sizes(docs(data), X.Mix(seed=f"s{seed}")).collect():
            n[r["doc_id"]] += r["copies"]
    size, target = brute(data)
    for s in "abc":                                                       # halves by size have the same rate
        rate = target[s] / size[s]
        for half in (range(0, 45), range(45, 90)):
            got = [n[d] / 12 for d, _, source in data if source == s and d % 90 in half]
            assert abs(sum(got) / len(got) - rate) < 0.12


def test_emit_gives_the_copies_and_keeps_columns(spark, docs):
    df = docs(rows(120))
    want = {r["doc_id"]: r["copies"] for r in X.mixed_sizes(df).collect() if r["copies"]}
    out = X.emit(df)
    assert out.columns == df.columns
    assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == want


def test_edge_cases(spark, docs):
    assert X.mixed_sizes(docs([])).count() == 0 and X.emit(docs([])).count() == 0
    odd = [(None, "a b", "s"), (1, None, "s"), (1, None, "s"), (2, "", None), (3, "  x\ty", "t")]
    got = X.mixed_sizes(docs(odd)).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == [("1", 0), ("1", 0), ("2", 0), ("3", 3), ("None", 2)]
    long = X.mixed_sizes(docs([(1, LONG, "s"), (2, "a b", "s"), (3, "c d", "t")])).collect()
    assert sorted(r["size"] for r in long) == [2, 2, 60_000]
    only = X.mixed_sizes(docs([(1, None, "s"), (2, "", "t")])).agg(F.sum("taken")).first()[0]
    assert only == 0
