import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import embeddings as V


def brute(rows, t=0.9):
    ok = [(k, np.array(v, float)) for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, low = {k: set() for k in range(len(rows))}, list(range(len(rows)))
    for a, x in ok:
        for b, y in ok:
            if a != b and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= t:
                links[a].add(b)
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    seen = {}
    for k in order:                            # smallest id first: it names its component
        todo = [k] if k not in seen else []
        while todo:
            c = todo.pop()
            if c not in seen:
                seen[c] = rows[k][0]
                todo += links[c]
    return sorted((rows[k][0], len(links[k]), seen[k]) for k in range(len(rows)))


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, label string, key string").withColumn("n", F.lit(1))


def check(spark, rows, **kw):
    got = V.near_duplicates(frame(spark, rows), V.Params(**kw)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute([(i, [np.float32(x).item() if x is not None else None for x in v] if v is not None else None) for i, v in rows])
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def vectors(n, d, seed, noise):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 6), d))
    return [(i, (rng.uniform(0.5, 3) * (centres[rng.integers(len(centres))] + noise * rng.normal(size=d))).astype("f4").tolist()) for i in range(n)]


def test_against_brute_force(spark):
    check(spark, vectors(300, 24, 1, 0.25), block=40, piece=16, step=5)


def test_two_dimensions_hot_group_and_copies(spark):
    rows = vectors(150, 2, 2, 0.02) + [(500 + i, [1.0, 0.0]) for i in range(60)] + [(600 + i, [2.0, 0.001 * i]) for i in range(60)]
    check(spark, rows, block=32, piece=8)


def test_edge_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, 0.0, 0.0]),
            (10, [1.0, 0.0, 0.0]), (11, [1e-30, 0.0]), (12, [-1.0, 0.0])]
    check(spark, rows)
    assert V.near_duplicates(frame(spark, [])).count() == 0
    assert V.near_duplicates(frame(spark, [(1, None), (2, [0.0])])).count() == 2
    got = V.near_duplicates(frame(spark, [(None, [1.0, 1.0]), (None, [1.0, 1.0]), (4, [2.0, 2.1]), (4, [2.0, 2.1]), (None, [-1.0, 5.0])])).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got) == [
        ("4", 3, "4", True), ("4", 3, "4", True), ("None", 0, "None", True), ("None", 3, "4", False), ("None", 3, "4", False)]


def test_matrices_are_not_shuffled(spark):
    """Some blocks are broadcast in a round, the others scanned in place; a
    round of one block each still finds every pair."""
    assert V.rounds([(1, 4), (2, 4), (3, 9), (4, 1), (5, 1)], 8) == [[1, 2], [3], [4, 5]]
    files = lambda: {n: spark._jvm.java.io.File(n).length() for n in
                     spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if n.endswith(".data")}
    before, rows = set(files()), vectors(240, 64, 3, 0.2)
    check(spark, rows, block=20, piece=16, held=1)
    matrices = 12 * 240 * 64 * 8                                  # every block in about 12 tiles
    assert sum(size for n, size in files().items() if n not in before) < matrices / 4
