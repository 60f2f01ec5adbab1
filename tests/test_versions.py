import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import versions as V
from tidemark.plans.ordered import bucket_of, latest_per_key, with_neighbour


def test_previous_version_pairs(spark):
    df = spark.createDataFrame([("p", 1, "v1"), ("p", 2, "v2"), ("p", 3, "v3"), ("q", 1, "w1")],
                               "path string, version long, content string")
    got = {(r.path, r.version): r.old_content for r in V.previous_version(df).collect()}
    assert got == {("p", 1): "", ("p", 2): "v1", ("p", 3): "v2", ("q", 1): ""}


def test_commit_cursor_suppresses_consecutive_repeats(spark):
    df = spark.createDataFrame([("r", i, s) for i, s in enumerate(["A", "B", "A", "A", None])],
                               "repo string, t long, sha string")
    got = [r.sha for r in V.commit_cursor(df, ["repo"], "t").orderBy("t").collect()]
    assert got == ["A", "B", "A"]


def test_debounce_fires_on_trailing_edge(spark):
    df = spark.createDataFrame([("p", s, i) for i, s in enumerate([0.0, 0.5, 1.5, 4.0])],
                               "path string, s double, id long") \
        .withColumn("ts", F.timestamp_seconds(F.col("s")))
    got = [r.s for r in V.debounce(df, "path", "ts", 1, tiebreak=["id"]).orderBy("ts").collect()]
    assert got == [1.5, 4.0]


def test_neighbour_plan_matches_plain_window(spark):
    """The bucketed plan must equal lag/lead over the whole key, whatever the
    bucket width (edges crossed many times, hot key included)."""
    rnd = random.Random(7)
    rows = [("hot" if rnd.random() < 0.5 else f"k{rnd.randint(0, 5)}", rnd.randint(0, 500), i, f"v{i}")
            for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o long, t long, v string")
    w = Window.partitionBy("k").orderBy("o", "t")
    want = {r.t: (r.p, r.n) for r in df.select("t", F.lag("v").over(w).alias("p"),
                                               F.lead("v").over(w).alias("n")).collect()}
    for width in (1, 3, 17, 1000):
        p = with_neighbour(df, ["k"], "o", ["v"], tiebreak=["t"], buckets=width)
        n = with_neighbour(p, ["k"], "o", ["v"], tiebreak=["t"], direction="next", buckets=width)
        got = {r.t: (r.prev_v, r.next_v) for r in n.collect()}
        assert got == want, width


def test_head_commit_ties_break_on_key(spark):
    df = spark.createDataFrame([("r", "main", "c1", 1, "2024-01-01"), ("r", "main", "c2", 2, "2024-01-01"),
                                ("r", "main", "c0", 0, "2023-12-31")],
                               "repo string, branch string, sha string, commit_key long, d string") \
        .withColumn("committed_at", F.to_timestamp("d"))
    assert [r.sha for r in V.head_commit(df).collect()] == ["c2"]
    first = latest_per_key(df, ["repo"], ["committed_at", "commit_key"], ["sha"], newest=False).collect()
    assert [r.sha for r in first] == ["c0"]


def test_text_facts_of_missing_and_unknown_texts(spark):
    from tidemark.operators.commits import with_text_facts
    facts = spark.createDataFrame([("1", 3, "x"), ("2", None, "y")], "id string, len int, md5 string")
    rows = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", ""), ("c", None), ("d", "9"), ("e", "2")], "k string, old string")
    got = sorted(map(tuple, with_text_facts(rows, facts, "old", "old_", {"len": 0, "md5": "none"}).collect()), key=str)
    assert got == sorted([("a", "1", 3, "x"), ("a", "1", 3, "x"), ("b", "", 0, "none"), ("c", None, 0, "none"),
                          ("d", "9", 0, "none"), ("e", "2", 0, "y")], key=str)


def test_neighbours_of_values_of_any_type_over_buckets(spark):
    """The edges of buckets are the same whether the values have an order
    (compared with the row) or not (maps)."""
    from pyspark.sql import functions as F
    from tidemark.plans.ordered import with_neighbour
    df = spark.range(60).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"), F.concat(F.lit("v"), 100 - F.col("id")).alias("v"))
    df = df.withColumn("m", F.create_map("v", "o"))
    for direction, step in (("prev", -3), ("next", 3)):
        rows = with_neighbour(df, ["k"], "o", ["v", "m"], direction=direction, prefix="n_", buckets=7).collect()
        assert len(rows) == 60
        for r in rows:
            o = r.o + step
            assert (r.n_v, r.n_m) == ((f"v{100 - o}", {f"v{100 - o}": o}) if 0 <= o < 60 else (None, None))
        plain = with_neighbour(df, ["k"], "o", ["v"], direction=direction, prefix="n_", buckets=7).collect()
        assert {(r.o, r.n_v) for r in plain} == {(r.o, r.n_v) for r in rows}


def test_bucket_search_is_not_linear_in_the_cuts(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 9 != 0, F.col("id")).alias("v"))
    for n in (2, 3, 64, 500):
        b = bucket_of(df, "v", n)
        got = df.select("v", b.alias("b")).collect()
        assert "filter(" not in str(b)          # a search by halves, not a count over all cuts
        assert all(r.b == 0 for r in got if r.v is None)
        order = [r.b for r in sorted((r for r in got if r.v is not None), key=lambda r: r.v)]
        assert order == sorted(order) and order[-1] == len(set(order)) - (0 if 0 in order else -1) - 1
