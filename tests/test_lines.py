import random
import time

from pyspark.sql import functions as F

from tidemark.functions.text import changed_line_numbers
from tidemark.operators import lines as LN


def by_blocks(spark, texts, pairs, block_lines):
    t = spark.createDataFrame(texts, "id string, content string")
    p = spark.createDataFrame(pairs, "k int, old_id string, new_id string")
    b = LN.changed_line_blocks(p, t, ["k"], block_lines)
    return {r.k: r.changed_lines for r in LN.whole_files(b, p, ["k"]).collect()}


def test_blocks_give_what_the_whole_diff_gives(spark):
    rng = random.Random(5)
    texts = [("null", None), ("empty", ""), ("one", "a"), ("feed", "\n"), ("cr", "a\r\nb")]
    for n in range(30):
        texts.append((f"t{n}", "\n".join(rng.choice(["", "a", "b", "a b"]) for _ in range(rng.choice([1, 3, 4, 7, 8, 9, 21])))))
    ids = [t[0] for t in texts]
    pairs = [(k, rng.choice([None, "unknown", *ids]), rng.choice(ids)) for k in range(300)]
    pairs += [(300, None, "empty"), (301, "null", "empty"), (302, "t3", "t3"), (303, "empty", "feed"), (304, None, None), (305, "unknown", "empty")]
    content = dict(texts)
    rows = [(k, content.get(o) or "", content.get(n)) for k, o, n in pairs if n is not None]
    whole = spark.createDataFrame(rows, "k int, o string, n string").select("k", changed_line_numbers("o", "n").alias("c"))
    expected = {r.k: r.c for r in whole.collect()} | {304: []}
    for block_lines in (1, 4, 1000):
        assert by_blocks(spark, texts, pairs, block_lines) == expected


def test_no_texts_and_no_pairs(spark):
    assert by_blocks(spark, [], [(1, None, "x")], 4) == {1: []}
    assert by_blocks(spark, [("x", "a")], [], 4) == {}


def test_a_million_lines(spark):
    n = 1_000_000
    line = F.concat(F.lit("line "), F.col("id").cast("string"))
    text = lambda name, c: spark.range(n).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", c.alias("l")))), lambda x: x["l"]), "\n")
                                              .alias("content")).select(F.lit(name).alias("id"), "content")
    hit = F.col("id").isin([0, 1023, 1024, 777_777, n - 1])
    texts = text("old", line).unionByName(text("new", F.when(hit, F.lit("changed")).otherwise(line)))
    pairs = spark.createDataFrame([(1, "old", "new")], "k int, old_id string, new_id string")
    blocks = LN.changed_line_blocks(pairs, texts, ["k"])
    assert sorted((r.block, r.changed_lines) for r in blocks.collect()) == [
        (0, [1, 1024]), (1, [1025]), (759, [777_778]), (976, [1_000_000])]


def test_texts_are_cut_once(spark):
    # 20,000 lines each: cutting both texts again for every line takes minutes
    n = 20_000
    text = lambda f: "\n".join(f(i) for i in range(n))
    old, new = text(lambda i: f"line {i}"), text(lambda i: "other" if i in (0, 777, n - 1) else f"line {i}") + "\nmore"
    df = spark.createDataFrame([(old, new)], "o string, n string").select(changed_line_numbers("o", "n").alias("c"))
    began = time.monotonic()
    assert df.first().c == [1, 778, n, n + 1]
    assert time.monotonic() - began < 20
