import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import versions as V
from tidemark.session import scratch_path
from tidemark.sources import commit_log as CL
from tidemark.streaming import operators as ST
from tidemark.streaming import runner as RUN

COMMIT = "repo string, branch string, commit_key long, sha string, committed_at timestamp_ntz"


def commits(spark, keys):
    rows = [("rep%d" % (k % 5) if k % 11 else None, "main" if k % 3 else "dev", k, f"c{k}") for k in keys]
    return spark.createDataFrame(rows, "repo string, branch string, commit_key long, sha string") \
        .withColumn("committed_at", F.timestamp_seconds(F.floor(F.col("commit_key") / 4) * 60).cast("timestamp_ntz"))


def run(spark, base, limit=None, schema=None):
    """One run into a sink with a folder per epoch."""
    def write(batch, epoch_id):
        batch.write.mode("overwrite").parquet(f"{base}/sink/epoch_id={epoch_id}")
    s = CL.read_commits(spark, f"{base}/log", schema, limit)
    RUN.drain(s.writeStream.foreachBatch(write), f"{base}/checkpoint")


def sink(spark, base):
    return spark.read.parquet(f"{base}/sink")


def keys(spark, base):
    return sorted(r.commit_key for r in sink(spark, base).collect())


def batch_sizes(spark, base):
    got = dict(sink(spark, base).groupBy("epoch_id").count().collect())
    return [got[k] for k in sorted(got)]


def test_batches_hold_the_admitted_rows_and_a_restart_goes_on(spark):
    base = scratch_path(spark, "t-commit-log")
    assert CL.append(commits(spark, range(25)), f"{base}/log", ["commit_key"]) == 0
    assert CL.append(commits(spark, []), f"{base}/log", ["commit_key"]) is None
    assert CL.append(commits(spark, range(25, 30)), f"{base}/log", ["commit_key"]) == 1
    run(spark, base, limit=8)
    assert batch_sizes(spark, base) == [8, 8, 8, 6] and keys(spark, base) == list(range(30))
    # in the log's order: a batch holds the next rows, across segments
    per = sink(spark, base).groupBy("epoch_id").agg(F.min("commit_key"), F.max("commit_key")).orderBy("epoch_id").collect()
    assert [tuple(r)[1:] for r in per] == [(0, 7), (8, 15), (16, 23), (24, 29)]
    run(spark, base, limit=8)                                       # nothing new
    assert len(batch_sizes(spark, base)) == 4
    CL.append(commits(spark, range(30, 50)), f"{base}/log", ["commit_key"])
    run(spark, base, limit=8)                                       # the stored offset holds, and so does the limit
    assert batch_sizes(spark, base) == [8, 8, 8, 6, 8, 8, 4] and keys(spark, base) == list(range(50))
    assert sorted(map(str, sink(spark, base).drop("epoch_id").collect())) == sorted(map(str, commits(spark, range(50)).collect()))


def test_a_failed_batch_is_read_again(spark):
    base = scratch_path(spark, "t-commit-log-fail")
    CL.append(commits(spark, range(12)), f"{base}/log", ["commit_key"])
    lost = []

    def write(batch, epoch_id):
        if epoch_id == 1 and not lost:
            lost.append(epoch_id)
            raise RuntimeError("lost")
        batch.write.mode("overwrite").parquet(f"{base}/sink/epoch_id={epoch_id}")

    def go():
        RUN.drain(CL.read_commits(spark, f"{base}/log", None, 5).writeStream.foreachBatch(write), f"{base}/checkpoint")

    with pytest.raises(Exception, match="lost"):
        go()
    CL.append(commits(spark, range(12, 20)), f"{base}/log", ["commit_key"])
    go()
    assert keys(spark, base) == list(range(20)) and batch_sizes(spark, base) == [5, 5, 5, 5]


def test_writers_side_by_side_take_numbers_of_their_own(spark, monkeypatch):
    base = scratch_path(spark, "t-commit-log-writers")
    for k in range(5):
        assert CL.append(commits(spark, [k]), f"{base}/log") == k
    monkeypatch.setattr(CL, "_numbers_taken", lambda fs, at, log: 2)       # what a slow writer has seen
    assert CL.append(commits(spark, [5]), f"{base}/log") == 5
    assert not [n for n in os.listdir(f"{base}/log") if n.startswith("_new")]
    run(spark, base)
    assert keys(spark, base) == list(range(6)) and batch_sizes(spark, base) == [6]


def test_columns_go_by_name(spark):
    base = scratch_path(spark, "t-commit-log-columns")
    log = f"{base}/log"
    CL.append(commits(spark, range(3)), log)
    wide = commits(spark, range(3, 6)).withColumn("parents", F.array(F.lit("p"))).withColumn("seen", F.lit(7).cast("timestamp"))
    CL.append(wide.select(*reversed(wide.columns)), log)
    run(spark, base, schema=wide.select("parents", "commit_key", "seen").schema)
    got = {r.commit_key: (r.parents, r.seen is None) for r in sink(spark, base).collect()}
    assert got == {**{k: (None, True) for k in range(3)}, **{k: (["p"], False) for k in range(3, 6)}}


def test_ranges_of_rows_cover_a_segment_once(spark):
    base = scratch_path(spark, "t-commit-log-ranges")
    c = commits(spark, range(1000)).repartition(3)
    CL.append(c, f"{base}/log")
    reader = CL.CommitLogReader(c.schema, {"path": f"{base}/log", "rowsPerTask": "70"})
    rnd = random.Random(3)
    cuts = sorted({0, 1000, *rnd.sample(range(1000), 6)})
    seen = []
    for a, b in zip(cuts, cuts[1:]):
        parts = reader.partitions({"segment": 0, "row": a}, {"segment": 0, "row": b})
        batches = [x for p in parts for x in reader.read(p)]
        assert sum(x.num_rows for x in batches) == b - a and all(p.value[2] - p.value[1] <= 70 for p in parts)
        seen += [k for x in batches for k in x.column("commit_key").to_pylist()]
    assert sorted(seen) == list(range(1000))


def test_a_missing_segment_is_an_error(spark):
    base = scratch_path(spark, "t-commit-log-missing")
    CL.append(commits(spark, range(3)), f"{base}/log")
    reader = CL.CommitLogReader(commits(spark, []).schema, {"path": f"{base}/log"})
    with pytest.raises(Exception, match="missing"):
        reader.partitions(CL.START, {"segment": 1, "row": 1})
    with pytest.raises(ValueError):
        CL.CommitLogReader(commits(spark, []).schema, {"path": base, "maxRowsPerTrigger": "0"})


def test_an_empty_log_gives_nothing_until_it_has_a_segment(spark):
    base = scratch_path(spark, "t-commit-log-empty")
    schema = commits(spark, []).schema
    run(spark, base, limit=2, schema=schema)
    assert keys(spark, base) == []
    CL.append(commits(spark, range(3)), f"{base}/log", ["commit_key"])
    run(spark, base, limit=2, schema=schema)
    assert keys(spark, base) == [0, 1, 2] and batch_sizes(spark, base) == [2, 1]


def test_heads_of_the_log_equal_the_batch_form(spark):
    base = scratch_path(spark, "t-commit-log-heads")
    order = list(range(60))
    random.Random(5).shuffle(order)                                # commits may come late
    for k in range(0, 60, 20):
        CL.append(commits(spark, order[k:k + 20]), f"{base}/log", ["commit_key"])
        s = CL.read_commits(spark, f"{base}/log", None, 7)
        RUN.drain(ST.moving_heads(s).writeStream.outputMode("update").foreachBatch(ST.heads_writer(f"{base}/heads")), f"{base}/checkpoint")
        want = V.head_commit(commits(spark, order[:k + 20]))
        got = ST.current_heads(spark.read.parquet(f"{base}/heads"))
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
