import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import answers as AN
from tidemark.session import scratch_path


def counting(calls, fail=(), die_after=None):
    """A client that notes every prompt as a file; it fails for some prompts,
    and its worker dies once when ``die_after`` prompts are noted."""
    class Client:
        def complete(self, prompts):
            if die_after is not None and len(os.listdir(calls)) >= die_after and not os.path.exists(f"{calls}.dead"):
                open(f"{calls}.dead", "w").close()
                os._exit(1)
            if any(p in fail for p in prompts):
                raise RuntimeError("busy")
            for p in prompts:
                with open(f"{calls}/{p or 'empty'}-{len(os.listdir(calls))}", "w"):
                    pass
            return [f"```\nfor {p}\n```" for p in prompts]
    return Client


@pytest.fixture
def folders(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    return str(calls), scratch_path(spark, "t-answers")


def asked(calls):
    return sorted(f.rsplit("-", 1)[0] for f in os.listdir(calls))


def test_a_prompt_is_asked_once_over_actions_and_runs(spark, folders):
    calls, path = folders
    rows = [(i, f"p{i % 7}") for i in range(70)] + [(98, None), (99, "")]
    req = spark.createDataFrame(rows, "request_id int, prompt string").repartition(5)
    out = AN.complete_with_log(req, counting(calls), path, buckets=3)
    assert out.count() == 72 and out.where("completion_error is not null").count() == 0
    assert {r.request_id: r.code for r in out.collect()} == {i: f"for {p or ''}".strip() for i, p in rows}
    more = req.unionByName(spark.createDataFrame([(100, "p0"), (101, "new")], req.schema))
    assert AN.complete_with_log(more, counting(calls), path, buckets=3).where("request_id = 101").first().code == "for new"
    assert asked(calls) == sorted([*(f"p{i}" for i in range(7)), "empty", "new"])


def test_calls_of_a_task_that_died_are_not_sent_again(spark, folders):
    """What a dead attempt has written stays: a later attempt over the same
    bucket sends the rest."""
    calls, path = folders
    req = spark.createDataFrame([(i, f"p{i}") for i in range(100)], "request_id int, prompt string")
    client = counting(calls, die_after=40)
    with pytest.raises(Exception):        # a local master does not retry a task  # noqa: B017, PT011
        AN.answer_missing(req, client, path, buckets=1)
    before = asked(calls)
    assert 40 <= len(before) < 100
    out = AN.complete_with_log(req, client, path, buckets=1)
    assert out.where(F.col("code") == F.concat(F.lit("for "), "prompt")).count() == 100
    assert asked(calls) == sorted(f"p{i}" for i in range(100))


def test_errors_are_kept_and_asked_again_on_a_later_attempt_only(spark, folders):
    calls, path = folders
    req = spark.createDataFrame([(i, f"p{i}") for i in range(10)], "request_id int, prompt string")
    out = AN.complete_with_log(req, counting(calls, fail=("p4",)), path, buckets=2)
    assert {r.request_id: r.completion_error for r in out.where("completion_error is not null").collect()} == {4: "RuntimeError: busy"}
    same = AN.complete_with_log(req, counting(calls), path, buckets=2)
    assert same.where("request_id = 4").first().completion_error == "RuntimeError: busy" and "p4" not in asked(calls)
    again = AN.complete_with_log(req, counting(calls), path, attempt=1, buckets=2).where("request_id = 4").first()
    assert again.completion_error is None and again.code == "for p4"
    assert asked(calls) == sorted(f"p{i}" for i in range(10))


def test_empty_log_and_no_requests(spark, folders):
    calls, path = folders
    assert AN.recorded_answers(spark, path).count() == 0
    none = spark.createDataFrame([], "request_id int, prompt string")
    assert AN.complete_with_log(none, counting(calls), path).count() == 0 and asked(calls) == []


def test_rows_left_twice_by_a_broken_fold_count_once(spark, folders):
    calls, path = folders
    req = spark.createDataFrame([(1, "a")], "request_id int, prompt string")
    AN.answer_missing(req, counting(calls), path)
    AN._read(spark, f"{path}/folded").write.parquet(f"{path}/calls/bucket=0")
    assert AN.complete_with_log(req, counting(calls), path).count() == 1 and asked(calls) == ["a"]
