"""The composite flow at size: what its steps write, shuffle and work out once."""

import os
import time

from pyspark.sql import functions as F

from tidemark.functions.paths import combine, directory_name, relative_path, with_test_path
from tidemark.operators import pipeline as PL
from tidemark.operators import routing as R
from tidemark.plans.materialize import materialize
from tidemark.plans.ordered import hot_keys, with_neighbour
from tidemark.sources.tables import skip_list

CLASS = "public class A {\n  public int One() { return 1; }\n}"


def change_inputs(spark, **route):
    df = spark.createDataFrame
    files = [("r", "A", "src/a.cs"), ("r", "A", "src/b.cs"), ("r", "B", "src/a.cs")]
    answers = [("1", "ollama", 200, '{"response":"class T { }"}'), ("2", "ollama", 200, '{"response":"  "}')]
    return PL.ChangeInputs(
        files=df([(*f, "2" if "b.cs" in f[2] else "1") for f in files], "repo string, sha string, file_path string, request_id string"),
        commits=df([("r", "A", []), ("r", "B", ["A"])], "repo string, sha string, parents array<string>"),
        blobs=df([(*f, "t") for f in files], "repo string, sha string, file_path string, content string"),
        texts=df([("t", CLASS)], "id string, content string"), skip=skip_list(spark), extension=".cs",
        route={"threshold": 300, "replay": df(answers, "request_id string, provider string, http_status int, body string"), **route})


def heads(spark):
    rows = [("r", "A", "2024-01-01", 0), ("r", "B", "2024-01-02", 1), ("r", "A", "2024-01-03", 2)]
    return spark.createDataFrame(rows, "repo string, sha string, t string, run_order long").withColumn("run_ts", F.to_timestamp("t"))


def test_change_sets_name_their_texts_by_id(spark):
    sets, codes = PL.change_sets_by_id(heads(spark), change_inputs(spark))
    got, texts = sets.collect(), {r.id: r.code for r in codes.collect()}
    assert sorted((r.sha, r.run_order, r.file_path, r.n_files) for r in got) == [("A", 0, "src/a.cs", 1), ("A", 2, "src/a.cs", 1), ("B", 1, "src/a.cs", 1)]
    assert list(texts.values()) == ["class T { }"] and {r.content for r in got} == set(texts)
    whole = PL.with_content(sets, codes)
    assert whole.columns == sets.columns and {r.content for r in whole.collect()} == {"class T { }"}


def test_change_rows_are_worked_out_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(R, "materialize", lambda df, name, *a, **k: written.append((name, df.columns)) or materialize(df, name, *a, **k))
    PL.route_commits(change_inputs(spark)).collect()
    names = [n for n, _ in written]
    # facts, known and outcomes read the written rows
    assert names.index("changes") < names.index("wanted") < names.index("facts") and names.count("changes") == 1
    assert "file_path" not in dict(written)["known"] and "file_path" not in dict(written)["hit"]


def test_a_written_table_leaves_no_shuffle_files(spark):
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {n for n in local.getAllFiles().mkString("\n").split("\n") if "shuffle_" in n}
    before = files()
    materialize(spark.range(1000).repartition(7, "id"), "t-freed")
    until = time.time() + 20                                     # they go behind the write
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before


def test_only_hot_keys_are_cut_into_buckets(spark):
    even = spark.range(200).select((F.col("id") % 100).alias("k"), F.col("id").alias("o"))
    assert hot_keys(even, ["k"], 4) == []
    plan = lambda df: with_neighbour(df, ["k"], "o", ["o"], buckets=4)
    assert "Join" not in plan(even)._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.o, r.prev_o) for r in plan(even).collect()} == {(i, i - 100 if i >= 100 else None) for i in range(200)}
    hot = even.unionByName(spark.range(1000, 1100).select(F.lit(None).cast("long").alias("k"), F.col("id").alias("o")))
    assert [r.k for r in hot_keys(hot, ["k"], 4)] == [None]
    got = {r.o: r.prev_o for r in plan(hot).collect()}
    assert all(got[i] == i - 1 for i in range(1001, 1100)) and got[1000] is None and got[150] == 50 and got[50] is None


def test_plain_paths_below_the_source_folder_map_as_the_others(spark):
    folders = ["src", "src/", "./src", "a/src", "", ".", None, "/src"]
    paths = ["src/a.cs", "src/m1/a.cs", "src//a.cs", "src/./a.cs", "src/a/", "src", "src/", "srcx/a.cs", "a/src/b.cs", "a.cs", "/src/a.cs", "src/.", "src/b", "./src/a.cs", "", None]
    df = spark.createDataFrame([(s, p) for s in folders for p in paths], "s string, p string")
    rel = relative_path(F.col("s"), F.col("p"))
    from tidemark.functions.text import extension, stem
    want = combine(F.lit("tests"), directory_name(rel), F.concat(stem(rel), F.lit("Tests"), extension(rel)))
    for r in with_test_path(df, "p", "got", F.col("s"), F.lit("tests")).withColumn("want", want).collect():
        assert r.got == r.want, r
    assert [c for c in with_test_path(df, "p", "got", F.col("s"), F.lit("tests")).columns] == ["s", "p", "got"]


def test_texts_in_one_file_are_scanned_by_many_tasks(spark):
    texts = spark.createDataFrame([(str(i), CLASS) for i in range(40)], "id string, content string").coalesce(1)
    wanted = texts.select("id").groupBy("id").agg(F.lit(True).alias("parsed"))
    facts, decls = R.text_index(texts.join(wanted, "id"), 300)
    assert len(facts.select(F.input_file_name()).distinct().collect()) > 1
    assert len(decls.select(F.input_file_name()).distinct().collect()) > 1 and decls.where("name = 'One'").count() == 40


def test_scratch_of_a_change_run_holds_results_only(spark, monkeypatch):
    at = {}

    def noted(df, name, *a, **k):
        out = materialize(df, name, *a, **k)
        at[name] = os.path.dirname(out.inputFiles()[0].removeprefix("file://"))
        return out
    monkeypatch.setattr(R, "materialize", noted)
    PL.route_commits(change_inputs(spark)).collect()
    assert os.path.exists(at["routed"]) and not [n for n in ("changes", "wanted", "known") if os.path.exists(at[n])]


def test_results_hold_ids_of_codes_through_two_upserts(spark, tmp_path):
    sets, codes = PL.change_sets_by_id(heads(spark), change_inputs(spark))
    made = PL.result_rows(materialize(sets, "t-sets"))
    for k in (0, 1):
        out = R.upsert_results(made.where(F.pmod("run_order", F.lit(2)) == k), PL.RESULT_ORDER, f"file:{tmp_path}/results", owner="t")
    texts = {r.id: r.code for r in codes.collect()}
    assert [(r.test_path, r.run_order, texts[r.generated_code]) for r in out.collect()] == [("r/tests/aTests.cs", 2, "class T { }")]


def test_review_requests_need_no_texts(spark):
    sets, _ = PL.change_sets_by_id(heads(spark), change_inputs(spark))
    requests = R.review_requests(sets, PL.RUN)
    assert "_code" not in requests._jdf.queryExecution().optimizedPlan().toString().replace("generated_code", "")
    assert sorted((r.run_order, r.n_files) for r in requests.collect()) == [(0, 1), (1, 1), (2, 1)]


def test_live_sinks_name_their_texts_by_id(spark, tmp_path):
    base = f"file:{tmp_path}/live"
    write = PL.change_run_writer(change_inputs(spark), base)
    for epoch, runs in enumerate(([0, 1], [2])):
        for _ in range(2):                                       # every epoch twice
            write(heads(spark).where(F.col("run_order").isin(runs)), epoch)
    texts = {r.id: r.code for r in PL.texts_of(spark, base).collect()}
    got = [(r.run_order, texts[r.content]) for r in spark.read.parquet(f"{base}/manifest").collect()]
    assert sorted(got) == [(k, "class T { }") for k in range(3)]
    assert [(r.run_order, texts[r.generated_code]) for r in R.current_results(spark, f"{base}/results").collect()] == [(2, "class T { }")]
