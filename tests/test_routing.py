import pytest
from pyspark.sql import functions as F

from tidemark.operators import pipeline as PL
from tidemark.operators import projects as PJ
from tidemark.operators import routing as R
from tidemark.session import scratch_path
from tidemark.sources.tables import skip_list

CLASS_ONE = "public class Calc\n{\n    public int Add(int a, int b) { return a + b; }\n}\n"
NO_PUBLIC = "public class Calc\n{\n    private int Add(int a, int b) { return a + b; }\n}\n"
IFACE = "public interface IArea { }\n"


def route(spark, rows, prompt_user=True):
    ch = spark.createDataFrame(rows, "file_path string, old_content string, new_content string, "
                                     "existing_test string, request_id string")
    rep = spark.createDataFrame([("ok", "openai", 200, '{"choices":[{"text":"class CalcTests { }"}]}'),
                                 ("blank", "openai", 200, '{"choices":[{"text":"  "}]}'),
                                 ("bad", "openai", 200, '{"nope":1}')],
                                "request_id string, provider string, http_status int, body string")
    out = R.outcome_routing(ch, ["file_path"], skip_list(spark), 300, replay=rep, prompt_user=prompt_user,
                            staging_root="tmp")
    return {r.file_path: r for r in out.collect()}


def test_outcomes(spark):
    got = route(spark, [
        ("src/Program.cs", "", CLASS_ONE, "", "ok"),
        ("src/I.cs", "", IFACE, "", "ok"),
        ("src/N.cs", "", NO_PUBLIC, "", "ok"),
        ("src/A.cs", "", CLASS_ONE, "", "ok"),
        ("src/B.cs", "", CLASS_ONE, "", "blank"),
        ("src/C.cs", "", CLASS_ONE, "", "bad"),
        ("src/D.cs", "", "", "", "ok"),
        ("src/E.txt", "", CLASS_ONE, "", "ok"),
    ])
    status = {k: v.status for k, v in got.items()}
    assert status == {"src/Program.cs": "skipped_listed", "src/I.cs": "skipped_interface",
                      "src/N.cs": "no_public_methods", "src/A.cs": "needs_review", "src/B.cs": "empty_response",
                      "src/C.cs": "error", "src/D.cs": "error", "src/E.txt": "error"}
    a = got["src/A.cs"]
    assert a.generated_code == "class CalcTests { }"
    assert a.test_path == "tests/ATests.cs" and a.staging_path == "tmp/ATests_temp.cs"
    assert "Method Code:\n" + CLASS_ONE in a.prompt


def test_large_file_sends_context_and_auto_applies(spark):
    body = "".join(f"        int v{i} = {i};\n" for i in range(310))
    old = "using System;\npublic class Big\n{\n    public void M()\n    {\n" + body + "    }\n    public void K() { }\n}\n"
    new = old.replace("int v5 = 5;", "int v5 = 50;")
    unchanged_method = old.replace("public void K() { }", "public void K() { }\n    private int f;")
    got = route(spark, [("src/Big.cs", old, new, "", "ok"), ("src/Big2.cs", old, unchanged_method, "", "ok")],
                prompt_user=False)
    assert got["src/Big.cs"].status == "auto_applied"
    p = got["src/Big.cs"].prompt
    assert "// BEGIN CLASS Big" in p and "public void M()" in p and "public void K()" not in p
    assert got["src/Big2.cs"].status == "no_affected_methods"


def test_ledger_upsert_and_manifest(spark):
    routed = spark.createDataFrame([("r", "c1", "src/a.cs", "needs_review", "tests\\aTests.cs", "x"),
                                    ("r", "c1", "src/b.cs", "skipped_listed", "tests/bTests.cs", None)],
                                   "repo string, sha string, file_path string, status string, "
                                   "test_path string, generated_code string")
    assert {r.status: r.n_files for r in R.outcome_ledger(routed).collect()} == \
        {"needs_review": 1, "skipped_listed": 1}
    commits = spark.createDataFrame([("r", "c1", "2024-01-02 03:04:05")], "repo string, sha string, t string") \
        .withColumn("run_ts", F.to_timestamp("t"))
    m = R.change_set_manifest(routed, commits, "auto/test-update-").collect()
    assert len(m) == 1 and m[0].branch == "auto/test-update-20240102030405"
    assert m[0].test_path == "tests/aTests.cs" and m[0].message == "Add/update test for src/a.cs" and m[0].n_files == 1
    assert m[0].content == "x" and m[0].base_branch == "main"
    req = R.review_requests(R.change_set_manifest(routed, commits, "auto/test-update-")).collect()
    assert [(r.branch, r.n_files, r.title) for r in req] == [("auto/test-update-20240102030405", 1, R.REVIEW_TITLE)]
    res = spark.createDataFrame([("t1", 1, "old"), ("t1", 2, "new"), ("t2", 1, "z")], "test_path string, v int, code string")
    got = {r.test_path: r.code for r in R.upsert_results(res, ["v"]).collect()}
    assert got == {"t1": "new", "t2": "z"}


def test_upsert_keeps_earlier_results_and_is_replay_safe(spark):
    path = scratch_path(spark, "t-results")
    batch = lambda *rows: spark.createDataFrame(rows, "test_path string, v int, code string")
    state = lambda: sorted((r.test_path, r.v, r.code) for r in R.current_results(spark, path).collect())
    assert R.current_results(spark, path) is None
    write = R.upsert_writer(path, ["v"])
    write(batch(("t1", 1, "a"), ("t2", 1, "b")), 0)
    write(batch(("t3", 1, "c"), ("t1", 2, "d")), 1)
    want = [("t1", 2, "d"), ("t2", 1, "b"), ("t3", 1, "c")]
    assert state() == want
    write(batch(("t3", 1, "c"), ("t1", 2, "d")), 1)          # the batch again after a failure
    write(batch(("t1", 1, "late")), 2)                       # an older row does not win
    assert state() == want


def test_upsert_rewrites_only_the_buckets_of_its_keys(spark):
    path = scratch_path(spark, "t-buckets")
    rows = lambda ids, v: spark.createDataFrame([(f"t{i}", v, f"code {i} {v}") for i in ids], "test_path string, v int, code string")
    files = lambda: {r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()}
    R.upsert_results(rows(range(1000), 1), ["v"], path)
    before = files()
    out = {r.test_path: r.v for r in R.upsert_results(rows(range(10), 2), ["v"], path).collect()}
    assert len(out) == 1000 and sum(v == 2 for v in out.values()) == 10
    bucket = lambda f: f.split("bucket=")[1].split("/")[0]
    changed = {bucket(f) for f in before ^ files()}
    assert len(before) == 32 and len(changed) <= 10 and len(before & files()) >= 22


def test_a_second_writer_fails_and_the_same_writer_goes_on(spark):
    path = scratch_path(spark, "t-writers")
    row = lambda v: spark.createDataFrame([("t1", v)], "test_path string, v int")
    with R._only_writer(spark, path, "first"):
        with pytest.raises(R.ConcurrentWriter):
            R.upsert_results(row(1), ["v"], path, owner="second")
        R.upsert_results(row(2), ["v"], path, owner="first")     # what a failed attempt left is its own
    assert [r.v for r in R.upsert_results(row(1), ["v"], path, owner="second").collect()] == [2]


def test_every_new_head_is_a_run_and_epochs_may_come_twice(spark):
    files = [("r", "A", "src/a.cs"), ("r", "B", "src/b.cs"), ("r", "B", "src/notes.txt"), ("r", "C", "src/readme.txt"), ("q", "A", "src/a.cs")]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    inputs = PL.ChangeInputs(
        files=df([(*f, "ok") for f in files], "repo string, sha string, file_path string, request_id string"),
        commits=df([("r", "A", []), ("r", "B", ["A"]), ("r", "C", ["B"]), ("q", "A", [])], "repo string, sha string, parents array<string>"),
        blobs=df([(r, s, p, "t") for r, s, p in files], "repo string, sha string, file_path string, content string"),
        texts=df([("t", CLASS_ONE)], "id string, content string"), skip=skip_list(spark), extension=".cs",
        route={"threshold": 300, "replay": df([("ok", "ollama", 200, '{"response":"class T { }"}')], "request_id string, provider string, http_status int, body string")})
    at = lambda s: f"2024-01-01 00:00:{s:02}"
    heads = [("r", "A", at(0), 0), ("r", "B", at(1), 1), ("r", "A", at(2), 2), ("r", "C", at(3), 3), ("q", "A", at(3), 4)]
    frame = lambda rows: df(rows, "repo string, sha string, t string, run_order long").withColumn("run_ts", F.to_timestamp("t"))
    out = lambda m: sorted((r.repo, r.sha, r.run_order, r.branch, r.file_path, r.n_files) for r in m.collect())
    got = out(PL.change_sets(frame(heads), inputs))
    assert got == [("q", "A", 4, "auto/test-update-20240101000003", "src/a.cs", 1), ("r", "A", 0, "auto/test-update-20240101000000", "src/a.cs", 1),
                   ("r", "A", 2, "auto/test-update-20240101000002", "src/a.cs", 1), ("r", "B", 1, "auto/test-update-20240101000001", "src/b.cs", 1)]
    base = scratch_path(spark, "t-live")
    write = PL.change_run_writer(inputs, base)
    for epoch, part in enumerate((heads[:2], heads[2:])):
        write(frame(part), epoch)
        write(frame(part), epoch)
    assert out(spark.read.parquet(f"{base}/manifest")) == got
    assert sorted((r.test_path, r.run_order) for r in R.current_results(spark, f"{base}/results").collect()) == \
        [("q/tests/aTests.cs", 4), ("r/tests/aTests.cs", 2), ("r/tests/bTests.cs", 1)]
    assert spark.read.parquet(f"{base}/requests").count() == 4


def test_unbalanced_source_and_unanswered_request(spark):
    got = route(spark, [("src/A.cs", "", CLASS_ONE + "{", "", "ok"), ("src/B.cs", "", CLASS_ONE, "", "never asked")])
    assert (got["src/A.cs"].status, got["src/A.cs"].error) == ("error", "source has unbalanced braces")
    assert (got["src/B.cs"].status, got["src/B.cs"].error) == ("error", "no completion")


def test_source_and_existing_test_come_from_the_working_tree(spark):
    ch = spark.createDataFrame([("src/A.cs", "", "", "", "ok"), ("src/B.cs", "", "", "own test", "ok"), ("src/C.cs", "", " ", "", "ok"),
                                ("src/D.cs", "", CLASS_ONE, "", "ok")],
                               "file_path string, old_content string, new_content string, existing_test string, request_id string")
    tree = spark.createDataFrame([("src/A.cs", CLASS_ONE), ("src/B.cs", NO_PUBLIC.replace("private", "public")), ("tests/ATests.cs", "// kept"),
                                  ("tests/BTests.cs", "// other"), ("src/D.cs", "stale")], "path string, content string")
    rep = spark.createDataFrame([("ok", "ollama", 200, '{"response":"class T { }"}')], "request_id string, provider string, http_status int, body string")
    got = {r.file_path: r for r in R.outcome_routing(ch, ["file_path"], skip_list(spark), 300, replay=rep, working_tree=tree).collect()}
    assert {k: (r.status, r.error) for k, r in got.items()} == {"src/A.cs": ("needs_review", None), "src/B.cs": ("needs_review", None),
                                                                "src/C.cs": ("error", "source file not found"), "src/D.cs": ("needs_review", None)}
    assert CLASS_ONE in got["src/A.cs"].prompt and "// kept" in got["src/A.cs"].prompt
    assert "own test" in got["src/B.cs"].prompt and "// other" not in got["src/B.cs"].prompt and "stale" not in got["src/D.cs"].prompt


def test_nested_projects_route_with_their_own_settings(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    projects = df([("r", "", "src", "tests", None, "openai", False), ("r", "src/api", "", "unit", "// like this", "azure", True),
                   ("r", "src/api/v2/deep", "", "t", None, "ollama", True), ("q", "src/api", "", "other", None, "azure", False)],
                  "repo string, project_path string, src_folder string, tests_folder string, sample string, provider string, background boolean")
    files = ["src/A.cs", "src/api/B.cs", "src/api/v2/C.cs", "src/apix/D.cs", "E.cs", "src/api/v2/deep/er/F.cs"]
    ch = df([("r", f, "", CLASS_ONE, "", "ok") for f in files] + [("q", "src/A.cs", "", CLASS_ONE, "", "ok"), ("q", "src/api/x/A.cs", "", CLASS_ONE, "", "ok")],
            "repo string, file_path string, old_content string, new_content string, existing_test string, request_id string")
    rows = PJ.with_project_test_path(PJ.with_project(ch, projects))
    assert {(r.repo, r.file_path): (r.project_path, r.test_path, r.provider) for r in rows.collect()} == {
        ("r", "src/A.cs"): ("", "tests/ATests.cs", "openai"), ("r", "src/api/B.cs"): ("src/api", "src/api/unit/BTests.cs", "azure"),
        ("r", "src/api/v2/C.cs"): ("src/api", "src/api/unit/v2/CTests.cs", "azure"), ("r", "src/apix/D.cs"): ("", "tests/apix/DTests.cs", "openai"),
        ("r", "E.cs"): ("", "tests/../ETests.cs", "openai"), ("r", "src/api/v2/deep/er/F.cs"): ("src/api/v2/deep", "src/api/v2/deep/t/er/FTests.cs", "ollama"),
        ("q", "src/A.cs"): (None, rows.where("repo = 'q' and file_path = 'src/A.cs'").first().test_path, None), ("q", "src/api/x/A.cs"): ("src/api", "src/api/other/x/ATests.cs", "azure")}
    rep = df([("ok", "ollama", 200, '{"response":"class T { }"}')], "request_id string, provider string, http_status int, body string")
    inside = PJ.with_project(ch, projects).where("project_path is not null")
    got = {(r.repo, r.file_path): r for r in R.outcome_routing(inside, ["repo", "file_path"], skip_list(spark), 300, replay=rep, **PJ.routing_by_project()).collect()}
    a, b = got["r", "src/A.cs"], got["r", "src/api/B.cs"]
    assert (a.status, a.test_path) == ("needs_review", "tests/ATests.cs") and "sample unit test" not in a.prompt
    assert (b.status, b.test_path) == ("auto_applied", "src/api/unit/BTests.cs") and "// like this" in b.prompt


def test_rows_carry_digests_of_texts_built_once(spark):
    ch = spark.createDataFrame([(f"src/{n}.cs", "", CLASS_ONE, "", "ok") for n in "ABC"] + [("src/D.cs", "", CLASS_ONE, "", None)],
                               "file_path string, old_content string, new_content string, existing_test string, request_id string")
    rep = spark.createDataFrame([("ok", "openai", 200, '{"choices":[{"text":"class T { }"}]}')], "request_id string, provider string, http_status int, body string")
    whole = R.outcome_routing(ch, ["file_path"], skip_list(spark), 300, replay=rep)
    short = R.outcome_routing(ch, ["file_path"], skip_list(spark), 300, replay=rep, prompt_as=F.md5, code_as=F.md5)
    none = R.outcome_routing(ch, ["file_path"], skip_list(spark), 300, replay=rep, prompt_as=None)
    expected = whole.withColumn("prompt", F.md5("prompt")).withColumn("generated_code", F.md5("generated_code"))
    assert sorted(map(str, short.collect())) == sorted(map(str, expected.collect()))
    assert {(r.status, r.prompt, r.error) for r in none.collect()} == {("needs_review", None, None), ("error", None, "no completion")}
