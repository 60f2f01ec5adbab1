from pyspark.sql import functions as F

from tests.helpers import one
from tidemark.functions import paths as P
from tidemark.operators import filters as FL
from tidemark.sources.tables import SKIP_FILES, skip_list


def tp(spark, path, src="src", tests="tests"):
    df = spark.createDataFrame([(path,)], "p string")
    return P.with_test_path(df, "p", "r", F.lit(src), F.lit(tests)).collect()[0]["r"]


def test_test_path_mapping(spark):
    assert tp(spark, "src/a/b.cs") == "tests/a/bTests.cs"
    assert tp(spark, "src/b.cs") == "tests/bTests.cs"
    assert tp(spark, "x/a.cs") == "tests/../x/aTests.cs"          # outside src, not normalised


def test_auto_mode_test_path(spark):
    df = spark.createDataFrame([("proj/r1/src/m/a.cs",)], "p string")
    got = P.with_test_path(df, "p", "r", F.lit("src"), F.lit("tests"), F.lit("proj/r1")).collect()[0]["r"]
    assert got == "proj/r1/tests/m/aTests.cs"


def test_staging_path(spark):
    assert one(spark, P.staging_path(F.col("v"), F.lit("tmp")), "tests/a/bTests.cs") == "tmp/bTests_temp.cs"


def test_repo_from_url(spark):
    u = F.col("v")
    url = "https://host.example/team/tool.git"
    assert one(spark, P.repo_owner(u), url) == "team"
    assert one(spark, P.repo_name(u), url) == "tool"
    assert one(spark, P.repo_url_error(u), url) is None
    assert one(spark, P.repo_url_error(u), "https://host.example/only") == P.INVALID_URL


def test_classify_location(spark):
    df = spark.createDataFrame([("src/x", True), ("HTTPS://h/a/b", False), ("nowhere", False)],
                               "loc string, e boolean")
    got = [r[0] for r in df.select(P.classify_location("loc", "e")).collect()]
    assert got == ["local", "remote", "invalid"]


def test_branch_name(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05",)], "t string")
    got = df.select(P.branch_name(F.lit("auto/test-update-"), F.to_timestamp("t"))).collect()[0][0]
    assert got == "auto/test-update-20240102030405"


def test_skip_list(spark):
    files = spark.createDataFrame([("Program.cs",), ("PROGRAM.cs",), ("C:\\Project\\Program.cs",), ("MyClass.cs",)],
                                  "file_path string")
    kept = FL.drop_skipped(files, skip_list(spark)).collect()
    assert [r[0] for r in kept] == ["MyClass.cs"]


def test_changed_source_files(spark):
    files = spark.createDataFrame([("src/SomeFile.cs",), ("src/SomeFile.txt",), ("  ",), ("tests/aTests.cs",),
                                   ("src/latests/a.cs",), ("src/Program.cs",), ("src/B.CS",)], "file_path string")
    got = FL.changed_source_files(files, skip_list(spark), ".cs", "tests").collect()
    assert sorted(r[0] for r in got) == ["src/B.CS", "src/SomeFile.cs"]


def test_commit_gate_and_approval(spark):
    files = spark.createDataFrame([("r", "c1", "src/SomeFile.txt"), ("r", "c2", "a.cs")],
                                  "repo string, sha string, file_path string")
    got = {r["sha"]: r["has_source_change"] for r in FL.commit_has_source_change(files, ".cs").collect()}
    assert got == {"c1": False, "c2": True}
    ans = spark.createDataFrame([("y",), ("YES",), ("n",), (None,)], "a string")
    assert [r[0] for r in ans.select(FL.is_approved("a")).collect()] == [True, True, False, False]
