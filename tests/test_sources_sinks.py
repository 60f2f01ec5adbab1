import os

import pytest
from pyspark.sql import functions as F

from tidemark.session import scratch_path, shared_dir
from tidemark.sources import files as SF
from tidemark.sources import sink as SK
from tidemark.streaming.operators import quarantine_writer


def test_whole_file_scan_round_trip(spark):
    root = scratch_path(spark, "t-files")
    docs = spark.createDataFrame([("a", "line1\nline2"), ("a", "x {"), ("b", "")], "folder string, text string")
    SF.write_one_file_per_row(docs, root, "text", "folder")
    got = SF.scan_whole_files(spark, root, "*.txt") \
        .select(F.regexp_extract("file_path", r"folder=([^/]+)/", 1).alias("f"), "content").collect()
    assert sorted((r.f, r.content) for r in got) == [("a", "line1\nline2\n"), ("a", "x {\n"), ("b", "\n")]


def test_quarantine_writer_is_replay_safe(spark):
    base = scratch_path(spark, "t-quarantine")
    write = quarantine_writer(f"{base}/files")
    batch = spark.createDataFrame([("a.cs", None), ("b.txt", "no parser")], "file_path string, error string")
    write(batch, 0)
    write(batch, 0)          # the same epoch replayed after a failure
    write(batch.filter(F.col("error").isNull()), 1)
    out = spark.read.parquet(f"{base}/files")
    assert sorted((r.epoch_id, r.file_path, r.failed) for r in out.collect()) == [(0, "a.cs", "false"), (0, "b.txt", "true"), (1, "a.cs", "false")]


def test_byte_order_mark_is_no_content(spark):
    df = spark.createDataFrame([("\ufeffusing A;",), ("x\ufeff",)], "v string")
    assert [r[0] for r in df.select(SF.without_bom("v")).collect()] == ["using A;", "x\ufeff"]


def test_shared_folder_must_be_named_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda k, d=None: d)}))
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session)


def files_below(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), encoding="utf-8", newline="").read() for d, _, fs in os.walk(root) for f in fs
            if f"/{SK.STAGED}/" not in f"{d}/"}


def test_each_row_is_written_at_its_own_path(spark):
    root = scratch_path(spark, "t-sink")
    rows = [(f"tests/a{i % 3}/F{i}Tests.cs", f"class F{i} {{}}\r\n\u00e4") for i in range(40)] + [("tests\\b\\G.cs", None)]
    SK.write_files(spark.createDataFrame(rows, "path string, content string").repartition(5), root)
    expected = {p.replace("\\", "/"): c or "" for p, c in rows}
    assert files_below(root) == expected
    got = SF.scan_whole_files(spark, root).collect()
    assert {r.file_path.split(root, 1)[1][1:]: r.content for r in got} == {p: c for p, c in expected.items() if c}
    # other paths stay, a path that is there is replaced
    SK.write_files(spark.createDataFrame([("tests/b/G.cs", "new")], "path string, content string"), root)
    assert files_below(root) == expected | {"tests/b/G.cs": "new"}
    SK.write_files(spark.createDataFrame([], "path string, content string"), root)
    assert files_below(root) == expected | {"tests/b/G.cs": "new"}


@pytest.mark.parametrize("bad", ["../out.cs", "/etc/x", "a/../../x", "", None, "a//b", "C:\\x", "_staged/x", "./a"])
def test_paths_outside_the_root_write_nothing(spark, bad):
    root = scratch_path(spark, "t-sink-bad")
    rows = [(f"ok/{i}.cs", "x") for i in range(20)] + [(bad, "x")]
    with pytest.raises(Exception, match="not a path below the root"):
        SK.write_files(spark.createDataFrame(rows, "path string, content string").repartition(4), root)
    assert files_below(root) == {}


def test_a_path_of_two_rows_is_an_error(spark):
    with pytest.raises(ValueError, match="2 rows for the path 'a/b.cs'"):
        SK.write_files(spark.createDataFrame([("a/b.cs", "1"), ("a\\b.cs", "2")], "path string, content string"), scratch_path(spark, "t-sink-twice"))


def test_attempts_that_were_not_chosen_leave_nothing(tmp_path):
    w = SK.TextFilesWriter(str(tmp_path))
    lost, kept = w.write(iter([("a.cs", "lost")])), w.write(iter([("a.cs", "kept"), ("b/c.cs", "x")]))
    assert lost.listing != kept.listing and not (tmp_path / "a.cs").exists()
    w.commit([kept, w.write(iter([])), None])
    assert files_below(tmp_path) == {"a.cs": "kept", "b/c.cs": "x"}
    w = SK.TextFilesWriter(str(tmp_path))
    w.abort([w.write(iter([("d.cs", "x")])), None])
    assert files_below(tmp_path) == {"a.cs": "kept", "b/c.cs": "x"}
    w.write(iter([("e.cs", "x")]))
    SK.clear_staging(str(tmp_path))
    assert not (tmp_path / SK.STAGED).exists() and files_below(tmp_path) == {"a.cs": "kept", "b/c.cs": "x"}


def test_one_file_per_row_starts_no_process_per_file(spark):
    # Spark's text writer (a process and a checksum file each) leaves .crc files
    root = scratch_path(spark, "t-many-files")
    docs = spark.createDataFrame([("a b", "x"), ("c:d%", None), (None, "y"), ("", "z")], "folder string, text string")
    SF.write_one_file_per_row(docs, root, "text", "folder")
    found = sorted((os.path.basename(d), f.rsplit(".", 1)[1], open(f"{d}/{f}").read()) for d, _, fs in os.walk(root) for f in fs)
    null = "folder=__HIVE_DEFAULT_PARTITION__"
    assert found == [(null, "txt", "y\n"), (null, "txt", "z\n"), ("folder=a b", "txt", "x\n"), ("folder=c%3Ad%25", "txt", "\n")]


def test_files_are_listed_and_read_by_tasks_as_spark_reads_them(spark, tmp_path):
    names = ["a.txt", "b c.txt", "x%20y.txt", "k=1/ä#1.txt", "k=1/_h.txt", "k=1/_p=1.txt", ".hid/a.txt", "_d/a.txt", "_d=1/e/f+g.txt", "z.TXT", "empty.txt", "b.cs", "w[1].txt", "a.gz"]
    for i, n in enumerate(names):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        text = b"" if n.startswith("empty") else b"\xef\xbb\xbfbom" if i == 0 else b"\xff raw\r\n" if i == 1 else f"text {i}\n".encode()
        if n.endswith(".gz"):
            import gzip
            text = gzip.compress(text)
        (tmp_path / n).write_bytes(text)
    out = lambda df: sorted((r.file_path, bytes(r.b)) for r in df.select("file_path", F.col("content").cast("binary").alias("b")).collect())
    for glob in (None, "*.txt", "?.{txt,cs}", "[!a]*.txt", "\\b*", "*\\[1].txt"):
        r = spark.read.option("recursiveFileLookup", True)
        r = r.option("pathGlobFilter", glob) if glob else r
        want = out(r.text(str(tmp_path), wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), SF.without_bom("value").alias("content")))
        got = SF.scan_whole_files(spark, str(tmp_path), glob)
        assert out(got) == want and len(want) > 0, glob
        # the driver holds no index of files
        assert "FileScan text" not in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        SF.scan_whole_files(spark, str(tmp_path / "none"))
    assert [r.content for r in SF.scan_whole_files(spark, str(tmp_path / "b.cs")).collect()] == ["text 11\n"]


def test_a_commit_moves_a_list_in_parts(tmp_path, monkeypatch):
    monkeypatch.setattr(SK, "MOVED", 3)
    w = SK.TextFilesWriter(str(tmp_path))
    w.commit([w.write(iter([(f"d{i % 2}/{i} .txt", str(i)) for i in range(10)]))])
    assert files_below(tmp_path) == {f"d{i % 2}/{i} .txt": str(i) for i in range(10)}
