from pyspark.sql import functions as F

from tests.helpers import one
from tidemark.functions import text as X


def test_effective_loc_counts_code_lines_only(spark):
    src = "a\n  // c\n\t//x\n\n  \r\nb // t\n/* z */"
    assert one(spark, X.effective_loc(F.col("v")), src) == 3


def lines(spark, old, new):
    df = spark.createDataFrame([(old, new)], "o string, n string")
    return df.select(X.changed_line_numbers(F.col("o"), F.col("n")).alias("r")).collect()[0]["r"]


def test_changed_lines_vectors(spark):
    assert lines(spark, "red\ngreen\nblue\ngrey", "red\nlime\nblue\nnavy\npink") == [2, 4, 5]
    assert lines(spark, "same\ntext", "same\ntext") == []
    assert lines(spark, "a\nb\nc", "a") == []            # trailing deletion flags nothing
    assert lines(spark, "", "x") == [1]
    assert lines(spark, "a", "a\r") == [1]               # CR stays on the line


def test_blank_tests_are_unicode_aware(spark):
    assert one(spark, X.is_blank(F.col("v")), "\u00a0 \t") is True
    assert one(spark, X.is_blank(F.col("v")), None) is True
    assert one(spark, X.not_blank(F.col("v")), " x ") is True
    assert one(spark, X.unicode_trim(F.col("v")), "\u00a0\t x y\n") == "x y"


def test_blank_coalesce(spark):
    df = spark.createDataFrame([("  ", "b"), ("a", "b"), (None, "b")], "a string, b string")
    got = [r[0] for r in df.select(X.blank_coalesce("a", "b")).collect()]
    assert got == ["b", "a", "b"]


def test_strip_think(spark):
    assert one(spark, X.strip_think(F.col("v")), "<think>which cases?</think>var ok = true;") == "var ok = true;"
    assert one(spark, X.strip_think(F.col("v")), "<think>a\nb</think> x <think>c</think>") == "x"
    assert one(spark, X.strip_think(F.col("v")), "<think>open x") == "<think>open x"


def test_extract_code_block(spark):
    f = lambda v: one(spark, X.extract_code_block(F.col("v")), v)
    assert f("as asked ```csharp\nstruct Dot { }\n``` bye") == "struct Dot { }"
    assert f(None) == ""
    assert f("   ") == ""
    assert f("  ```\nunclosed  ") == "```\nunclosed"
    assert f("``````") == ""
    assert f("```c#\ncode\n```") == "#\ncode"
    assert f("<think>```x```</think>plain") == "plain"


def test_path_name_parts(spark):
    assert one(spark, X.basename(F.col("v")), "C:\\Project\\Program.cs") == "Program.cs"
    assert one(spark, X.stem(F.col("v")), "a/b.c.cs") == "b.c"
    assert one(spark, X.extension(F.col("v")), "a/b.c.cs") == ".cs"
    assert one(spark, X.extension(F.col("v")), "a/noext") == ""
    assert one(spark, X.stem(F.col("v")), ".gitignore") == ""
