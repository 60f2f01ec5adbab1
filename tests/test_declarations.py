from pyspark.sql import functions as F

from tidemark.operators import declarations as D

KEYS = ["file_path"]

BIN = """using System;

public class Bin
{
    private int x;

    public Bin() { x = 1; }

    public void Fill()
    {
        Console.WriteLine("full { now");
    }

    private void Drain() { }
    protected void Shake() { }
    public int Level() => x;
}
"""

TESTS = """public class BinTests
{
    public void Load() { }
    public void Load_Extra() { }
    public void Other() { }
}
"""


def files(spark, *texts):
    return spark.createDataFrame([(f"f{i}.cs", t) for i, t in enumerate(texts)], "file_path string, content string")


def test_method_source(spark):
    f = files(spark, BIN)
    d = D.declarations(f, KEYS)
    src = D.method_source(d, f, KEYS, "Fill").collect()[0]["source"]
    assert "Fill" in src and "Console.WriteLine" in src
    assert src.startswith("\n    public void Fill()") and src.endswith("}\n")
    assert D.method_source(d, f, KEYS, "NonExistentMethod").collect()[0]["source"] == ""


def test_tests_for_method(spark):
    f = files(spark, TESTS)
    d = D.declarations(f, KEYS)
    got = D.tests_for_method(d, f, KEYS, "Load").collect()[0]["tests"]
    assert "Load()" in got and "Load_Extra" in got and "Other" not in got
    assert D.tests_for_method(d, f, KEYS, "Nope").collect()[0]["tests"] == ""


def test_public_methods(spark):
    none = "public class C { private void A() {} protected void B() {} internal void D() {} }"
    nested = "public class Outer { public void A() {} public class In { public void B() {} } public void C() {} }"
    f = files(spark, BIN, none, nested, "public struct S { public void A() {} }")
    d = D.declarations(f, KEYS)
    got = {r.file_path: r.public_methods for r in D.public_methods(d, f, KEYS).collect()}
    assert got == {"f0.cs": ["Fill", "Level"], "f1.cs": [], "f2.cs": ["A", "C", "B"], "f3.cs": []}


def test_kinds_spans_and_literals(spark):
    src = 'namespace N {\n  class A {\n    string s = "}{"; // {\n    A() { }\n    int P { get; set; }\n    int Q => 1;\n  }\n}\n'
    d = D.declarations(files(spark, src), KEYS)
    got = {(r.kind, r.name, r.start_line, r.end_line) for r in d.collect()}
    assert got == {("namespace", "N", 1, 8), ("class", "A", 2, 7), ("field", "s", 3, 3),
                   ("constructor", "A", 4, 4), ("property", "P", 5, 5), ("property", "Q", 6, 6)}


def test_methods_around_lines(spark):
    f = files(spark, "public class Pair { int Left() { return 1; } int Right() { return 2; } }")
    d = D.declarations(f, KEYS)
    changed = spark.createDataFrame([("f0.cs", [1])], "file_path string, changed_lines array<int>")
    got = sorted(r.name for r in D.methods_around_lines(d, changed, KEYS).collect())
    assert got == ["Left", "Right"]


def test_constructor_change_hits_no_method(spark):
    f = files(spark, BIN)
    d = D.declarations(f, KEYS)
    changed = spark.createDataFrame([("f0.cs", [7])], "file_path string, changed_lines array<int>")
    assert D.methods_around_lines(d, changed, KEYS).count() == 0


def test_context_assembly(spark):
    f = files(spark, BIN, "using System;\nnamespace N { }\n")
    d = D.declarations(f, KEYS)
    m = d.filter(F.col("name") == "Fill")
    got = {r.file_path: r.context for r in D.context_assembly(d, f, m, KEYS).collect()}
    c = got["f0.cs"]
    assert c.startswith("using System;\n\n\n// BEGIN CLASS Bin\npublic class Bin {\n")
    assert "private int x;" in c and "public Bin()" in c and "Fill" in c
    assert c.endswith("// END CLASS\n}\n")
    assert got["f1.cs"] == "using System;\n\n\n// BEGIN CLASS \n"


def test_language_routing(spark):
    df = spark.createDataFrame([(".cs",), (".CS",), (".java",), (".py",), (".ts",), (".js",), (".txt",)], "e string")
    got = [r[0] for r in df.select(D.language_route(F.col("e"))).collect()]
    assert got == ["supported", "supported"] + ["not_implemented"] * 4 + ["unsupported"]


def test_parser_registry():
    import pytest
    assert D.parser_for(".CS") is D.declarations
    with pytest.raises(NotImplementedError):
        D.parser_for(".java")
    with pytest.raises(ValueError):
        D.parser_for(".txt")


def index(spark, text):
    rows = D.declarations(files(spark, text), KEYS).orderBy("decl_id").collect()
    return [(r.kind, r.name, r.is_public, r.start_line, r.end_line) for r in rows], [r.full_text for r in rows]


def test_byte_order_mark(spark):
    got, _ = index(spark, "\ufeffusing System;\npublic class A { public void M() { } }\n")
    assert got == [("using", "System", False, 1, 1), ("class", "A", True, 2, 2), ("method", "M", True, 2, 2)]
    assert index(spark, "\ufeff#nullable enable\npublic class A { }")[0] == [("class", "A", True, 2, 2)]


def test_directives(spark):
    got, text = index(spark, "class C {\n  #region a { b\n  public void Foo() { }\n  #endregion\n#nullable enable\n  public int F;\n"
                             "#pragma warning disable {\n  private int g;\n}\n")
    assert got == [("class", "C", False, 1, 9), ("method", "Foo", True, 3, 3), ("field", "F", True, 6, 6), ("field", "g", False, 8, 8)]
    assert text[1] == "  #region a { b\n  public void Foo() { }\n"


def test_conditional_branches(spark):
    got, _ = index(spark, "class C {\n#if DEBUG\n  void A() {\n#else\n  void B() {\n#endif\n  }\n#if !X\n  int k;\n#if Z || !Y\n  int m;\n#endif\n"
                          "#elif Y\n  int n;\n#endif\n#if X && !Y\n  int o;\n#elif true\n  int p;\n#else\n  int q;\n#endif\n}\n")
    assert [(k, n) for k, n, *_ in got] == [("class", "C"), ("method", "B"), ("field", "k"), ("field", "m"), ("field", "p")]
    assert got[0][4] == 23 and got[1][3:] == (5, 7)


def test_attributes_with_brackets_and_braces(spark):
    got, text = index(spark, 'class C {\n [A(typeof(int[]))] public void M() { }\n [A(new[] {1})] public void N() { }\n [X][Y("]")]\n public int f;\n}\n')
    assert got == [("class", "C", False, 1, 6), ("method", "M", True, 2, 2), ("method", "N", True, 3, 3), ("field", "f", True, 4, 5)]
    assert text[2] == " [A(new[] {1})] public void N() { }\n"


def test_tuples_defaults_and_constraints(spark):
    got, _ = index(spark, "class C {\n public (int a, int b) Two() { return (1,2); }\n private (int, int) t = (1, 2);\n (int,int) u;\n"
                          " public void D(int a = 1, (int,int) z = default) { }\n public T G<T>(T x) where T : class, new() { return x; }\n"
                          " public C(int a) : base(a) { }\n ~C() { }\n}\n")
    assert [(k, n, p) for k, n, p, *_ in got[1:]] == [("method", "Two", True), ("field", "t", False), ("field", "u", False), ("method", "D", True),
                                                     ("method", "G", True), ("constructor", "C", True), ("destructor", "~C", False)]


def test_operators_delegates_and_events_are_no_members(spark):
    got, _ = index(spark, 'class C {\n public static C operator +(C a, C b) { return a; }\n public static implicit operator string(C c) => "";\n'
                          " public static bool operator ==(C a, C b) => true;\n public delegate void D(int x);\n public event System.Action E;\n"
                          " public event System.Action F { add { } remove { } }\n}\n")
    assert got == [("class", "C", False, 1, 8)]


def test_initializers_and_expression_bodies_reach_their_semicolon(spark):
    got, text = index(spark, "class C {\n public X P { get; set; } = new();\n private Foo f = new Foo { A = 1 };\n public int R() => Run(() => { return 1; });\n"
                             " private int z;\n public Bar B { get; } = new Bar { Q = 1 };\n int[] a = { 1, 2 };\n}\n")
    assert [(k, n) for k, n, *_ in got[1:]] == [("property", "P"), ("field", "f"), ("method", "R"), ("field", "z"), ("property", "B"), ("field", "a")]
    assert text[2] == " private Foo f = new Foo { A = 1 };\n" and text[3] == " public int R() => Run(() => { return 1; });\n"


def test_records_and_enums(spark):
    got, _ = index(spark, "public record struct P(int X) { public P(int a, int b) : this(a) { } public void M() { } }\npublic record R(int Y);\nenum E { A, B }\n")
    assert [(k, n) for k, n, *_ in got] == [("record", "P"), ("constructor", "P"), ("method", "M"), ("record", "R"), ("enum", "E")]


def test_strings_of_every_kind_and_comments_at_the_end(spark):
    got, _ = index(spark, 'class C {\n string s = """"\n a """ { \n"""";\n string t = $"{x["a{"]} {{ {(y ? "}" : "{")}"; string u = "http://a{b";\n'
                          ' string v = $@"a""{{ {b}"; string w = @"\\"; char c = \'{\';\n void M() { }\n} // done }')
    assert [(k, n) for k, n, *_ in got] == [("class", "C"), *(("field", x) for x in "stuvwc"), ("method", "M")]
    assert got[0][4] == 8


def test_unbalanced_files_have_no_declarations(spark):
    f = files(spark, "class C { void M() { }", "class C { void M() { } } // {", "class C { } }")
    assert {r.file_path for r in D.declarations(f, KEYS).collect()} == {"f1.cs"}
    assert [r[0] for r in f.select(D.braces_balance("content")).collect()] == [False, True, False]


def test_scan_has_one_exchange(spark):
    plan = D.declarations(files(spark, BIN), KEYS, with_text=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Union" not in plan and "Join" not in plan


def names(spark, text):
    d = D.declarations(spark.createDataFrame([("f", text)], "k string, content string"), ["k"], with_text=False)
    return [(r.kind, r.name) for r in d.orderBy("start_pos").collect()]


def test_letters_of_all_scripts_and_verbatim_names(spark):
    assert names(spark, "class Ä { public void Größe() {} int Überzahl; } class @class { public @class() { } void @event(int @in) { } }") == [
        ("class", "Ä"), ("method", "Größe"), ("field", "Überzahl"), ("class", "@class"), ("constructor", "class"), ("method", "event")]


def test_deep_parentheses_and_attributes(spark):
    assert names(spark, "class C { public int M(int a = ((((((1)))))) + f(g(h(i(j(k(l()))))))) { return a; } }") == [("class", "C"), ("method", "M")]
    assert names(spark, "class C { [A(x[y[z[w[0]]]], new[] { 1 })] [B] public void M() { } [C(a[b[c[d]]])] int[][] f; }") == [
        ("class", "C"), ("method", "M"), ("field", "f")]


def test_defined_symbols_choose_the_branch(spark):
    text = "#define X\n#define Y\n#undef Y\nclass C {\n#if X && !Y\nvoid A() { }\n#else\nvoid B() {\n#endif\n#if Y || Z\nvoid D() {\n#elif !X\nvoid E() {\n#else\nvoid F() { }\n#endif\n}"
    assert names(spark, text) == [("class", "C"), ("method", "A"), ("method", "F")]


def test_function_pointer_fields(spark):
    assert names(spark, "unsafe class C { public delegate*<int, void> f; public delegate void H(int x); int g; }") == [
        ("class", "C"), ("field", "f"), ("field", "g")]


def test_methods_around_very_many_lines(spark):
    n = 100_000
    decls = spark.range(n // 5).selectExpr("'k' as k", "'method' as kind", "cast(id * 5 + 1 as int) as start_line", "cast(id * 5 + 4 as int) as end_line", "cast(id as string) as name")
    lines = [i for i in range(1, n + 1) if i % 5 == 0 or i % 7 == 0 and i % 3 == 0]
    changed = spark.createDataFrame([("k", lines), ("other", [1])], "k string, changed_lines array<int>")
    got = {int(r.name) for r in D.methods_around_lines(decls, changed, ["k"]).collect()}
    assert got == {(i - 1) // 5 for i in lines if i % 5}


def test_search_in_an_ordered_array(spark):
    cases = [([], 1, 9), ([5], 5, 5), ([5], 6, 9), ([5], 1, 4), ([1, 4, 9], 5, 8), ([1, 4, 9], 2, 4), ([1, 4, 9], 9, 99), ([1, 2, 3, 4, 5, 6, 7, 8], 8, 8)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a array<int>, lo int, hi int")
    got = [r.x for r in df.select("i", D.any_between(F.col("a"), F.col("lo"), F.col("hi")).alias("x")).orderBy("i").collect()]
    assert got == [any(lo <= x <= hi for x in a) for a, lo, hi in cases]


def test_tests_of_many_methods(spark):
    decls = spark.createDataFrame([("k", 1, "method", "Add_WhenA", 10, "t1"), ("k", 2, "method", "AddAll_WhenB", 5, "t2"), ("k", 3, "method", "Sub_X", 1, "t3"),
                                   ("k", 4, "field", "Add_f", 2, "t4"), ("j", 1, "method", "Add_Z", 1, "t5")],
                                  "k string, decl_id int, kind string, name string, start_pos int, full_text string")
    m = spark.createDataFrame([("k", "Add"), ("k", "Add"), ("k", "Sub"), ("k", "add"), ("j", "AddAll"), ("k", "AddAll_WhenB")], "k string, name string")
    got = {(r.k, r.name): r.tests for r in D.tests_of_methods(m, decls, ["k"]).collect()}
    assert got == {("k", "Add"): "t2\nt1\n", ("k", "Sub"): "t3\n", ("k", "add"): "", ("j", "AddAll"): "", ("k", "AddAll_WhenB"): "t2\n"}


def test_scan_looks_back_only(spark):
    # a frame to the end of the file costs the square of its segments
    files = spark.createDataFrame([("a.cs", BIN)], "file_path string, content string")
    plan = D.declarations(files, KEYS, with_text=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "1, unboundedfollowing" not in plan.lower()
    assert "repartitionbyexpression" in plan.lower()
