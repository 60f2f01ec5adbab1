"""C# code corpus rendered from ``documents``.

Each document becomes one C# file.  Every line of the document text becomes
one statement ``_log.Add("...");`` inside ``Load()``, so the whole text is
carried, string literals hold quotes, and the file size grows with the text.
Variants by ``doc_id``: every 13th file declares a nested interface, every
11th file has no public method among the plain ones, every 5th file ends its
class with 15 lines of less common syntax (``EXTRA``: directives with and
without compiled branches, attributes with brackets and braces, tuples, an
operator, a delegate, an event, initializers, an interpolated and a raw
string, a record struct).  ``tidemark.plans.oracle`` renders the same text in
SQL.

Line layout (n = number of text lines)::

    1  using System;
    2  using System.Collections.Generic;
    4  namespace Corpus.{source}
    7  public class Doc{id}                 (ends on line 26+n)
    9  field _log        10 field _size
    11 struct Shape / interface IShape with method Area
    12 class Inner with method Ping
    14 constructor       16 Size()          18-19 Lang()
    21 Load() .. 23+n    25+n Check()
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Lines 26+n .. 40+n of every 5th file; ``@`` stands for the class's name.
EXTRA = """\
#region Extra {
        [Tag(typeof(int[])), Use(new[] {1})] public (int a, int b) Pair(int x = 1) { return (x, x); }
#endregion
        public static @ operator +(@ a, @ b) { return a; }
        public delegate void Hook(int x);
        public event System.Action Fired;
        public string Name { get; set; } = "n{";
        private int[] _seq = new[] { 1, 2 };
#if DEBUG
        public void Ghost() {
#else
        public void Real() {
#endif
            var t = $"{{ {(true ? "}" : "{")}"; var r = \"\"\" { " \"\"\"; }
        public record struct Point(int X) { public int Twice() => X * 2; }
"""


def escape_literal(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def code_template(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    did = doc_id.cast("string")
    vis = F.when(F.pmod(doc_id, F.lit(11)) == 0, F.lit("internal")).otherwise(F.lit("public"))
    ping = F.when(F.pmod(doc_id, F.lit(11)) == 0, F.lit("private")).otherwise(F.lit("public"))
    shape = F.when(F.pmod(doc_id, F.lit(13)) == 0, F.lit("public interface IShape { int Area(); }")) \
             .otherwise(F.lit("public struct Shape { public int Area() { return 1; } }"))
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    body = F.array_join(
        F.transform(lines, lambda l: F.concat(F.lit('            _log.Add("'), escape_literal(l), F.lit('");\n'))),
        "")
    return F.concat(
        F.lit("using System;\nusing System.Collections.Generic;\n\nnamespace Corpus."), source,
        F.lit("\n{\n    /// <summary>Document "), did, F.lit(" ("), lang, F.lit(")</summary>\n"),
        F.lit("    public class Doc"), did, F.lit("\n    {\n"),
        F.lit("        private readonly List<string> _log = new List<string>();\n"),
        F.lit("        private int _size = "), n_chars.cast("string"), F.lit(";\n"),
        F.lit("        "), shape, F.lit("\n"),
        F.lit("        public class Inner { "), ping, F.lit(" void Ping() { } }\n\n"),
        F.lit("        public Doc"), did, F.lit("(int size) { _size = size; }\n\n"),
        F.lit("        "), vis, F.lit(" int Size() { return _size; }\n\n"),
        F.lit('        [Obsolete("use Size")]\n'),
        F.lit("        "), vis, F.lit(' string Lang() => "'), lang, F.lit('";\n\n'),
        F.lit("        private void Load()\n        {\n"),
        body,
        F.lit("        }\n\n"),
        F.lit('        protected bool Check(string s) { return s == "}"; }\n'),
        F.when(F.pmod(doc_id, F.lit(5)) == 0, F.replace(F.lit(EXTRA), F.lit("@"), F.concat(F.lit("Doc"), did))).otherwise(F.lit("")),
        F.lit("    }\n}\n"),
    )
