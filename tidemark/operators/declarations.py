"""Declaration index for C# sources and the questions asked of it.

One pass turns a table of files into a ``declarations`` table; every
question (method by name, tests for a method, public methods, methods
around changed lines, context for a large file) is then a query on it.

The scan is built from Spark SQL only:

1. Files are dealt by their keys, the only exchange of the scan.  Branches
   of ``#if`` blocks that are not compiled are blanked at equal length.
2. ``regexp_extract_all`` cuts each file into *segments*, each ending in
   ``{``, ``}`` or ``;``.  String and char literals, comments, directives and
   bracketed lists (attributes) are matched as whole tokens, so braces inside
   them never cut.
3. ``posexplode`` gives one row per segment; a window per file (running
   sums) gives each segment its offset, line and brace depth.
4. Each segment is classified from its masked header (literals, comments and
   directives blanked at equal length, leading attributes removed, the
   contents of parentheses folded).
5. Parent and end: each opening segment plays two roles, a member at its own
   depth and an opener at the depth it opens.  A window over ``(file, depth)``
   gives every member the last opener before it (its parent) and the end of an
   initializer or expression body (the next ``;`` at its depth), and every
   opener the first closing segment after it; a window over ``(file, segment)``
   puts the two roles together.  All windows use the partitioning of step 1.
6. Only for ``with_text``: a join back to the file text cuts the full text of
   each declaration, with leading and trailing trivia as a syntax tree's full
   string has it.

A file's segments are processed by one task (the windows are per file), so
work is bounded by the largest single file, never by a hot key.  A file whose
braces do not balance has no declarations (``braces_balance`` tells).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import unicode_trim

# Token patterns of the language (Java regex, possessive where safe).
_RAW = r'\$*+(?<q>"{3,}+)[\s\S]*?(?<!")\k<q>(?!")'
_HOLE = r'\{(?:[^{}"]++|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|\{[^{}]*+\})*+\}'
_INTERPOLATED = (r'\$"(?:[^"\\{\n]++|\\.|\{\{|' + _HOLE + r')*+"'
                 r'|(?:\$@|@\$)"(?:[^"{]++|""|\{\{|' + _HOLE + r')*+"')
_STRING = r'@"(?:[^"]|"")*+"|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"' + r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
_COMMENT = r"//[^\n]*+|/\*[\s\S]*?\*/"
_DIRECTIVE = r"(?<=(?:\A|\n)[ \t\uFEFF]{0,99})#[^\n]*+"
_LIT = "|".join([_RAW, _INTERPOLATED, _STRING, _COMMENT, _DIRECTIVE])
_PLAIN = r"""[^"'/@#$\[\]{};]++"""


def _list(depth: int) -> str:
    """A bracketed list (attributes) with brackets inside brackets, ``depth``
    levels down, and braces without braces on any level."""
    flat = inner = r"[^\[\]{};]++|\{[^{}]*+\}"
    for _ in range(depth):
        inner = rf"{flat}|\[(?:{inner})*+\]"
    return r"\[(?:" + _PLAIN + "|" + _LIT.replace("<q>", "<r>") + "|" + inner + r")*+\]"


_LIST = _list(6)
TOKEN_RE = _LIT + r"""|[^"'/@#$]++|[\s\S]"""
SEGMENT_RE = "(?:" + _LIT + "|" + _LIST + "|" + _PLAIN + r"|[^{};])*+(?:[{};]|\z)"
MASKED_TOKEN_RE = r"""^(?:\$*"{3}|\$?@?\$?"|'|//|/\*|#)"""
ATTRIBUTES_RE = r"^(?U)(?:\s*\[[^\[\]]*+\])+"          # once brackets inside brackets are gone
BLANK_RE = r"^(?U)[\s\uFEFF]*"
TYPE_RE = r"^(?U)(?:\w+\s+)*?(class|struct|interface|record|enum)\s+(?:struct\s+|class\s+)?(@?\w+)"
TYPE_KINDS = ("class", "struct", "interface", "record", "enum")
MEMBER_PARENTS = ("class", "struct", "interface", "record")
PARSER_EXTENSIONS = {".cs": "supported", ".java": "not_implemented", ".py": "not_implemented",
                     ".ts": "not_implemented", ".js": "not_implemented"}
UNBALANCED = "source has unbalanced braces"


def mask(c: Column) -> Column:
    """Blank literals, comments and directives at equal length, keeping newlines."""
    toks = F.regexp_extract_all(c, F.lit(TOKEN_RE), 0)
    return F.array_join(F.transform(toks, lambda t: F.when(t.rlike(MASKED_TOKEN_RE),
                                                         F.regexp_replace(t, r"[^\n]", " ")).otherwise(t)), "")


def braces_balance(content) -> Column:
    """Whether a text has as many ``{`` as ``}`` outside literals and comments."""
    c = F.col(content) if isinstance(content, str) else content
    toks = F.regexp_extract_all(compiled_text(F.coalesce(c, F.lit(""))), F.lit(_LIT + "|[{}]"), 0)
    return F.aggregate(toks, F.lit(0), lambda s, t: s + F.when(t == "{", 1).when(t == "}", -1).otherwise(0)) == 0


def compiled_text(c: Column) -> Column:
    """Blank, at equal length, the branches of ``#if`` blocks that are not
    compiled with the symbols that the file itself defines (``#define X``
    without ``#undef X``): ``X`` holds if it is one, ``!X`` if not, ``true``
    always; ``&&`` and ``||`` combine them.  Only the few directive lines are
    folded into a state: one letter per open block, ``a`` (this branch
    compiles), ``w`` (none yet), ``d`` (an earlier one did)."""
    d = lambda lines: F.filter(F.transform(F.filter(F.transform(lines, lambda l, i: F.struct(i.alias("i"), l.alias("l"))), lambda x: x["l"].contains("#")),
                                           lambda x: F.struct(x["i"].alias("i"), F.regexp_extract(x["l"], r"^\s*#\s*(if|elif|else|endif)\b", 1).alias("d"),
                                                              F.regexp_extract(x["l"], r"^\s*#\s*(?:if|elif)\b([^/]*)", 1).alias("c"))),
                               lambda x: x["d"] != "")
    term_re = r"^(?U)\s*\(*\s*(!?)\s*\(?\s*(\w+)\s*\)*\s*$"

    def holds(e, defined):
        def term(t):
            name, negated = F.regexp_extract(t, term_re, 2), F.regexp_extract(t, term_re, 1) == "!"
            return (name != "") & (((name == "true") | F.array_contains(defined, name)) != negated)
        return F.exists(F.split(e, r"\|\|"), lambda o: F.forall(F.split(o, "&&"), term))

    def symbols(lines, word):
        return F.transform(F.filter(lines, lambda l: l.contains("#")), lambda l: F.regexp_extract(l, rf"^(?U)\s*#\s*{word}\s+(\w+)", 1))

    def step(s, x, holds):
        top = F.right(s["open"], F.lit(1))
        rest = F.substring(s["open"], F.lit(1), F.greatest(F.length(s["open"]) - 1, F.lit(0)))
        now = (F.when(x["d"] == "if", F.concat(s["open"], F.when(holds(x["c"]), "a").otherwise("w")))
                .when(x["d"] == "endif", rest)
                .when(top != "w", F.concat(rest, F.lit("d")))
                .when((x["d"] == "else") | holds(x["c"]), F.concat(rest, F.lit("a")))
                .otherwise(s["open"]))
        return F.struct(now.alias("open"), F.concat(s["marks"], F.array(F.struct(x["i"].alias("i"), (~now.rlike("[wd]")).alias("on")))).alias("marks"))

    start = F.struct(F.lit("").alias("open"), F.array().cast("array<struct<i:int,on:boolean>>").alias("marks"))

    def blanked(x):
        on = lambda i: F.coalesce(F.try_element_at(F.filter(x["marks"], lambda m: m["i"] <= i), F.lit(-1))["on"], F.lit(True))
        return F.transform(x["lines"], lambda l, i: F.when(on(i) | (l.contains("#") & l.rlike(r"^\s*#")), l).otherwise(F.regexp_replace(l, ".", " ")))

    def marks(lines, defined):
        return F.aggregate(d(lines), start, lambda s, x: step(s, x, lambda e: holds(e, defined)), lambda s: s["marks"])

    # arrays of one element bind the lines, the symbols, then the marks, so that each is worked out once
    cut = F.transform(F.array(F.split(c, "\n", -1)), lambda lines: F.struct(
        lines.alias("lines"), F.array_except(symbols(lines, "define"), symbols(lines, "undef")).alias("defined")))
    bound = F.transform(cut, lambda x: F.struct(x["lines"].alias("lines"), marks(x["lines"], x["defined"]).alias("marks")))
    return F.when(c.contains("#if"), F.array_join(F.transform(bound, blanked)[0], "\n")).otherwise(c)


def _nl(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


# Fixed value: a token's trailing trivia - blanks, block comments on the same
# line, an optional line comment, then the end of the line.
TRAILING_TRIVIA_RE = r"^[ \t\f\x0B]*+(?:/\*[^\n]*?\*/[ \t\f\x0B]*+)*+(?://[^\n]*+)?(?:\r\n|\n|\r)?"


def segments(files: DataFrame, keys: Sequence[str], content: str = "content") -> DataFrame:
    """One row per segment with its text, offset, line, depth and the length
    of the trailing trivia it starts with; none of files whose braces do not
    balance.  Files are dealt by their keys first; everything later in the
    scan stays in that partitioning."""
    keys = list(keys)
    parts = F.filter(F.regexp_extract_all(compiled_text(F.coalesce(F.col(content), F.lit(""))), F.lit(SEGMENT_RE), 0),
                     lambda s: s != "")
    # in so many parts: a few MB of text are minutes of work, which Spark would put together by their bytes.
    # Twice as many as a join has: where the files come out of a join on the same keys, Spark would drop a
    # repartition into as many parts and put those of the join together
    n = 2 * int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = files.select(*keys, content).repartition(n, *keys).select(*keys, F.posexplode(parts).alias("idx", "seg"))
    # a comment or directive may end the file in one of these characters
    last = F.substring(F.when(F.col("seg").rlike(COMMENT_LAST_RE), mask(F.col("seg"))).otherwise(F.col("seg")), -1, 1)
    term = F.when(last.isin("{", "}", ";"), last).otherwise(F.lit(""))
    s = s.select(*keys, "idx", "seg", F.length("seg").alias("len"), _nl(F.col("seg")).alias("nl"),
                 term.alias("term"), F.length(F.regexp_extract("seg", TRAILING_TRIVIA_RE, 0)).alias("tt"))
    w = Window.partitionBy(*keys).orderBy("idx")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    delta = F.when(F.col("term") == "{", 1).when(F.col("term") == "}", -1).otherwise(0)
    return s.select(
        "*",
        F.coalesce(F.sum("len").over(before), F.lit(0)).alias("seg_start"),
        F.coalesce(F.sum("nl").over(before), F.lit(0)).alias("nl_before"),
        F.coalesce(F.sum(delta).over(before), F.lit(0)).alias("depth"),
        F.coalesce(F.lead("tt").over(w), F.lit(0)).alias("next_tt"),
        F.sum(delta).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("surplus"),
    ).where("surplus = 0").drop("surplus")


# A segment whose last line may hold a comment or directive.
COMMENT_LAST_RE = r"(?://|/\*|(?:^|\n)[ \t]*#)[^\n]*\z"

OPEN, CLOSE = "\u2039", "\u203a"           # stand for a folded pair of parentheses
FOLDED = OPEN + CLOSE


def _nesting(h: Column, opening: str, closing: str) -> Column:
    """How deep a header's brackets of one sort are nested."""
    signs = F.regexp_extract_all(h, F.lit(f"[{opening}{closing}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    opens = "(" if "(" in opening else "["

    def step(s, t):
        now = s["now"] + F.when(t == opens, 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))
    return F.aggregate(signs, start, step, lambda s: s["most"])


def _times(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _folded(h: Column) -> Column:
    """A header with every pair of parentheses and its contents as one sign,
    however deep."""
    return F.aggregate(_times(_nesting(h, "(", ")")), h, lambda x, _: F.regexp_replace(x, r"\([^()]*\)", FOLDED))


def _flat_lists(h: Column) -> Column:
    """A header without the brackets that are inside other brackets."""
    return F.aggregate(_times(_nesting(h, r"\[", r"\]") - 1), h, lambda x, _: F.regexp_replace(x, r"(\[[^\[\]]*)(?:\[[^\[\]]*\][^\[\]]*)+", "$1"))


def _header(s: DataFrame) -> DataFrame:
    """Masked header (segment without its terminator, literals and comments
    blanked), node start and raw classification."""
    h = mask(F.when(F.col("term") == "", F.col("seg")).otherwise(F.expr("substring(seg, 1, length(seg) - 1)")))
    s = s.withColumn("h", h)
    s = s.withColumn("lead_ws", F.length(F.regexp_extract("h", BLANK_RE, 0)))
    s = s.withColumn("lead_nl", _nl(F.expr("substring(h, 1, lead_ws)")))
    return _classify(s)


def _classify(s: DataFrame) -> DataFrame:
    bare = F.regexp_replace(_flat_lists(F.regexp_replace(F.col("h"), BLANK_RE, "")), ATTRIBUTES_RE, "")
    s = s.withColumn("ht", unicode_trim(bare))
    s = s.withColumn("hf", _folded(F.col("ht")))
    # the signature: up to an initializer or expression body, without base call and constraints
    s = s.withColumn("sig", F.regexp_replace("hf", r"(?s)(?:=>|(?<![=!<>])=(?![=>])).*$", ""))
    s = s.withColumn("is_expr", F.col("sig") != F.col("hf"))
    s = s.withColumn("sig", unicode_trim(F.regexp_replace(F.regexp_replace("sig", r"(?s)\swhere\s.*$", ""),
                                                          r"\s*:\s*(?:base|this)\s*" + FOLDED + r"\s*$", "")))
    h, hf, sig, term = F.col("ht"), F.col("hf"), F.col("sig"), F.col("term")
    called = r"(?U)(~?\s*@?\w+)\s*(?:<[\w\s,<>\[\]?.@]*>)?\s*" + FOLDED + "$"
    # a plain search comes before each pattern that has a fixed part
    word = lambda w: sig.contains(w) & sig.rlike(rf"^(?U)(?:\w+\s+)*?{w}\b(?!\s*\*)")
    s = s.withColumn("type_kw", F.when(reduce(or_, (hf.contains(k) for k in TYPE_KINDS)), F.regexp_extract(hf, TYPE_RE, 1)).otherwise(F.lit("")))
    type_kw = F.col("type_kw")
    arrow_first = hf.contains("=>") & hf.rlike(r"(?s)^" + r"(?:(?!=>|(?<![=!<>])=(?![=>])).)*+=>")
    indexer = sig.contains("this") & sig.rlike(r"\bthis\s*\[")
    raw = (F.when((term == ";") & h.contains("using") & h.rlike(r"^(?:global\s+)?using\s"), F.lit("using"))
           .when(term.isin("{", ";") & h.startswith("namespace") & h.rlike(r"^(?U)namespace\s+[\w.@]+$"), F.lit("namespace"))
           .when(term.isin("{", ";") & (type_kw != ""), type_kw)
           .when((term == "}") | (term == "") | (h == "") | h.rlike(r"^[=).,\]?:&|+*/<>-]"), F.lit(None).cast("string"))
           .when(word("delegate"), F.lit("delegate"))
           .when(word("event"), F.lit("event"))
           .when(sig.contains("operator") & sig.rlike(r"\boperator\b"), F.lit("operator"))
           .when(indexer, F.lit("property"))
           .when(sig.endswith(FOLDED) & sig.rlike(called), F.lit("callable"))
           .when(F.col("is_expr") & arrow_first, F.lit("property"))
           .when((term == ";") | F.col("is_expr"), F.lit("field"))
           .when(term == "{", F.lit("property")))
    # a column of its own: the name asks for it five times
    s = s.withColumn("raw_kind", raw)
    raw = F.col("raw_kind")
    name = (F.when(raw == "using", F.regexp_extract(h, r"^(?U)(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.@]+)", 1))
            .when(raw == "namespace", F.regexp_extract(h, r"^(?U)namespace\s+([\w.@]+)", 1))
            .when(raw.isin(*TYPE_KINDS), F.regexp_extract(hf, TYPE_RE, 2))
            .when(raw == "callable", F.regexp_replace(F.regexp_extract(sig, called, 1), r"[\s@]", ""))
            .when(indexer, F.lit("this"))
            .when(raw.isin("field", "property"), F.regexp_extract(sig, r"(?U)(@?\w+)\s*$", 1)))
    return (s.withColumn("name", name)
             .withColumn("is_public", h.contains("public") & h.rlike(r"^(?:\w+\s+)*?public\b"))
             .withColumn("starts_eq", h.startswith("=")))


def declarations(files: DataFrame, keys: Sequence[str], content: str = "content",
                 with_text: bool = True) -> DataFrame:
    """``declarations`` rows (keys..., decl_id, kind, name, is_public,
    parent_id, parent_kind, parent_name, parent_pos, start_pos, end_pos,
    full_start, full_end, start_line, end_line[, full_text]).  Positions are
    0-based character offsets, ``end_pos``/``full_end`` exclusive; lines
    1-based.  Operators, delegates, events and indexers are not members here."""
    keys = list(keys)
    s = segments(files, keys, content)
    # mask + classify every segment once; only small columns travel on
    cls = _header(s).select(*keys, "idx", "depth", "term", "seg_start", "len", "nl_before", "nl", "next_tt", "tt",
                            "raw_kind", "name", "is_public", "lead_ws", "lead_nl", "is_expr", "starts_eq")
    role = lambda level, opens: F.struct(level.alias("level"), F.lit(opens).alias("is_opener"))
    roles = F.when(F.col("term") == "{", F.array(role(F.col("depth"), False), role(F.col("depth") + 1, True))) \
             .otherwise(F.array(role(F.col("depth"), False)))
    u = cls.withColumn("role", F.explode(roles)).select("*", "role.level", "role.is_opener").drop("role")
    w = Window.partitionBy(*keys, "level").orderBy("idx")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # what follows is what has passed in descending order: a frame to the end of the file is worked out anew for every row
    after = Window.partitionBy(*keys, "level").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    end = F.struct((F.col("seg_start") + F.col("len")).alias("pos"), (F.col("nl_before") + F.col("nl") + 1).alias("line"),
                   F.col("next_tt").alias("tt"))
    opener = F.struct("idx", "raw_kind", "name", (F.col("seg_start") + F.col("lead_ws")).alias("pos"))
    u = u.select(
        "*",
        F.last(F.when(F.col("is_opener"), opener), ignorenulls=True).over(before).alias("parent"),
        F.when(F.col("is_opener"), F.last(F.when(~F.col("is_opener") & (F.col("term") == "}"), end), ignorenulls=True).over(after)).alias("closer"),
        F.last(F.when(~F.col("is_opener") & (F.col("term") == ";"), end), ignorenulls=True).over(after).alias("semicolon"),
        F.coalesce(F.lead("starts_eq").over(w), F.lit(False)).alias("assigned"))
    u = u.withColumn("closer", F.max("closer").over(Window.partitionBy(*keys, "idx")))

    pk = F.col("parent.raw_kind")
    d = u.filter((~F.col("is_opener")) & F.col("raw_kind").isNotNull()
                 & (pk.isNull() | pk.isin("namespace", *MEMBER_PARENTS)))
    kind = (F.when(F.col("raw_kind").isin("using", "namespace") & (pk.isNull() | (pk == "namespace")), F.col("raw_kind"))
            .when(F.col("raw_kind").isin(*TYPE_KINDS), F.col("raw_kind"))
            .when(pk.isin(*MEMBER_PARENTS) & (F.col("raw_kind") == "callable"),
                  F.when(F.col("name") == F.ltrim(F.col("parent.name"), F.lit("@")), F.lit("constructor"))
                   .when(F.col("name").startswith("~"), F.lit("destructor"))
                   .otherwise(F.lit("method")))
            .when(pk.isin(*MEMBER_PARENTS) & F.col("raw_kind").isin("field", "property"), F.col("raw_kind")))
    d = d.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    # an initializer or expression body goes on to its semicolon
    d = d.withColumn("end", F.when(F.col("term") != "{", end).when(F.col("is_expr") | F.col("assigned"), F.col("semicolon"))
                             .otherwise(F.col("closer")))
    full_start = F.when(F.col("idx") == 0, F.lit(0)).otherwise(F.col("seg_start") + F.col("tt"))
    d = d.select(
        *keys, F.col("idx").alias("decl_id"), "kind", "name", "is_public",
        F.col("parent.idx").alias("parent_id"), pk.alias("parent_kind"), F.col("parent.name").alias("parent_name"),
        F.col("parent.pos").alias("parent_pos"),
        (F.col("seg_start") + F.col("lead_ws")).alias("start_pos"), F.col("end.pos").alias("end_pos"),
        full_start.alias("full_start"), (F.col("end.pos") + F.col("end.tt")).alias("full_end"),
        (F.col("nl_before") + F.col("lead_nl") + 1).cast("int").alias("start_line"),
        F.col("end.line").cast("int").alias("end_line"),
    )
    if not with_text:
        return d
    f = files.select(*keys, F.col(content).alias("_text"))
    return (d.join(f, keys)
             .withColumn("full_text", F.expr("substring(_text, full_start + 1, full_end - full_start)"))
             .drop("_text"))


# --------------------------------------------------------------------------- questions
def _per_file(files: DataFrame, keys: Sequence[str], agg: DataFrame, col_name: str, default) -> DataFrame:
    base = files.select(*keys)
    return base.join(agg, list(keys), "left").withColumn(col_name, F.coalesce(F.col(col_name), default))


def method_source(decls: DataFrame, files: DataFrame, keys: Sequence[str], method_name: str) -> DataFrame:
    """Full text of the first method named exactly ``method_name`` in
    any type; ``''`` when there is none."""
    m = decls.filter((F.col("kind") == "method") & (F.col("name") == method_name))
    a = m.groupBy(*keys).agg(F.min_by("full_text", "start_pos").alias("source"))
    return _per_file(files, keys, a, "source", F.lit(""))


def ordered_concat(text: str, pos: str) -> Column:
    """A3: texts in document order, each followed by a newline."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos), F.col(text)))),
                                    lambda x: F.concat(x[text], F.lit("\n"))), "")


def tests_for_method(decls: DataFrame, files: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """D3: every method whose name starts with ``prefix`` (ordinal), each
    followed by a newline, in document order; ``''`` when none."""
    m = decls.filter((F.col("kind") == "method") & F.col("name").startswith(prefix))
    a = m.groupBy(*keys).agg(ordered_concat("full_text", "start_pos").alias("tests"))
    return _per_file(files, keys, a, "tests", F.lit(""))


def public_methods(decls: DataFrame, files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Public methods declared directly in classes (nested classes are
    visited as classes of their own, outer class first); overloads repeat."""
    m = decls.filter((F.col("kind") == "method") & F.col("is_public") & (F.col("parent_kind") == "class"))
    a = m.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("parent_pos", "start_pos", "name"))),
                    lambda x: x["name"]).alias("public_methods"))
    return _per_file(files, keys, a, "public_methods", F.array().cast("array<string>"))


def any_between(ordered: Column, low: Column, high: Column) -> Column:
    """Whether an ascending array of numbers has one from ``low`` to ``high``:
    a binary search for the first that is not under ``low``."""
    n = F.size(ordered)
    halvings = F.sequence(F.lit(1), F.ceil(F.log2(n + 1)).cast("int") + 1)

    def step(s, _):
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        under = F.get(ordered, mid) < low
        done = s["lo"] >= s["hi"]
        return F.struct(F.when(~done & under, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(~done & ~under, mid).otherwise(s["hi"]).alias("hi"))

    first = F.aggregate(halvings, F.struct(F.lit(0).alias("lo"), n.alias("hi")), step, lambda s: s["lo"])
    return F.coalesce(F.get(ordered, first) <= high, F.lit(False))


def methods_around_lines(decls: DataFrame, changed: DataFrame, keys: Sequence[str],
                         lines_col: str = "changed_lines") -> DataFrame:
    """Methods (any type) whose line span holds at least one changed
    line.  A file's methods meet its changed lines (ascending) once, as arrays
    of one row, and each method is a binary search, so a file costs
    (methods + lines) x log(lines)."""
    keys = list(keys)
    cols = [c for c in decls.columns if c not in keys]
    methods = decls.filter(F.col("kind") == "method").groupBy(*keys).agg(F.collect_list(F.struct(*cols)).alias("_methods"))
    lines = changed.select(*keys, F.col(lines_col).alias("_changed")).where(F.size("_changed") > 0)
    hit = F.filter("_methods", lambda m: any_between(F.col("_changed"), m["start_line"], m["end_line"]))
    return methods.join(lines, keys).select(*keys, F.explode(hit).alias("_m")).select(*keys, "_m.*").select(*decls.columns)


def tests_of_methods(methods: DataFrame, test_decls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """D3 for many methods at once: (keys..., name, tests) for every distinct
    name of ``methods``, with all methods of ``test_decls`` (same keys, with
    full_text) whose name starts with it, in document order, each followed by
    a newline; '' when there is none.  An equi join on the prefixes of the
    test methods' names, of narrow rows; texts are joined at the end."""
    keys = list(keys)
    wanted = methods.select(*keys, "name").distinct()
    tests = test_decls.filter(F.col("kind") == "method")
    prefixes = F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda n: F.substring("name", F.lit(1), n)))
    found = tests.select(*keys, "decl_id", prefixes.alias("name")).join(wanted, [*keys, "name"])
    texts = found.join(tests.select(*keys, "decl_id", "start_pos", "full_text"), [*keys, "decl_id"])
    a = texts.groupBy(*keys, "name").agg(ordered_concat("full_text", "start_pos").alias("tests"))
    return wanted.join(a, [*keys, "name"], "left").withColumn("tests", F.coalesce("tests", F.lit("")))


def context_assembly(decls: DataFrame, files: DataFrame, methods: DataFrame, keys: Sequence[str],
                     content: str = "content") -> DataFrame:
    """Usings; blank line; ``// BEGIN CLASS {name}``; with a first class:
    ``public class {name} {``, its fields and constructors (nested ones
    included), the given methods, ``// END CLASS``, ``}``.  With no class
    the methods are dropped.

    Declarations travel as positions; all parts of a file are gathered by one
    grouped pass, and the texts are cut from the file in one join at the end."""
    keys = list(keys)
    first = decls.filter(F.col("kind") == "class").groupBy(*keys).agg(
        F.min_by(F.struct("name", "start_pos", "end_pos"), F.col("start_pos")).alias("cls"))
    own = [F.col("kind").alias("part"), "start_pos", "full_start", "full_end"]
    inner = (decls.filter(F.col("kind").isin("field", "constructor")).join(first, keys)
             .filter((F.col("start_pos") >= F.col("cls.start_pos")) & (F.col("end_pos") <= F.col("cls.end_pos"))).select(*keys, *own))
    rest = decls.filter(F.col("kind") == "using").unionByName(methods).select(*keys, *own)
    parts = (rest.unionByName(inner).groupBy(*keys)
             .agg(F.array_sort(F.collect_list(F.struct("start_pos", "part", "full_start", "full_end"))).alias("p")))

    def cat(part: str) -> Column:
        chosen = F.filter(F.coalesce(F.col("p"), F.array()), lambda x: x["part"] == part)
        return F.array_join(F.transform(chosen, lambda x: F.concat(
            F.substring("_text", x["full_start"].cast("int") + 1, (x["full_end"] - x["full_start"]).cast("int")), F.lit("\n"))), "")

    out = files.select(*keys, F.col(content).alias("_text")).join(parts, keys, "left").join(first, keys, "left")
    cls_part = F.when(F.col("cls").isNotNull(), F.concat(
        F.lit("public class "), F.col("cls.name"), F.lit(" {\n"), cat("field"), cat("constructor"), cat("method"),
        F.lit("// END CLASS\n}\n"))).otherwise(F.lit(""))
    text = F.concat(cat("using"), F.lit("\n// BEGIN CLASS "), F.coalesce(F.col("cls.name"), F.lit("")), F.lit("\n"),
                    cls_part)
    return out.select(*keys, text.alias("context"))


# Messages of the parser factory.
def parser_for(ext: str):
    """The declaration scan for a file extension.  Only C# has one;
    the other recognised languages raise like the source tool's stubs, and
    unknown extensions are not supported."""
    route = PARSER_EXTENSIONS.get(ext.lower(), "unsupported")
    if route == "supported":
        return declarations
    if route == "not_implemented":
        raise NotImplementedError(f"{ext} parsing is not implemented yet.")
    raise ValueError(f"Parser for files with '{ext}' extension not supported.")


def language_route(ext_col) -> Column:
    """Parser routing by lower-cased extension."""
    e = F.lower(ext_col)
    expr = F.lit("unsupported")
    for ext, route in reversed(list(PARSER_EXTENSIONS.items())):
        expr = F.when(e == ext, F.lit(route)).otherwise(expr)
    return expr
