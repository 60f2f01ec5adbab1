"""Oracle SQL (DuckDB dialect) for the registered queries.

Each statement recomputes a query's result from the raw driver tables with
plain SQL windows, joins and list functions, so the Spark plans (bucketed
neighbour plans, partial aggregates, the declaration scan) are checked
against a straightforward formulation.  Column names and types match the
Spark output.
"""

from __future__ import annotations

NL = "chr(10)"

# lines 26+n .. 40+n of every 5th code file
EXTRA = """#region Extra {
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

# code file rendering: the same rule as tidemark.sources.corpus.code_template
CODE_TEMPLATE = """(
  'using System;
using System.Collections.Generic;

namespace Corpus.' || source || '
{
    /// <summary>Document ' || CAST(doc_id AS VARCHAR) || ' (' || lang || ')</summary>
    public class Doc' || CAST(doc_id AS VARCHAR) || '
    {
        private readonly List<string> _log = new List<string>();
        private int _size = ' || CAST(n_chars AS VARCHAR) || ';
        ' || CASE WHEN doc_id % 13 = 0 THEN 'public interface IShape { int Area(); }'
                  ELSE 'public struct Shape { public int Area() { return 1; } }' END || '
        public class Inner { ' || CASE WHEN doc_id % 11 = 0 THEN 'private' ELSE 'public' END || ' void Ping() { } }

        public Doc' || CAST(doc_id AS VARCHAR) || '(int size) { _size = size; }

        ' || CASE WHEN doc_id % 11 = 0 THEN 'internal' ELSE 'public' END || ' int Size() { return _size; }

        [Obsolete("use Size")]
        ' || CASE WHEN doc_id % 11 = 0 THEN 'internal' ELSE 'public' END || ' string Lang() => "' || lang || '";

        private void Load()
        {
' || array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)),
        lambda l: '            _log.Add("' || replace(replace(l, '\\', '\\\\'), '"', '\\"') || '");
'), '') || '        }

        protected bool Check(string s) { return s == "}"; }
' || CASE WHEN doc_id % 5 = 0 THEN replace('""" + EXTRA + """', '@', 'Doc' || CAST(doc_id AS VARCHAR)) ELSE '' END || '    }
}
')"""

CODE_FILE_PATH = "('src/' || source || '/' || CASE WHEN source LIKE '%7' THEN 'Program.cs' ELSE 'Service.cs' END)"

CODE_VERSIONS = f"""(SELECT {CODE_FILE_PATH} AS file_path, doc_id AS version, {CODE_TEMPLATE} AS content,
        doc_id, source, lang, n_chars, text FROM documents)"""


def lines(expr: str) -> str:
    return f"string_split(coalesce({expr}, ''), {NL})"


def effective_loc(expr: str) -> str:
    return (f"CAST(len(list_filter({lines(expr)}, lambda l: regexp_matches(l, '\\S') "
            f"AND NOT regexp_matches(l, '^\\s*//'))) AS INTEGER)")


def changed_lines(old: str, new: str) -> str:
    return (f"CAST(list_filter(range(1, len({lines(new)}) + 1), lambda i: i > len({lines(old)}) "
            f"OR {lines(old)}[i] IS DISTINCT FROM {lines(new)}[i]) AS INTEGER[])")


def not_blank(expr: str) -> str:
    return f"({expr} IS NOT NULL AND regexp_matches({expr}, '\\S'))"


def prev_content(content: str, key: str, order: str) -> str:
    return (f"CASE WHEN lag({order}) OVER (PARTITION BY {key} ORDER BY {order}) IS NULL THEN '' "
            f"ELSE coalesce(lag({content}) OVER (PARTITION BY {key} ORDER BY {order}), '') END")


DOC_VERSIONS = f"""(SELECT source AS path, doc_id AS version, text AS content,
        {prev_content('text', 'source', 'doc_id')} AS old_content FROM documents)"""

CODE_WITH_PREV = f"""(SELECT c.*, {prev_content('content', 'file_path', 'version')} AS old_content
        FROM {CODE_VERSIONS} c)"""

FILE_EVENTS = """(SELECT 'u' || CAST(user_id AS VARCHAR) AS path, ts, event_id,
        CASE WHEN event_type = 'signup' THEN 'rename' ELSE 'change' END AS event_type,
        props AS content FROM events)"""

COMMIT_POLLS = """(SELECT 'r' || CAST(o.o_custkey AS VARCHAR) AS repo, l.l_shipdate AS poll_ts,
        l.l_orderkey AS poll_order, l.l_linenumber AS poll_line, 'c' || CAST(l.l_orderkey AS VARCHAR) AS sha
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""

SQL: dict[str, str] = {}

SQL["change_summary"] = f"""
WITH v AS (SELECT path, version, content, old_content FROM {DOC_VERSIONS})
SELECT path, count(*) AS n_versions,
       CAST(sum(len({changed_lines('old_content', 'content')})) AS BIGINT) AS changed_lines,
       CAST(sum(CASE WHEN {effective_loc('content')} > 20 AND {not_blank('old_content')}
                      AND {not_blank('content')} THEN 1 ELSE 0 END) AS BIGINT) AS large_changes,
       max({effective_loc('content')}) AS max_effective_loc
FROM v GROUP BY path"""

SQL["previous_version"] = f"SELECT path, version, old_content FROM {DOC_VERSIONS}"

SQL["changed_lines"] = f"""SELECT path, version, {changed_lines('old_content', 'content')} AS changed_lines
FROM {DOC_VERSIONS}"""

SQL["changed_lines_long"] = SQL["changed_lines"]
SQL["effective_loc"] = f"SELECT file_path, version, {effective_loc('content')} AS effective_loc FROM {CODE_VERSIONS}"

SQL["large_file_split"] = f"""SELECT file_path, version, {effective_loc('content')} AS effective_loc,
  ({effective_loc('content')} > 60 AND {not_blank('old_content')} AND {not_blank('content')}) AS is_large
FROM {CODE_WITH_PREV}"""

SQL["debounce_batch"] = f"""
SELECT path, ts, event_id, event_type, ts + INTERVAL 3600 SECOND AS fire_ts FROM (
  SELECT *, lead(ts) OVER (PARTITION BY path ORDER BY ts, event_id) AS nxt FROM {FILE_EVENTS})
WHERE nxt IS NULL OR nxt > ts + INTERVAL 3600 SECOND"""

SQL["commit_cursor"] = f"""
SELECT repo, poll_ts, poll_order, poll_line, sha FROM (
  SELECT *, lag(sha) OVER (PARTITION BY repo ORDER BY poll_ts, poll_order, poll_line) AS last_sha
  FROM {COMMIT_POLLS}) WHERE last_sha IS DISTINCT FROM sha"""

SQL["head_commit"] = """
SELECT repo, branch, sha, committed_at FROM (
  SELECT 'r' || CAST(o_custkey AS VARCHAR) AS repo, 'main' AS branch, 'c' || CAST(o_orderkey AS VARCHAR) AS sha,
         o_orderdate AS committed_at,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders) WHERE rn = 1"""

# --------------------------------------------------------------------------- filters, paths, commits
BASENAME = "regexp_extract({0}, '([^/\\\\]*)$', 1)"
SKIP_LOWER = "('program.cs', 'startup.cs', 'assemblyinfo.cs', 'globalusings.cs', 'usings.cs')"

COMMIT_FILES = """(SELECT x.repo, x.sha, x.file_path, x.status, x.additions, x.deletions, x.l_partkey, x.l_linenumber
 FROM (SELECT y.*, row_number() OVER (PARTITION BY y.repo, y.sha, y.file_path ORDER BY y.l_linenumber DESC, y.l_partkey DESC,
   y.l_suppkey DESC, y.l_quantity DESC, y.l_extendedprice DESC, y.l_returnflag DESC) AS rn
 FROM (SELECT 'r' || CAST(o.o_custkey AS VARCHAR) AS repo, 'c' || CAST(l.l_orderkey AS VARCHAR) AS sha,
  CASE WHEN l_linenumber = 4 THEN 'src/m' || CAST(l_partkey % 40 AS VARCHAR) || '/Part' || CAST(l_partkey AS VARCHAR) || '.CS'
       WHEN l_linenumber = 5 THEN 'src/m' || CAST(l_partkey % 40 AS VARCHAR) || '/Part' || CAST(l_partkey AS VARCHAR) || '.txt'
       WHEN l_linenumber = 6 THEN 'tests/m' || CAST(l_partkey % 40 AS VARCHAR) || '/Part' || CAST(l_partkey AS VARCHAR) || 'Tests.cs'
       WHEN l_linenumber = 7 THEN 'src/m' || CAST(l_partkey % 40 AS VARCHAR) || '/Program.cs'
       ELSE 'src/m' || CAST(l_partkey % 40 AS VARCHAR) || '/Part' || CAST(l_partkey AS VARCHAR) || '.cs' END AS file_path,
  CASE WHEN l_returnflag = 'R' THEN 'removed' WHEN l_returnflag = 'A' THEN 'added' ELSE 'modified' END AS status,
  CAST(trunc(l_quantity) AS INTEGER) AS additions, l_linenumber AS deletions, l_partkey, l_linenumber,
  l_suppkey, l_quantity, l_extendedprice, l_returnflag
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey) y) x WHERE x.rn = 1)"""

SOURCE_CHANGES = f"""(SELECT * FROM {COMMIT_FILES} cf
  WHERE file_path IS NOT NULL AND regexp_matches(file_path, '\\S') AND lower(file_path) LIKE '%.cs'
    AND NOT contains(file_path, 'tests') AND lower({BASENAME.format('file_path')}) NOT IN {SKIP_LOWER})"""

BLOBS = f"""(SELECT cf.repo, cf.sha, cf.file_path, {CODE_TEMPLATE} AS content
   FROM {COMMIT_FILES} cf JOIN documents d ON cf.l_partkey % (SELECT max(doc_id) + 1 FROM documents) = d.doc_id
   WHERE cf.status <> 'removed')"""

COMMITS = """(SELECT repo, sha, committed_at, commit_key,
   lag(sha) OVER (PARTITION BY repo ORDER BY committed_at, commit_key) AS parent_sha FROM (
   SELECT 'r' || CAST(o_custkey AS VARCHAR) AS repo, o_orderkey AS commit_key, 'c' || CAST(o_orderkey AS VARCHAR) AS sha,
          o_orderdate AS committed_at FROM orders))"""


def segs(x: str) -> str:
    return f"list_filter(string_split({x}, '/'), lambda s: s <> '' AND s <> '.')"


def relative_path(rt: str, p: str) -> str:
    r, q = segs(rt), segs(p)
    common = (f"(CASE WHEN least(len({r}), len({q})) = 0 THEN 0 ELSE len(list_filter(range(1, least(len({r}), len({q})) + 1), "
              f"lambda i: {r}[1:i] = {q}[1:i])) END)")
    joined = (f"array_to_string(list_concat(list_transform(range(len({r}) - {common}), lambda x: '..'), "
              f"{q}[{common} + 1:len({q})]), '/')")
    return f"(CASE WHEN {joined} = '' THEN '.' ELSE {joined} END)"


def combine(*parts: str) -> str:
    return "concat_ws('/', " + ", ".join(f"nullif(regexp_replace({p}, '/+$', ''), '')" for p in parts) + ")"


def stem(x: str) -> str:
    return f"regexp_extract({BASENAME.format(x)}, '^(.*?)(\\.[^.]*)?$', 1)"


def extension(x: str) -> str:
    return f"regexp_extract({BASENAME.format(x)}, '(\\.[^.]+)$', 1)"


def directory_name(x: str) -> str:
    return f"regexp_extract({x}, '^(.*)/[^/]*$', 1)"


def test_path(fp: str, src: str, tests: str, project: str | None = None) -> str:
    if project is not None:
        src, tests = combine(project, src), combine(project, tests)
    rel = relative_path(src, fp)
    return combine(tests, directory_name(rel), f"{stem(rel)} || 'Tests' || {extension(rel)}")


SQL["skip_list_anti"] = f"""SELECT repo, sha, file_path, l_linenumber FROM {COMMIT_FILES}
WHERE lower({BASENAME.format('file_path')}) NOT IN {SKIP_LOWER}"""

SQL["extension_filter"] = f"SELECT repo, sha, file_path, l_linenumber FROM {COMMIT_FILES} WHERE lower(file_path) LIKE '%.cs'"

SQL["changed_source_files"] = f"SELECT repo, sha, file_path, status, additions, deletions FROM {SOURCE_CHANGES}"

SQL["interface_filter"] = f"SELECT file_path, version, contains(content, 'interface') AS is_interface FROM {CODE_VERSIONS}"

SQL["commit_has_source_change"] = f"""SELECT repo, sha, bool_or(lower(file_path) LIKE '%.cs') AS has_source_change
FROM {COMMIT_FILES} GROUP BY repo, sha"""

SQL["approval_gate"] = f"""SELECT c.file_path, c.version, CASE WHEN l.quality = 1 THEN 'Yes' ELSE 'n' END AS answer,
  coalesce(lower(CASE WHEN l.quality = 1 THEN 'Yes' ELSE 'n' END) IN ('y', 'yes'), false) AS applied
FROM {CODE_VERSIONS} c JOIN labels l ON c.version = l.doc_id"""

SQL["test_path_mapping"] = f"""SELECT repo, sha, file_path, l_linenumber,
  {test_path('file_path', "'src'", "'tests'")} AS test_path,
  {test_path("'proj/' || repo || '/' || file_path", "'src'", "'tests'", "'proj/' || repo")} AS auto_test_path
FROM {COMMIT_FILES}"""

SQL["staging_paths"] = f"""SELECT repo, sha, file_path, test_path,
  {combine("'staging'", f"{stem('test_path')} || '_temp' || {extension('test_path')}")} AS staging_path
FROM (SELECT *, {test_path('file_path', "'src'", "'tests'")} AS test_path FROM {SOURCE_CHANGES})"""

URL_SEGS = "string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/')"
SQL["repo_from_url"] = f"""SELECT page_id,
  CASE WHEN len({URL_SEGS}) >= 3 THEN {URL_SEGS}[2] END AS owner,
  CASE WHEN len({URL_SEGS}) >= 3 THEN replace({URL_SEGS}[3], '.git', '') END AS repo,
  CASE WHEN len({URL_SEGS}) < 3 THEN 'Invalid GitHub repository URL.' END AS error
FROM pages"""

SQL["classify_location"] = f"""
WITH inputs AS (
  SELECT 'url' AS kind, page_id AS id, url AS location FROM pages
  UNION ALL SELECT 'folder', doc_id, 'src/' || source FROM documents
  UNION ALL SELECT 'name', doc_id, 'docs/' || lang FROM documents),
listing AS (SELECT DISTINCT {directory_name('file_path')} AS location FROM {CODE_VERSIONS})
SELECT i.kind, i.id, i.location,
  CASE WHEN l.location IS NOT NULL THEN 'local'
       WHEN lower(i.location) LIKE 'http://%' OR lower(i.location) LIKE 'https://%' THEN 'remote'
       ELSE 'invalid' END AS location_class
FROM inputs i LEFT JOIN listing l ON i.location = l.location"""

SQL["skip_list_distinct"] = f"SELECT DISTINCT lower({BASENAME.format('file_path')}) AS name FROM {COMMIT_FILES}"

SQL["commit_file_changes"] = f"""
WITH heads AS (SELECT repo, sha FROM (
  SELECT 'r' || CAST(o_custkey AS VARCHAR) AS repo, 'c' || CAST(o_orderkey AS VARCHAR) AS sha,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders) WHERE rn = 1)
SELECT f.repo, f.sha, f.file_path, f.status, f.additions, f.deletions
FROM {COMMIT_FILES} f JOIN heads h ON f.repo = h.repo AND f.sha = h.sha"""

BEFORE_AFTER = f"""(SELECT f.repo, f.sha, f.file_path, c.parent_sha,
   coalesce(bo.content, '') AS old_content, coalesce(bn.content, '') AS new_content
 FROM {SOURCE_CHANGES} f
 LEFT JOIN {COMMITS} c ON f.repo = c.repo AND f.sha = c.sha
 LEFT JOIN {BLOBS} bo ON bo.repo = f.repo AND bo.sha = c.parent_sha AND bo.file_path = f.file_path
 LEFT JOIN {BLOBS} bn ON bn.repo = f.repo AND bn.sha = f.sha AND bn.file_path = f.file_path)"""

SQL["content_before_after"] = f"""SELECT repo, sha, file_path, parent_sha, md5(old_content) AS old_md5,
  md5(new_content) AS new_md5, CAST(length(old_content) AS INTEGER) AS old_len, CAST(length(new_content) AS INTEGER) AS new_len
FROM {BEFORE_AFTER}"""

SQL["blank_coalesce"] = f"""SELECT repo, sha, file_path,
  md5(CASE WHEN {not_blank('new_content')} THEN new_content ELSE old_content END) AS source_md5
FROM {BEFORE_AFTER}"""

SQL["existing_test_lookup"] = f"""SELECT f.repo, f.sha, f.file_path, f.test_path, md5(coalesce(b.content, '')) AS test_md5
FROM (SELECT *, {test_path('file_path', "'src'", "'tests'")} AS test_path FROM {SOURCE_CHANGES}) f
LEFT JOIN {BLOBS} b ON b.repo = f.repo AND b.sha = f.sha AND b.file_path = f.test_path"""

COMPLETION_TEXT = """(CASE (conv_id + turn) % 5
  WHEN 0 THEN 'Here is the code:
```csharp
' || text || '
```
Done.'
  WHEN 1 THEN '<think>' || text || '</think>
```
' || text || '
```'
  WHEN 2 THEN text
  WHEN 3 THEN '   '
  ELSE '<think>plan</think>  ' || text || '  ' END)"""

ANSWERS = f"(SELECT conv_id, turn, {COMPLETION_TEXT} AS answer FROM conversations WHERE role = 'assistant')"


def utrim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def strip_think(x: str) -> str:
    return utrim(f"regexp_replace({x}, '(?s)<think>.*?</think>', '', 'g')")


FENCE = "'(?s)```(?:\\w+)?\\s*(.*?)```'"


def extract_code(x: str) -> str:
    s = strip_think(x)
    return (f"(CASE WHEN {x} IS NULL OR NOT regexp_matches({x}, '\\S') THEN '' "
            f"WHEN regexp_matches({s}, {FENCE}) THEN {utrim(f'regexp_extract({s}, {FENCE}, 1)')} "
            f"ELSE {utrim(s)} END)")


SQL["strip_think"] = f"SELECT conv_id, turn, {strip_think('answer')} AS stripped FROM {ANSWERS}"
SQL["extract_code_block"] = f"SELECT conv_id, turn, {extract_code('answer')} AS code FROM {ANSWERS}"

# --------------------------------------------------------------------------- declarations (by construction)
# The corpus template fixes where every declaration is; these statements
# state the expected index from the template's layout, independently of the
# scan that has to find it.
CODE_BASE = f"""(SELECT {CODE_FILE_PATH} AS file_path, doc_id AS version, doc_id, source, lang, text,
   CAST(len(string_split(coalesce(text, ''), chr(10))) AS INTEGER) AS n,
   CASE WHEN doc_id % 11 = 0 THEN 'internal' ELSE 'public' END AS vis,
   CASE WHEN doc_id % 11 = 0 THEN 'private' ELSE 'public' END AS ping,
   CASE WHEN doc_id % 5 = 0 THEN 15 ELSE 0 END AS ex
 FROM documents)"""

DECL_ROWS = [
    ("1", "'using'", "'System'", "false", "NULL", "1", "1"),
    ("2", "'using'", "'System.Collections.Generic'", "false", "NULL", "2", "2"),
    ("3", "'namespace'", "'Corpus.' || source", "false", "NULL", "4", "27 + n + ex"),
    ("4", "'class'", "'Doc' || CAST(doc_id AS VARCHAR)", "true", "'namespace'", "7", "26 + n + ex"),
    ("5", "'field'", "'_log'", "false", "'class'", "9", "9"),
    ("6", "'field'", "'_size'", "false", "'class'", "10", "10"),
    ("7", "CASE WHEN doc_id % 13 = 0 THEN 'interface' ELSE 'struct' END",
     "CASE WHEN doc_id % 13 = 0 THEN 'IShape' ELSE 'Shape' END", "true", "'class'", "11", "11"),
    ("8", "'method'", "'Area'", "doc_id % 13 <> 0", "CASE WHEN doc_id % 13 = 0 THEN 'interface' ELSE 'struct' END",
     "11", "11"),
    ("9", "'class'", "'Inner'", "true", "'class'", "12", "12"),
    ("10", "'method'", "'Ping'", "doc_id % 11 <> 0", "'class'", "12", "12"),
    ("11", "'constructor'", "'Doc' || CAST(doc_id AS VARCHAR)", "true", "'class'", "14", "14"),
    ("12", "'method'", "'Size'", "doc_id % 11 <> 0", "'class'", "16", "16"),
    ("13", "'method'", "'Lang'", "doc_id % 11 <> 0", "'class'", "18", "19"),
    ("14", "'method'", "'Load'", "false", "'class'", "21", "23 + n"),
    ("15", "'method'", "'Check'", "false", "'class'", "25 + n", "25 + n"),
]
EXTRA_ROWS = [
    ("16", "'method'", "'Pair'", "true", "'class'", "27 + n", "27 + n"),
    ("17", "'property'", "'Name'", "true", "'class'", "32 + n", "32 + n"),
    ("18", "'field'", "'_seq'", "false", "'class'", "33 + n", "33 + n"),
    ("19", "'method'", "'Real'", "true", "'class'", "37 + n", "39 + n"),
    ("20", "'record'", "'Point'", "true", "'class'", "40 + n", "40 + n"),
    ("21", "'method'", "'Twice'", "true", "'record'", "40 + n", "40 + n"),
]

SQL["declaration_index"] = "\nUNION ALL\n".join(
    f"SELECT file_path, version, CAST({no} AS INTEGER) AS decl_no, {kind} AS kind, {name} AS name, "
    f"{pub} AS is_public, CAST({pk} AS VARCHAR) AS parent_kind, CAST({sl} AS INTEGER) AS start_line, "
    f"CAST({el} AS INTEGER) AS end_line FROM {CODE_BASE} WHERE {where}"
    for where, rows in (("true", DECL_ROWS), ("ex > 0", EXTRA_ROWS)) for no, kind, name, pub, pk, sl, el in rows)

LOAD_BODY = """array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)),
        lambda l: '            _log.Add("' || replace(replace(l, '\\', '\\\\'), '"', '\\"') || '");
'), '')"""
LOAD_TEXT = f"""('
        private void Load()
        {{
' || {LOAD_BODY} || '        }}
')"""
LANG_TEXT = """('
        [Obsolete("use Size")]
        ' || vis || ' string Lang() => "' || lang || '";
')"""
SIZE_TEXT = """('
        ' || vis || ' int Size() { return _size; }
')"""
CHECK_TEXT = """('
        protected bool Check(string s) { return s == "}"; }
')"""
AREA_TEXT = "(CASE WHEN doc_id % 13 = 0 THEN 'int Area(); ' ELSE 'public int Area() { return 1; } ' END)"
PING_TEXT = "(ping || ' void Ping() { } ')"

SQL["method_source"] = f"SELECT file_path, version, {LOAD_TEXT} AS source FROM {CODE_BASE}"
SQL["tests_for_method"] = f"""SELECT file_path, version, {LANG_TEXT} || '
' || {LOAD_TEXT} || '
' AS tests FROM {CODE_BASE}"""
SQL["public_methods"] = f"""SELECT file_path, version,
  CAST(CASE WHEN doc_id % 11 = 0 THEN [] ELSE ['Size', 'Lang'] END || CASE WHEN ex > 0 THEN ['Pair', 'Real'] ELSE [] END
    || CASE WHEN doc_id % 11 = 0 THEN [] ELSE ['Ping'] END AS VARCHAR[]) AS public_methods
FROM {CODE_BASE}"""



def extra_lines(first: int, end: int) -> str:
    return "'" + "".join(EXTRA.splitlines(keepends=True)[first:end]) + "'"


SEQ_TEXT = f"CASE WHEN doc_id % 5 = 0 THEN {extra_lines(7, 8)} || chr(10) ELSE '' END"

METHOD_SPANS = f"""[{{'name': 'Area', 's': 11, 'e': 11, 'txt': {AREA_TEXT}}},
  {{'name': 'Ping', 's': 12, 'e': 12, 'txt': {PING_TEXT}}},
  {{'name': 'Size', 's': 16, 'e': 16, 'txt': {SIZE_TEXT}}},
  {{'name': 'Lang', 's': 18, 'e': 19, 'txt': {LANG_TEXT}}},
  {{'name': 'Load', 's': 21, 'e': 23 + n, 'txt': {LOAD_TEXT}}},
  {{'name': 'Check', 's': 25 + n, 'e': 25 + n, 'txt': {CHECK_TEXT}}}] || CASE WHEN doc_id % 5 = 0 THEN [
  {{'name': 'Pair', 's': 27 + n, 'e': 27 + n, 'txt': {extra_lines(0, 2)}}},
  {{'name': 'Real', 's': 37 + n, 'e': 39 + n, 'txt': {extra_lines(8, 14)}}},
  {{'name': 'Twice', 's': 40 + n, 'e': 40 + n, 'txt': 'public int Twice() => X * 2; '}}] ELSE [] END"""

AFFECTED = f"""(SELECT file_path, version, doc_id, n, lang, vis, ping, text,
   list_filter({METHOD_SPANS}, lambda m: len(list_filter(ch, lambda l: l BETWEEN m.s AND m.e)) > 0) AS hits
 FROM (SELECT b.*, {changed_lines('p.old_content', 'p.content')} AS ch
       FROM {CODE_BASE} b JOIN {CODE_WITH_PREV} p ON b.file_path = p.file_path AND b.version = p.version))"""

SQL["methods_around_lines"] = f"""SELECT file_path, version, h.name AS name, CAST(h.s AS INTEGER) AS start_line,
  CAST(h.e AS INTEGER) AS end_line FROM (SELECT file_path, version, unnest(hits) AS h FROM {AFFECTED})"""

SQL["affected_methods"] = f"""SELECT file_path, version, CAST(list_transform(hits, lambda m: m.name) AS VARCHAR[]) AS methods
FROM {AFFECTED}"""

# the old version's methods, of which a name begins with an affected method's
SQL["tests_of_affected_methods"] = f"""
WITH m AS (SELECT file_path, version, {METHOD_SPANS} AS methods FROM {CODE_BASE}),
p AS (SELECT m.file_path, m.version, o.methods FROM (SELECT file_path, version, lag(version) OVER (PARTITION BY file_path ORDER BY version) AS before FROM m) m
      LEFT JOIN m o ON o.file_path = m.file_path AND o.version = m.before),
a AS (SELECT file_path, version, unnest(list_distinct(list_transform(hits, lambda h: h.name))) AS name FROM {AFFECTED}),
t AS (SELECT a.file_path, a.version, a.name, array_to_string(list_transform(list_filter(coalesce(p.methods, []),
        lambda h: starts_with(h.name, a.name)), lambda h: h.txt || chr(10)), '') AS tests
      FROM a JOIN p ON a.file_path = p.file_path AND a.version = p.version)
SELECT file_path, version, name, md5(tests) AS tests_md5, CAST(length(tests) AS INTEGER) AS tests_len FROM t"""

SQL["context_assembly"] = f"""SELECT file_path, version, 'using System;

using System.Collections.Generic;


// BEGIN CLASS Doc' || CAST(doc_id AS VARCHAR) || '
public class Doc' || CAST(doc_id AS VARCHAR) || ' {{
        private readonly List<string> _log = new List<string>();

        private int _size = ' || CAST(d.n_chars AS VARCHAR) || ';

' || {SEQ_TEXT} || '
        public Doc' || CAST(doc_id AS VARCHAR) || '(int size) {{ _size = size; }}

' || array_to_string(list_transform(hits, lambda m: m.txt || chr(10)), '') || '// END CLASS
}}
' AS context FROM {AFFECTED} JOIN (SELECT doc_id AS did, n_chars FROM documents) d ON d.did = doc_id"""

SQL["language_routing"] = f"""SELECT repo, sha, file_path, {extension('file_path')} AS extension,
  CASE lower({extension('file_path')}) WHEN '.cs' THEN 'supported'
       WHEN '.java' THEN 'not_implemented' WHEN '.py' THEN 'not_implemented'
       WHEN '.ts' THEN 'not_implemented' WHEN '.js' THEN 'not_implemented' ELSE 'unsupported' END AS route
FROM {COMMIT_FILES}"""

# --------------------------------------------------------------------------- completions
# Fixed value: the prompt of the source tool.
DEFAULT_PROMPT_SQL = ("'Generate xUnit tests for the following code with 100% code coverage. The tests should follow "
                      "the naming convention: MethodName_WhenCondition_ReturnsExpectedResult. Only generate tests for "
                      "public methods and constructors. Do not create tests for interfaces or private methods. If "
                      "existing tests are provided, update only the tests related to the method.'")


def prompt_sql(code: str, tests: str) -> str:
    return (f"({DEFAULT_PROMPT_SQL} || '\n\nMethod Code:\n' || coalesce({code}, '') || '\n\nExisting Tests:\n' "
            f"|| coalesce({tests}, '') || '\n\nProvide the complete updated test file content as output.')")


SAMPLE_PROMPT = f"""(CASE WHEN sample IS NULL THEN {prompt_sql("''", "''")} ELSE replace({prompt_sql("''", "''")}, '\n\nMethod Code:',
  '\n\nUse the following sample unit test as a reference for the structure and style:\n' || sample || '\n\nMethod Code:') END)"""

PROJECTS = """(SELECT 'r' || c_custkey AS repo, '' AS project_path, 'src' AS src_folder, 'tests' AS tests_folder, CAST(NULL AS VARCHAR) AS sample,
   CASE c_custkey % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'ollama' ELSE 'azure' END AS provider, false AS background FROM customer
 UNION ALL SELECT 'r' || c_custkey, 'src/m' || m, '', 'unit', '// sample of m' || m, CASE m % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'ollama' ELSE 'azure' END, true
 FROM customer, (SELECT unnest(range(40)) AS m) WHERE c_custkey % 2 = 0 AND (c_custkey + m) % 4 = 0)"""

SQL["project_change_rows"] = f"""SELECT repo, sha, file_path, project_path, src_folder, tests_folder,
  {test_path('file_path', 'src_folder', 'tests_folder', 'project_path')} AS test_path, provider, background, md5({SAMPLE_PROMPT}) AS prompt_md5
FROM (SELECT f.repo, f.sha, f.file_path, p.* EXCLUDE (repo),
        row_number() OVER (PARTITION BY f.repo, f.sha, f.file_path ORDER BY length(p.project_path) DESC) AS rn
      FROM {SOURCE_CHANGES} f LEFT JOIN {PROJECTS} p ON p.repo = f.repo AND (p.project_path = '' OR starts_with(f.file_path, p.project_path || '/')))
WHERE rn = 1"""


def request_id(number: str) -> str:
    return f"(CAST({number} % ((SELECT max(conv_id) + 1 FROM conversations) * 11 // 10 + 1) AS VARCHAR) || ':1')"


CODE_REQUESTS = f"""(SELECT file_path, version, {request_id('version')} AS request_id,
   {prompt_sql('content', "''")} AS prompt FROM {CODE_VERSIONS})"""

REPLAY = f"""(SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS request_id,
   CASE conv_id % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'ollama' ELSE 'azure' END AS provider,
   CASE WHEN conv_id % 17 = 5 THEN 400 ELSE 200 END AS http_status,
   CASE conv_id % 3
     WHEN 0 THEN CASE WHEN conv_id % 19 = 7 THEN '{{"choices":[]}}' ELSE to_json({{'choices': [{{'text': {COMPLETION_TEXT}}}]}}) END
     WHEN 1 THEN to_json({{'response': {COMPLETION_TEXT}}})
     ELSE to_json({{'content': [{{'type': 'text', 'text': {COMPLETION_TEXT}}}]}}) END AS body
 FROM conversations WHERE role = 'assistant')"""


def has_key(j: str, k: str) -> str:
    return f"coalesce(list_contains(json_keys({j}), '{k}'), false)"


PARSE_ERR = f"""(CASE WHEN http_status NOT BETWEEN 200 AND 299 THEN
    CASE WHEN provider = 'azure' THEN 'chat request failed with status ' || CAST(http_status AS VARCHAR) END
  WHEN provider = 'ollama' THEN CASE WHEN NOT {has_key('body', 'response')} THEN 'missing property: response' END
  WHEN provider = 'azure' THEN CASE WHEN NOT {has_key("json_extract(body, '$.content[0]')", 'text')}
                                    THEN 'missing property: content[0].text' END
  ELSE CASE WHEN NOT {has_key('body', 'choices')} THEN 'missing property: choices'
            WHEN json_array_length(body, '$.choices') > 0 AND NOT {has_key("json_extract(body, '$.choices[0]')", 'text')}
            THEN 'missing property: text' END END)"""

PARSE_TXT = f"""(CASE WHEN {PARSE_ERR} IS NOT NULL THEN NULL
  WHEN http_status NOT BETWEEN 200 AND 299 THEN ''
  WHEN provider = 'ollama' THEN coalesce(json_extract_string(body, '$.response'), '')
  WHEN provider = 'azure' THEN coalesce(json_extract_string(body, '$.content[0].text'), '')
  ELSE CASE WHEN coalesce(json_array_length(body, '$.choices'), 0) = 0 THEN ''
            ELSE coalesce(json_extract_string(body, '$.choices[0].text'), '') END END)"""

PARSED_REPLAY = f"""(SELECT request_id, provider, http_status, body, {PARSE_TXT} AS txt, {PARSE_ERR} AS err
 FROM {REPLAY})"""

SQL["build_prompt"] = f"""SELECT file_path, version, md5(prompt) AS prompt_md5, CAST(length(prompt) AS INTEGER) AS prompt_len
FROM {CODE_REQUESTS}"""

SQL["logged_completion"] = f"""SELECT file_path, version, md5(prompt) AS prompt_md5, CAST(NULL AS VARCHAR) AS completion_error,
  '// ' || md5(prompt) AS code FROM {CODE_REQUESTS}"""
SQL["chat_messages"] = f"""SELECT file_path, version, ['system', 'user'] AS roles,
  'You are a helpful AI that generates unit tests.' AS system_text, md5(prompt) AS user_md5 FROM {CODE_REQUESTS}"""

SQL["request_json"] = f"""SELECT file_path, version, ['model', 'prompt', 'stream', 'max_tokens', 'temperature'] AS keys,
  'your-model' AS model, md5(prompt) AS prompt_md5, 'false' AS stream, 1500 AS max_tokens,
  CAST(0.2 AS DOUBLE) AS temperature
FROM {CODE_REQUESTS}"""

SQL["provider_routing"] = f"""SELECT q.file_path, q.version,
  CASE q.version % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'ollama' ELSE 'azure' END AS provider,
  CASE WHEN q.version % 3 = 2 THEN ['model', 'messages', 'max_output_tokens', 'temperature']
       ELSE ['model', 'prompt', 'stream', 'max_tokens', 'temperature'] END AS keys,
  md5(q.prompt) AS prompt_md5
FROM {CODE_REQUESTS} q"""

SQL["parse_completion"] = f"SELECT request_id, provider, http_status, txt AS generated, err AS error FROM {PARSED_REPLAY}"

SQL["completion_replay"] = f"""SELECT q.file_path, q.version, q.request_id,
  CASE WHEN r.body IS NOT NULL THEN r.txt END AS generated,
  CASE WHEN r.body IS NOT NULL THEN r.err ELSE 'no completion' END AS completion_error,
  {extract_code("CASE WHEN r.body IS NOT NULL THEN r.txt END")} AS code
FROM {CODE_REQUESTS} q LEFT JOIN {PARSED_REPLAY} r ON q.request_id = r.request_id"""


# --------------------------------------------------------------------------- routing
CONTEXT_SQL = """('using System;

using System.Collections.Generic;


// BEGIN CLASS Doc' || CAST(doc_id AS VARCHAR) || '
public class Doc' || CAST(doc_id AS VARCHAR) || ' {
        private readonly List<string> _log = new List<string>();

        private int _size = ' || CAST(n_chars AS VARCHAR) || ';

' || """ + SEQ_TEXT + """ || '
        public Doc' || CAST(doc_id AS VARCHAR) || '(int size) { _size = size; }

' || array_to_string(list_transform(hits, lambda m: m.txt || chr(10)), '') || '// END CLASS
}
')"""


def routing_sql(base: str, prompt_user: bool, staging: bool) -> str:
    """R1 over ``base`` (keys, file_path, old_content, new_content,
    existing_test, request_id and the facts of the document the new content
    was rendered from: doc_id, n, lang, vis, ping, text, n_chars)."""
    final_ok = "needs_review" if prompt_user else "auto_applied"
    ext = extension("file_path")
    stage = (f"CASE WHEN generated_code IS NOT NULL THEN "
             f"{combine(chr(39) + 'staging' + chr(39), f'{stem('test_path')} || {chr(39)}_temp{chr(39)} || {extension('test_path')}')} END"
             if staging else "CAST(NULL AS VARCHAR)")
    return f"""
WITH b AS {base},
x AS (SELECT b.*, CASE WHEN {not_blank('new_content')} THEN new_content END AS source,
        lower({BASENAME.format('file_path')}) IN {SKIP_LOWER} AS skipped,
        {ext} AS ext, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 3 END + CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END AS n_public,
        {changed_lines('old_content', 'new_content')} AS ch,
        {test_path('file_path', "'src'", "'tests'")} AS test_path
      FROM b),
y AS (SELECT x.*, list_filter({METHOD_SPANS}, lambda m: len(list_filter(ch, lambda l: l BETWEEN m.s AND m.e)) > 0) AS hits,
        ({effective_loc('source')} > 60 AND {not_blank('old_content')} AND {not_blank('source')}
         AND {not_blank('new_content')}) AS large
      FROM x),
z AS (SELECT y.*,
        CASE WHEN skipped THEN 'skipped_listed' WHEN source IS NULL THEN 'error'
             WHEN contains(source, 'interface') THEN 'skipped_interface'
             WHEN lower(ext) <> '.cs' THEN 'error'
             WHEN n_public = 0 THEN 'no_public_methods'
             WHEN large AND len(hits) = 0 THEN 'no_affected_methods' END AS pre,
        CASE WHEN skipped THEN NULL WHEN source IS NULL THEN 'source file not found'
             WHEN contains(source, 'interface') THEN NULL
             WHEN lower(ext) IN ('.java', '.py', '.ts', '.js') THEN ext || ' parsing is not implemented yet.'
             WHEN lower(ext) <> '.cs' THEN 'Parser for files with ''' || ext || ''' extension not supported.' END AS pre_error,
        {prompt_sql(f"CASE WHEN large THEN {CONTEXT_SQL} ELSE source END",
                    f"CASE WHEN {not_blank('existing_test')} THEN existing_test ELSE '' END")} AS prompt0
      FROM y),
a AS (SELECT z.*, CASE WHEN r.body IS NOT NULL THEN r.txt END AS generated,
        CASE WHEN r.body IS NOT NULL THEN r.err ELSE 'no completion' END AS completion_error
      FROM z LEFT JOIN {PARSED_REPLAY} r ON z.request_id = r.request_id),
c AS (SELECT a.*, {extract_code('generated')} AS code FROM a),
o AS (SELECT c.*,
        CASE WHEN pre IS NOT NULL THEN pre WHEN completion_error IS NOT NULL THEN 'error'
             WHEN code IS NULL OR NOT regexp_matches(code, '\\S') THEN 'empty_response' ELSE '{final_ok}' END AS status,
        CASE WHEN pre IS NOT NULL THEN NULL ELSE prompt0 END AS prompt,
        CASE WHEN pre IS NULL AND code IS NOT NULL AND regexp_matches(code, '\\S') THEN code END AS generated_code,
        CASE WHEN pre IS NOT NULL THEN pre_error ELSE completion_error END AS error
      FROM c)
SELECT o.*, {stage} AS staging_path FROM o"""


CODE_ROUTING_BASE = f"""(SELECT p.file_path, p.version, p.old_content, p.content AS new_content, '' AS existing_test,
   {request_id('p.version')} AS request_id, b.doc_id, b.n, b.lang, b.vis, b.ping, b.text, d.n_chars
 FROM {CODE_WITH_PREV} p JOIN {CODE_BASE} b ON p.file_path = b.file_path AND p.version = b.version
 JOIN (SELECT doc_id AS did, n_chars FROM documents) d ON d.did = b.doc_id)"""

ROUTED_OUT = ("SELECT {keys}, file_path, status, staging_path, test_path, md5(prompt) AS prompt_md5, "
              "md5(generated_code) AS code_md5, error FROM ({q})")

SQL["outcome_routing"] = ROUTED_OUT.format(keys="version", q=routing_sql(CODE_ROUTING_BASE, False, False))
SQL["outcome_ledger"] = (f"SELECT status, count(*) AS n_files FROM ({routing_sql(CODE_ROUTING_BASE, False, False)}) "
                         "GROUP BY status")
SQL["write_test_files"] = f"""SELECT replace(test_path, '\\', '/') AS test_path, md5(arg_max(generated_code, version)) AS content_md5
FROM ({routing_sql(CODE_ROUTING_BASE, False, False)}) WHERE generated_code IS NOT NULL GROUP BY test_path"""
SQL["upsert_results"] = f"""SELECT test_path, arg_max(version, version) AS version, md5(arg_max(generated_code, version)) AS code_md5
FROM ({routing_sql(CODE_ROUTING_BASE, False, False)}) WHERE status = 'auto_applied' GROUP BY test_path"""
SQL["review_cycle"] = f"""SELECT r.file_path, r.version, r.test_path, r.staging_path,
  CASE WHEN l.quality = 1 THEN 'Yes' ELSE 'n' END AS answer,
  coalesce(lower(CASE WHEN l.quality = 1 THEN 'Yes' ELSE 'n' END) IN ('y', 'yes'), false) AS applied,
  max(CASE WHEN l.quality = 1 THEN r.version END) OVER (PARTITION BY r.test_path) AS result_version,
  md5(r.generated_code) AS code_md5
FROM ({routing_sql(CODE_ROUTING_BASE, True, True)}) r JOIN labels l ON r.version = l.doc_id
WHERE r.status = 'needs_review'"""

COMMIT_ROUTING_BASE = f"""(SELECT f.repo, f.sha, f.file_path, coalesce(bo.content, '') AS old_content,
   coalesce(bn.content, '') AS new_content, coalesce(bt.content, '') AS existing_test,
   {request_id('f.l_partkey')} AS request_id, d.doc_id, d.n, d.lang, d.vis, d.ping, d.text, d.n_chars
 FROM (SELECT *, {test_path('file_path', "'src'", "'tests'")} AS tpath FROM {SOURCE_CHANGES}) f
 LEFT JOIN {COMMITS} c ON f.repo = c.repo AND f.sha = c.sha
 LEFT JOIN {BLOBS} bo ON bo.repo = f.repo AND bo.sha = c.parent_sha AND bo.file_path = f.file_path
 LEFT JOIN {BLOBS} bn ON bn.repo = f.repo AND bn.sha = f.sha AND bn.file_path = f.file_path
 LEFT JOIN {BLOBS} bt ON bt.repo = f.repo AND bt.sha = f.sha AND bt.file_path = f.tpath
 LEFT JOIN (SELECT doc_id, lang, text, n_chars, CAST(len(string_split(coalesce(text, ''), chr(10))) AS INTEGER) AS n,
              CASE WHEN doc_id % 11 = 0 THEN 'internal' ELSE 'public' END AS vis,
              CASE WHEN doc_id % 11 = 0 THEN 'private' ELSE 'public' END AS ping FROM documents) d
   ON d.doc_id = f.l_partkey % (SELECT max(doc_id) + 1 FROM documents))"""

SQL["change_run"] = ROUTED_OUT.format(keys="repo, sha", q=routing_sql(COMMIT_ROUTING_BASE, True, True))

# one run per head that the cursor sees, of commits with a source file
MANIFEST = f"""(
WITH r AS (SELECT * FROM ({routing_sql(COMMIT_ROUTING_BASE, True, True)}) WHERE generated_code IS NOT NULL),
g AS (SELECT repo, sha FROM {COMMIT_FILES} GROUP BY repo, sha HAVING bool_or(lower(file_path) LIKE '%.cs')),
runs AS (SELECT c.repo, c.sha, c.poll_ts AS run_ts, c.poll_order AS run_order, 'auto/test-update-' || strftime(c.poll_ts, '%Y%m%d%H%M%S') AS branch
         FROM ({SQL["commit_cursor"]}) c JOIN g ON c.repo = g.repo AND c.sha = g.sha)
SELECT r.repo, r.sha, r.file_path, r.test_path, r.generated_code, runs.run_ts, runs.run_order, runs.branch,
       count(*) OVER (PARTITION BY r.repo, run_ts, run_order) AS n_files,
       row_number() OVER (PARTITION BY r.repo, test_path ORDER BY run_ts DESC, run_order DESC, file_path DESC) AS age
FROM r JOIN runs ON r.repo = runs.repo AND r.sha = runs.sha)"""

SQL["change_set_manifest"] = f"""SELECT repo, sha, run_ts, run_order, branch, 'main' AS base_branch, replace(test_path, '\\', '/') AS test_path,
  md5(generated_code) AS content_md5, 'Add/update test for ' || file_path AS message, n_files FROM {MANIFEST}"""

SQL["review_requests"] = f"""SELECT repo, run_ts, run_order, branch, 'main' AS base_branch, count(*) AS n_files, 'Automated Test Update' AS title,
  'This PR was generated automatically to add/update unit tests for modified files.' AS body
FROM {MANIFEST} GROUP BY repo, run_ts, run_order, branch"""

SQL["commit_results"] = f"""SELECT repo || '/' || test_path AS test_path, run_ts, run_order, file_path, md5(generated_code) AS code_md5
FROM {MANIFEST} WHERE age = 1"""

SQL["stream_change_pipeline"] = f"""SELECT repo, sha, run_ts, run_order, branch, 'main' AS base_branch, replace(test_path, '\\', '/') AS test_path,
  md5(generated_code) AS content_md5, 'Add/update test for ' || file_path AS message, n_files, age = 1 AS is_result FROM {MANIFEST}"""

MANUAL_BASE = f"""(SELECT 'src/' || source || '/Doc' || CAST(doc_id AS VARCHAR) || '.cs' AS file_path, '' AS old_content,
   {CODE_TEMPLATE} AS new_content, CASE WHEN doc_id % 4 = 0 THEN '// tests of ' || CAST(doc_id AS VARCHAR) ELSE '' END AS existing_test,
   {request_id('doc_id')} AS request_id, doc_id, lang, text, n_chars, CAST(len(string_split(coalesce(text, ''), chr(10))) AS INTEGER) AS n,
   CASE WHEN doc_id % 11 = 0 THEN 'internal' ELSE 'public' END AS vis, CASE WHEN doc_id % 11 = 0 THEN 'private' ELSE 'public' END AS ping
 FROM documents)"""

SQL["manual_run"] = f"""SELECT file_path, status, staging_path, test_path, md5(prompt) AS prompt_md5, md5(generated_code) AS code_md5, error
FROM ({routing_sql(MANUAL_BASE, True, True)})"""

# --------------------------------------------------------------------------- sources and streams
SQL["scan_whole_files"] = """SELECT source, md5(text || chr(10)) AS content_md5,
  CAST(length(text) + 1 AS INTEGER) AS n_chars FROM documents"""
SQL["stream_file_events"] = f"""SELECT path || '.cs' AS path, ts, event_id, event_type, content FROM {FILE_EVENTS}
WHERE event_id % 3 = 0 AND event_id % 7 <> 0"""
SQL["stream_commit_log"] = """SELECT 'r' || CAST(o_custkey AS VARCHAR) AS repo, 'main' AS branch, o_orderkey AS commit_key,
  'c' || CAST(o_orderkey AS VARCHAR) AS sha, o_orderdate AS committed_at FROM orders"""
SQL["stream_head_commit"] = SQL["head_commit"]
SQL["stream_debounce"] = SQL["debounce_batch"]
SQL["stream_previous_version"] = SQL["previous_version"]
SQL["stream_commit_cursor"] = SQL["commit_cursor"]
SQL["quarantine"] = f"""SELECT repo, sha, file_path,
  CASE WHEN lower({extension('file_path')}) IN ('.java', '.py', '.ts', '.js') THEN {extension('file_path')} || ' parsing is not implemented yet.'
       ELSE 'Parser for files with ''' || {extension('file_path')} || ''' extension not supported.' END AS error
FROM {COMMIT_FILES} WHERE lower({extension('file_path')}) <> '.cs'"""
