"""Column expressions for file paths, repository URLs and branch names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import col, extension, stem

# Fixed value: message for a URL without owner and repository.
INVALID_URL = "Invalid GitHub repository URL."


def _segments(c) -> Column:
    """Path segments, empty and ``.`` segments dropped (``/`` separated)."""
    return F.filter(F.split(col(c), "/"), lambda s: (s != "") & (s != "."))


def relative_path(relative_to, path) -> Column:
    """``path`` relative to the folder ``relative_to``: the common leading
    segments are dropped and every remaining folder segment becomes ``..``
    (so a file outside the folder maps to ``../x/a.cs``)."""
    rt, p = _segments(relative_to), _segments(path)
    m = F.least(F.size(rt), F.size(p))
    common = F.when(m == 0, F.lit(0)).otherwise(
        F.size(F.filter(F.sequence(F.lit(1), m), lambda i: F.slice(rt, 1, i) == F.slice(p, 1, i))))
    ups = F.array_repeat(F.lit(".."), F.size(rt) - common)
    rest = F.slice(p, common + 1, F.greatest(F.size(p) - common, F.lit(0)))
    joined = F.array_join(F.concat(ups, rest), "/")
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def combine(*parts) -> Column:
    """Join non-empty parts with ``/`` (empty parts are dropped)."""
    cleaned = [F.regexp_replace(col(p), r"/+$", "") for p in parts]
    return F.concat_ws("/", *[F.when(c != "", c) for c in cleaned])


def directory_name(c) -> Column:
    """Everything before the last ``/``; '' when there is none."""
    return F.regexp_extract(col(c), r"^(.*)/[^/]*$", 1)


def _plain(c: Column) -> Column:
    """Whether a path has no empty and no ``.`` segment (plain searches, no pattern)."""
    return ~(c.contains("//") | c.contains("/./") | c.startswith("/") | c.startswith("./") | c.endswith("/") | c.endswith("/.") | c.isin("", "."))


def with_test_path(df, path_col: str, out_col: str, src_folder, tests_folder, project_folder=None):
    """``{tests}/{relative dir}/{stem}Tests{ext}``.  With a project folder
    (auto mode) both folders are taken under it first.  Staged projections: each intermediate (segments, common prefix,
    relative path) is its own column, so the optimizer keeps one copy of it
    instead of inlining the nested expression at every use (which made the
    generated code too large to compile).  A plain path below a plain source
    folder is cut behind it; only the others are taken apart."""
    src, tests = col(src_folder), col(tests_folder)
    if project_folder is not None:
        src, tests = combine(project_folder, src), combine(project_folder, tests)
    t = "_tp_"
    path = col(path_col)
    below = F.coalesce(path.startswith(F.concat(src, F.lit("/"))) & _plain(src) & _plain(path), F.lit(False))
    d = (df.withColumn(t + "below", below).withColumn(t + "rt", F.when(~F.col(t + "below"), _segments(src)))
           .withColumn(t + "p", F.when(~F.col(t + "below"), _segments(path))).withColumn(t + "tests", tests))
    rt, p = F.col(t + "rt"), F.col(t + "p")
    m = F.least(F.size(rt), F.size(p))
    d = d.withColumn(t + "c", F.when(F.col(t + "below"), F.lit(0)).when(m == 0, F.lit(0)).otherwise(
        F.size(F.filter(F.sequence(F.lit(1), m), lambda i: F.slice(rt, 1, i) == F.slice(p, 1, i)))))
    c = F.col(t + "c")
    joined = F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(rt) - c),
                                     F.slice(p, c + 1, F.greatest(F.size(p) - c, F.lit(0)))), "/")
    cut = F.substring(path, F.length(src) + 2, F.length(path))
    d = d.withColumn(t + "rel", F.when(F.col(t + "below"), cut).when(joined == "", F.lit(".")).otherwise(joined))
    rel = F.col(t + "rel")
    name = F.concat(stem(rel), F.lit("Tests"), extension(rel))
    d = d.withColumn(out_col, combine(F.col(t + "tests"), directory_name(rel), name))
    return d.drop(t + "below", t + "rt", t + "p", t + "tests", t + "c", t + "rel")


def staging_path(test_path_col, staging_root) -> Column:
    """``{stem}_temp{ext}`` under the staging folder."""
    name = F.concat(stem(test_path_col), F.lit("_temp"), extension(test_path_col))
    return combine(staging_root, name)


def url_path_segments(url) -> Column:
    return F.split(F.coalesce(F.try_parse_url(col(url), F.lit("PATH")), F.lit("")), "/")


def repo_owner(url) -> Column:
    seg = url_path_segments(url)
    return F.when(F.size(seg) >= 3, F.get(seg, 1))


def repo_name(url) -> Column:
    """Second path segment with every ``.git`` removed."""
    seg = url_path_segments(url)
    return F.when(F.size(seg) >= 3, F.replace(F.get(seg, 2), F.lit(".git"), F.lit("")))


def repo_url_error(url) -> Column:
    return F.when(F.size(url_path_segments(url)) < 3, F.lit(INVALID_URL))


def classify_location(location, folder_exists) -> Column:
    """Existing folder -> local; http(s) URL (any case) -> remote;
    anything else -> invalid."""
    loc = F.lower(col(location))
    return (F.when(col(folder_exists), F.lit("local"))
            .when(loc.startswith("http://") | loc.startswith("https://"), F.lit("remote"))
            .otherwise(F.lit("invalid")))


def branch_name(prefix, run_ts) -> Column:
    """P5: prefix + ``yyyyMMddHHmmss`` of the run timestamp (session zone UTC)."""
    return F.concat(col(prefix), F.date_format(col(run_ts), "yyyyMMddHHmmss"))


def commit_message(file_path) -> Column:
    """P6 message text (fixed value)."""
    return F.concat(F.lit("Add/update test for "), col(file_path))


def repo_path(file_path) -> Column:
    """P6 normalisation: ``\\`` -> ``/``."""
    return F.translate(col(file_path), "\\", "/")
