"""Filters and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import basename, col, not_blank

def skip_names(skip: DataFrame, name_col: str = "file_name") -> DataFrame:
    """A5: case-insensitive distinct set of names."""
    return skip.select(F.lower(F.col(name_col)).alias("_skip_name")).distinct()


def drop_skipped(df: DataFrame, skip: DataFrame, path_col: str = "file_path") -> DataFrame:
    """Drop rows whose base name (either separator) is in the skip
    list, ignoring case.  Spark broadcasts the list when its measured size
    allows."""
    names = skip_names(skip)
    return df.join(names, F.lower(basename(F.col(path_col))) == F.col("_skip_name"), "left_anti")


def has_extension(path, ext: str) -> Column:
    """path ends with ``ext``, ignoring case."""
    return F.lower(col(path)).endswith(ext.lower())


def changed_source_files(df: DataFrame, skip: DataFrame, ext: str, tests_folder: str,
                         path_col: str = "file_path") -> DataFrame:
    """F5 = F3 non-blank path, F2 extension, F4 not under the tests folder
    (substring, case-sensitive), F1 skip list."""
    p = F.col(path_col)
    kept = df.filter(not_blank(p) & has_extension(p, ext) & ~p.contains(tests_folder))
    return drop_skipped(kept, skip, path_col)


def is_interface_file(content) -> Column:
    """the text contains ``interface`` anywhere (comments included)."""
    return col(content).contains("interface")


def commit_has_source_change(files: DataFrame, ext: str, keys=("repo", "sha"),
                             path_col: str = "file_path") -> DataFrame:
    """per commit, whether any changed file has the extension.  A
    partial aggregate (``bool_or``), combined map-side."""
    return files.groupBy(*keys).agg(F.bool_or(has_extension(F.col(path_col), ext)).alias("has_source_change"))


def is_approved(answer) -> Column:
    """``y`` or ``yes`` ignoring case; anything else (or null) rejects."""
    return F.coalesce(F.lower(col(answer)).isin("y", "yes"), F.lit(False))
