"""The project a changed file belongs to, with its settings (P10).

Projects are folders of repositories, and one may lie inside another: a file
belongs to the project with the longest folder that holds it.  Settings travel
as columns of the change row, so test path (P2), prompt (P7), provider (U3) and
routing (R1) are those of the row's project.

The match is made once per directory, not per file: every directory is joined
on (repo, folder) with its own ancestors, and the longest folder found wins - a
partial aggregate over narrow rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.paths import directory_name, with_test_path

#: Settings of a project; ``background``: apply results without asking.
SETTINGS = ("src_folder", "tests_folder", "sample", "provider", "background")


def with_project(changes: DataFrame, projects: DataFrame) -> DataFrame:
    """``changes(repo, file_path, ...)`` with ``project_path`` and the settings
    of ``projects(repo, project_path, settings...)``, one row per folder ('' is
    the whole repository); all null for a file in no project."""
    folder = directory_name("file_path")
    dirs = changes.select("repo", folder.alias("_dir")).distinct()
    parts = F.split("_dir", "/")
    ancestors = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    found = dirs.select("repo", "_dir", F.explode(ancestors).alias("project_path")).join(projects.select("repo", "project_path"), ["repo", "project_path"])
    best = found.groupBy("repo", "_dir").agg(F.max(F.struct(F.length("project_path").alias("n"), "project_path"))["project_path"].alias("project_path"))
    settings = best.join(projects.select("repo", "project_path", *SETTINGS), ["repo", "project_path"])
    return changes.withColumn("_dir", folder).join(settings, ["repo", "_dir"], "left").drop("_dir")


def with_project_test_path(rows: DataFrame) -> DataFrame:
    """P2 with the project's own folders."""
    return with_test_path(rows, "file_path", "test_path", F.col("src_folder"), F.col("tests_folder"), F.col("project_path"))


def routing_by_project() -> dict:
    """Keyword arguments of ``route_by_id`` and ``outcome_routing`` for change
    rows that carry their project's settings."""
    return {"src_folder": F.col("src_folder"), "tests_folder": F.col("tests_folder"), "project_folder": F.col("project_path"),
            "sample": F.col("sample"), "prompt_user": ~F.col("background"), "per_row": ("sample", "background")}
