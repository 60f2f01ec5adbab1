"""Versions, cursors and debouncing over ordered change rows.

All keyed "previous/next row" logic goes through
``tidemark.plans.ordered.with_neighbour``, which spreads a hot key over many
tasks instead of sorting it in one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import changed_line_numbers, effective_loc, not_blank
from tidemark.plans.ordered import latest_per_key, with_neighbour


def previous_version(df: DataFrame, key: str = "path", order: str = "version",
                     content: str = "content", tiebreak: Sequence[str] = (),
                     buckets: int | None = None) -> DataFrame:
    """Add ``old_content`` = the content of the previous version of the
    same key, ``''`` for the first version."""
    out = with_neighbour(df, [key], order, [content], tiebreak=tiebreak, prefix="_prev_",
                         buckets=buckets, found_col="_has_prev")
    return (out.withColumn("old_content", F.when(F.col("_has_prev"), F.coalesce(F.col(f"_prev_{content}"), F.lit("")))
                           .otherwise(F.lit("")))
               .drop(f"_prev_{content}", "_has_prev"))


def changed_lines(df: DataFrame, old: str = "old_content", new: str = "content",
                  out: str = "changed_lines") -> DataFrame:
    """J6 as an array column of 1-based line numbers."""
    return df.withColumn(out, changed_line_numbers(F.col(old), F.col(new)))


def large_file_flag(new, old, threshold: int) -> F.Column:
    """F8: effective lines above the threshold and both versions non-blank."""
    return (effective_loc(new) > F.lit(threshold)) & not_blank(old) & not_blank(new)


def change_summary(versions: DataFrame, threshold: int, key: str = "path") -> DataFrame:
    """Flagship: per path, what changed between consecutive versions and how
    many of those changes hit a large file.

    W1 previous version -> J6 changed lines -> A1 effective lines -> F8 ->
    aggregate per path (partial aggregation, so a hot path is combined
    map-side).
    """
    v = previous_version(versions, key=key)
    v = v.select(
        key,
        F.size(changed_line_numbers(F.col("old_content"), F.col("content"))).alias("n_changed"),
        effective_loc(F.col("content")).alias("eff"),
        large_file_flag(F.col("content"), F.col("old_content"), threshold).alias("large"),
    )
    return v.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_versions"),
        F.sum("n_changed").alias("changed_lines"),
        F.sum(F.col("large").cast("int")).alias("large_changes"),
        F.max("eff").alias("max_effective_loc"),
    )


def commit_cursor(df: DataFrame, key: Sequence[str], order: str, sha: str = "sha",
                  tiebreak: Sequence[str] = ()) -> DataFrame:
    """Keep a row when its sha differs from the previous row's sha of the
    same key (consecutive repeats suppressed: A,B,A,A -> A,B,A).  Rows with
    a null sha are dropped first."""
    d = df.filter(F.col(sha).isNotNull())
    d = with_neighbour(d, key, order, [sha], tiebreak=tiebreak, prefix="_last_")
    return d.filter(~F.col(sha).eqNullSafe(F.col(f"_last_{sha}"))).drop(f"_last_{sha}")


def debounce(df: DataFrame, key: str, ts: str, interval_seconds: float,
             tiebreak: Sequence[str] = ()) -> DataFrame:
    """Trailing-edge debounce.  An event fires only if the next event on
    the same key is absent or more than ``interval`` later (strictly, to
    agree with ``session_window`` which merges events exactly one gap
    apart).  Adds ``fire_ts`` = ts + interval."""
    d = with_neighbour(df, [key], ts, [ts], tiebreak=tiebreak, direction="next", prefix="_next_")
    gap = F.make_dt_interval(secs=F.lit(interval_seconds))
    nxt = F.col(f"_next_{ts}")
    return (d.filter(nxt.isNull() | (nxt > F.col(ts) + gap))
             .withColumn("fire_ts", F.col(ts) + gap)
             .drop(f"_next_{ts}"))


def head_commit(commits: DataFrame, key: Sequence[str] = ("repo", "branch"),
                values: Sequence[str] = ("sha", "committed_at")) -> DataFrame:
    """Newest commit per (repo, branch), ties broken by the higher sha
    key.  A partial aggregate, not a sorted window."""
    return latest_per_key(commits, list(key), ["committed_at", "commit_key"], list(values))
