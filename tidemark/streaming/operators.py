"""Streaming operators (S3, S4, T1, T6); T2 and T3 are in ``state``.

* S3 source events: changes of files with the watched extension.
* T1 debounce: event-time session windows with a watermark; a session
  closes when no event follows within the gap, and emits its last event.
* S4 head commit: the newest commit per branch of a commit log, kept by
  Spark's aggregation state; each epoch writes the heads that moved.
* T6 quarantine: ``foreachBatch`` splits each micro-batch into accepted
  rows and rows that failed a check, written to separate tables.

Every ``foreachBatch`` output is one folder per epoch, overwritten when a
batch is replayed after a failure, so no row is lost or doubled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.filters import has_extension
from tidemark.plans.ordered import latest_per_key
from tidemark.streaming.state import publish


def source_events(events: DataFrame, ext: str, path: str = "path") -> DataFrame:
    """S3: events of files with the extension; deletes are not changes."""
    return events.filter(has_extension(F.col(path), ext) & (F.col("event_type") != "delete"))


def debounce_stream(events: DataFrame, key: str, ts: str, gap_seconds: int, lateness_seconds: int,
                    tiebreak: str = "event_id", payload=("event_type",)) -> DataFrame:
    """Trailing-edge debounce as ``session_window``; emits the last event
    of each closed session and ``fire_ts`` = session end (last ts + gap).
    Sessions stay open for ``lateness_seconds`` of event time, so events up to
    that late still join theirs; ``late_events_writer`` keeps later ones."""
    gap = f"{gap_seconds} seconds"
    last = F.max_by(F.struct(F.col(ts), F.col(tiebreak), *[F.col(p) for p in payload]),
                    F.struct(F.col(ts), F.col(tiebreak)))
    s = (events.withWatermark(ts, f"{lateness_seconds} seconds")
               .groupBy(F.col(key), F.session_window(F.col(ts), gap).alias("w"))
               .agg(last.alias("last")))
    return s.select(key, F.col("last").getField(ts).alias(ts), F.col("last").getField(tiebreak).alias(tiebreak),
                    *[F.col("last").getField(p).alias(p) for p in payload],
                    F.col("w.end").alias("fire_ts"))


def _state_before(spark, path: str, epoch_id: int) -> DataFrame | None:
    """The state as the batch before this one left it."""
    return spark.read.parquet(f"{path}/epoch_id={epoch_id - 1}") if epoch_id else None


def late_events_writer(path: str, ts: str, lateness_seconds: int):
    """A ``foreachBatch`` function for the same events that keeps those
    behind the newest event of earlier batches by more than the lateness -
    all that a watermark may drop - as a table under ``{path}/late``."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        before = _state_before(spark, f"{path}/newest", epoch_id)
        newest = before.first()[0] if before is not None else None
        late = F.lit(False) if newest is None else F.col(ts) < F.lit(newest) - F.make_dt_interval(secs=F.lit(lateness_seconds))
        batch.filter(late).write.mode("overwrite").parquet(f"{path}/late/epoch_id={epoch_id}")
        seen = batch.select(ts) if before is None else batch.select(ts).unionByName(before)
        seen.agg(F.max(ts).alias(ts)).write.mode("overwrite").parquet(f"{path}/newest/epoch_id={epoch_id}")
    return write


HEAD_KEY = ("repo", "branch")
HEAD_ORDER = ("committed_at", "commit_key")


def moving_heads(commits: DataFrame) -> DataFrame:
    """S4 as a stream (output mode ``update``): the head of every branch that
    a batch has commits of, ordered as in ``versions.head_commit``."""
    head = F.max_by(F.struct("sha", *HEAD_ORDER), F.struct(*HEAD_ORDER)).alias("head")
    return commits.groupBy(*HEAD_KEY).agg(head).select(*HEAD_KEY, "head.*")


def heads_writer(path: str):
    """A ``foreachBatch`` function for ``moving_heads``; an epoch adds its
    folder to the log of heads once."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        publish(batch.sparkSession, lambda: batch, path, epoch_id)
    return write


def current_heads(moved: DataFrame) -> DataFrame:
    """The head of every branch from the log of heads.  A branch's head only
    moves up in ``HEAD_ORDER``."""
    return latest_per_key(moved, HEAD_KEY, HEAD_ORDER, ("sha", "committed_at"))


def quarantine_writer(path: str, error_col: str = "error"):
    """A ``foreachBatch`` function that writes each batch once, rows with
    an error under ``failed=true`` and the others under ``failed=false``; one
    bad row never stops the stream."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        (batch.withColumn("failed", F.col(error_col).isNotNull())
              .write.mode("overwrite").partitionBy("failed").parquet(f"{path}/epoch_id={epoch_id}"))
    return write
