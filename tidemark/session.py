"""Session defaults and the shared scratch folder.

Scratch data (streaming inputs/outputs, written tables that cut lineage) lives
under the folder the cluster names in ``spark.checkpoint.dir``.  A folder of
our own is created only when that setting is absent, which is the case in
local tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcast only what AQE has measured at runtime; the static threshold
    # stays at Spark's default.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tidemark", extra: dict | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus)
    conf.setdefault("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Scratch folders of no scope, and those of the scopes open in this thread of
#: work, the innermost last: queries in other threads have their own.
_loose: list[str] = []
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scratch_scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide checkpoint folder (``spark.checkpoint.dir``).  It is
    created only on a local master, where every task sees the driver's disk;
    elsewhere a missing setting is an error, as each executor would write to
    its own disk."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-ckpt-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str, outer: bool = False) -> str:
    """A fresh sub-folder of the shared folder for one run of one operator;
    ``outer``: it is to outlive the innermost ``scratch_scope``."""
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex[:12]}"
    open_ = (_loose, *_scopes.get())
    open_[-2 if outer and len(open_) > 1 else -1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession):
    """Scratch folders made inside are deleted on leaving: for tables that no
    plan handed out reads any more."""
    made: list[str] = []
    token = _scopes.set((*_scopes.get(), made))
    try:
        yield
    finally:
        _scopes.reset(token)
        delete_paths(spark, made)


@contextmanager
def shuffles_freed(spark: SparkSession):
    """The shuffle files of what is executed inside go when it ends, not when
    the driver happens to collect its garbage: a query of many written steps
    would keep those of all steps on disk."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release_scratch(spark: SparkSession) -> None:
    """Delete the scratch folders that belong to no scope.  Results that still
    read them must have been written or collected before."""
    paths = _loose.copy()
    delete_paths(spark, paths)
    for p in paths:
        _loose.remove(p)


def delete_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders with all they hold, on whatever file system they are."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
