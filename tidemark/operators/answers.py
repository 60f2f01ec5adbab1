"""Answer log of the completion client (U2): each prompt is asked once.

Prompts are told by their SHA-256.  Distinct prompts that the log does not
answer are dealt to buckets, and the tasks write the answers of every client
call as a file of their own (complete under a hidden name, then renamed)
before they ask on.  A task that runs again reads its buckets first and sends
only what is missing; later actions and later runs read the log.  After a job
its many small files are folded into one written table, then deleted; a
failure between the two leaves rows twice, which readers take once.

    {path}/calls/bucket=k/*.parquet     answers of single calls
    {path}/folded/<run>/*.parquet       answers of finished jobs

``path`` is a shared folder that ``pyarrow`` can name (a local path or a URI).
Two attempts of one task at the same time (speculation) may both send a
prompt: keep speculation off where calls are dear.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import col, extract_code_block
from tidemark.operators.completion import CLIENT_BATCH, ask
from tidemark.session import delete_paths

LOG_SCHEMA = "prompt_sha string, generated string, completion_error string, attempt long"
BUCKETS = 64
_CALL = pa.schema([("prompt_sha", pa.string()), ("generated", pa.string()), ("completion_error", pa.string()), ("attempt", pa.int64())])


def prompt_sha(prompt) -> Column:
    """What tells prompts apart; a null prompt is an empty one."""
    return F.sha2(F.coalesce(col(prompt), F.lit("")), 256)


def _read(spark: SparkSession, path: str) -> DataFrame:
    r = spark.read.schema(LOG_SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    return r.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _current(spark: SparkSession, path: str) -> DataFrame:
    """One row per prompt of the log; an answer goes before an error, a later
    attempt before an earlier one."""
    parts = [_read(spark, f"{path}/{d}") for d in ("folded", "calls") if _exists(spark, f"{path}/{d}")]
    if not parts:
        return spark.createDataFrame([], LOG_SCHEMA)
    log = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    newest = F.max_by(F.struct("generated", "completion_error", "attempt"),
                      F.struct(F.col("completion_error").isNull().alias("ok"), "attempt", F.coalesce("generated", F.lit("")).alias("g")))
    return log.groupBy("prompt_sha").agg(newest.alias("a")).select("prompt_sha", "a.*")


def recorded_answers(spark: SparkSession, path: str) -> DataFrame:
    """What the log holds: (prompt_sha, generated, completion_error)."""
    return _current(spark, path).drop("attempt")


def _write_call(fs, folder: str, rows: list[tuple]) -> None:
    name = uuid.uuid4().hex
    fs.create_dir(folder, recursive=True)
    pq.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CALL)], schema=_CALL), f"{folder}/_{name}", filesystem=fs)
    fs.move(f"{folder}/_{name}", f"{folder}/{name}.parquet")


def _written(fs, folder: str, attempt: int) -> set[str]:
    """Prompts of a bucket that this attempt (run) has answered already."""
    files = [f.path for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if f.path.endswith(".parquet")]
    out: set[str] = set()
    for f in files:
        t = pq.read_table(f, filesystem=fs, columns=["prompt_sha", "completion_error", "attempt"]).to_pylist()
        out |= {r["prompt_sha"] for r in t if r["completion_error"] is None or r["attempt"] == attempt}
    return out


def answer_missing(prompts: DataFrame, client_factory: Callable[[], object], path: str, prompt_col: str = "prompt",
                   attempt: int = 0, buckets: int = BUCKETS) -> None:
    """Ask the client for all prompts that the log at ``path`` has no answer
    of.  Prompts whose call failed are recorded with their error, and asked
    again by a greater ``attempt`` only."""
    spark = prompts.sparkSession
    p = prompts.select(prompt_sha(prompt_col).alias("prompt_sha"), F.coalesce(prompt_col, F.lit("")).alias("prompt")).dropDuplicates(["prompt_sha"])
    settled = _current(spark, path).where(F.col("completion_error").isNull() | (F.col("attempt") >= attempt))
    p = p.join(settled.select("prompt_sha"), "prompt_sha", "left_anti")
    p = p.withColumn("bucket", F.pmod(F.xxhash64("prompt_sha"), F.lit(buckets)).cast("int"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_factory()
        fs, base = pafs.FileSystem.from_uri(path)
        seen: dict[int, set[str]] = {}
        for pdf in batches:
            n = 0
            for bucket, group in pdf.groupby("bucket"):
                folder = f"{base}/calls/bucket={bucket}"
                if bucket not in seen:
                    seen[bucket] = _written(fs, folder, attempt)
                todo = [r for r in zip(group["prompt_sha"], group["prompt"]) if r[0] not in seen[bucket]]
                for i in range(0, len(todo), CLIENT_BATCH):
                    call = todo[i:i + CLIENT_BATCH]
                    got = ask(client, [t for _, t in call])
                    _write_call(fs, folder, [(s, a, e, attempt) for (s, _), (a, e) in zip(call, got)])
                    n += len(call)
            yield pd.DataFrame({"n": [n]})

    asked = p.repartition(buckets, "bucket").mapInPandas(run, "n long")
    asked.write.format("noop").mode("overwrite").save()
    fold(spark, path)


def fold(spark: SparkSession, path: str) -> None:
    """Write the files of single calls again as fewer files and delete them.
    Run it when no job is asking."""
    calls = f"{path}/calls"
    if _exists(spark, calls):
        _read(spark, calls).write.parquet(f"{path}/folded/{uuid.uuid4().hex}")
        delete_paths(spark, [calls])


def complete_with_log(requests: DataFrame, client_factory: Callable[[], object], path: str, prompt_col: str = "prompt",
                      attempt: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """U2 through the log: adds ``generated``, ``completion_error`` and
    ``code``.  Missing answers are asked for and written now; the frame
    returned only reads them, however many actions use it."""
    answer_missing(requests, client_factory, path, prompt_col, attempt, buckets)
    log = recorded_answers(requests.sparkSession, path)
    j = requests.withColumn("prompt_sha", prompt_sha(prompt_col)).join(log, "prompt_sha", "left").drop("prompt_sha")
    return j.withColumn("code", extract_code_block(F.col("generated")))


def logged_completer(client_factory: Callable[[], object], path: str, **how) -> Callable[[DataFrame], DataFrame]:
    """``complete_with_log`` as the ``completer`` of ``route_by_id``."""
    return lambda todo: complete_with_log(todo, client_factory, path, **how)
