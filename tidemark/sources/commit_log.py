"""Commit log as a stream source with offsets.

The log is a folder of numbered segments, each a folder of parquet files with
a note (``_segment.json``) of its schema and of the rows per file.  ``append``
writes a segment under a hidden name and publishes it by one rename that fails
where the number is taken; it then takes the next one, so writers may run side
by side and the numbers have no gap.  Rows of a segment are in the order asked
for, files by name and rows within a file.

``read_commits`` reads the log as a Python data source.  An offset is
``{"segment": s, "row": r}``: everything before row r of segment s has been
read.  A trigger admits at most ``maxRowsPerTrigger`` rows, cut anywhere in a
segment, so a long log is taken up in even batches, also after a stop.  Spark's
checkpoint is the only record of what has been read: on a restart Spark plans
the last batch again before it asks for a newer offset, and the reader admits
from there, as Spark's own simple stream reader does.

The driver sees notes of segments (one line per file), never rows; the probe
for new segments asks for the next number only and does not list the log.
Tasks read their rows one Arrow batch at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

NOTE = "_segment.json"
ROWS_PER_TASK = 1_000_000
START = {"segment": 0, "row": 0}


def segment_path(log: str, number: int) -> str:
    return f"{log.rstrip('/')}/segment-{number:010d}"


# --------------------------------------------------------------------------- writing
def append(df: DataFrame, log: str, order: Sequence[str] = ()) -> int | None:
    """Publish the rows of ``df``, sorted by ``order``, as the log's next
    segment and give its number; an empty frame adds none."""
    spark = df.sparkSession
    hidden = f"{log.rstrip('/')}/_new-{uuid.uuid4().hex}"
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    rows.write.parquet(hidden)
    name = F.substring_index(F.input_file_name(), "/", -1)
    files = sorted(tuple(r) for r in spark.read.schema(df.schema).parquet(hidden).groupBy(name.alias("f")).agg(F.count(F.lit(1)).alias("n")).collect())
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(hidden).getFileSystem(conf)
    if not files:
        fs.delete(at(hidden), True)
        return None
    out = fs.create(at(f"{hidden}/{NOTE}"))
    out.write(bytearray(json.dumps({"files": files, "schema": df.schema.jsonValue()}).encode("utf-8")))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    number = _numbers_taken(fs, at, log)
    while True:
        target = at(segment_path(log, number))
        try:
            context.rename(at(hidden), target, no_options)          # fails where the target is there
            return number
        except Exception:
            if not fs.exists(target):
                raise
            number += 1


def _numbers_taken(fs, at, log: str) -> int:
    """The first free number: doubling, then halving, as numbers have no gap."""
    taken = lambda n: fs.exists(at(segment_path(log, n)))
    high = 1
    while taken(high - 1):
        high *= 2
    low = high // 2                                                 # all below are taken
    while low < high - 1:
        middle = (low + high - 1) // 2
        low, high = (middle + 1, high) if taken(middle) else (low, middle + 1)
    return low


# --------------------------------------------------------------------------- reading
class CommitLogReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        options = {k.lower(): v for k, v in options.items()}             # as Spark hands them over
        self.schema, self.log = schema, options["path"]
        self.limit = int(options["maxrowspertrigger"]) if options.get("maxrowspertrigger") else None
        self.per_task = int(options.get("rowspertask") or ROWS_PER_TASK)
        if self.limit is not None and self.limit < 1 or self.per_task < 1:
            raise ValueError("maxRowsPerTrigger and rowsPerTask must be positive")
        self.planned: dict | None = None
        self.notes: dict[int, list] = {}

    # ---- the log's notes
    def _files(self, number: int) -> list | None:
        """(file, rows) of a segment, null where it is not there (yet)."""
        if number not in self.notes:
            text = _read_text(f"{segment_path(self.log, number)}/{NOTE}")
            if text is None:
                return None
            self.notes[number] = json.loads(text)["files"]
        return self.notes[number]

    def _rows(self, number: int) -> int | None:
        files = self._files(number)
        return None if files is None else sum(n for _, n in files)

    # ---- offsets
    def initialOffset(self) -> dict:
        return dict(START)

    def latestOffset(self) -> dict:
        return self.admit(self.planned or START, self.limit)

    def admit(self, start: dict, limit: int | None) -> dict:
        """The offset at most ``limit`` rows after ``start``."""
        number, row = start["segment"], start["row"]
        left = limit
        while (rows := self._rows(number)) is not None:
            if left is not None and rows - row >= left:
                return {"segment": number, "row": row + left}
            left = None if left is None else left - (rows - row)
            if self._rows(number + 1) is None:
                return {"segment": number, "row": rows}
            number, row = number + 1, 0
        return {"segment": number, "row": row}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for number in range(start["segment"], end["segment"] + 1):
            files = self._files(number)
            if files is None:
                if (start["segment"], start["row"]) == (end["segment"], end["row"]):
                    break                                           # nothing to read yet
                raise PySparkException(f"segment {number} of {self.log} is missing")
            low = start["row"] if number == start["segment"] else 0
            high = end["row"] if number == end["segment"] else None
            first = 0
            for name, n in files:
                a, b = max(low - first, 0), n if high is None else min(high - first, n)
                out += [InputPartition((f"{segment_path(self.log, number)}/{name}", i, min(i + self.per_task, b))) for i in range(a, b, self.per_task)]
                first += n
        self.planned = dict(end)
        self.notes = {k: v for k, v in self.notes.items() if k >= end["segment"]}
        # a query without a batch still wants a partition
        return out or [InputPartition(None)]

    def commit(self, end: dict) -> None:
        pass

    # ---- rows, in tasks
    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        path, first, last = partition.value
        target = to_arrow_schema(self.schema)
        fs, inner = pafs.FileSystem.from_uri(path)
        with fs.open_input_file(inner) as source:
            file = pq.ParquetFile(source, coerce_int96_timestamp_unit="us")
            held = set(file.schema_arrow.names)
            wanted, groups, at = [f.name for f in target if f.name in held], [], 0
            begin = None
            for g in range(file.num_row_groups):
                n = file.metadata.row_group(g).num_rows
                if at < last and at + n > first:
                    begin = at if begin is None else begin
                    groups.append(g)
                at += n
            at = begin or 0
            for batch in file.iter_batches(row_groups=groups, columns=wanted):
                low, high = max(first - at, 0), min(last - at, batch.num_rows)
                at += batch.num_rows
                if low < high:
                    rows = batch.slice(low, high - low)
                    yield pa.RecordBatch.from_arrays([rows.column(f.name).cast(f.type) if f.name in held else pa.nulls(rows.num_rows, f.type)
                                                      for f in target], schema=target)


def _read_text(path: str) -> str | None:
    fs, inner = pafs.FileSystem.from_uri(path)
    if fs.get_file_info(inner).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(inner) as f:
        return f.read().decode("utf-8")


def nullable(schema: StructType) -> StructType:
    """The schema with columns that may be null: a segment may lack them."""
    return StructType([StructField(f.name, f.dataType, True, f.metadata) for f in schema])


class CommitLog(DataSource):
    """``format("commit_log")`` with the options of ``read_commits``."""

    @classmethod
    def name(cls) -> str:
        return "commit_log"

    def schema(self) -> StructType:
        text = _read_text(f"{segment_path(self.options['path'], 0)}/{NOTE}")
        if text is None:
            raise PySparkException(f"no segment in {self.options['path']}: give a schema")
        return nullable(StructType.fromJson(json.loads(text)["schema"]))

    def streamReader(self, schema: StructType) -> CommitLogReader:
        return CommitLogReader(schema, dict(self.options))


def read_commits(spark: SparkSession, log: str, schema: StructType | None = None, max_rows_per_trigger: int | None = None) -> DataFrame:
    """The log as a stream.  ``schema`` (default: that of the first segment)
    picks columns by name; a column that a segment lacks is null there."""
    spark.dataSource.register(CommitLog)
    r = spark.readStream.format("commit_log").option("path", log)
    r = r.schema(nullable(schema)) if schema is not None else r
    return (r.option("maxRowsPerTrigger", str(max_rows_per_trigger)) if max_rows_per_trigger else r).load()
