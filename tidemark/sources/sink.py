"""File sink: one text file per row at the row's own path.

A Python data source writer with Spark's commit protocol.  A task attempt
writes its files under ``{root}/_staged/<write>/<attempt>`` with a list of
them; the driver's commit moves the files of the attempts that Spark chose to
their paths, one part of a list after the other, and then takes the staging folder away.
Attempts that fail and writes that are aborted leave nothing at any path; tasks
that still run while a write is aborted may leave staged files, which scans
pass over and ``clear_staging`` takes away.
Moves are single steps where the file system has them (as HDFS and local
disks); a commit that is cut short leaves whole files, and the same write a
second time gives the same files.
"""

from __future__ import annotations

import io
import json
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STAGED = "_staged"
MOVERS = 32
MOVED = 10_000                     # files of a list that are in memory at a time


def inner_path(path: str | None) -> str:
    """``path`` with ``/`` between its parts; an error unless it is in normal
    form (no empty, ``.`` or ``..`` part) and stays below its root."""
    clean = (path or "").replace("\\", "/")
    parts = clean.split("/")
    if any(p in ("", ".", "..") for p in parts) or parts[0] == STAGED or ":" in parts[0]:
        raise ValueError(f"not a path below the root: {path!r}")
    return clean


def staged_files(listing: str | None) -> WriterCommitMessage:
    """Where an attempt's list is (none: no rows).  The message is of Spark's
    own class, as the driver may unpickle it without this package."""
    message = WriterCommitMessage()
    message.listing = listing
    return message


def clear_staging(root: str) -> None:
    """Take away what aborted writes have staged; run it when none is writing."""
    fs, base = pafs.FileSystem.from_uri(root)
    folder = f"{base.rstrip('/')}/{STAGED}"
    if fs.get_file_info(folder).type == pafs.FileType.Directory:
        fs.delete_dir(folder)


class TextFilesWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.write_id = root, uuid.uuid4().hex

    def _at(self) -> tuple[pafs.FileSystem, str]:
        fs, base = pafs.FileSystem.from_uri(self.root)
        return fs, base.rstrip("/")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        fs, base = self._at()
        folder = f"{base}/{STAGED}/{self.write_id}/{uuid.uuid4().hex}"
        listing = f"{folder}/list"
        fs.create_dir(folder, recursive=True)
        n = 0
        try:
            with fs.open_output_stream(listing) as names:
                for path, content in iterator:
                    target = inner_path(path)
                    with fs.open_output_stream(f"{folder}/{n}") as out:
                        out.write((content or "").encode("utf-8"))
                    names.write((json.dumps(target) + "\n").encode("utf-8"))
                    n += 1
        except BaseException:
            fs.delete_dir(folder)
            raise
        return staged_files(listing if n else None)

    def commit(self, messages: list) -> None:
        fs, base = self._at()

        made: set[str] = set()

        def move(staged: str, target: str) -> None:
            folder = posixpath.dirname(f"{base}/{target}")
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            fs.move(staged, f"{base}/{target}")

        with ThreadPoolExecutor(MOVERS) as pool:
            for m in messages:
                if m is not None and m.listing:
                    folder = posixpath.dirname(m.listing)
                    with fs.open_input_stream(m.listing) as f, io.TextIOWrapper(f, "utf-8", newline="\n") as lines:
                        numbered = enumerate(lines)
                        # a part at a time: this is the driver
                        while part := list(islice(numbered, MOVED)):
                            for _ in pool.map(move, (f"{folder}/{i}" for i, _ in part), (json.loads(line) for _, line in part)):
                                pass
        self._clear(fs, base)

    def abort(self, messages: list) -> None:
        self._clear(*self._at())

    def _clear(self, fs: pafs.FileSystem, base: str) -> None:
        folder = f"{base}/{STAGED}/{self.write_id}"
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)


class TextFiles(DataSource):
    """``format("text_files")``: rows (path, content) as files below the
    option ``root``; files at other paths stay."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool) -> TextFilesWriter:
        return TextFilesWriter(self.options["root"])


def write_files(df: DataFrame, root: str, path: str = "path", content: str = "content") -> None:
    """Write each row's ``content`` (null: empty) as UTF-8 to its own ``path``
    below ``root``, replacing what is there.  Paths must be distinct (as in
    the results table): a repeated one, a null one or one that leaves the
    root is an error, and nothing is written."""
    rows = df.select(F.col(path).alias("path"), F.col(content).alias("content"))
    twice = rows.groupBy(F.replace("path", F.lit("\\"), F.lit("/")).alias("p")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if twice is not None:
        raise ValueError(f"{twice['n']} rows for the path {twice['p']!r}")
    write_distinct_files(rows, root)


def write_distinct_files(rows: DataFrame, root: str) -> None:
    """``write_files`` of rows (path, content) whose paths are known to be distinct."""
    rows.sparkSession.dataSource.register(TextFiles)
    rows.write.format("text_files").mode("append").option("root", root).save()
