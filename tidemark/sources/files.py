"""Whole-file sources and file writers.

Files are listed and read by tasks: Spark's own file sources keep the status
of every file, and a split for it, in the driver, which does not hold those of
millions of files.
"""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.materialize import materialize
from tidemark.sources.sink import write_distinct_files

LISTED = 10_000                    # files of one batch of a listing
READ_BYTES = 1 << 22               # text of one batch


def without_bom(content: str) -> Column:
    """A text without the byte order mark that may start a file."""
    return F.regexp_replace(content, "^\uFEFF", "")


def glob_pattern(glob: str) -> str:
    """A glob of Hadoop as a regular expression of whole names."""
    out, curly, in_set, i = [], 0, False, 0
    while i < len(glob):
        c = glob[i]
        if c == "\\":
            i += 1
            if i == len(glob):
                raise ValueError(f"missing escaped character in {glob!r}")
            c += glob[i]                    # as Hadoop passes it on
        elif in_set:
            c, in_set = "^" if c == "!" and glob[i - 1] == "[" else c, c != "]"
        elif c == "[":
            in_set = True
        elif c == "{":
            c, curly = "(?:", curly + 1
        elif c == "}" and curly:
            c, curly = ")", curly - 1
        elif c == "," and curly:
            c = "|"
        else:
            c = {"*": ".*", "?": "."}.get(c) or re.escape(c)
        out.append(c)
        i += 1
    if in_set or curly:
        raise ValueError(f"unclosed group in {glob!r}")
    return "(?sa)" + "".join(out)


def _hidden(name: str) -> bool:
    """Names that Spark's file sources pass over."""
    return name.startswith(".") or name.endswith("._COPYING_") or \
        (name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata")))


# Fixed value: characters that a path of Java's URIs holds as ``%XX``.
QUOTED_RE = re.compile(r"""[\x00-\x20\x7f-\xa0"#%<>?\[\\\]^`{|}\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]""")


def file_uri(path: str) -> str:
    """A path as Spark's file sources show it in ``_metadata.file_path``."""
    return QUOTED_RE.sub(lambda m: quote(m.group(), safe=""), path)


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a path as Hadoop writes it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(quote(path, safe="/:@"))


def _listed(glob: str | None):
    """Task: folders -> their entries that a scan sees."""
    names = re.compile(glob_pattern(glob)) if glob else None
    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("is_folder", pa.bool_())])

    def entries(path):
        fs, inner = _at(path)
        for e in fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True)):
            is_folder = e.type == pafs.FileType.Directory
            if not _hidden(e.base_name) and (is_folder or e.size and (names is None or names.fullmatch(e.base_name))):
                yield f"{path.rstrip('/')}/{e.base_name}", e.size or 0, is_folder

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = []
                for row in entries(path):
                    rows.append(row)
                    if len(rows) == LISTED:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
    return run


def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, size) of the files under ``root`` (which may be a pattern)
    whose names fit the glob.  Folder by folder, level by level, in tasks; the
    driver sees ``root`` and whether a level has folders.  A folder's entries
    are in the memory of one task."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = list(fs.globStatus(hadoop_path) or [])
    if not top:
        raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {root}.")
    fits = re.compile(glob_pattern(glob)) if glob else None
    files = [(s.getPath().toString(), s.getLen()) for s in top if s.isFile() and s.getLen() and (fits is None or fits.fullmatch(s.getPath().getName()))]
    levels = [spark.createDataFrame(files, "path string, size long")] if files else []
    folders = [s.getPath().toString() for s in top if s.isDirectory()]
    level = spark.range(1, numPartitions=1).select(F.explode(F.array(*map(F.lit, folders))).alias("path")) if folders else None
    while level is not None:
        found = materialize(level.mapInArrow(_listed(glob), "path string, size long, is_folder boolean"), "listing")
        levels.append(found.where("not is_folder").select("path", "size"))
        level = found.where("is_folder").select("path")
        # dealt one by one: a folder may hold most files
        level = None if level.isEmpty() else level.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return reduce(DataFrame.unionByName, levels) if levels else spark.createDataFrame([], "path string, size long")


def _read(batches):
    """Task: files -> their bytes, a few MB in a batch."""
    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.large_binary()).cast(pa.binary())],
                                          names=["file_path", "bytes"])

    for b in batches:
        rows, size = [], 0
        for path in b.column("path").to_pylist():
            fs, inner = _at(path)
            with fs.open_input_stream(inner) as f:              # names such as x.gz are read unpacked, as Spark does
                rows.append((file_uri(path), f.read()))
            size += len(rows[-1][1])
            if size > READ_BYTES:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)


def scan_whole_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """S1 + S2: one row per file under ``root`` (recursive), ``content`` the
    whole text, ``file_path`` as Spark's file sources name it.  The glob prunes
    at listing time, before any file is opened.  Files of no bytes, which the
    flow treats like missing ones, are passed over, as hidden ones are."""
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = list_files(spark, root, glob).select("path").repartition(n)          # paths only, dealt in turn
    df = files.mapInArrow(_read, "file_path string, bytes binary").select("file_path", F.col("bytes").cast("string").alias("value"))
    return df.select("file_path", without_bom("value").alias("content"))


# Fixed value: characters that a partition folder's name holds as ``%XX``.
ESCAPED_RE = r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]"""


def folder_name(column: str) -> Column:
    """The folder of a value as Spark's own partitioned writers name it."""
    c = F.col(column).cast("string")
    one = lambda x: F.when(x.rlike(ESCAPED_RE), F.concat(F.lit("%"), F.lpad(F.hex(x), 2, "0"))).otherwise(x)
    value = F.when(c.rlike(ESCAPED_RE), F.array_join(F.transform(F.split(c, ""), one), "")).otherwise(c)
    return F.concat(F.lit(f"{column}="), F.coalesce(F.nullif(value, F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__")))


def write_one_file_per_row(df: DataFrame, root: str, text_col: str, folder_col: str) -> None:
    """Write each row's text, ended by a newline, as its own file in a folder
    per ``folder_col`` value, through the file sink: Spark's text writer starts
    a process per file on a local disk and its commit moves one at a time.
    ``sink.write_files`` writes rows at paths of their own."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(text_col, folder_col).repartition(n)
    path = F.concat(folder_name(folder_col), F.lit("/part-"), F.monotonically_increasing_id().cast("string"), F.lit(".txt"))
    write_distinct_files(rows.select(path.alias("path"), F.concat(F.coalesce(F.col(text_col), F.lit("")), F.lit("\n")).alias("content")), root)
