"""Outcome routing and the composite flows.

R1 routes every changed file to exactly one outcome, first match wins:

``skipped_listed``, ``error`` (no readable source), ``skipped_interface``,
``error`` (no parser for the extension), ``no_public_methods``,
``no_affected_methods``, then - after the completion - ``error`` (client or
answer failure), ``empty_response``, ``auto_applied`` / ``needs_review``.

File-only outcomes are decided before the completion stage, and only the
rows still open are sent to it (Catalyst cannot push filters through a
``mapInPandas`` client, so the split is explicit).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.paths import (branch_name, commit_message, repo_path, staging_path,
                                      with_test_path)
from tidemark.functions.text import basename, blank_coalesce, changed_line_numbers, effective_loc, extension, is_blank, not_blank
from tidemark.operators import declarations as D
from tidemark.operators.completion import build_prompt, replay_completions
from tidemark.operators.filters import is_interface_file, skip_names
from tidemark.plans.materialize import materialize
from tidemark.plans.ordered import latest_per_key
from tidemark.session import scratch_scope

OUTCOMES = ("error", "skipped_listed", "skipped_interface", "no_public_methods", "no_affected_methods",
            "empty_response", "auto_applied", "needs_review")


# Messages of the parser factory.
def unsupported(ext) -> F.Column:
    return F.concat(F.lit("Parser for files with '"), ext, F.lit("' extension not supported."))


def not_implemented(ext) -> F.Column:
    return F.concat(ext, F.lit(" parsing is not implemented yet."))


def outcome_routing(changes: DataFrame, keys: Sequence[str], skip: DataFrame, threshold: int,
                    working_tree: DataFrame | None = None, src_folder: str = "src", tests_folder: str = "tests",
                    project_folder=None, **how) -> DataFrame:
    """R1 over change rows (keys..., file_path, old_content, new_content,
    existing_test, request_id).

    ``working_tree(path, content)``, the output of a whole-file scan, gives the
    source of a row without new content and the existing test of a row without
    one.  The texts are taken out once, by their hash; everything else is
    ``route_by_id``, which also says what ``how`` holds and what is returned.
    """
    c = changes.withColumn("has_new", not_blank("new_content"))
    if working_tree is not None:
        c = with_test_path(c, "file_path", "_test_path", F.lit(src_folder), F.lit(tests_folder), project_folder)
        for path, own in (("file_path", "new_content"), ("_test_path", "existing_test")):
            c = c.join(working_tree.select(F.col("path").alias(path), F.col("content").alias("_local")), path, "left")
            c = c.withColumn(own, blank_coalesce(own, "_local")).drop("_local")
        c = c.drop("_test_path")
    texts = {"old_id": "old_content", "new_id": "new_content", "test_id": "existing_test"}
    for i, text in texts.items():
        c = c.withColumn(i, F.when(not_blank(text), F.sha2(text, 256)))
    c = materialize(c, "changes")
    each = F.explode(F.array(*(F.struct(F.col(i).alias("id"), F.col(t).alias("content")) for i, t in texts.items())))
    distinct = c.select(each.alias("x")).select("x.*").where("id is not null").groupBy("id").agg(F.first("content").alias("content"))
    return route_by_id(c.drop(*texts.values()), materialize(distinct, "texts"), keys, skip, threshold, src_folder=src_folder,
                       tests_folder=tests_folder, project_folder=project_folder, **how)


def text_index(texts: DataFrame, threshold: int, outer: bool = False) -> tuple[DataFrame, DataFrame]:
    """Facts (id, iface, parsed, balanced, big) and declarations of
    ``texts(id, content[, parsed])``, both written (``outer``: to outlive the
    innermost ``scratch_scope``); ``parsed``: some file of this text has a
    parser (all, if the column is not there)."""
    t = texts if "parsed" in texts.columns else texts.withColumn("parsed", F.lit(True))
    # dealt, as in the scan: a few MB of texts in one file are minutes of work
    t = t.repartition(2 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    t = t.withColumn("iface", is_interface_file("content")).withColumn("parsed", F.col("parsed") & ~F.col("iface"))
    t = t.withColumn("balanced", F.when(F.col("parsed"), D.braces_balance("content")).otherwise(F.lit(True)))
    facts = t.withColumn("big", F.col("parsed") & (effective_loc("content") > F.lit(threshold)))
    facts = materialize(facts.select("id", "iface", "parsed", "balanced", "big"), "facts", outer)
    parsed = texts.join(facts.where("parsed and balanced").select("id"), "id", "left_semi")
    return facts, materialize(D.declarations(parsed, ["id"], with_text=False), "declarations", outer)


def route_by_id(changes: DataFrame, texts: DataFrame, keys: Sequence[str], skip: DataFrame, threshold: int,
                replay: DataFrame | None = None, completer=None, src_folder: str = "src",
                tests_folder: str = "tests", project_folder=None, sample=None,
                prompt_user: bool = True, staging_root: str | None = None, index: tuple[DataFrame, DataFrame] | None = None,
                per_row: Sequence[str] = (), prompt_as: Callable[[Column], Column] | None = F.col,
                code_as: Callable[[Column], Column] = F.col) -> DataFrame:
    """R1 over change rows that name their texts: (keys..., file_path, old_id,
    new_id, test_id, request_id[, has_new]) and ``texts(id, content)``; a null
    id is a missing or blank text.

    Every fact of a text (interface, balance, size, declarations) is worked
    out once per id, changed lines and context once per pair of ids of a large
    file, each distinct prompt is built once and each recorded answer parsed
    once.  ``prompt_as`` and ``code_as`` say what of a prompt and of an answer's
    code the rows get: the text itself, or what a function of the column gives,
    as a digest, so that the rows carry no texts; ``prompt_as`` None: nothing
    of the prompt.  ``index``: ``text_index`` of ``texts``, where it is kept.
    The folders, ``sample`` and ``prompt_user`` may be columns of the change
    rows (settings of their projects); ``per_row`` names those that ``sample``
    and ``prompt_user`` need.

    ``replay`` (J8) or ``completer`` (a function DataFrame -> DataFrame adding
    ``generated``/``completion_error``/``code``, e.g. U2) answers prompts.
    Returns keys, file_path, status, test_path, staging_path, prompt,
    generated_code, error.
    """
    keys = list(keys)
    fp = [] if "file_path" in keys else ["file_path"]
    names = skip_names(skip)
    c = changes if "has_new" in changes.columns else changes.withColumn("has_new", F.col("new_id").isNotNull())
    c = (c.join(names, F.lower(basename(F.col("file_path"))) == F.col("_skip_name"), "left")
          .withColumn("skipped", F.col("_skip_name").isNotNull()).drop("_skip_name"))
    routes = lambda df: df.withColumn("_ext", extension(F.col("file_path"))).withColumn("_route", D.language_route(F.col("_ext")))
    content = lambda i: texts.select(F.col("id").alias(i), F.col("content").alias(f"{i}_text"))
    pair = ["old_id", "new_id"]
    with scratch_scope(changes.sparkSession):
        # worked out once: what their texts are, facts, pairs and outcomes read the rows
        c = routes(materialize(c, "changes"))
        if index is None:                # of the texts that some row still needs
            wanted = c.where("not skipped and new_id is not null").groupBy(F.col("new_id").alias("id")) \
                      .agg(F.bool_or(F.col("_route") == "supported").alias("parsed"))
            index = text_index(texts.join(materialize(wanted, "wanted"), "id"), threshold, outer=True)
        facts, decls = index
        public = (decls.filter((F.col("kind") == "method") & F.col("is_public") & (F.col("parent_kind") == "class"))
                       .groupBy("id").agg(F.count(F.lit(1)).alias("n_public")))
        # written, as what is to be joined to all rows: of its known size, the rows stay where they are
        known = materialize(facts.join(public, "id", "left").withColumnRenamed("id", "new_id"), "known")
        c = c.join(known, "new_id", "left").withColumn("_large", F.coalesce(F.col("big") & F.col("has_new") & F.col("old_id").isNotNull(), F.lit(False)))

        # changed lines, affected methods and context per pair of texts of a large file
        large = c.where("_large and n_public > 0").select(*pair).distinct().join(content("old_id"), "old_id").join(content("new_id"), "new_id")
        large = large.withColumn("changed_lines", changed_line_numbers(F.col("old_id_text"), F.col("new_id_text"))).drop("old_id_text")
        large = materialize(large, "large", outer=True)
        of_large = decls.withColumnRenamed("id", "new_id").join(large.select(*pair), "new_id")
        hit = D.methods_around_lines(of_large, large, pair)
        ctx = D.context_assembly(of_large, large, hit, pair, content="new_id_text")
        n_hit = materialize(hit.groupBy(*pair).agg(F.count(F.lit(1)).alias("n_affected")), "hit")
        c = c.join(n_hit, pair, "left")

        route, ext = F.col("_route"), F.col("_ext")
        status = (F.when(F.col("skipped"), F.lit("skipped_listed"))
                  .when(F.col("new_id").isNull(), F.lit("error"))
                  .when(F.col("iface"), F.lit("skipped_interface"))
                  .when((route != "supported") | ~F.col("balanced"), F.lit("error"))
                  .when(F.coalesce(F.col("n_public"), F.lit(0)) == 0, F.lit("no_public_methods"))
                  .when(F.col("_large") & (F.coalesce(F.col("n_affected"), F.lit(0)) == 0), F.lit("no_affected_methods")))
        error = (F.when(F.col("status") != "error", F.lit(None).cast("string"))
                 .when(F.col("new_id").isNull(), F.lit("source file not found"))
                 .when(route == "unsupported", unsupported(ext))
                 .when(route == "not_implemented", not_implemented(ext))
                 .when(~F.col("balanced"), F.lit(D.UNBALANCED)))
        c = c.withColumn("status", status).withColumn("error", error)
        c = with_test_path(c, "file_path", "test_path", F.lit(src_folder), F.lit(tests_folder), project_folder)
        c = materialize(c.select(*keys, *fp, "request_id", "old_id", "new_id", "test_id", "_large", "status", "error", "test_path", *per_row), "routed", outer=True)

    nothing = F.lit(None).cast("string")
    done = c.filter(F.col("status").isNotNull()).select(*keys, *fp, "status", "test_path", nothing.alias("prompt"),
                                                        nothing.alias("generated_code"), "error")
    todo = c.filter(F.col("status").isNull()).drop("status", "error")
    # rows of the same texts and settings have the same prompt
    parts = ["old_id", "new_id", "test_id", *per_row]
    todo = todo.withColumn("old_id", F.when(F.col("_large"), F.col("old_id"))).drop("_large") \
               .withColumn("prompt_id", F.md5(F.to_json(F.struct(*parts))))
    asked = todo.select("prompt_id", *parts).distinct()
    code = F.when(F.col("old_id").isNotNull(), F.col("context")).otherwise(F.col("new_id_text"))
    prompts = asked.join(content("new_id"), "new_id").join(content("test_id"), "test_id", "left").join(ctx, pair, "left") \
                   .withColumn("prompt", build_prompt(code, F.coalesce("test_id_text", F.lit("")), sample))
    todo = todo.drop("old_id", "new_id", "test_id")
    shown = nothing if prompt_as is None else prompt_as("prompt")
    if completer is not None:
        answered = completer(todo.join(prompts.select("prompt_id", "prompt"), "prompt_id"))
        answered = answered.withColumn("_blank", is_blank("code")).withColumn("code", code_as("code")).withColumn("prompt", shown)
    else:
        replies = replay_completions(todo.select("request_id").distinct(), replay)
        replies = materialize(replies.select(F.col("request_id").alias("_asked"), "completion_error", is_blank("code").alias("_blank"), code_as("code").alias("code")), "replies")
        answered = todo.join(prompts.select("prompt_id", shown.alias("prompt")), "prompt_id") \
                       .join(replies, F.col("request_id").eqNullSafe(F.col("_asked")))
    final = (F.when(F.col("completion_error").isNotNull(), F.lit("error"))
             .when(F.col("_blank"), F.lit("empty_response"))
             .when(F.lit(prompt_user), F.lit("needs_review")).otherwise(F.lit("auto_applied")))
    answered = answered.select(*keys, *fp, final.alias("status"), "test_path", "prompt",
                               F.when(~F.col("_blank"), F.col("code")).alias("generated_code"),
                               F.col("completion_error").alias("error"))
    out = done.unionByName(answered)
    stage = nothing if staging_root is None else \
        F.when(F.col("generated_code").isNotNull(), staging_path(F.col("test_path"), F.lit(staging_root)))
    return out.withColumn("staging_path", stage)


def outcome_ledger(routed: DataFrame) -> DataFrame:
    """Rows per outcome (a partial aggregate)."""
    return routed.groupBy("status").agg(F.count(F.lit(1)).alias("n_files"))


RESULT_BUCKETS = 32


class ConcurrentWriter(RuntimeError):
    """Another writer holds the results table."""


@contextmanager
def _only_writer(spark, path: str, owner: str):
    """Hold the table's lock file, made in one step by the file system.  The
    lock of the same owner is taken over: it is what a failed attempt left."""
    hadoop = spark._jvm.org.apache.hadoop
    lock = hadoop.fs.Path(f"{path}/_writer")
    fs = lock.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        out = fs.create(lock, False)
        out.writeBytes(owner)
        out.close()
    except Py4JJavaError as e:
        if not fs.exists(lock):
            raise
        held = fs.open(lock)
        try:
            other = bytes(held.readAllBytes()).decode()
        finally:
            held.close()
        if other != owner:
            raise ConcurrentWriter(f"{path} is being written by {other}") from e
    try:
        yield
    finally:
        fs.delete(lock, False)


def current_results(spark, path: str) -> DataFrame | None:
    """The results table; None before the first write."""
    try:
        return spark.read.parquet(path).drop("bucket")
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def upsert_results(results: DataFrame, order: Sequence[str], path: str | None = None,
                   key: str = "test_path", owner: str | None = None, buckets: int = RESULT_BUCKETS) -> DataFrame:
    """Last write wins per test path - the newest row per key (a partial
    ``max_by`` aggregate).  With ``path`` the rows are merged into the table
    there, which is laid out in hash buckets of the key: only buckets that
    hold a key of ``results`` are read and written again (dynamic partition
    overwrite: new files first, then the bucket's folder is replaced).  Keys
    that are not in ``results`` stay, and the same rows a second time change
    nothing.  One writer at a time: a second ``owner`` gets ConcurrentWriter,
    the same owner goes on after a failure.  ``buckets`` belongs to the table
    and must stay as it was at the first write."""
    cols = [c for c in results.columns if c != key]
    if path is None:
        return latest_per_key(results, [key], list(order), cols)
    spark = results.sparkSession
    with _only_writer(spark, path, owner or uuid.uuid4().hex), scratch_scope(spark):
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        rows = materialize(latest_per_key(results, [key], list(order), cols).withColumn("bucket", bucket), "upsert")
        touched = sorted(r[0] for r in rows.select("bucket").distinct().collect())      # at most ``buckets`` numbers
        before = current_results(spark, path)
        if before is not None:
            old = spark.read.parquet(path).where(F.col("bucket").isin(touched))
            rows = latest_per_key(old.select(*rows.columns).unionByName(rows), [key], list(order), [*cols, "bucket"])
        (rows.repartition(min(buckets, len(touched) or 1), "bucket").write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))
    return current_results(spark, path)


def upsert_writer(path: str, order: Sequence[str], key: str = "test_path", owner: str = "stream"):
    """S7 for a stream: a ``foreachBatch`` function.  A batch that is replayed
    merges to the same table."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        upsert_results(batch, order, path, key, owner)
    return write


# Title and body of a review request.
REVIEW_TITLE = "Automated Test Update"
REVIEW_BODY = "This PR was generated automatically to add/update unit tests for modified files."


def change_set_manifest(routed: DataFrame, runs: DataFrame, prefix: str, base_branch: str = "main",
                        run: Sequence[str] = ("run_ts",)) -> DataFrame:
    """One branch off ``base_branch`` per run of a commit (``runs``: repo,
    sha and the columns ``run`` that tell the runs of a repository apart, the
    first being the run's time, which names the branch), and one commit per
    file with generated code: path, content, message.  Kept as one row per
    file (a commit with a third of all files must not become one array in one
    task).  All runs of a commit have its files, so these are counted once per
    commit, by a partial aggregate over narrow rows."""
    files = routed.filter(F.col("generated_code").isNotNull())
    counts = files.groupBy("repo", "sha").agg(F.count(F.lit(1)).alias("n_files"))
    r = runs.select("repo", "sha", *run).join(counts, ["repo", "sha"])
    branch = branch_name(F.lit(prefix), F.col(run[0])).alias("branch")          # after the joins, which need not carry it
    return (files.join(r, ["repo", "sha"])
                 .select("repo", "sha", *run, branch, F.lit(base_branch).alias("base_branch"), "file_path", repo_path(F.col("test_path")).alias("test_path"),
                         F.col("generated_code").alias("content"), commit_message(F.col("file_path")).alias("message"), "n_files"))


def review_requests(manifest: DataFrame, run: Sequence[str] = ("run_ts",)) -> DataFrame:
    """One review request per run (a partial aggregate)."""
    return (manifest.groupBy("repo", *run, "branch", "base_branch").agg(F.count(F.lit(1)).alias("n_files"))
                    .withColumn("title", F.lit(REVIEW_TITLE)).withColumn("body", F.lit(REVIEW_BODY)))
