"""Driver tables and the roles they play.

The tool this engine re-creates reads file snapshots, change events, commit
logs and completion answers.  The benchmark tables are mapped onto those
roles by fixed rules, written once here (Spark) and once in
``tidemark.plans.oracle`` (SQL):

=================  ============================================================
role               mapping
=================  ============================================================
file versions      ``documents``: path = ``source``, version = ``doc_id``
code files         ``documents`` rendered through the C# template in
                   ``tidemark.sources.corpus`` (whole text, one line each)
file events        ``events``: path = ``user_id``, ``signup`` = rename
commits            ``orders``: repo = ``o_custkey``, sha = ``o_orderkey``,
                   committed_at = ``o_orderdate``; parent = previous order of
                   the same customer
changed files      ``lineitem``: path from part key and line number
blobs              code file of document ``l_partkey`` at (repo, sha, path)
completions        ``conversations``: assistant turns wrapped by a fixed rule
approvals          ``labels``: quality 1 = yes
=================  ============================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.ordered import with_neighbour
from tidemark.sources.corpus import code_template

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# The settings the source tool ships with.
SKIP_FILES = ["Program.cs", "Startup.cs", "AssemblyInfo.cs", "GlobalUsings.cs", "Usings.cs"]
SRC_FOLDER = "src"
TESTS_FOLDER = "tests"
CODE_EXTENSION = ".cs"
BRANCH_PREFIX = "auto/test-update-"
MAIN_BRANCH = "main"
LARGE_FILE_LINES = 300


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def skip_list(spark: SparkSession, names=None) -> DataFrame:
    """Skip list as a one-column table (a settings-sized parameter)."""
    # literals: a table from Python rows starts Python workers on all cores for five names
    names = F.array(*map(F.lit, names or SKIP_FILES))
    return spark.range(1, numPartitions=1).select(F.explode(names).alias("file_name"))


# --------------------------------------------------------------------------- file versions
def file_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("path"), F.col("doc_id").alias("version"),
                    F.col("text").alias("content"))


def code_file_name(source) -> F.Column:
    """One file per source folder; folders ending in 7 hold a skip-listed name."""
    return F.when(source.endswith("7"), F.lit("Program.cs")).otherwise(F.lit("Service.cs"))


def code_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of C# files: one path per ``source``, one version per doc."""
    d = read_table(spark, sf_dir, "documents")
    src = F.col("source")
    return d.select(
        F.concat(F.lit("src/"), src, F.lit("/"), code_file_name(src)).alias("file_path"),
        F.col("doc_id").alias("version"),
        code_template(F.col("doc_id"), src, F.col("lang"), F.col("n_chars"), F.col("text")).alias("content"),
    )


# --------------------------------------------------------------------------- events
def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"),
        F.col("ts"),
        F.col("event_id"),
        F.when(F.col("event_type") == "signup", F.lit("rename")).otherwise(F.lit("change")).alias("event_type"),
        F.col("props").alias("content"),
    )


# --------------------------------------------------------------------------- commits
def commit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, branch, commit_key, sha, committed_at) without parents."""
    return read_table(spark, sf_dir, "orders").select(
        F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("repo"),
        F.lit(MAIN_BRANCH).alias("branch"),
        F.col("o_orderkey").alias("commit_key"),
        F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("sha"),
        F.col("o_orderdate").alias("committed_at"),
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, branch, sha, committed_at, parents).  The first parent is the
    previous order of the same customer, found with the skew-safe
    neighbour plan (one customer may hold a third of all orders)."""
    o = commit_rows(spark, sf_dir)
    o = with_neighbour(o, ["repo"], "committed_at", ["sha"], tiebreak=["commit_key"], prefix="parent_")
    return o.select("repo", "branch", "sha", "commit_key", "committed_at",
                    F.when(F.col("parent_sha").isNull(), F.array().cast("array<string>"))
                    .otherwise(F.array(F.col("parent_sha"))).alias("parents"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, project_path, settings): every customer's repository is a
    project; in every second one a quarter of the folders m0 to m39 are
    projects of their own."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey")
    repo = F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("repo")
    none = F.lit(None).cast("string")
    whole = c.select(repo, F.lit("").alias("project_path"), F.lit(SRC_FOLDER).alias("src_folder"), F.lit(TESTS_FOLDER).alias("tests_folder"),
                     none.alias("sample"), provider_of(F.col("c_custkey")).alias("provider"), F.lit(False).alias("background"))
    m = c.where("c_custkey % 2 = 0").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("m")).where("(c_custkey + m) % 4 = 0")
    own = m.select(repo, F.concat(F.lit("src/m"), "m").alias("project_path"), F.lit("").alias("src_folder"), F.lit("unit").alias("tests_folder"),
                   F.concat(F.lit("// sample of m"), "m").alias("sample"), provider_of(F.col("m")).alias("provider"), F.lit(True).alias("background"))
    return whole.unionByName(own)


def _line_path(partkey, linenumber) -> F.Column:
    folder = F.concat(F.lit("m"), F.pmod(partkey, F.lit(40)).cast("string"))
    part = F.concat(F.lit("Part"), partkey.cast("string"))
    src = F.concat(F.lit("src/"), folder, F.lit("/"))
    return (F.when(linenumber == 4, F.concat(src, part, F.lit(".CS")))
            .when(linenumber == 5, F.concat(src, part, F.lit(".txt")))
            .when(linenumber == 6, F.concat(F.lit("tests/"), folder, F.lit("/"), part, F.lit("Tests.cs")))
            .when(linenumber == 7, F.concat(src, F.lit("Program.cs")))
            .otherwise(F.concat(src, part, F.lit(".cs"))))


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, sha, file_path, status, additions, deletions, l_partkey, l_linenumber),
    one row per path and commit."""
    # a commit lists a path once: the line item that sorts last (line numbers
    # repeat in the data, so the whole row is the order).  Line items are dealt
    # once, by commit, for the aggregate and for the join with orders; paths are
    # made after that, of the numbers that tell them apart
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"]
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", *order).repartition("l_orderkey")
    last = F.max(F.struct(*order)).alias("f")
    line, part = F.col("l_linenumber"), F.col("l_partkey")
    kind = F.when(part.isNull(), F.lit(-1)).when(line.isin(4, 5, 6, 7), line).otherwise(F.lit(0))
    named = F.when(line == 7, F.pmod(part, F.lit(40))).otherwise(part)
    lines = li.groupBy("l_orderkey", kind.alias("kind"), named.alias("named")).agg(last) \
              .withColumn("file_path", _line_path(F.col("f.l_partkey"), F.col("f.l_linenumber")))
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    flag = F.col("f.l_returnflag")
    return lines.join(o, lines["l_orderkey"] == o["o_orderkey"]).select(
        F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("repo"),
        F.concat(F.lit("c"), F.col("l_orderkey").cast("string")).alias("sha"),
        "file_path",
        F.when(flag == "R", F.lit("removed")).when(flag == "A", F.lit("added")).otherwise(F.lit("modified")).alias("status"),
        F.col("f.l_quantity").cast("int").alias("additions"),
        F.col("f.l_linenumber").alias("deletions"),
        "f.l_partkey", "f.l_linenumber")


def blob_ids(spark: SparkSession, sf_dir: str, files: DataFrame | None = None) -> DataFrame:
    """File content at (repo, sha, path) as the id of its text: the code file of
    document ``l_partkey`` (counted round the documents) for every file a commit
    did not remove.  ``files``: ``commit_files`` where it is written already."""
    cf = (commit_files(spark, sf_dir) if files is None else files).filter(F.col("status") != "removed")
    d = read_table(spark, sf_dir, "documents").select("doc_id")
    last = d.agg(F.max("doc_id")).first()[0] or 0
    return (cf.withColumn("doc_id", F.pmod("l_partkey", F.lit(last + 1))).join(d, "doc_id", "left_semi")
              .select("repo", "sha", "file_path", F.col("doc_id").cast("string").alias("content")))


def code_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, content): the code file of every document."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"),
                    code_template(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text")).alias("content"))


# --------------------------------------------------------------------------- completions
def completion_text(conv_id, turn, text) -> F.Column:
    """Wrap an assistant turn by a fixed rule into fenced / think / plain /
    blank answers."""
    k = F.pmod(conv_id + turn, F.lit(5))
    return (F.when(k == 0, F.concat(F.lit("Here is the code:\n```csharp\n"), text, F.lit("\n```\nDone.")))
            .when(k == 1, F.concat(F.lit("<think>"), text, F.lit("</think>\n```\n"), text, F.lit("\n```")))
            .when(k == 2, text)
            .when(k == 3, F.lit("   "))
            .otherwise(F.concat(F.lit("<think>plan</think>  "), text, F.lit("  "))))


def provider_of(number) -> F.Column:
    """The provider is a setting of the project; projects take turns."""
    k = F.pmod(number, F.lit(3))
    return F.when(k == 0, F.lit("openai")).when(k == 1, F.lit("ollama")).otherwise(F.lit("azure"))


def request_of(spark: SparkSession, sf_dir: str, number) -> F.Column:
    """Request id of file ``number``: turn 1 of a conversation, dealt over all
    conversations and as many again by a tenth, which no answer has."""
    last = read_table(spark, sf_dir, "conversations").agg(F.max("conv_id")).first()[0] or 0
    return F.concat(F.pmod(number, F.lit((last + 1) * 11 // 10 + 1)).cast("string"), F.lit(":1"))


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay table (request_id, provider, http_status, body): every
    assistant turn is the answer to request ``{conv_id}:{turn}``; provider
    and status follow fixed rules."""
    c = read_table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    answer = completion_text(F.col("conv_id"), F.col("turn"), F.col("text"))
    provider = provider_of(F.col("conv_id"))
    status = F.when(F.pmod(F.col("conv_id"), F.lit(17)) == 5, F.lit(400)).otherwise(F.lit(200))
    body = (F.when(provider == "openai",
                   F.when(F.pmod(F.col("conv_id"), F.lit(19)) == 7, F.lit('{"choices":[]}'))
                   .otherwise(F.to_json(F.struct(F.array(F.struct(answer.alias("text"))).alias("choices")))))
            .when(provider == "ollama", F.to_json(F.struct(answer.alias("response"))))
            .otherwise(F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), answer.alias("text"))).alias("content")))))
    return c.select(F.concat_ws(":", "conv_id", "turn").alias("request_id"),
                        provider.alias("provider"), status.alias("http_status"), body.alias("body"))


def working_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): one C# file per document, and the test file of every
    fourth."""
    d = read_table(spark, sf_dir, "documents")
    name = F.concat("source", F.lit("/Doc"), "doc_id")
    code = d.select(F.concat(F.lit("src/"), name, F.lit(".cs")).alias("path"),
                    code_template(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text")).alias("content"))
    return code.unionByName(d.where(F.pmod("doc_id", F.lit(4)) == 0).select(
        F.concat(F.lit("tests/"), name, F.lit("Tests.cs")).alias("path"), F.concat(F.lit("// tests of "), "doc_id").alias("content")))


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, answer): quality 1 answers ``Yes``, 0 answers ``n``."""
    lab = read_table(spark, sf_dir, "labels")
    return lab.select("doc_id", F.when(F.col("quality") == 1, F.lit("Yes")).otherwise(F.lit("n")).alias("answer"))
