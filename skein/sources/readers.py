"""Readers for dumps of discussions; every schema is stated, none inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DUMP = (
    "post struct<id:string,name:string,title:string,selftext:string,subreddit:string,created_utc:double,created:double>,"
    "comments array<struct<id:string,name:string,parent_id:string,author:string,body:string,created_utc:double,"
    "created:double,score:bigint,is_submitter:boolean>>"
)
TURN = (
    "type string, post_id string, n_turns bigint, position bigint, comment_id string, author string, alias string, body string,"
    "finish_reason string, response_model string, error string, n_chars bigint, shown_indices array<bigint>, truncated boolean"
)
HISTORY = "author string, n_records bigint, records array<struct<body:string,selftext:string,subreddit:string,link_id:string,name:string,id:string,title:string>>"


def dump(spark: SparkSession, path: str, least: int = 0, most: int | None = None) -> DataFrame:
    """Threads of a (zstd-compressed) JSON-lines dump with their cleaned comments.

    Bad lines are skipped; blank, removed and deleted comments are dropped; threads without
    comments, or with fewer than ``least`` or more than ``most``, are left out.
    """
    rows = spark.read.schema(DUMP).json(path).filter("post is not null")
    body = lambda c: F.regexp_replace(F.coalesce(c["body"], F.lit("")), r"(?U)^\s+|\s+$", "")
    clean = F.transform(
        F.filter(F.coalesce("comments", F.array()), lambda c: ~body(c).isin("", "[deleted]", "[removed]")),
        lambda c: F.struct(
            F.coalesce(c["id"], c["name"], F.lit("")).alias("id"), c["parent_id"].alias("parent_id"),
            F.coalesce(F.nullif(c["author"], F.lit("")), F.lit("[unknown]")).alias("author"), body(c).alias("body"),
            F.coalesce(c["created_utc"], c["created"], F.lit(0.0)).alias("created_utc"),
            F.coalesce(c["score"], F.lit(0)).alias("score"), F.coalesce(c["is_submitter"], F.lit(False)).alias("is_submitter"),
        ),
    )
    out = rows.select(
        F.coalesce("post.id", "post.name", F.lit("")).alias("post_id"), F.coalesce("post.title", F.lit("")).alias("title"),
        F.coalesce("post.selftext", F.lit("")).alias("selftext"), F.coalesce("post.subreddit", F.lit("")).alias("subreddit"),
        F.coalesce("post.created_utc", "post.created", F.lit(0.0)).alias("created_utc"), clean.alias("comments"),
    )
    n = F.size("comments")
    return out.filter((n > 0) & (n >= least) & (F.lit(True) if most is None else n <= most))


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file: the lines of (zstd-compressed) text files as they are, blank ones left out."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return rows.filter(F.length(F.trim("value")) > 0)


def thread_by_id(spark: SparkSession, path: str, post_id: str, least: int = 0) -> DataFrame:
    """The thread of one id, if the dump holds it; of repeated ones any."""
    return dump(spark, path, least).filter(F.col("post_id") == post_id).limit(1)


def strict_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON-lines files; a line that does not parse raises ValueError with file and line.

    A leading byte-order mark and blank lines are skipped. Lines are numbered only where one is bad.
    """
    bad = "_corrupt_record"
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("value"), F.col("_metadata.file_path").alias("file"))
    lines = lines.filter(F.trim("value") != "")
    rows = lines.select("file", "value", F.from_json("value", f"{schema}, {bad} string", {"columnNameOfCorruptRecord": bad}).alias("r"))
    first = rows.filter(F.col(f"r.{bad}").isNotNull()).select("file", "value").limit(1).collect()
    if first:
        raise ValueError(f"{first[0]['file']}:{_line_of(spark, first[0]['file'], first[0]['value'])}: invalid JSON")
    return rows.select("r.*").drop(bad)


def _line_of(spark: SparkSession, file: str, value: str) -> int:
    """Number of the first line of a file with this text; the file is read line by line, once."""
    for k, r in enumerate(spark.read.text(file).coalesce(1).toLocalIterator(), 1):
        if r["value"].lstrip("\ufeff") == value:
            return k
    return 0


def simulations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All JSON documents below a folder, one a file, with their file name; in order of name they are first to last."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("multiLine", True).option("pathGlobFilter", "*.json")
    return rows.json(path).select("*", F.col("_metadata.file_path").alias("file"))


def replay(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, turns) of simulated records: a ``meta`` line followed by turn lines.

    Both have file_id, the name of the file without its ending, which is the thread the file is for.
    A line that does not parse, such as one cut off at the end of a file, is left out.
    """
    rows = spark.read.text(path, wholetext=False).select(F.from_json("value", TURN).alias("r"), F.col("_metadata.file_name").alias("n"))
    rows = rows.withColumn("file_id", F.regexp_replace("n", r"\.[^.]*$", "")).filter("r is not null and (r.type = 'meta' or r.position is not null)")
    rows = rows.select("file_id", "r.*")
    return rows.filter("type = 'meta'").select("file_id", "post_id", "n_turns"), rows.filter("type is null").drop("type", "n_turns", "post_id")


def resume_at(headers: DataFrame, turns: DataFrame) -> DataFrame:
    """file_id, n_done, n_turns, next: where the generation of each thread goes on.

    Turns count up to the first gap in their positions, as what follows one cannot be relied on.
    """
    per = turns.groupBy("file_id").agg(F.array_sort(F.collect_set("position")).alias("p"))
    gap = F.array_position(F.transform("p", lambda x, i: (x == i).cast("int")), 0)
    done = F.when(gap > 0, gap - 1).otherwise(F.size("p")).cast("long")
    out = headers.groupBy("file_id").agg(F.max("n_turns").alias("n_turns")).join(per, "file_id", "left")
    n = F.coalesce(done, F.lit(0))
    return out.select("file_id", n.alias("n_done"), "n_turns", F.when(n < F.col("n_turns"), n).alias("next"))


def history(spark: SparkSession, path: str) -> DataFrame:
    """author, subreddit, post_id, body: the usable records of author histories."""
    r = spark.read.schema(HISTORY).json(path).select("author", F.explode("records").alias("r"))
    bare = lambda c: F.regexp_extract(c, "^t3_(.+)$", 1)
    post = F.coalesce(*[F.nullif(bare(F.col(f"r.{c}")), F.lit("")) for c in ("link_id", "name", "id")], F.col("r.id"))
    body = F.regexp_replace(F.coalesce(F.nullif("r.body", F.lit("")), F.col("r.selftext"), F.lit("")), r"(?U)^\s+|\s+$", "")
    out = r.select("author", F.col("r.subreddit").alias("subreddit"), post.alias("post_id"), body.alias("body"))
    return out.filter(~F.col("body").isin("", "[deleted]", "[removed]"))


def table_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header."""
    return spark.read.schema(schema).option("header", True).csv(path)
