"""Comments in reading order, their text windows, words and authors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.hierarchy import MAX_LOCAL_ROWS, hierarchies
from skein.operators.ordering import positions
from skein.session import cut

#: White space of any script, as Java knows it only by request.
SPACE = r"(?U)\s+"
STRIP = r"(?U)^\s+|\s+$"


def linearise(comments: DataFrame, max_local_rows: int = MAX_LOCAL_ROWS) -> DataFrame:
    """Add ``pos``: depth first, siblings by time and id, what no top comment leads to at the end.

    comments: post_id, id (unique in its post), parent_id (bare), to_post, created_utc and more.
    A comment is a top one if it names the post or nothing; one whose parent is missing, or that
    hangs on a circle or below such a comment, comes last by time and id. The comments of a post are
    walked in one task, other columns staying in Arrow; posts above ``max_local_rows`` are ordered
    by their paths instead, over many tasks and with the same outcome. An empty table gives none.
    """
    n = int(comments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = cut(comments.groupBy("post_id").count().filter(F.col("count") > max_local_rows).select("post_id"), "hot")
    schema = T.StructType([*comments.schema.fields, T.StructField("pos", T.LongType())])
    if hot.isEmpty():
        return comments.repartition(n, "post_id").sortWithinPartitions("post_id").mapInArrow(_preorder, schema)
    small = comments.join(hot, "post_id", "left_anti")
    large = _by_paths(cut(comments.join(hot, "post_id", "left_semi"), "large"))
    return small.repartition(n, "post_id").sortWithinPartitions("post_id").mapInArrow(_preorder, schema).unionByName(large)


def _preorder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by post_id with the position of each row; a post may span several batches."""
    held: list[pa.RecordBatch] = []
    now = None

    def give() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        post, ids, parents, to_post, times = (t.column(c).to_pylist() for c in ("post_id", "id", "parent_id", "to_post", "created_utc"))
        nulls_first = lambda k: (times[k] is not None, times[k] or 0.0, ids[k])
        order = sorted(range(len(ids)), key=nulls_first)
        children: dict[str, list[int]] = {}
        tops = []
        for k in reversed(order):  # so that the first comes off a stack first
            if to_post[k] or parents[k] is None or parents[k] == post[k]:
                tops.append(k)
            else:
                children.setdefault(parents[k], []).append(k)
        pos, seen, stack = [-1] * len(ids), 0, tops
        while stack:
            k = stack.pop()
            pos[k], seen = seen, seen + 1
            stack.extend(children.pop(ids[k], ()))
        for k in order:
            if pos[k] < 0:
                pos[k], seen = seen, seen + 1
        yield from t.append_column("pos", pa.array(pos, pa.int64())).combine_chunks().to_batches()

    for batch in batches:
        posts = batch.column(batch.schema.get_field_index("post_id")).to_pylist()
        start = 0
        for k in range(len(posts) + 1):
            if k == len(posts) or posts[k] != now:
                if k > start:
                    held.append(batch.slice(start, k - start))
                if k < len(posts):
                    if held:
                        yield from give()
                    held, now, start = [], posts[k], k
    if held:
        yield from give()


def _by_paths(comments: DataFrame) -> DataFrame:
    known = comments.select("post_id", "id", F.struct("created_utc", "id").alias("key"))
    up = F.when(F.coalesce("to_post", F.lit(False)), F.lit(None)).otherwise(F.col("parent_id"))
    nodes = hierarchies(comments, F.col("post_id"), F.col("id"), up)
    top = comments.filter(F.coalesce("to_post", F.lit(False)) | F.col("parent_id").isNull() | (F.col("parent_id") == F.col("post_id")))
    steps = nodes.filter("path is not null").select(F.col("scope").alias("post_id"), F.col("id").alias("of"), "root", F.posexplode("path").alias("k", "id"))
    steps = steps.join(top.select("post_id", F.col("id").alias("root")), ["post_id", "root"], "left_semi")
    ways = steps.join(known, ["post_id", "id"]).groupBy("post_id", "of").agg(F.array_sort(F.collect_list(F.struct("k", "key"))).alias("way"))
    ways = ways.select("post_id", F.col("of").alias("id"), F.transform("way", lambda s: s["key"]).alias("way"))
    rows = comments.join(ways, ["post_id", "id"], "left")
    own = F.array(F.struct("created_utc", "id"))
    rows = rows.withColumn("__way", F.coalesce("way", own)).withColumn("__late", F.col("way").isNull()).drop("way")
    out = positions(rows, "post_id", [F.col("__late"), F.col("__way")])
    return out.select(*comments.columns, "pos")


def lexical_growth(windows: DataFrame) -> DataFrame:
    """thread_id, total, growth: distinct words, and those that are new after the first window.

    A single window grows by its own vocabulary. windows: thread_id, win, text.
    """
    words = windows.select("thread_id", "win", F.explode(F.split(F.lower("text"), SPACE)).alias("w")).filter("w <> ''")
    first = words.groupBy("thread_id", "w").agg(F.min("win").alias("win"))
    n = windows.groupBy("thread_id").agg(F.count("*").alias("n"))
    g = first.groupBy("thread_id").agg(F.count("*").alias("total"), F.count_if(F.col("win") == 0).alias("start"))
    growth = F.when(F.col("n") == 1, F.col("total")).otherwise(F.col("total") - F.col("start"))
    return g.join(n, "thread_id").select("thread_id", "total", growth.alias("growth"))


def hash_embed(texts: DataFrame, dim: int = 256) -> DataFrame:
    """id, bucket, weight: the non-zero entries of deterministic bag-of-words vectors of length 1.

    A word's bucket comes from the first eight bytes of its SHA-256, read as a little-endian
    number, modulo ``dim``. Null texts and texts without words have no rows.
    """
    words = texts.select("id", F.explode(F.split(F.lower("text"), SPACE)).alias("w")).filter("w <> ''")
    # byte by byte from the highest, so that no step leaves the range of a long
    h, bucket = F.sha2("w", 256), F.lit(0).cast("long")
    for k in range(7, -1, -1):
        bucket = (bucket * 256 + F.conv(F.substring(h, 2 * k + 1, 2), 16, 10).cast("long")) % dim
    bucket = bucket.cast("int").alias("bucket")
    n = words.select("id", bucket).groupBy("id", "bucket").agg(F.count("*").alias("n"))
    size = n.groupBy("id").agg(F.sqrt(F.sum(F.pow("n", 2))).alias("size"))
    return n.join(size, "id").select("id", "bucket", (F.col("n") / F.col("size")).alias("weight"))


def hash_vectors(texts: DataFrame, dim: int = 256) -> DataFrame:
    """The columns of ``texts`` (id, unique, and text among them) and e: dense hashed vectors, zeros for no words."""
    held = hash_embed(texts, dim).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("__m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.coalesce(F.try_element_at("__m", k), F.lit(0.0)))
    nothing = F.array_repeat(F.lit(0.0), dim)
    return texts.join(held, "id", "left").withColumn("e", F.when(F.col("__m").isNull(), nothing).otherwise(dense)).drop("__m")


def post_text(title: Column, selftext: Column) -> Column:
    """The stripped title and, after a blank line, the stripped text of a post unless that is blank."""
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), STRIP, "")
    return F.concat_ws("\n\n", strip(title), F.nullif(strip(selftext), F.lit("")))


def clipped(text: Column, n: int) -> Column:
    """The text with white space collapsed, cut to at most ``n`` characters, at a word's end if one is there."""
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), "^ | $", "")
    head = F.substring(flat, 1, n)
    whole = F.when(head.contains(" "), F.regexp_replace(head, " [^ ]*$", ""))
    return F.when(F.length(flat) <= n, flat).otherwise(F.coalesce(F.nullif(whole, F.lit("")), F.trim(head)))


def unusable(title: Column) -> Column:
    """Whether a title says nothing: null, blank, or a note that it was removed or deleted."""
    return F.coalesce(title, F.lit("")).rlike(r"(?iU)^\s*$|^\[\s*(removed by moderator|removed|deleted)\s*\]\s*$")


# Authors that are no persons.
NOBODY = ("", "[deleted]", "[removed]", "AutoModerator")


def by_persons(rows: DataFrame, author: str = "author") -> DataFrame:
    """Rows whose author is known and no bot."""
    return rows.filter(F.col(author).isNotNull() & ~F.col(author).isin(*NOBODY))


def renumbered(rows: DataFrame, group: str = "post_id") -> DataFrame:
    """Rows with ``pos`` counted anew without gaps, in the order it had; for rows left by a filter."""
    old = rows.withColumnRenamed("pos", "__old")
    return positions(old, group, [F.col("__old")]).drop("__old")
