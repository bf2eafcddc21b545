"""Lines that a page shares with the page nearest to it by URL, deleted.

Pages of one host are put in the order of their paths; of the two pages next to it a page is paired
with the one whose path shares more leading segments. The lines of the pair are aligned by their
longest common subsequence, and the lines in it are what the site adds to every page.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.ordering import positions

#: A link to a page: host and path.
URL = r"https?://([^/\s\"'<>()\[\]]+)(/[^\s\"'<>()\[\]?#]*)"


def common(a: list[str], b: list[str]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``: increasing matches, by piles."""
    at: dict[str, list[int]] = {}
    for j, line in enumerate(b):
        at.setdefault(line, []).append(j)
    tops: list[int] = []  # the least end in b of a common subsequence of each length
    nodes: list[tuple[int, int]] = []  # (place in a, node before)
    pile: list[int] = []  # the node on top of each pile
    for i, line in enumerate(a):
        for j in reversed(at.get(line, ())):
            k = bisect_left(tops, j)
            nodes.append((i, pile[k - 1] if k else -1))
            if k == len(tops):
                tops.append(j)
                pile.append(len(nodes) - 1)
            else:
                tops[k], pile[k] = j, len(nodes) - 1
    out, n = [], pile[-1] if pile else -1
    while n >= 0:
        out.append(nodes[n][0])
        n = nodes[n][1]
    return out[::-1]


def closeness(a: str, b: str) -> int:
    """Leading path segments that two paths share."""
    n = 0
    for x, y in zip(a.strip("/").split("/"), b.strip("/").split("/")):
        if x != y:
            break
        n += 1
    return n


def without_shared(pages: DataFrame, key: str, host: str, path: str, text: str) -> DataFrame:
    """(key, text, n_lines, n_shared): each page without the lines it shares with its nearest page.

    Blank lines are not aligned and stay. A page alone on its host, or of a null host, path or text,
    keeps all lines; repeated keys are pages of their own. Hosts of any size are split over tasks.
    An empty table gives none; other columns are dropped.
    """
    slim = pages.select(F.col(key).alias("k"), F.col(host).alias("h"), F.coalesce(F.col(path), F.lit("")).alias("p"), F.col(text).alias("t"))
    known = slim.filter("h is not null and t is not null")
    order = positions(known.withColumn("o", F.xxhash64("k", "t")), "h", [F.col("p"), F.col("k").cast("string"), F.col("o")], "n").drop("o")
    cols = ["h", "n", "p", "t"]
    near = lambda d, s: order.select(F.col("h"), (F.col("n") + d).alias("n"), F.col("p").alias(f"p{s}"), F.col("t").alias(f"t{s}"))
    pair = order.join(near(1, 0), ["h", "n"], "left").join(near(-1, 1), ["h", "n"], "left").select("k", *cols[2:], "p0", "t0", "p1", "t1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, t, p0, t0, p1, t1 in zip(*(batch.column(k).to_pylist() for k in range(1, 7))):
                other = t0 if t1 is None or (t0 is not None and closeness(p, p0) >= closeness(p, p1)) else t1
                lines = t.split("\n")
                full = [k for k, x in enumerate(lines) if x.strip()]
                gone = set()
                if other is not None:
                    mine = [lines[k].strip() for k in full]
                    gone = {full[k] for k in common(mine, [x.strip() for x in other.split("\n") if x.strip()])}
                rows.append(("\n".join(x for k, x in enumerate(lines) if k not in gone), len(full), len(gone)))
            out = list(zip(*rows)) if rows else [[]] * 3
            kinds = [pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(out, kinds)]], ["k", "text", "n_lines", "n_shared"])

    schema = T.StructType([pair.schema["k"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_shared", T.LongType())])
    done = pair.mapInArrow(run, schema)
    lines = F.size(F.filter(F.split("t", "\n"), lambda x: F.length(F.trim(x)) > 0)).cast("long")
    rest = slim.filter("h is null or t is null").select("k", F.col("t").alias("text"), F.when(F.col("t").isNotNull(), lines).otherwise(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_shared"))
    return done.unionByName(rest).withColumnRenamed("k", key)


def first_link(text: str) -> tuple:
    """(host, path) columns of the first link in a text; null without one."""
    host, path = F.regexp_extract(text, URL, 1), F.regexp_extract(text, URL, 2)
    return F.when(host != "", F.lower(host)), F.when(host != "", path)
