"""Parent-child rows to full hierarchies.

Rows of one scope (a post) are co-located when the scope is small enough for a task; a task
finds the connected components of each scope and walks every component depth first with node
colouring. Of scopes above ``max_local_rows`` the components are found by pointer doubling over
joins on the node id, in about log2(depth) rounds; each component is then co-located and walked
in the same way. Only a component that exceeds a task by itself gets its paths by doubling too.
All routes give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.session import cut, release

#: Rows of one scope that a single task may hold (some 100 bytes each in Python).
MAX_LOCAL_ROWS = 200_000

NODE_SCHEMA = T.StructType(
    [
        T.StructField("scope", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("path", T.ArrayType(T.StringType())),
        T.StructField("depth", T.LongType()),
        T.StructField("root", T.StringType()),
        T.StructField("n_descendants", T.LongType()),
        T.StructField("cycle_id", T.StringType()),
        T.StructField("back_edge", T.BooleanType()),
        T.StructField("below", T.ArrayType(T.StringType())),
    ]
)
#: Path entries that a task holds before it gives rows out; paths of a deep tree take far more.
FLUSH = 2_000_000

_ARROW = pa.schema(
    [
        ("scope", pa.string()),
        ("id", pa.string()),
        ("path", pa.list_(pa.string())),
        ("depth", pa.int64()),
        ("root", pa.string()),
        ("n_descendants", pa.int64()),
        ("cycle_id", pa.string()),
        ("back_edge", pa.bool_()),
        ("below", pa.list_(pa.string())),
    ]
)


def components(parent: list[int]) -> list[list[int]]:
    """Connected components of the graph node -> parent (-1: none), by union-find."""
    lead = list(range(len(parent)))

    def find(x: int) -> int:
        while lead[x] != x:
            lead[x] = lead[lead[x]]
            x = lead[x]
        return x

    for x, p in enumerate(parent):
        if p >= 0:
            a, b = find(x), find(p)
            if a != b:
                lead[a] = b
    groups: dict[int, list[int]] = {}
    for x in range(len(parent)):
        groups.setdefault(find(x), []).append(x)
    return list(groups.values())


def traverse(ids: list[str], parent: list[int], paths: bool = True) -> Iterator[tuple]:
    """(id, path, depth, root, n_descendants, cycle_id, back_edge, below) of every node.

    A component of a graph with one parent per node is either a tree (one node without a
    parent) or one circle with trees below it. Trees are walked from the root; in the others a
    walk up the parents colours nodes grey until it meets a grey one, which closes the circle,
    and what hangs on it is walked from the nodes next to the circle. One path is kept at a time.
    """
    children: list[list[int]] = [[] for _ in ids]
    for x, p in enumerate(parent):
        if p >= 0:
            children[p].append(x)
    for nodes in components(parent):
        on: set[int] = set()
        starts = [x for x in nodes if parent[x] < 0]
        if not starts:
            grey: dict[int, int] = {}
            x = nodes[0]
            while x not in grey:
                grey[x] = len(grey)
                x = parent[x]
            on = {y for y, k in grey.items() if k >= grey[x]}
            starts = [c for y in on for c in children[y] if c not in on]
        cycle = min((ids[y] for y in on), default=None)
        order, stack = [], list(starts)
        while stack:
            x = stack.pop()
            order.append(x)
            stack.extend(children[x])
        # every node of a circle lies below every other one and itself
        for y in on:
            yield ids[y], None, None, None, len(nodes) if paths else None, cycle, ids[y] == cycle, None
        if not paths:
            depth: dict[int, int] = {}
            for x in order:
                d = depth[x] = depth.get(parent[x], -1) + 1
                yield (ids[x], None, None, None, None, cycle, False, None) if on else (ids[x], None, d, ids[starts[0]], None, None, False, None)
            continue
        size = dict.fromkeys(order, 0)
        for x in reversed(order):
            if parent[x] in size:
                size[parent[x]] += size[x] + 1
        way: list[str] = []
        level = dict.fromkeys(starts, 0)
        for x in order:
            d = level.pop(x)
            del way[d:]
            way.append(ids[x])
            for c in children[x]:
                level[c] = d + 1
            if on:
                yield ids[x], None, None, None, size[x], cycle, False, list(way)
            else:
                yield ids[x], list(way), d, way[0], size[x], None, False, None


def _walk(paths: bool):
    """mapInArrow function over batches sorted by scope; a scope may span several batches."""

    def emit(scopes: list, rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [()] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([scopes, *cols], _ARROW.types)], schema=_ARROW)

    def finish(scope: str, least: dict) -> Iterator[pa.RecordBatch]:
        names, at = list(least), {x: k for k, x in enumerate(least)}
        link = [at.get(p, -1) if p is not None else -1 for p in least.values()]
        scope, rows, held = scope.split(_PART)[0], [], 0
        for row in traverse(names, link, paths):
            rows.append(row)
            held += 8 + len(row[1] or row[7] or ())
            if held > FLUSH:
                yield emit([scope] * len(rows), rows)
                rows, held = [], 0
        if rows:
            yield emit([scope] * len(rows), rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, least = None, {}
        for batch in batches:
            for s, i, p in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if s != now:
                    if least:
                        yield from finish(now, least)
                    now, least = s, {}
                other = least.get(i)
                least[i] = p if other is None or (p is not None and p < other) else other
        if least:
            yield from finish(now, least)

    return run


#: What parts a scope from the name of a component in keys.
_PART = "\u0001"


def _double(nodes: DataFrame, paths: bool) -> DataFrame:
    """Pointer doubling for scopes of any size; ``nodes`` has scope, id, parent."""
    known = cut(nodes.groupBy("scope", "id").agg(F.min("parent").alias("parent")), "nodes")
    there = known.select("scope", F.col("id").alias("parent"), F.lit(True).alias("there"))
    state = known.join(there, ["scope", "parent"], "left").select(
        "scope",
        "id",
        F.when(F.col("there"), F.col("parent")).alias("up"),
        F.when(F.col("there"), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("depth"),
        F.col("id").alias("least"),
        (F.array("id") if paths else F.lit(None).cast("array<string>")).alias("path"),
        F.when(F.col("there").isNull(), F.col("id")).alias("root"),
    )
    state = cut(state, "tree")
    open_before, total = -1, 0
    while True:
        left = state.filter(F.col("up").isNotNull()).count()
        if left == open_before or left == 0:
            break
        open_before = left
        total += 1
        state = _round(state, paths)
    # What is still open never ends: it hangs on a circle. A few more rounds make the pointers
    # of all of it lie on the circle and the running minimum span the circle.
    rounds = max(1, left.bit_length() + 1) if left else 0
    ring = cut(state.filter(F.col("up").isNotNull()), "ring") if left else state.filter(F.col("up").isNotNull())
    for _ in range(max(0, rounds - total)):
        ring = _round(ring, False)
    on = ring.select("scope", F.col("up").alias("id"), F.lit(True).alias("on")).distinct()
    least = ring.select("scope", F.col("id").alias("up"), F.col("least").alias("cycle_id"))
    circled = ring.join(least, ["scope", "up"]).join(on, ["scope", "id"], "left")
    circled = circled.select("scope", "id", "cycle_id", F.coalesce("on", F.lit(False)).alias("on"))
    if left and paths:
        circled = cut(circled, "circled")
        # without the circles, what hangs on them is trees; each circle holds its whole component
        hanging = known.join(circled.filter(~F.col("on")), ["scope", "id"], "left_semi")
        size = _double(hanging, True).select("scope", "id", "n_descendants", F.col("path").alias("below"))
        whole = circled.groupBy("scope", "cycle_id").agg(F.count("*").alias("whole"))
        circled = circled.join(size, ["scope", "id"], "left").join(whole, ["scope", "cycle_id"])
        circled = circled.withColumn("n_descendants", F.when(F.col("on"), F.col("whole")).otherwise(F.col("n_descendants")))
    else:
        circled = circled.withColumn("n_descendants", F.lit(None).cast("long")).withColumn("below", F.lit(None).cast("array<string>"))
    trees = state.filter(F.col("up").isNull())
    if paths:
        below = trees.select(
            "scope", F.explode(F.slice("path", 1, F.size("path") - 1)).alias("id")
        )
        below = below.groupBy("scope", "id").agg(F.count("*").alias("n_descendants"))
        trees = trees.join(below, ["scope", "id"], "left")
    else:
        trees = trees.withColumn("n_descendants", F.lit(None).cast("long"))
    out = trees.select(
        "scope", "id", "path", "depth", "root",
        (F.coalesce("n_descendants", F.lit(0)) if paths else F.col("n_descendants")).alias(
            "n_descendants"
        ),
        F.lit(None).cast("string").alias("cycle_id"), F.lit(False).alias("back_edge"), F.lit(None).cast("array<string>").alias("below"),
    )
    none = F.lit(None)
    return out.unionByName(
        circled.select(
            "scope", "id", none.cast("array<string>").alias("path"),
            none.cast("long").alias("depth"), none.cast("string").alias("root"),
            "n_descendants", "cycle_id",
            (F.col("on") & (F.col("id") == F.col("cycle_id"))).alias("back_edge"), "below",
        )
    )


def _round(state: DataFrame, paths: bool) -> DataFrame:
    far = state.select(
        "scope", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"),
        F.col("least").alias("l2"), F.col("root").alias("r2"), F.col("path").alias("p2"),
    )
    joined = state.filter(F.col("up").isNotNull()).join(far, ["scope", "up"])
    moved = joined.select(
        "scope",
        "id",
        F.col("up2").alias("up"),
        (F.col("depth") + F.col("d2")).alias("depth"),
        F.least("least", "l2").alias("least"),
        (F.concat("p2", "path") if paths else F.col("path")).alias("path"),
        F.col("r2").alias("root"),
    )
    out = cut(moved.unionByName(state.filter(F.col("up").isNull())), "tree")
    release(state)
    return out


def hierarchies(
    rows: DataFrame,
    scope: Column,
    node: Column,
    parent: Column,
    paths: bool = True,
    max_local_rows: int = MAX_LOCAL_ROWS,
) -> DataFrame:
    """One row per distinct (scope, node): path, depth, root, descendants or the circle it hangs on.

    * A parent counts only if it is a node of the same scope; null, the scope itself and absent
      parents end the chain, so such a node is a root of depth 0.
    * Rows with a null node are dropped; rows with a null scope form the scope null and take
      part like any other; repeated rows count once (of differing parents the least is kept).
    * Nodes on or below a circle get no path, depth or root but ``cycle_id``, the smallest id on
      the circle; ``back_edge`` marks the one node per circle whose parent link closes it.
      ``below`` is the path of a node below a circle from the node next to the circle on.
    * An empty table gives an empty result. Other columns of ``rows`` are ignored, whatever
      their names.
    * ``n_descendants`` of a node on a circle counts the whole component, itself included. Without
      ``paths`` it, ``path`` and ``below`` are null.
    """
    spark = rows.sparkSession
    slim = rows.select(
        F.coalesce(scope.cast("string"), F.lit("\u0000")).alias("scope"), node.cast("string").alias("id"), parent.cast("string").alias("parent"),
    ).filter(F.col("id").isNotNull())
    slim = slim.withColumn("parent", F.when(F.col("parent") != F.col("scope"), F.col("parent")))
    hot = cut(slim.groupBy("scope").count().filter(F.col("count") > max_local_rows).select("scope"), "hot")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def local(some: DataFrame) -> DataFrame:
        return some.repartition(n, "scope").sortWithinPartitions("scope").mapInArrow(_walk(paths), NODE_SCHEMA)

    if hot.isEmpty():
        out = local(slim)
    else:
        large = slim.join(hot, "scope", "left_semi")
        ends = _double(large, False).select("scope", "id", F.coalesce("cycle_id", "root").alias("part"))
        large = cut(large.join(ends, ["scope", "id"]), "parts")
        sizes = large.groupBy("scope", "part").agg(F.countDistinct("id").alias("n"))
        over = cut(sizes.filter(F.col("n") > max_local_rows).select("scope", "part"), "over")
        fits = large.join(over, ["scope", "part"], "left_anti").select(F.concat("scope", F.lit(_PART), "part").alias("scope"), "id", "parent")
        out = local(slim.join(hot, "scope", "left_anti").unionByName(fits))
        if not over.isEmpty():
            out = out.unionByName(_double(large.join(over, ["scope", "part"], "left_semi").drop("part"), paths))
    return out.withColumn("scope", F.when(F.col("scope") != "\u0000", F.col("scope")))


def descendants(nodes: DataFrame) -> DataFrame:
    """(scope, id, descendant_id, distance): every pair of a node and one below it.

    Made from the paths row by row, so no node's descendants are gathered in one place. Nodes on
    circles lie below themselves without end and take no part; nodes below circles do.
    """
    way = F.coalesce("path", "below")
    up = nodes.filter(way.isNotNull()).select(
        "scope", F.col("id").alias("descendant_id"), F.posexplode(F.slice(way, 1, F.size(way) - 1)).alias("k", "ancestor"), F.size(way).alias("n"),
    )
    return up.select("scope", F.col("ancestor").alias("id"), "descendant_id", (F.col("n") - 1 - F.col("k")).cast("long").alias("distance"))


def fullname_id(c: Column) -> Column:
    """``t1_abc`` -> ``abc``: the text after the first underscore, if there is one."""
    return F.regexp_replace(c, "^[^_]*_", "")
