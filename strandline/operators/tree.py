"""Trees over collections of sketches: positions, summaries, pruned search, and clustering into a binary tree.

A tree is two tables by position: nodes and leaves. Position 0 is the root; a node's children follow from its
position and the tree's arity.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import bloom
from strandline.operators.compare import count_common, jaccard, mismatch
from strandline.operators.sketch import exploded

#: Clustering chooses pairs on the driver from overlaps found by Spark; beyond this many sketches it would not fit.
MOST_LEAVES = 10_000


def parent(pos: Column, d: int = 2) -> Column:
    """The parent's position; null of the root."""
    return F.when(pos > 0, F.floor((pos - 1) / d).cast("bigint"))


def child(pos: Column, c: int, d: int = 2) -> Column:
    """The position of child ``c``, counted from 0."""
    return (pos * d + c + 1).cast("bigint")


def children(pos: Column, d: int = 2) -> Column:
    """The positions of all ``d`` children."""
    return F.array(*(child(pos, c, d) for c in range(d)))


def ancestors(leaves: DataFrame, d: int = 2) -> DataFrame:
    """``leaves`` (pos) with a row for each position above each leaf, in ``ancestor``."""
    depth, widest = 0, leaves.agg(F.max("pos")).first()[0] or 0
    while widest > 0:
        widest, depth = (widest - 1) // d, depth + 1
    ups, at = [], F.col("pos")
    for _ in range(depth):
        at = parent(at, d)
        ups.append(at)
    return leaves.withColumn("ancestor", F.explode(F.filter(F.array(*ups, F.lit(None).cast("bigint")), lambda p: p.isNotNull())))


def min_n_below(leaves: DataFrame, d: int = 2) -> DataFrame:
    """(pos, min_n_below): the least sketch size under each node. leaves: pos, sketch."""
    sized = leaves.select("pos", F.size("sketch.mins").cast("bigint").alias("n"))
    return ancestors(sized, d).groupBy(F.col("ancestor").alias("pos")).agg(F.min("n").alias("min_n_below"))


def node_filters(leaves: DataFrame, tables=bloom.DEFAULT_TABLES, d: int = 2) -> DataFrame:
    """(node, tbl, bucket, bitmap): each node's filter holds the hashes of all leaves under it. Leaves' filters are
    built first and united upwards, so a hash is hashed into bins once."""
    own = bloom.build(exploded(leaves.select("pos", "sketch")), tables, ("pos",))
    return bloom.unite(ancestors(own, d).withColumnRenamed("ancestor", "node"), ("node",))


def node_bounds(filters: DataFrame, below: DataFrame, queries: DataFrame, tables=bloom.DEFAULT_TABLES) -> DataFrame:
    """(node, query, similarity, containment): upper bound of a query's similarity with any leaf under a node, and the
    part of the query that the node's filter holds."""
    found = bloom.hits(filters, queries, tables).join(below.withColumnRenamed("pos", "node"), "node")
    part = lambda by: F.col("hits") / F.col(by)
    return found.select("node", "query", F.least(part("min_n_below"), F.lit(float("inf"))).alias("similarity"), part("size").alias("containment"))


def _level(pos: int, d: int) -> int:
    depth = 0
    while pos > 0:
        pos, depth = (pos - 1) // d, depth + 1
    return depth


def reached(leaves: DataFrame, queries: DataFrame, threshold: float, tables=bloom.DEFAULT_TABLES, d: int = 2, stride: int = 8) -> DataFrame:
    """(query, id): the pairs that a descent from the root comes to, for similarity.

    A node holds all that its children hold and its least sketch is no larger than theirs, so bounds only fall on
    the way down. Hence the descent may skip levels: it stops at each ``stride``-th one and at the parents of leaves, and
    a query's hashes are held only against nodes whose stop above passed. The root, which holds all that the tree does,
    isn't asked unless it is the only node. A child of no node is always reached."""
    asked = exploded(queries.select(F.col("id").alias("query"), "sketch")).select("query", "hk").distinct()
    filters, below = node_filters(leaves, tables, d), min_n_below(leaves, d).withColumnRenamed("pos", "node")
    ends = leaves.select(parent(F.col("pos"), d).alias("node")).where("node is not null").distinct()
    lowest = _level(ends.agg(F.max("node")).first()[0] or 0, d)
    firsts = [sum(d**i for i in range(n)) for n in range(lowest + 2)]  # the first position of each level
    span = lambda a, b: F.col("node").between(firsts[a], firsts[b + 1] - 1)
    frontier, passed = queries.select(F.col("id").alias("query")).distinct().withColumn("node", F.lit(0).cast("bigint")), None
    for at in range(0, lowest + 1, stride):
        last = min(at + stride - 1, lowest)
        # The stop itself, then the parents of leaves between it and the next stop.
        kept = _passing(frontier, filters.where(span(at, at)), below, asked, threshold, tables) if at or not lowest else frontier
        inner = None
        for n in range(at + 1, last + 1):
            up = F.col("node")
            for _ in range(n - at):
                up = parent(up, d)
            hop = ends.where(span(n, n)).select("node", up.alias("stop"))
            inner = hop if inner is None else inner.unionByName(hop)
        if inner is not None:
            asked_for = kept.withColumnRenamed("node", "stop").join(inner, "stop").select("query", "node")
            inner = _passing(asked_for, filters.where(span(at + 1, last)), below, asked, threshold, tables)
        here = kept.join(ends, "node", "left_semi").select("query", "node")
        here = here if inner is None else here.unionByName(inner)
        passed = here if passed is None else passed.unionByName(here)
        if at + stride <= lowest:
            steps = kept.select("query", "node")
            for _ in range(stride):
                steps = steps.select("query", F.explode(children(F.col("node"), d)).alias("node"))
            frontier = steps.join(below.select("node"), "node", "left_semi").select("query", "node")
    homes = leaves.select(parent(F.col("pos"), d).alias("node"), "id")
    roots = homes.where("node is null").select("id").join(queries.select(F.col("id").alias("query")).distinct()).select("query", "id")
    return homes.join(passed, "node").select("query", "id").unionByName(roots)


def _passing(pairs: DataFrame, filters: DataFrame, below: DataFrame, asked: DataFrame, threshold: float, tables) -> DataFrame:
    """The (query, node) of ``pairs`` whose bound is above ``threshold``: joined with the filters by node, table and bucket."""
    place = F.col("bin") + 1
    probes = bloom.bins(pairs.join(asked, "query"), tables, ("query", "node")).withColumn("bucket", F.bitmap_bucket_number(place)).withColumn("bit", F.bitmap_bit_position(place))
    held = probes.join(filters, ["node", "tbl", "bucket"]).where(bloom.bit_is_set()).groupBy("query", "node", "hk").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(tables))
    found = held.groupBy("query", "node").agg(F.count(F.lit(1)).alias("hits")).join(below, "node")
    return found.where(F.coalesce(F.try_divide("hits", "min_n_below"), F.lit(float("inf"))) > threshold).select("query", "node")


def tree_find(leaves: DataFrame, queries: DataFrame, threshold: float, tables=bloom.DEFAULT_TABLES, d: int = 2) -> DataFrame:
    """(query, id, similarity) of the leaves above ``threshold``; only those that the descent reaches are compared.
    Similarity only: for containment a node's bound says nothing of its leaves, and ``find`` is the search. Sketches that
    can't be compared don't match.

    leaves: pos, id, sketch. queries: id, sketch."""
    if threshold < 0:
        raise ValueError("a threshold under 0 would pair everything with everything")
    one, two = leaves.select("id", F.col("sketch").alias("x_")), queries.select(F.col("id").alias("query"), F.col("sketch").alias("y_"))
    pairs = reached(leaves, queries, threshold, tables, d).distinct().join(one, "id").join(two, "query")
    alike = F.when(mismatch(F.col("x_"), F.col("y_")).isNull(), jaccard(F.col("x_"), F.col("y_")))
    return pairs.select("query", "id", alike.alias("similarity")).where(F.col("similarity") > threshold)


def _pairing(count: int, overlap: Callable[[int, int], int]) -> list[tuple[int, ...]]:
    """From the last item down, each with the remaining one that it shares most with (the first of equals); an odd one
    alone. The rule in its plain form, quadratic; ``pair_up`` does the same from the overlaps that aren't 0."""
    left, groups = list(range(count)), []
    while left:
        item = left.pop()
        if not left:
            groups.append((item,))
            break
        best = max(range(len(left)), key=lambda i: (overlap(item, left[i]), -i))
        groups.append((item, left.pop(best)))
    return groups


def pair_up(count: int, a: np.ndarray, b: np.ndarray, shared: np.ndarray) -> list[tuple[int, ...]]:
    """The groups of ``_pairing``, where a[i] and b[i] (a > b) share shared[i] and all other pairs nothing."""
    order = np.lexsort((b, -shared, a))
    b, starts = b[order], np.searchsorted(a[order], np.arange(count + 1))
    taken, first, groups = np.zeros(count, bool), 0, []
    for item in range(count - 1, -1, -1):
        if taken[item]:
            continue
        taken[item] = True
        mine = b[starts[item] : starts[item + 1]]
        free = mine[~taken[mine]]
        while first < item and taken[first]:
            first += 1
        if not len(free) and first >= item:
            groups.append((item,))
            continue
        other = int(free[0]) if len(free) else first
        taken[other] = True
        groups.append((item, other))
    return groups


def _renumbered(lists: Column, to: np.ndarray) -> Column:
    """Lists of group numbers under new numbers."""

    def run(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(values.offsets, pa.array(to[values.values.to_numpy(zero_copy_only=False)]))

    return F.arrow_udf(run, "array<int>")(lists)


def scaffold(leaves: DataFrame, order: str = "id") -> DataFrame:
    """(pos, level, id, is_leaf): leaves clustered into a binary tree, by shared hashes, level by level. A group that a
    level leaves alone is the left child of a node of its own, so that all leaves are equally deep.

    Spark makes of each hash the list of leaves that have it, and of equal lists one with a weight; lists of one leaf
    have no part in any level. A level renumbers the lists and sums the weights of their pairs. The choice of pairs,
    one after the other by definition, is made on the driver, for up to MOST_LEAVES leaves. leaves: id, sketch; taken
    by ``order``."""
    spark: SparkSession = leaves.sparkSession
    schema = "pos long, level int, id string, is_leaf boolean"
    held = leaves.select(F.col("id").cast("string").alias("id"), F.col(order).alias("o_"), F.col("sketch.mins").alias("mins_")).persist()
    named = held.select("id", "o_").limit(MOST_LEAVES + 1).collect()
    if len(named) > MOST_LEAVES:
        held.unpersist()
        raise ValueError(f"clustering takes at most {MOST_LEAVES} leaves")
    if not named:
        held.unpersist()
        return spark.createDataFrame([], schema)
    ids = [r["id"] for r in sorted(named, key=lambda r: (r["o_"] is None, r["o_"]))]
    place = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, g int")
    members = held.join(F.broadcast(place), "id").select("g", F.explode("mins_").alias("hk")).groupBy("hk").agg(F.sort_array(F.collect_set("g")).alias("gs"))
    lists = members.where(F.size("gs") > 1).groupBy("gs").agg(F.count(F.lit(1)).alias("w")).persist()
    groups: list = list(range(len(ids)))
    at = np.arange(len(ids), dtype=np.int32)  # the group that each leaf is in
    while len(groups) > 1 or not isinstance(groups[0], tuple):
        now = lists.select(F.sort_array(F.array_distinct(_renumbered(F.col("gs"), at))).alias("gs"), "w").where(F.size("gs") > 1)
        pairs = now.select(F.posexplode("gs").alias("i", "a"), "gs", "w").where("i > 0").select("a", F.explode(F.expr("slice(gs, 1, i)")).alias("b"), "w")
        counted = pairs.groupBy("a", "b").agg(F.sum("w").alias("n")).toArrow()
        paired = pair_up(len(groups), *(counted[c].to_numpy() for c in ("a", "b", "n")))
        to = np.zeros(len(groups), np.int32)
        for new, group in enumerate(paired):
            to[list(group)] = new
        at, groups = to[at], [tuple(groups[i] for i in group) for group in paired]
    lists.unpersist()
    held.unpersist()
    rows, stack = [], [(0, 0, groups[0])]
    while stack:
        pos, level, group = stack.pop()
        if isinstance(group, int):
            rows.append((pos, level, ids[group], True))
        else:
            rows.append((pos, level, None, False))
            stack += [(2 * pos + 1 + i, level + 1, part) for i, part in enumerate(group)]
    return spark.createDataFrame(sorted(rows), schema)


def leaf_overlap(leaves: DataFrame, query: DataFrame) -> DataFrame:
    """(id, common) of each leaf with one query sketch; leaves without a sketch share nothing."""
    one = query.select(F.col("sketch").alias("q_")).limit(1)
    return leaves.join(F.broadcast(one)).select("id", F.coalesce(count_common(F.col("sketch"), F.col("q_")), F.lit(0).cast("bigint")).alias("common"))


def insert(collection: DataFrame, more: DataFrame) -> DataFrame:
    """The collection with further rows."""
    return collection.unionByName(more)
