"""Comparing sketches: two in a row, and all pairs by an equi-join on hashes.

The pairs within one table are counted block by block: sketches are dealt to blocks by their ids, and for two blocks the
hashes that both have come to one place, with the lists of their sketches. What is shuffled are these lists and not a row
for each pair and hash, of which there are as many as the square of a frequent hash's sketches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Two sketches are compared only if these agree, looked at in this order.
CHECKS = (
    ("ksize", "MismatchKSizes: different ksizes cannot be compared"),
    ("is_protein", "MismatchDNAProt: DNA/prot minhashes cannot be compared"),
    ("max_hash", "MismatchMaxHash: mismatch in max_hash; comparison fail"),
    ("seed", "MismatchSeed: mismatch in seed; comparison fail"),
)
KEYS = [f for f, _ in CHECKS]
#: Sketches of a block, and rows for a pair and hash that a task makes at once.
BLOCK, PAIRS_AT_ONCE = 8192, 1 << 20


def mismatch(a: Column, b: Column) -> Column:
    """The first reason why two sketches can't be compared; null if they can. num and counts have no say."""
    return F.coalesce(*(F.when(~a[f].eqNullSafe(b[f]), F.lit(said)) for f, said in CHECKS), F.lit(None).cast("string"))


def checked(a: Column, b: Column, result: Column) -> Column:
    """``result``, or the typed error if the sketches can't be compared."""
    why = mismatch(a, b)
    return F.when(why.isNotNull(), F.raise_error(why)).otherwise(result)


def union_of(a: Column, b: Column) -> Column:
    """The hashes of both, or of these the smallest ``num`` of the first if it has a num."""
    both = F.array_union(a["mins"], b["mins"])
    return F.when(a["num"] > 0, F.slice(F.array_sort(both), 1, a["num"].cast("int"))).otherwise(both)


def count_common(a: Column, b: Column) -> Column:
    """How many hashes two sketches share, whatever their num; an error if they can't be compared, as in what follows."""
    return checked(a, b, F.size(F.array_intersect(a["mins"], b["mins"])).cast("bigint"))


def intersection(a: Column, b: Column) -> Column:
    """struct<common: the shared hashes within the (cut) union, size: that union's size>."""
    union = union_of(a, b)
    common = F.array_intersect(F.array_intersect(a["mins"], b["mins"]), union)
    return checked(a, b, F.struct(common.alias("common"), F.size(union).cast("bigint").alias("size")))


def jaccard(a: Column, b: Column) -> Column:
    """Shared hashes by the union's; 0 of two empty sketches. The first's ``num`` cuts the union."""
    i = intersection(a, b)
    return F.size(i["common"]) / F.greatest(F.lit(1).cast("bigint"), i["size"])


def containment(inner: Column, other: Column) -> Column:
    """The part of ``inner`` that ``other`` has; null, which passes no threshold, of an empty ``inner``."""
    return F.try_divide(count_common(inner, other).cast("double"), F.size(inner["mins"]).cast("double"))


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """(row of each element, the elements) of a column of lists."""
    return pc.list_parent_indices(column).to_numpy(zero_copy_only=False), column.flatten()


def _tiles(rows: pa.Table, same: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, place_a, place_b, new_run) for each pair of sketches and hash of two blocks, by pair and then by hash, and
    whether it is the first of its pair; a pair's rows are never divided. Then what the codes a and b stand for:
    (ids, sizes, nums), in the order of the ids."""
    (row_x, x), (row_y, y) = _flat(rows["x"].combine_chunks()), _flat(rows["y"].combine_chunks())
    coded = pa.concat_arrays([x.field("id"), y.field("id")]).dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy(zero_copy_only=False)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    codes = place[coded.indices.to_numpy(zero_copy_only=False)]
    get = lambda name: np.concatenate([s.field(name).to_numpy(zero_copy_only=False) for s in (x, y)])
    sizes, nums, places = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), get("place").astype(np.int64)
    sizes[codes], nums[codes] = get("size"), get("num")
    about = (coded.dictionary.take(pa.array(order)), sizes, nums)
    code_y, place_y = codes[len(row_x) :], places[len(row_x) :]
    starts = np.searchsorted(row_y, np.arange(rows.num_rows + 1))
    by_sketch = np.argsort(codes[: len(row_x)], kind="stable")
    code_x, place_x, row_x = codes[: len(row_x)][by_sketch], places[: len(row_x)][by_sketch], row_x[by_sketch]
    many = starts[row_x + 1] - starts[row_x]
    before = np.concatenate([[0], np.cumsum(many)])
    firsts = np.flatnonzero(np.diff(code_x, prepend=-1))  # a sketch's rows stay together
    ends, at = np.append(firsts[1:], len(code_x)), 0
    while at < len(firsts):
        upto = max(at + 1, int(np.searchsorted(before[ends], before[firsts[at]] + PAIRS_AT_ONCE, "right")))
        lo, hi = firsts[at], ends[upto - 1]
        at = upto
        n = many[lo:hi]
        other = np.arange(before[hi] - before[lo]) + np.repeat(starts[row_x[lo:hi]] - before[lo:hi] + before[lo], n)
        a, b, pa_, pb_ = np.repeat(code_x[lo:hi], n), code_y[other], np.repeat(place_x[lo:hi], n), place_y[other]
        if same:
            kept = a < b
            a, b, pa_, pb_ = a[kept], b[kept], pa_[kept], pb_[kept]
        else:
            kept = a < b
            a, b, pa_, pb_ = np.where(kept, a, b), np.where(kept, b, a), np.where(kept, pa_, pb_), np.where(kept, pb_, pa_)
        if not len(a):
            continue
        pair = a * len(order) + b
        by_pair = np.argsort((pair << 31) | pa_)  # codes are below 2^14, places below 2^31
        pair = pair[by_pair]
        yield a[by_pair], b[by_pair], pa_[by_pair], pb_[by_pair], np.flatnonzero(np.diff(pair, prepend=-1)), about


def _counted(rows: pa.Table, same: bool, threshold: float | None, cut: bool) -> Iterator[pa.RecordBatch]:
    """The pairs of two blocks, and those alone whose similarity is above ``threshold``, if one is given. With ``cut``
    the union is cut to the first's num: a shared hash that is the ``i``-th of its pair has place_a + place_b - i hashes of
    the union up to itself."""
    for a, b, place_a, place_b, firsts, (ids, sizes, nums) in _tiles(rows, same):
        common = np.diff(np.append(firsts, len(a)))
        num = nums[a[firsts]]
        a_, b_ = a[firsts], b[firsts]
        size = sizes[a_] + sizes[b_] - common
        if cut:
            nth = np.arange(len(a)) - np.repeat(firsts, common) + 1
            limit = np.where(num > 0, num, np.iinfo(np.int64).max)
            common = np.add.reduceat((place_a + place_b - nth <= np.repeat(limit, common)).astype(np.int64), firsts)
            size = np.minimum(size, limit)
        kept = slice(None) if threshold is None else common / np.maximum(1, size) > threshold
        a_, b_ = a_[kept], b_[kept]
        if len(a_):
            numbers = [pa.array(v) for v in (common[kept], size[kept], sizes[a_], sizes[b_])]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a_)), ids.take(pa.array(b_)), *numbers], ["a", "b", "common", "size", "size_a", "size_b"])


def _own_pairs(sketches: DataFrame, id_col: str, sketch: str, threshold: float | None = None, cut: bool = False) -> DataFrame:
    """(a, b, common, size, size_a, size_b) of the pairs within a table, the smaller id first.

    The table is kept, as its rows are counted first for the number of blocks. A task holds the lists of two blocks, at most
    2 BLOCK sketches' hashes, and PAIRS_AT_ONCE rows, or a sketch's own."""
    s, whole = F.col(sketch), lambda c: (c - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("bigint")
    kind_of = {"ksize": s["ksize"], "is_protein": s["is_protein"], "max_hash": whole(s["max_hash"]), "seed": whole(s["seed"])}  # longs are much faster keys than decimals
    held = sketches.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *(c.alias(k) for k, c in kind_of.items()), s["num"].alias("num"), s["mins"].alias("mins")).persist()
    n = held.count()
    blocks = max(-(-n // BLOCK), min(12, -(-n // 256)), 1)
    each = held.select(*KEYS, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", F.size("mins").alias("size"), F.coalesce("num", F.lit(0)).alias("num"), F.posexplode("mins").alias("place", "hk"))
    entry = F.struct("id", (F.col("place") + 1).alias("place"), "size", "num")
    dealt, key = each.repartition("hk", *KEYS), ["hk", *KEYS]
    shared = dealt.withColumn("n_", F.count(F.lit(1)).over(Window.partitionBy(*key))).where("n_ > 1")  # most hashes are one sketch's own
    lists = shared.groupBy(*key, "block").agg(F.collect_list(entry).alias("list"))
    x, y = (lists.select(*key, F.col("block").alias(b), F.col("list").alias(v)) for b, v in (("i", "x"), ("j", "y")))
    joined = x.join(y, key).where("i < j or (i = j and size(x) > 1)").select("i", "j", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, now = [], None
        for batch in batches:
            i, j = (batch.column(c).to_numpy() for c in (0, 1))
            edges = [0, *(np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0)) + 1).tolist(), len(i)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if (i[lo], j[lo]) != now and parts:
                    yield from _counted(pa.Table.from_batches(parts), now[0] == now[1], threshold, cut)
                    parts = []
                now = (i[lo], j[lo])
                parts.append(batch.slice(lo, hi - lo))
        if parts:
            yield from _counted(pa.Table.from_batches(parts), now[0] == now[1], threshold, cut)

    kind = held.schema["id"].dataType
    out = T.StructType([T.StructField(c, kind) for c in "ab"] + [T.StructField(c, T.LongType()) for c in ("common", "size", "size_a", "size_b")])
    return joined.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(run, out)


def common_pairs(left: DataFrame, right: DataFrame | None = None, id_col: str = "id", sketch: str = "sketch") -> DataFrame:
    """(a, b, common, size_a, size_b) of every pair of compatible sketches that share a hash.

    With one table, pairs of different ids, the smaller first. An equi-join on hash and parameters: pairs that
    share nothing are never made, and AQE splits the hashes that many sketches share."""
    if right is None:
        return _own_pairs(left, id_col, sketch).drop("size")

    def rows(df: DataFrame, name: str) -> DataFrame:
        s = F.col(sketch)
        keyed = df.select(F.col(id_col).alias(name), *(s[k].alias(k) for k in KEYS), F.size(s["mins"]).cast("bigint").alias(f"size_{name}"), F.explode(s["mins"]).alias("hk"))
        return keyed

    joined = rows(left, "a").join(rows(right, "b"), [*KEYS, "hk"])
    return joined.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"))


def jaccard_pairs(left: DataFrame, right: DataFrame | None = None, threshold: float = 0.0, id_col: str = "id", sketch: str = "sketch") -> DataFrame:
    """(a, b, common, size, similarity) of the compatible pairs above ``threshold`` (at least 0), exact in both modes.

    In threshold mode the pair counts suffice. In number mode the places of the shared hashes in both sketches give the cut
    union of pairs within one table; of two tables only pairs that can still pass, by common / size_a > threshold where
    size_a <= num, fetch their hashes for it."""
    if threshold < 0:
        raise ValueError("a threshold under 0 would pair everything with everything")
    if right is None:
        done = _own_pairs(left, id_col, sketch, threshold, cut=True).select("a", "b", "common", "size")
    else:
        pairs = common_pairs(left, right, id_col, sketch)
        pairs = pairs.where(F.col("common") / F.col("size_a") > threshold)
        one = left.select(F.col(id_col).alias("a"), F.col(sketch).alias("sa"))
        two = right.select(F.col(id_col).alias("b"), F.col(sketch).alias("sb"))
        exact = pairs.join(one, "a").join(two, "b").withColumn("i", intersection(F.col("sa"), F.col("sb")))
        done = exact.select("a", "b", F.size("i.common").cast("bigint").alias("common"), F.col("i.size").alias("size"))
    return done.withColumn("similarity", F.col("common") / F.greatest(F.lit(1).cast("bigint"), F.col("size"))).where(F.col("similarity") > threshold)


def scaled_jaccard_pairs(left: DataFrame, right: DataFrame | None = None, threshold: float = 0.0, id_col: str = "id", sketch: str = "sketch") -> DataFrame:
    """As ``jaccard_pairs`` for sketches in threshold mode, from the counts alone."""
    pairs = _own_pairs(left, id_col, sketch, threshold) if right is None else common_pairs(left, right, id_col, sketch).withColumn("size", F.col("size_a") + F.col("size_b") - F.col("common"))
    return pairs.select("a", "b", "common", "size", (F.col("common") / F.col("size")).alias("similarity")).where(F.col("similarity") > threshold)


def containment_pairs(inner: DataFrame, other: DataFrame, threshold: float = 0.0, id_col: str = "id", sketch: str = "sketch") -> DataFrame:
    """(a, b, common, size_a, containment): how much of each ``inner`` sketch each ``other`` has, above ``threshold``."""
    pairs = common_pairs(inner, other, id_col, sketch)
    return pairs.select("a", "b", "common", "size_a", (F.col("common") / F.col("size_a")).alias("containment")).where(F.col("containment") > threshold)
