"""Bloom filters of several tables and one hash: a hash's bin in a table is its remainder by the table's size.

A filter is a set of rows (node, tbl, bucket, bitmap), a bitmap for each 32,768 bins that have any bit; a
bucket without a row is all zeros. Building ORs 64 bins at a time, in longs, which combine in every task without a sort
of the hashes, as Spark's aggregate of bitmaps would have it; what is shuffled has the size of the filters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.hashing import BIAS

# The table sizes of filters that start from 100,000 bins and four tables.
DEFAULT_TABLES = (99991, 99989, 99971, 99961)


#: The first rows of bins are broadcast up to this many.
BROADCAST_ROWS = 250_000


def primes_below(start: int, count: int) -> tuple[int, ...]:
    """The ``count`` largest primes below ``start``, the largest first: the table sizes of a new filter."""
    found: list[int] = []
    n = start - 1
    while len(found) < count and n > 1:
        if all(n % d for d in range(2, int(n**0.5) + 1)):
            found.append(n)
        n -= 1
    if len(found) < count:
        raise ValueError("not enough primes below the start")
    return tuple(found)


def bin_of(hk: Column, size: int) -> Column:
    """The unsigned hash modulo ``size``, in long arithmetic on hk."""
    return (F.pmod(hk, F.lit(size).cast("bigint")) + F.lit(BIAS % size).cast("bigint")) % F.lit(size).cast("bigint")


def bins(rows: DataFrame, tables: Sequence[int] = DEFAULT_TABLES, by: Sequence[str] = ("node",), hk: str = "hk") -> DataFrame:
    """(by, hk, tbl, bin): a row for each hash and table."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("tbl"), bin_of(F.col(hk), n).alias("bin")) for i, n in enumerate(tables))))
    return rows.select(*by, hk, each.alias("b_")).select(*by, F.col(hk).alias("hk"), "b_.tbl", "b_.bin")


def build(rows: DataFrame, tables: Sequence[int] = DEFAULT_TABLES, by: Sequence[str] = ("node",), hk: str = "hk") -> DataFrame:
    """(by, tbl, bucket, bitmap) of all hashes of each node."""
    at = F.col("bin")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.lit(56) - F.floor(at % 64 / 8) * 8 + at % 8).cast("int"))  # the bytes' order is that of a bitmap
    words = bins(rows, tables, by, hk).groupBy(*by, "tbl", F.shiftright(at, 6).alias("word_")).agg(F.bit_or(bit).alias("bits_"))
    lists = words.groupBy(*by, "tbl", (F.shiftright("word_", 9) + 1).alias("bucket")).agg(F.sort_array(F.collect_list(F.struct((F.col("word_") % 512).cast("int").alias("w"), F.col("bits_").alias("v")))).alias("all_"))
    before = lambda i: F.coalesce(F.get(F.col("all_"), i - 1)["w"], F.lit(-1))
    digits = F.transform("all_", lambda x, i: F.concat(F.repeat(F.lit("0" * 16), x["w"] - before(i) - 1), F.lpad(F.hex(x["v"]), 16, "0")))
    return lists.select(*by, "tbl", "bucket", F.unhex(F.rpad(F.array_join(digits, ""), 8192, "0")).alias("bitmap"))


def unite(filters: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, tbl, bucket, bitmap): the union of all filters of each group."""
    return filters.groupBy(*by, "tbl", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def occupied(filters: DataFrame, by: Sequence[str] = ("node",)) -> DataFrame:
    """(by, occupied): bits set over all tables."""
    return filters.groupBy(*by).agg(F.sum(F.bitmap_count("bitmap")).cast("bigint").alias("occupied"))


def unique_hashes(rows: DataFrame, tables: Sequence[int] = DEFAULT_TABLES, by: Sequence[str] = ("node",), order: str = "pos", hk: str = "hk") -> DataFrame:
    """(by, unique_kmers): how many hashes set a bit that none before them, by ``order``, had set in some table."""
    kind = rows.schema[order].dataType
    parts = [F.col(order)[f] for f in kind.names] if isinstance(kind, T.StructType) else [F.col(order)]
    names = [f"first_{i}" for i in range(len(parts))]
    some, firsts = rows.select(*by, F.col(hk).alias("hk"), *(c.alias(n) for c, n in zip(parts, names, strict=True))), None
    # A struct's minimum would sort all hashes. Its fields' minima, one after the other, combine in every task, and from the
    # second on only rows of the bins' first values of the fields before count.
    for i, name in enumerate(names):
        keys, place = [*by, *names[:i]], [*by, "tbl", "bin"]
        each = some
        if firsts is not None:
            firsts = firsts.persist()
            small = firsts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
            each = _among(some, firsts.select(*keys).distinct(), keys, small)
        each = bins(each, tables, (*by, *names[: i + 1]), "hk")
        if firsts is not None:
            each = _among(each, firsts, [*place, *names[:i]], small)
        least = F.when(F.max(F.col(name).isNull()), F.lit(None)).otherwise(F.min(name)).alias(name)  # a null field is the least
        firsts = each.groupBy(*place, *names[:i]).agg(least)
    return firsts.groupBy(*by, *names).count().groupBy(*by).agg(F.count(F.lit(1)).alias("unique_kmers"))


def _among(a: DataFrame, b: DataFrame, keys: Sequence[str], small: bool) -> DataFrame:
    """The rows of ``a`` whose keys ``b`` has, nulls being equal."""
    renamed = b.select(*(F.col(k).alias(f"{k}_r") for k in keys))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_r"))
    return a.join(F.broadcast(renamed) if small else renamed, on, "left_semi")


def bit_is_set(bitmap: str = "bitmap", bit: str = "bit") -> Column:
    """Whether the bit is 1, by the hexadecimal digit that holds it: four bits a digit, a byte's lower four last."""
    digit = F.ascii(F.substring(F.hex(F.substring(bitmap, (F.floor(F.col(bit) / 8) + 1).cast("int"), F.lit(1))), F.when(F.col(bit) % 8 < 4, 2).otherwise(1), F.lit(1)))
    value = digit - F.when(digit > 57, 55).otherwise(48)
    return F.floor(value / F.element_at(F.array(*(F.lit(2**k) for k in range(4))), (F.col(bit) % 4 + 1).cast("int"))) % 2 == 1


def contains(filters: DataFrame, probes: DataFrame, tables: Sequence[int] = DEFAULT_TABLES, by: Sequence[str] = ("node",), hk: str = "hk") -> DataFrame:
    """(by, hk) of each node of ``filters`` and each distinct hash of ``probes`` that has all its bins set there."""
    asked = bins(probes.select(hk).distinct(), tables, (), hk).withColumn("bucket", F.bitmap_bucket_number(F.col("bin") + 1)).withColumn("bit", F.bitmap_bit_position(F.col("bin") + 1))
    hits = filters.join(asked, ["tbl", "bucket"]).where(bit_is_set()).groupBy(*by, "hk").agg(F.count(F.lit(1)).alias("n"))
    return hits.where(F.col("n") == len(tables)).select(*by, "hk")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(node_a, node_b, shared, either): bits set in both filters and in one at least, over all tables, of each pair
    of nodes that share a bit; all other pairs share none. a and b: node, tbl, bucket, bitmap."""
    x = a.select(F.col("node").alias("node_a"), "tbl", "bucket", F.col("bitmap").alias("x"))
    y = b.select(F.col("node").alias("node_b"), "tbl", "bucket", F.col("bitmap").alias("y"))
    both = x.join(y, ["tbl", "bucket"]).select("node_a", "node_b", "tbl", "bucket", F.explode(F.array("x", "y")).alias("bitmap"))
    shared = both.groupBy("node_a", "node_b", "tbl", "bucket").agg(F.bitmap_and_agg("bitmap").alias("m")).groupBy("node_a", "node_b").agg(F.sum(F.bitmap_count("m")).cast("bigint").alias("shared")).where("shared > 0")
    size = lambda df, name: occupied(df).select(F.col("node").alias(f"node_{name}"), F.col("occupied").alias(name))
    found = shared.join(size(a, "a"), "node_a").join(size(b, "b"), "node_b")
    return found.select("node_a", "node_b", "shared", (F.col("a") + F.col("b") - F.col("shared")).alias("either"), F.col("a").alias("bits_a"))


def similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """(node_a, node_b, shared, either, similarity): shared bits by bits in either; null of two empty filters."""
    return overlap(a, b).select("node_a", "node_b", "shared", "either", F.try_divide(F.col("shared").cast("double"), F.col("either").cast("double")).alias("similarity"))


def containment(a: DataFrame, b: DataFrame, tables: Sequence[int] = DEFAULT_TABLES) -> DataFrame:
    """(node_a, node_b, shared, of_capacity, of_bits): shared bits by the tables' whole length, as the established
    format defines it, and by the bits of ``a``."""
    part = lambda d: F.try_divide(F.col("shared").cast("double"), d.cast("double"))
    return overlap(a, b).select("node_a", "node_b", "shared", part(F.lit(sum(tables))).alias("of_capacity"), part(F.col("bits_a")).alias("of_bits"))


def hits(filters: DataFrame, queries: DataFrame, tables: Sequence[int] = DEFAULT_TABLES) -> DataFrame:
    """(node, query, hits, size): how many of each query's hashes each node's filter holds. queries: query, hk."""
    sizes = queries.groupBy("query").agg(F.countDistinct("hk").alias("size"))
    found = contains(filters, queries, tables).join(queries.select("query", "hk").distinct(), "hk")
    return found.groupBy("node", "query").agg(F.count(F.lit(1)).alias("hits")).join(sizes, "query")
