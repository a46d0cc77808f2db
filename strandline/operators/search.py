"""Searching collections of sketches.

One exact search serves flat collections and trees alike: the hashes of the queries are joined with those of
the collection, so that only sketches that share one are ever compared. Results have an order: the most alike
first, then by name and MD5.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.compare import containment_pairs, jaccard_pairs
from strandline.operators.sketch import md5sum

# The usual options of a search.
DEFAULT_THRESHOLD, DEFAULT_TOP = 0.8, 3


def first_query(signatures: DataFrame, order: str = "name") -> DataFrame:
    """The first signature of a selection, in a stated order."""
    return signatures.orderBy(F.col(order).asc_nulls_last(), md5sum(F.col("sketch"))).limit(1)


def find(collection: DataFrame, queries: DataFrame, threshold: float = DEFAULT_THRESHOLD, by_containment: bool = False, id_col: str = "id") -> DataFrame:
    """(query, id, similarity): every sketch of the collection whose Jaccard similarity with a query (or, by
    containment, whose own part that the query has) is strictly above ``threshold``."""
    if by_containment:
        found = containment_pairs(collection, queries, threshold, id_col)
        return found.select(F.col("b").alias("query"), F.col("a").alias(id_col), F.col("containment").alias("similarity"))
    found = jaccard_pairs(collection, queries, threshold, id_col)
    return found.select(F.col("b").alias("query"), F.col("a").alias(id_col), "similarity")


def find_where(collection: DataFrame, query: DataFrame, predicate: Callable[[Column, Column], Column]) -> DataFrame:
    """The rows of the collection whose sketch fulfils a predicate of (sketch, query's sketch). One query, broadcast."""
    one = query.select(F.col("sketch").alias("query_")).limit(1)
    return collection.join(F.broadcast(one), predicate(F.col("sketch"), F.col("query_"))).drop("query_")


def find_in(databases: dict[str, DataFrame], queries: DataFrame, **options) -> DataFrame:
    """The finds of all databases, with the database's name in ``db``."""
    if not databases:
        raise ValueError("no databases to search")
    found = None
    for name, one in databases.items():
        part = find(one, queries, **options).withColumn("db", F.lit(name))
        found = part if found is None else found.unionByName(part)
    return found


def ranked(found: DataFrame, collection: DataFrame, id_col: str = "id") -> DataFrame:
    """``found`` with name, md5 and rank: the most alike first, then by name and MD5."""
    named = collection.select(id_col, "name", md5sum(F.col("sketch")).alias("md5"))
    order = Window.partitionBy("query").orderBy(F.col("similarity").desc(), F.col("name").asc_nulls_last(), "md5", id_col)
    return found.join(named, id_col).withColumn("rank", F.row_number().over(order))


def top(found: DataFrame, collection: DataFrame, n: int = DEFAULT_TOP, best_only: bool = False, id_col: str = "id") -> DataFrame:
    """The best ``n`` finds of each query (0: all; best_only: one)."""
    n = 1 if best_only else n
    all_of = ranked(found, collection, id_col)
    return all_of.where(F.col("rank") <= n) if n else all_of


def tenths(x: Column) -> Column:
    """``x``, not negative, in tenths: the nearest of its exact binary value, and of two equally near the even one. Spark's
    own formatting rounds the shortest decimal that reads as ``x``, halves upwards. The part after the point is a whole number
    of 2^-59; smaller parts, which only numbers below 0.008 have, decide nothing."""
    whole = F.floor(x).cast("bigint")
    ten = F.floor((x - whole) * F.lit(float(1 << 59))).cast("bigint") * 10
    down, rest = F.shiftright(ten, 59), ten.bitwiseAND(F.lit((1 << 59) - 1))
    up = (rest > (1 << 58)) | ((rest == (1 << 58)) & (down % 2 == 1))
    return whole * 10 + down + F.when(up, 1).otherwise(0)


def report(found: DataFrame) -> DataFrame:
    """(query, rank, line): each find as a line of text, the similarity in percent."""
    percent = tenths(F.col("similarity") * 100)
    return found.select("query", "rank", F.format_string("%4d.%d%%       %-60s", F.floor(percent / 10).cast("bigint"), percent % 10, F.coalesce("name", F.lit(""))).alias("line"))
