"""Sketches of a stream of rows, kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.hashing import SEED, bias_of, murmur64_column
from strandline.operators.sketch import build, exploded, normal_mode


def hash_stream(stream: DataFrame, by: list[str], word: str, seed: int = SEED, max_hash: int = 0) -> DataFrame:
    """(by, hk, cnt) of a streaming table of words: a running count by group and hash, for update or complete mode."""
    hashed = stream.select(*by, murmur64_column(F.col(word), seed).alias("hk")).where(F.col("hk").isNotNull())
    if max_hash:
        hashed = hashed.where(F.col("hk") <= bias_of(max_hash))
    return hashed.groupBy(*by, "hk").agg(F.count(F.lit(1)).alias("cnt"))


def fold_batch(state: DataFrame | None, batch: DataFrame, by: list[str], num: int = 1000, max_hash: int = 0, track_abundance: bool = False, **parameters) -> DataFrame:
    """(by, sketch): the sketches of ``state`` with a batch of rows (by, hk) added; for ``foreachBatch``.

    Exact for the hashes. Counts are exact in threshold mode; in number mode a hash that falls out and comes back
    is counted from its return, as in any sketch that is kept in bounded space."""
    num, max_hash = normal_mode(num, max_hash)
    rows = batch.select(*by, "hk", F.lit(1).cast("bigint").alias("abund"))
    if state is not None:
        rows = exploded(state.select(*by, "sketch")).unionByName(rows)
    return build(rows, by, num, max_hash, track_abundance=track_abundance, count="abund", **parameters)
