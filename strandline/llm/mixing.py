"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens to the power of an exponent between 0 (all alike) and 1 (as they
come), made to sum to 1. The exponent is the one at which the weights reach the target entropy, given as a part
of the most that so many sources can have, raised as far as needed to keep every source within ``repeats``
passes of its documents. Both are found by bisection, 32 points at a time: each round is one aggregate over
the sources, so that no list of sources comes to the driver, however many there are.

The weights are realised to a budget of tokens. A source's documents are dealt into blocks of about
``block_tokens`` by hash; each pass takes its blocks in an order of its own, and a block's documents in theirs.
Whole passes take all; the last pass takes blocks in order until its tokens are spent, cutting the last block
at the document that reaches the budget. So a source misses its budget by less than one document, and only the
cut blocks, one for each source, are ever put in order document by document.

Tokens are words. Null and empty texts have none and cost nothing. A null source is a source of its own; a
source without any token is passed through once. Repeated rows are documents each. An empty table gives an
empty result. Other columns pass whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import free_name, join_small, materialise

GRID = 32


def _key(source: str) -> Column:
    """Null apart from every string."""
    return F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))


def _sums(shares: DataFrame, grid: list[float]) -> list[tuple[float, float]]:
    """For each exponent the entropy of the weights, and the most passes of a source for a budget of 1."""
    p, a = F.col("p"), F.col("g.a")
    points = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(x).alias("a")) for i, x in enumerate(grid)))
    each = shares.select("p", F.explode(points).alias("g")).groupBy("g.i", "g.a")
    rows = each.agg(F.sum(F.pow(p, a)).alias("z"), F.sum(F.pow(p, a) * F.log(p)).alias("l"), F.max(F.pow(p, a - 1)).alias("m")).collect()
    return [(math.log(r["z"]) - r["a"] * r["l"] / r["z"], r["m"] / r["z"]) for r in sorted(rows, key=lambda r: r["i"])]


def _bisect(shares: DataFrame, fine) -> float:
    """The smallest exponent in [0, 1] where ``fine(entropy, passes)``, false below it and true above, or 1."""
    low, high = 0.0, 1.0
    for k in range(5):
        grid = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        found = [fine(*x) for x in _sums(shares, grid)]
        if found[0]:
            return low
        i = found.index(True) if True in found else GRID
        low, high = grid[i - 1], grid[i]
    return high


def weights(sizes: DataFrame, entropy: float | None = 0.95, repeats: float = 4.0, budget: float = 1.0) -> tuple[DataFrame, float]:
    """((key, tokens, weight, target), exponent) of each source that has tokens. sizes: key, tokens (a row each
    source). budget: in passes over all tokens; target: the source's tokens in the mixture."""
    some = sizes.where("tokens > 0")
    whole = some.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not whole["t"]:
        return some.select("key", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("target")), 1.0
    shares = some.select("key", "tokens", (F.col("tokens") / whole["t"]).alias("p"))
    most = math.log(whole["n"]) if whole["n"] > 1 else 0.0
    exponent = 0.0 if entropy is None else _bisect(shares, lambda h, _: h <= entropy * most + 1e-12)
    if entropy is not None and exponent >= 1.0 - 1e-6:
        exponent = 1.0
    exponent = max(exponent, _bisect(shares, lambda _, passes: budget * passes <= repeats * (1 + 1e-9)))
    total = shares.agg(F.sum(F.pow("p", F.lit(exponent)))).first()[0]
    weight = F.pow("p", F.lit(exponent)) / total
    return shares.select("key", "tokens", weight.alias("weight"), F.round(weight * (budget * whole["t"])).cast("long").alias("target")), exponent


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def plan(rows: DataFrame, entropy: float | None, repeats: float, budget: float, block_tokens: int, most_blocks: int = 100_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """How often each row is taken. rows: key, tokens, row (a number of its own).

    Returns the sources (key, n_blocks), the blocks (key, block, passes, all: whether the last pass takes all
    of it) and the rows (row) that the last pass takes from the blocks that it cuts."""
    sizes = materialise(rows.groupBy("key").agg(F.sum("tokens").alias("size")), "sizes")
    target, _ = weights(sizes.withColumnRenamed("size", "tokens"), entropy, repeats, budget)
    spare = F.when(F.col("size") > 0, F.col("target") % F.col("size")).otherwise(F.lit(0))
    passes = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(1)).cast("long")
    n_blocks = F.least(F.ceil(F.greatest(F.col("size"), F.lit(1)) / block_tokens), F.lit(most_blocks)).cast("long")
    sources = materialise(sizes.join(target.select("key", "target"), "key", "left").select("key", n_blocks.alias("n_blocks"), passes.alias("passes"), spare.alias("spare")), "sources")
    dealt = join_small(rows, sources, "key").withColumn("block", block_of(F.col("row"), F.col("n_blocks")))
    totals = dealt.groupBy("key", "block").agg(F.sum("tokens").alias("size"), F.first("passes").alias("passes"), F.first("spare").alias("spare"))
    order = Window.partitionBy("key").orderBy(F.xxhash64("block", F.col("passes") + 1), "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = totals.withColumn("left", F.col("spare") - F.coalesce(F.sum("size").over(order), F.lit(0)))
    blocks = materialise(blocks.select("key", "block", "passes", "left", ((F.col("left") > 0) & (F.col("size") <= F.col("left"))).alias("all")), "blocks")
    inside = join_small(dealt.select("key", "block", "row", "tokens"), blocks.where("left > 0 and not all").select("key", "block", "left", "passes"), ["key", "block"])
    before = Window.partitionBy("key", "block").orderBy(F.xxhash64("row", F.col("passes") + 1), "row").rowsBetween(Window.unboundedPreceding, -1)
    taken = inside.withColumn("so_far", F.coalesce(F.sum("tokens").over(before), F.lit(0))).where(F.col("so_far") < F.col("left")).select("row")
    return sources.select("key", "n_blocks"), blocks.drop("left"), taken


def block_of(row: Column, n_blocks: Column) -> Column:
    return F.pmod(F.xxhash64(row), n_blocks)


def mix(docs: DataFrame, entropy: float | None = 0.95, repeats: float = 4.0, budget: float = 1.0, block_tokens: int = 1 << 20) -> tuple[DataFrame, str]:
    """``docs`` as often as the mixture takes each, and the name of a struct column more: tokens, pass (from 1),
    block, block_order and doc_order. Sorted by pass, block_order and doc_order a source is permuted in blocks."""
    m = free_name(docs, "mix")
    own = F.struct(_key("source").alias("key"), word_count("text").alias("tokens"), F.monotonically_increasing_id().alias("row"))
    written = materialise(docs.withColumn(m, own), "mixing", "zstd")
    sources, blocks, taken = plan(written.select(f"{m}.*"), entropy, repeats, budget, block_tokens)
    named = lambda df: df.select(*(F.col(c).alias(f"{m}_{c}") for c in df.columns))
    at = F.col
    placed = join_small(written, named(sources), at(f"{m}.key") == at(f"{m}_key")).drop(f"{m}_key")
    placed = placed.withColumn(f"{m}_of", block_of(at(f"{m}.row"), at(f"{m}_n_blocks")))
    placed = join_small(placed, named(blocks), (at(f"{m}.key") == at(f"{m}_key")) & (at(f"{m}_of") == at(f"{m}_block")))
    placed = join_small(placed, named(taken), at(f"{m}.row") == at(f"{m}_row"), "left")
    times = at(f"{m}_passes") + F.when(at(f"{m}_all") | at(f"{m}_row").isNotNull(), 1).otherwise(0)
    own = [at(f"`{c}`") for c in docs.columns]
    passed = placed.where(times > 0).select(*own, m, f"{m}_of", F.explode(F.sequence(F.lit(1).cast("long"), times)).alias(f"{m}_pass"))
    order = lambda c: F.xxhash64(c, at(f"{m}_pass"))
    return passed.select(*own, F.struct(at(f"{m}.tokens").alias("tokens"), at(f"{m}_pass").alias("pass"), at(f"{m}_of").alias("block"), order(at(f"{m}_of")).alias("block_order"), order(at(f"{m}.row")).alias("doc_order")).alias(m)), m


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture with the documents' own columns."""
    mixed, extra = mix(docs, **options)
    return mixed.drop(extra)
