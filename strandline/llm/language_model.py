"""A modified Kneser-Ney model of code points whose tables are sharded by n-gram and grow with the text.

An n-gram is ``ORDER`` whole code points, so every script is told apart and a window reaches over the ends of
words. The counts of all orders are one table, written once and never gathered anywhere. Below the unigrams all
code points there are get an equal share.

To score texts they are first put into blocks of BLOCK_BYTES, written in buckets of blocks. Each block names its
different n-grams once, packed and dealt to shards by their hash. The different n-grams of a shard get their
probabilities by joins with the model's tables, order by order; the shard answers each block that asked; and
each block adds its answers up text by text where it lies, as its bucket needs no shuffle. What is shuffled are the
different n-grams of a block at two or three bytes each, neither texts nor every occurrence.

In a block n-grams are told apart by a hash of 64 bits: two of a million would share one in a block of 10^7.
The model itself has n-grams as strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import byte_slices, materialise, materialise_buckets, remove, texts_of, written

ORDER = 5
#: Stands before a text. It is no character; a text that has it all the same counts it as the start of one.
START = "\U0010ffff"
CODE_POINTS = 0x110000
BLOCK_BYTES = 16 << 20
SLICE_BYTES = 1 << 19
#: A shard answers about so many blocks' worth of n-grams.
BLOCKS_A_SHARD = 4
#: Fixed value: the odd multiplier of the n-grams' hash.
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _points(texts: list[str]) -> np.ndarray:
    """The code points of all texts, ORDER - 1 starts before each."""
    pad = START * (ORDER - 1)
    return np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), "<u4")


def _hashes(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each n-gram, whose code points stand one in each of ``columns``."""
    out = np.empty(len(columns[0]), np.uint64)
    for at in range(0, len(out), 1 << 15):  # as much as stays in the cache
        h = columns[0][at : at + (1 << 15)].astype(np.uint64)
        for points in columns[1:]:
            h *= _MULTIPLIER
            h += points[at : at + (1 << 15)]
        h ^= h >> np.uint64(32)
        np.multiply(h, _MULTIPLIER, out=out[at : at + (1 << 15)])
    return out


def _ngrams(texts: list[str], spelt: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each character of all texts the place of its n-gram in the list of different ones; their hashes; their
    code points, a row each (if ``spelt``); and the number of characters of each text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    if not lengths.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, ORDER), np.uint32), lengths
    points = _points(texts)
    first = np.arange(lengths.sum()) + np.repeat(np.arange(len(texts)) * (ORDER - 1), lengths)
    n = len(points) - ORDER + 1
    which, distinct = pd.factorize(_hashes([points[k : k + n] for k in range(ORDER)])[first])
    if not spelt:
        return which, distinct, np.zeros((0, ORDER), np.uint32), lengths
    places = np.empty(len(distinct), np.int64)
    places[which[::-1]] = first[::-1]
    return which, distinct, points[places[:, None] + np.arange(ORDER)], lengths


def _strings(points: np.ndarray) -> list[str]:
    flat = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [flat[i : i + ORDER] for i in range(0, len(flat), ORDER)]


def _rows(grams: list[str]) -> np.ndarray:
    """The code points of n-grams of ORDER each."""
    return np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, ORDER)


def windows(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """For each character of all texts the place of its n-gram in the list of different ones; that list; and the
    number of characters of each text."""
    which, _, points, lengths = _ngrams(texts)
    return which, _strings(points), lengths


class Gathered:
    """The different n-grams of texts that come slice by slice, with how often each occurred."""

    def __init__(self):
        self.hashes, self.points, self.counts = [], [], []

    def add(self, texts: list[str]) -> None:
        which, hashes, points, _ = _ngrams([x for x in texts if x])
        if len(hashes):
            self.hashes.append(hashes)
            self.points.append(points)
            self.counts.append(np.bincount(which, minlength=len(hashes)))

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes in order, code points, counts)."""
        if not self.hashes:
            return np.zeros(0, np.uint64), np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int64)
        hashes, at, where = np.unique(np.concatenate(self.hashes), return_index=True, return_inverse=True)
        return hashes, np.concatenate(self.points)[at], np.bincount(where, np.concatenate(self.counts), len(hashes)).astype(np.int64)


def count(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, c) of all n-grams of the highest order: added up by blocks of a task, then by shard."""

    def run(batches):
        def told(seen):
            _, points, counts = seen.all()
            for at in range(0, len(counts), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(_strings(points[at : at + (1 << 16)])), pa.array(counts[at : at + (1 << 16)])], ["gram", "c"])

        seen, used = Gathered(), 0
        for batch in byte_slices(batches, "text", SLICE_BYTES):
            texts = texts_of(batch)
            seen.add(texts)
            used += sum(map(len, texts))
            if used >= BLOCK_BYTES:
                yield from told(seen)
                seen, used = Gathered(), 0
        yield from told(seen)

    rows = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "gram string, c long")
    return rows.groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(n: list[int]) -> list[float]:
    """The three discounts of one order, from the numbers of n-grams counted once to four times."""
    n = [0, *n]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
    usual = (0.5, 0.75, 0.9)
    return [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) if n[k] and n[k + 1] else usual[k - 1] for k in (1, 2, 3)]


def shorter(highest: DataFrame) -> DataFrame:
    """(gram, c, order) of the orders below the highest: there an n-gram counts once for each code point before it."""
    # With c in it the aggregate below is the same one as in the highest order's own rows, so that its shuffle is shared.
    seen = highest.where("c > 0")
    tails = (F.struct(F.lit(n).alias("order"), F.substring("gram", ORDER - n, n + 1).alias("longer")) for n in range(1, ORDER - 1))
    longer = seen.select(F.lit(ORDER - 1).alias("order"), F.col("gram").alias("longer")).union(seen.select(F.explode(F.array(*tails)).alias("a")).select("a.*").distinct())
    return longer.groupBy(F.expr("substring(longer, 2, order)").alias("gram"), "order").agg(F.count(F.lit(1)).alias("c")).select("gram", "c", "order")


def train(trusted: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, context, own, gamma, order) of each n-gram of each order: its discounted share of its context, and the
    context's weight of the order below. Only counts are written, once for all orders, as each file costs an executor two
    forks where Hadoop has no native code; the discounts, which need all counts, come when the table is read."""
    highest = count(trusted, text_col)
    every = highest.select("gram", "c", F.lit(ORDER).alias("order")).union(shorter(highest))
    context = Window.partitionBy("order", "context")  # at most as many rows as there are code points
    of = [F.count_if(x).over(context).alias(f"k{k}") for k, x in ((1, F.col("c") == 1), (2, F.col("c") == 2), (3, F.col("c") >= 3))]
    counted = every.withColumn("context", F.expr("substring(gram, 1, order - 1)"))
    counts = materialise(counted.select("gram", "context", "c", F.sum("c").over(context).alias("all"), *of, "order"), "model")
    rare = counts.groupBy("order").agg(*(F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).collect()
    lost = held = F.lit(None).cast("double")
    for r in rare:
        d1, d2, d3 = discounts([r[f"n{k}"] for k in (1, 2, 3, 4)])
        here = F.col("order") == r["order"]
        lost = F.when(here, F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)).otherwise(lost)
        held = F.when(here, d1 * F.col("k1") + d2 * F.col("k2") + d3 * F.col("k3")).otherwise(held)
    return counts.select("gram", "context", ((F.col("c") - lost) / F.col("all")).alias("own"), (held / F.col("all")).alias("gamma"), "order")


def probabilities(model: DataFrame, grams: DataFrame) -> DataFrame:
    """(gram, p) of the n-grams of the highest order in ``grams`` (gram, each once), seen in training or not."""
    spark, before = grams.sparkSession, written(grams.sparkSession)
    highest = materialise(grams, "asked")
    below = None
    for n in range(1, ORDER + 1):
        asked = highest if n == ORDER else highest.select(F.substring("gram", ORDER + 1 - n, n).alias("gram")).distinct()
        rows = asked.select("gram", F.substring("gram", 1, n - 1).alias("context"), F.substring("gram", 2, n - 1).alias("suffix"))
        known = model.where(F.col("order") == n)
        rows = rows.join(known.select("gram", "own"), "gram", "left").join(known.groupBy("context").agg(F.first("gamma").alias("gamma")), "context", "left")
        if below is None:
            rows = rows.withColumn("below", F.lit(1.0 / CODE_POINTS))
        else:
            rows = rows.join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix", "left")
        p = F.coalesce("own", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col("below")
        below = rows.select("gram", p.alias("p"))
    below = materialise(below, "asked")
    remove(spark, [x for x in written(spark)[:-1] if x not in before])
    return below


def in_blocks(docs: DataFrame, text: str, block: str, row: str) -> tuple[DataFrame, int]:
    """``docs`` as written, with two longs last: ``block``, which rows of one task with about BLOCK_BYTES of text
    share, and ``row``, a number of its own; and about how many blocks there are. Little text makes smaller blocks, two a core."""

    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    wide = min(max(size // (2 * docs.sparkSession.sparkContext.defaultParallelism), SLICE_BYTES), BLOCK_BYTES)

    def run(batches: Iterator[pa.RecordBatch]):
        base, used, at = TaskContext.get().partitionId(), 0, 0
        for batch in byte_slices(batches, text, SLICE_BYTES):
            n = batch.num_rows
            numbers = [pa.array([(base << 32) + used // wide] * n, pa.int64()), pa.array(np.arange(at, at + n) + (base << 40))]
            used += sum(len(x.encode("utf-8", "surrogatepass")) for x in texts_of(batch, text))
            at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *numbers], [*batch.schema.names, block, row])

    kind = T.StructType([*docs.schema.fields, T.StructField(block, T.LongType()), T.StructField(row, T.LongType())])
    count = 1 + size // wide
    return materialise_buckets(docs.mapInArrow(run, kind), "blocks", block, min(count, 100_000)), count


def _pack(points: np.ndarray) -> bytes:
    """N-grams, already in the order of their code points, column by column."""
    return pa.compress(np.ascontiguousarray(points.T, "<u4").tobytes(), "zstd", asbytes=True)


def _unpack(raw: bytes, n: int) -> list[np.ndarray]:
    flat = np.frombuffer(pa.decompress(raw, 4 * ORDER * n, "zstd", asbytes=True), "<u4")
    return [flat[k * n : (k + 1) * n] for k in range(ORDER)]


def _shards(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def _asked(blocks: DataFrame, block: str, text: str, shards: int) -> DataFrame:
    """(shard, block, n, grams): the different n-grams of each block, packed by shard."""

    def run(batches: Iterator[pa.RecordBatch]):
        def told(of, seen):
            hashes, points, _ = seen.all()
            shard = _shards(hashes, shards)
            points = points[np.lexsort((*points.T[::-1], shard))]
            edges = np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])
            some = np.flatnonzero(np.diff(edges))
            for at in range(0, len(some), 256):
                part = some[at : at + 256]
                packed = [_pack(points[edges[k] : edges[k + 1]]) for k in part]
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([of] * len(part), pa.int64()), pa.array((edges[part + 1] - edges[part]).astype(np.int32)), pa.array(packed, pa.binary())], ["shard", "block", "n", "grams"])

        of, seen = None, Gathered()
        for batch in byte_slices(batches, "text", SLICE_BYTES):
            numbers = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if of != numbers[a]:
                    if of is not None:
                        yield from told(of, seen)
                    of, seen = int(numbers[a]), Gathered()
                seen.add(texts_of(batch.slice(a, b - a)))
        if of is not None:
            yield from told(of, seen)

    rows = blocks.select(F.col(block).alias("block"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "shard int, block long, n int, grams binary")  # a block that two tasks read may ask twice


def _different(asked: pa.Table) -> pa.Table:
    """(gram) of all requests of a shard, each once."""
    rows = [_unpack(raw, n) for raw, n in zip(asked.column("grams").to_pylist(), asked.column("n").to_pylist(), strict=True)]
    columns = [np.concatenate([r[k] for r in rows]) for k in range(ORDER)]
    at = np.unique(_hashes(columns), return_index=True)[1]
    return pa.table({"gram": pa.array(_strings(np.stack([c[at] for c in columns], axis=1)), pa.string())})


def _answers(asked: pa.Table, known: pa.Table) -> pa.Table:
    """(block, n, grams, surprise) of all requests of a shard; known: gram, p."""
    hashes = _hashes(list(_rows(known.column("gram").to_pylist()).T)) if known.num_rows else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    hashes, surprise = hashes[order], -np.log(known.column("p").to_numpy()[order]).astype("<f4")
    values = [surprise[np.searchsorted(hashes, _hashes(_unpack(raw, n)))].tobytes() for raw, n in zip(asked.column("grams").to_pylist(), asked.column("n").to_pylist(), strict=True)]
    return pa.table([asked.column("block"), asked.column("n"), asked.column("grams"), pa.array(values, pa.binary())], ["block", "n", "grams", "surprise"])


def score(model: DataFrame, docs: DataFrame, text: str, block: str, row: str, carry: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """``docs``, whose column ``text`` is a string, as ``in_blocks`` wrote it, and (row, those of ``carry``, total, n) of
    each: the summed negative log probability and number of a text's characters. carry: a name for each expression
    that goes along; ``block`` and ``row`` name columns that docs hasn't."""
    blocks, count = in_blocks(docs, text, block, row)
    shards = max(16, -(-count // BLOCKS_A_SHARD))
    asked = materialise(_asked(blocks, block, text, shards), "asked")
    known = probabilities(model, asked.groupBy("shard").applyInArrow(_different, "gram string"))

    def dealt(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                shard = _shards(_hashes(list(_rows(batch.column(0).to_pylist()).T)), shards)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], ["gram", "p", "shard"])

    known = known.mapInArrow(dealt, "gram string, p double, shard int")
    answers = asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_answers, "block long, n int, grams binary, surprise binary")
    light = blocks.select(F.col(block).alias("block"), F.col(row).alias("row"), F.col(f"`{text}`").alias("text"), *(F.expr(x).alias(c) for c, x in carry.items()))
    names = ["row", *carry]
    kind = T.StructType([*(light.schema[c] for c in names), T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType())])

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = zip(right.column("grams").to_pylist(), right.column("n").to_pylist(), strict=True)
        hashes = np.concatenate([np.zeros(0, np.uint64), *(_hashes(_unpack(raw, n)) for raw, n in lists)])
        surprise = np.frombuffer(b"".join(right.column("surprise").to_pylist()), "<f4")
        order = np.argsort(hashes)
        hashes, surprise = hashes[order], surprise[order].astype(float)
        totals, numbers = [np.zeros(0)], [np.zeros(0, np.int64)]
        for batch in byte_slices(left.select(["text"]).to_batches(), "text", SLICE_BYTES // 2):
            which, distinct, _, n = _ngrams(texts_of(batch), spelt=False)
            values = surprise[np.searchsorted(hashes, distinct)] if len(distinct) else np.zeros(0)
            run = np.concatenate([[0.0], np.cumsum(values[which])])
            ends = np.cumsum(n)
            totals.append(run[ends] - run[ends - n])
            numbers.append(n)
        out = left.select(names)
        return out.append_column("total", pa.array(np.concatenate(totals))).append_column("n", pa.array(np.concatenate(numbers)))

    # A block of empty texts has no answers; a cogroup keeps it all the same.
    return blocks, light.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add, kind)
