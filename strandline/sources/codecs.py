"""Compressed files by what they hold, not by their names."""

from __future__ import annotations

import bz2
import gzip
import lzma
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How each format's files begin.
MAGIC = {"gzip": bytes.fromhex("1F8B"), "bzip2": bytes.fromhex("425A"), "lzma": bytes.fromhex("FD377A585A")}
_OPEN = {"gzip": gzip.decompress, "bzip2": bz2.decompress, "lzma": lzma.decompress}
_CLOSE = {"gzip": lambda x: gzip.compress(x, 9, mtime=0), "bzip2": lambda x: bz2.compress(x, 9), "lzma": lambda x: pack_lzma(x)}


def pack_lzma(content: bytes) -> bytes:
    """At the best level, with a dictionary no longer than the content, which finds the same matches: the level's own has
    64 MB and takes 674 MB of memory, made anew for each content."""
    fitting = min(1 << 26, max(4096, 1 << (len(content) - 1).bit_length() if content else 0))
    return lzma.compress(content, filters=[{"id": lzma.FILTER_LZMA2, "preset": 9, "dict_size": fitting}])


def plain(content: bytes | None) -> bytes | None:
    """The bytes of content in any of the formats."""
    for name, magic in MAGIC.items():
        if content is not None and content.startswith(magic):
            return _OPEN[name](content)
    return content


def sniff(content: Column) -> Column:
    """gzip, bzip2, lzma or none, by the first bytes; files too short to say are none."""
    start = F.hex(F.substring(content, 1, 5))
    named = F.lit("none")
    for name, magic in MAGIC.items():
        named = F.when(start.startswith(magic.hex().upper()), name).otherwise(named)
    return named


def decompress(content: Column) -> Column:
    """The plain bytes of content in any of the formats."""

    def run(blobs: pa.Array) -> pa.Array:
        return pa.array([plain(x) for x in blobs.to_pylist()], pa.binary())

    return F.arrow_udf(run, "binary")(content)


def compress(content: Column, codec: str) -> Column:
    """The bytes in one of the formats, at its best level, or as they are for ``none``."""
    if codec == "none":
        return content
    pack = _CLOSE[codec]

    def run(blobs: pa.Array) -> pa.Array:
        return pa.array([None if x is None else pack(x) for x in blobs.to_pylist()], pa.binary())

    return F.arrow_udf(run, "binary")(content)


def choose(found: str, is_set: bool, value: str | None = None) -> str:
    """The format to write in: the named one (an unknown name: none) if one was set, else the input's own."""
    if not is_set:
        return found
    return value if value in MAGIC else "none"


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, codec, content): whole files, decompressed by what they hold. The path ``-`` is the driver's standard input."""
    if path == "-":
        raw = spark.createDataFrame([("-", sys.stdin.buffer.read())], "path string, content binary")
    else:
        raw = spark.read.format("binaryFile").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a file at a time in plain form
                part = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([plain(part.column(2)[0].as_py())], pa.binary())], ["path", "codec", "content"])

    return raw.select("path", sniff(F.col("content")).alias("codec"), "content").mapInArrow(run, "path string, codec string, content binary")
