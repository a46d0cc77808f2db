"""Bloom filter files in the OXLI layout."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The format's mark, version and type of file; little-endian throughout.
MARK, VERSION, KIND = b"OXLI", 4, 2
BUCKET_BITS = 32768


def parse(raw: bytes) -> dict:
    """The fields of one file: ksize, occupied, and for each table its size and set bins."""
    mark, version, kind, ksize, tables, occupied = struct.unpack_from("<4sBBIBQ", raw)
    if (mark, version, kind) != (MARK, VERSION, KIND):
        raise ValueError("not an OXLI Bloom filter of version 4, type 2")
    at, sizes, bins = struct.calcsize("<4sBBIBQ"), [], []
    for _ in range(tables):
        (size,) = struct.unpack_from("<Q", raw, at)
        body = np.frombuffer(raw, np.uint8, size // 8 + 1, at + 8)
        at += 8 + size // 8 + 1
        bits = np.flatnonzero(np.unpackbits(body, bitorder="little"))
        sizes.append(size)
        bins.append(bits[bits < size])
    return {"ksize": ksize, "occupied": occupied, "sizes": sizes, "bins": bins}


def render(sizes: list[int], bins: list[np.ndarray], ksize: int) -> bytes:
    """The bytes of one file; each table has size / 8 + 1 bytes, also where 8 divides the size."""
    occupied = sum(len(np.unique(b)) for b in bins)
    out = [struct.pack("<4sBBIBQ", MARK, VERSION, KIND, ksize, len(sizes), occupied)]
    for size, some in zip(sizes, bins, strict=True):
        bits = np.zeros((size // 8 + 1) * 8, np.uint8)
        bits[np.asarray(some, np.int64)] = 1
        out += [struct.pack("<Q", size), np.packbits(bits, bitorder="little").tobytes()]
    return b"".join(out)


def read_filters(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, ksize, occupied, tbl, size, bins array) of each file's tables."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(frames):
        for pdf in frames:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                f = parse(bytes(content))
                rows += [(name, f["ksize"], f["occupied"], i, size, b.tolist()) for i, (size, b) in enumerate(zip(f["sizes"], f["bins"], strict=True))]
            yield pd.DataFrame(rows, columns=["path", "ksize", "occupied", "tbl", "size", "bins"])

    return raw.mapInPandas(run, "path string, ksize long, occupied long, tbl int, size long, bins array<bigint>")


def to_bitmaps(read: DataFrame, by: str = "path") -> DataFrame:
    """(node, tbl, bucket, bitmap) of files that were read."""
    place = F.col("bin") + 1
    bins = read.select(F.col(by).alias("node"), "tbl", F.explode("bins").alias("bin"))
    return bins.groupBy("node", "tbl", F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))


def to_files(filters: DataFrame, sizes: list[int], ksize: int) -> DataFrame:
    """(node, content): the file of each filter (node, tbl, bucket, bitmap). A filter's rows are bounded by its tables."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bins: list[list[np.ndarray]] = [[] for _ in sizes]
        for tbl, bucket, bitmap in zip(pdf["tbl"], pdf["bucket"], pdf["bitmap"], strict=True):
            bits = np.flatnonzero(np.unpackbits(np.frombuffer(bytes(bitmap), np.uint8), bitorder="little"))
            bins[tbl].append(bits + (int(bucket) - 1) * BUCKET_BITS)
        found = [np.concatenate([*b, np.zeros(0, np.int64)]).astype(np.int64) for b in bins]
        return pd.DataFrame({"node": [pdf["node"].iloc[0]], "content": [render(sizes, found, ksize)]})

    kind = filters.schema["node"].dataType.simpleString()
    return filters.groupBy("node").applyInPandas(run, f"node {kind}, content binary")
