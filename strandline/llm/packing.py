"""Packing by concatenate and cut.

All documents form one stream of ids, each closed by ``end_id``. Pass one encodes each text once and writes
its ids with its place in its partition; the partitions' totals, a row each, give every partition its
global base by a prefix sum. Pass two cuts the stream at every multiple of the window and returns a boundary
record for each piece. Only the last sequence of all can be short, so padding is under one window.

The order is that of the written partitions; each id lies in exactly one piece, whatever was retried, as the
places are read from the committed table. Null texts are empty (the end id alone); an empty table gives no
pieces; repeated rows are packed as often as they occur; other columns of the input are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import bounded_batches, byte_slices, materialise, texts_of, with_bases
from strandline.llm.encoders import encoder

WINDOW = 1024


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pid, at, n, wide, ids): ids as bytes, ``at`` ids after the start of partition ``pid``. Not yet written."""
    source = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {source.schema['id'].dataType.simpleString()}, pid int, at long, n long, wide int, ids binary"

    def encode(batches):
        enc, pid, at = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        width, end = enc.dtype.itemsize, np.asarray([end_id], enc.dtype).tobytes()
        for batch in byte_slices(batches, "text", 1 << 20):
            ids = [x + end for x in enc.encode(texts_of(batch))]
            n = np.fromiter((len(x) // width for x in ids), np.int64, len(ids))
            places = at + np.cumsum(n) - n
            at += int(n.sum())
            rows = len(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(rows, pid, np.int32)), pa.array(places), pa.array(n), pa.array(np.full(rows, width, np.int32)), pa.array(ids, pa.binary())],
                ["id", "pid", "at", "n", "wide", "ids"],
            )

    return source.mapInArrow(encode, schema)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: (``id_col``, start, length, doc_tokens, sequence_id, offset, ids).

    ids: the piece's ids as little-endian unsigned 32-bit numbers. ``start`` counts the document's ids before
    the piece, ``offset`` the sequence's."""
    encoded = materialise(encode_documents(docs, tokenizer_path, end_id, id_col, text_col), "packing", "zstd")
    totals = encoded.groupBy("pid").agg(F.sum("n").alias("total"))
    placed = with_bases(encoded, totals, "total", "base").select("id", (F.col("base") + F.col("at")).alias("place"), "n", "wide", "ids")
    schema = f"id {encoded.schema['id'].dataType.simpleString()}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

    def cut(batches):
        for batch in byte_slices(batches, "ids", 1 << 20):
            place, n, wide = (batch.column(i).to_numpy() for i in (1, 2, 3))
            row, start, stop, ids = [], [], [], []
            for i, raw in enumerate(batch.column(4)):
                wider = np.frombuffer(raw.as_buffer(), "<u2" if wide[i] == 2 else "<u4").astype("<u4").tobytes()
                g, total, a = int(place[i]), int(n[i]), 0
                while a < total:
                    b = min(total, a + window - (g + a) % window)
                    row.append(i)
                    start.append(a)
                    stop.append(b)
                    ids.append(wider[4 * a : 4 * b])
                    a = b
            at, a, b = np.asarray(row, np.int64), np.asarray(start, np.int64), np.asarray(stop, np.int64)
            g = place[at] + a
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), *map(pa.array, (a, b - a, n[at], g // window, g % window)), pa.array(ids, pa.binary())],
                ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return placed.mapInArrow(cut, schema).withColumnRenamed("id", id_col)
