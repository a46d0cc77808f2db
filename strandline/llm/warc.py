"""WARC records and a Merkle fixity audit of replicas.

``records`` turns pages into WARC response records; ``place`` gives each its file and offset, in the order of
page id, by a two-pass prefix sum over the records' lengths alone: the bytes themselves are never shuffled,
only their hashes are. Files are closed at ``file_bytes``.

``audit`` compares two replicas. A record's leaf is the SHA-256 of its place, length and digest. Leaves are
hashed by ordered ranges of ``span`` bytes of a file, those ranges eight by eight up to the file's root, and
files eight by eight, in the order of their numbers, up to one root: each node is the SHA-256 of its children's numbers
and hashes in order. The audit starts from the two roots and goes down only below nodes that differ, so equal
branches are never opened and equal replicas end at the root.

A node has eight children, and a range as many records as it has bytes at most, so nothing unbounded is
gathered. Records at one place in one replica (repeated rows) are first put together under their least and
greatest digest and number. Null urls and pages are empty; null page ids come first. A null file, offset or record
takes no part in an audit. Empty replicas are equal. Other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import join_small, materialise, with_bases

FANOUT = 8
SPAN = 1 << 18
FILE_BYTES = 64 << 20


def records(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(page_id, record): each page as the bytes of a WARC record. ``date`` stands for the time of capture, which pages
    don't tell. A record of a null page id is named by the hash of its url and page."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    end = F.lit("\r\n")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.sha2(F.concat(text("url"), F.lit("\n"), text("html")), 256)),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), text("url"), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(text("html")).cast("string"), end, end,
    )
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.concat(head, text("html"), end, end).cast("binary").alias("record"))


def place(recs: DataFrame, file_bytes: int = FILE_BYTES, first_file: int = 0) -> DataFrame:
    """(page_id, file, offset, length, digest) of each record, by page id and digest, in files from ``first_file`` on; no
    record is split."""
    light = recs.select("page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    ordered = light.repartitionByRange("page_id", "digest").sortWithinPartitions("page_id", "digest")

    def run(batches):
        pid, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at + np.cumsum(n) - n), pa.array(np.full(len(n), pid, np.int32))], [*batch.schema.names, "at", "pid"])
            at += int(n.sum())

    summed = materialise(ordered.mapInArrow(run, "page_id long, length long, digest string, at long, pid int"), "warc")
    totals = summed.groupBy("pid").agg(F.sum("length").alias("total"))
    placed = with_bases(summed, totals, "total", "base").withColumn("global", F.col("base") + F.col("at"))
    placed = placed.withColumn("file", F.floor(F.col("global") / file_bytes).cast("long"))
    starts = placed.groupBy("file").agg(F.min("global").alias("start"))
    return join_small(placed, starts, "file").select("page_id", (F.col("file") + first_file).alias("file"), (F.col("global") - F.col("start")).alias("offset"), "length", "digest")


def place_copy(first: DataFrame, copy: DataFrame) -> DataFrame:
    """(file, offset, length, digest) of a second replica's records, hashed from their own bytes, at the places that
    ``first`` (from ``place``) gave them. copy: page_id, written (the digest of what was once written), record."""
    read = copy.select(F.col("page_id").alias("of"), "written", F.octet_length("record").cast("long").alias("found"), F.sha2("record", 256).alias("read")).distinct()
    placed = first.join(read, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("written")))
    return placed.select("file", "offset", F.col("found").alias("length"), F.col("read").alias("digest"))


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def leaves(replica: DataFrame) -> DataFrame:
    """(file, offset, length, digest, leaf): a row for each place. replica: file, offset, length, digest."""
    known = replica.where(F.col("file").isNotNull() & F.col("offset").isNotNull() & F.col("digest").isNotNull())
    one = known.groupBy("file", "offset").agg(F.max("length").alias("length"), F.min("digest").alias("digest"), F.max("digest").alias("other"), F.count(F.lit(1)).alias("n"))
    return one.select("file", "offset", "length", "digest", _hash(F.col("offset"), F.col("length"), F.col("digest"), F.col("other"), F.col("n")).alias("leaf"))


def _fold(children: DataFrame, file: Column, node: Column, order: str, hashed: str) -> DataFrame:
    """The parents (file, node, hash) of nodes or leaves, from their hashes in order."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(hashed).alias("h"))))
    folded = children.select(file.alias("f"), node.alias("k"), order, hashed).groupBy("f", "k").agg(ordered.alias("c"))
    return folded.select(F.col("f").alias("file"), F.col("k").alias("node"), F.sha2(F.array_join(F.transform("c", lambda c: F.concat_ws(":", c["o"], c["h"])), "|"), 256).alias("hash"))


def tree(found: DataFrame, span: int = SPAN, file_bytes: int = FILE_BYTES, last_file: int = 0) -> list[DataFrame]:
    """The levels (file, node, hash) from the ranges of leaves up to the root."""
    levels = [materialise(_fold(found, F.col("file"), F.floor(F.col("offset") / span).cast("long"), "offset", "leaf"), "ranges")]
    width = span
    while width < file_bytes + span:  # up to the files' roots; a file's last record may reach beyond its bytes
        levels.append(materialise(_fold(levels[-1], F.col("file"), F.floor(F.col("node") / FANOUT).cast("long"), "node", "hash"), "ranges"))
        width *= FANOUT
    files = last_file + 1
    while files > 1:
        levels.append(materialise(_fold(levels[-1], F.floor(F.col("file") / FANOUT).cast("long"), F.lit(0).cast("long"), "file", "hash"), "ranges"))
        files = -(-files // FANOUT)
    return levels


def audit(left: DataFrame, right: DataFrame, span: int = SPAN, file_bytes: int = FILE_BYTES) -> DataFrame:
    """(file, offset, length, digest, found_digest, fault) of each place where ``right`` differs from ``left``;
    fault: changed, missing (only left has it) or extra. Both: file, offset, length, digest."""
    a, b = (materialise(leaves(x), "leaves") for x in (left, right))
    last = a.select("file").union(b.select("file")).agg(F.max("file")).first()[0] or 0
    up_a, up_b = (tree(x, span, file_bytes, last) for x in (a, b))
    in_file = 1
    width = span
    while width < file_bytes + span:
        in_file, width = in_file + 1, width * FANOUT
    differing = None  # the nodes to open, of the level just compared
    for level in range(len(up_a) - 1, -1, -1):
        x, y = up_a[level], up_b[level]
        if differing is not None:
            over_files = level + 1 >= in_file
            file = F.floor(F.col("file") / FANOUT) if over_files else F.col("file")
            node = F.lit(0).cast("long") if over_files else F.floor(F.col("node") / FANOUT)
            opened = differing.select(F.col("file").alias("of"), F.col("node").alias("on"))
            x, y = (join_small(z, opened, (file == F.col("of")) & (node == F.col("on")), "left_semi") for z in (x, y))
        both = x.select("file", "node", F.col("hash").alias("h")).join(y, ["file", "node"], "full_outer")
        differing = materialise(both.where(~F.col("h").eqNullSafe(F.col("hash"))).select("file", "node"), "differing")
    opened = differing.select(F.col("file").alias("of"), F.col("node").alias("on"))
    near = (F.col("file") == F.col("of")) & (F.floor(F.col("offset") / span) == F.col("on"))
    x, y = (join_small(z, opened, near, "left_semi") for z in (a, b))
    y = y.select("file", "offset", F.col("length").alias("found_length"), F.col("digest").alias("found_digest"), F.col("leaf").alias("found_leaf"))
    both = x.join(y, ["file", "offset"], "full_outer").where(~F.col("leaf").eqNullSafe(F.col("found_leaf")))
    fault = F.when(F.col("leaf").isNull(), "extra").when(F.col("found_leaf").isNull(), "missing").otherwise("changed")
    return both.select("file", "offset", F.coalesce("length", "found_length").alias("length"), "digest", "found_digest", fault.alias("fault"))
