"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Texts become sets of five-word shingles; texts with equal sets are put together first, so that copies cost
one row whatever their number. Each set has ``trees`` labels of ``depth`` min-hashes. All labels are sorted by tree
and label, which is the depth-first order of the trees' prefix tries: the longest common prefix of a label with the one
before it tells every trie node that both are under. One sort so gives, for each prefix length, the first set under a
set's node; neighbours over the edge of two partitions are compared on the driver, a row each partition.

Matching starts from whole labels. The sets under one trie node are linked to the node's first set, never to each other;
the components of these links hold the candidate pairs, and are verified whole and exactly. Of the links found the least
similar one, of similarity s, says how far a prefix has to be shortened: until the chance that such a pair shares a
prefix in one tree at least, 1 - (1 - s^prefix)^trees, is ``recall`` or more (of links at the threshold, if none was
found). What a shorter prefix finds can ask for a shorter one still. So texts whose copies are nearly equal are matched
by long prefixes that little else shares, and no similarity that was met is found less surely than ``recall``.

Verification counts the intersections of sets in blocks against blocks, each pair of blocks in a task of its own; only
each set's number of links and a spanning forest leave the task. Blocks have at most ``block`` sets and about
ELEMENTS shingles. In a component of several, sets are put in classes by size, a class ending where sizes have grown by
1 / threshold: links only join sets of one class or two neighbouring ones, and other blocks never meet. So no pair is
listed, none within a component is missed, and one huge group is spread over many tasks of bounded memory.

Rows with a null id, and texts without words (null, empty, blank), have no links: class null and their own id.
Texts of under five words have one shingle of all their words. Very long texts are sets like others, hashed whole in
one task; a set of a million shingles takes 8 MB and a block of its own. Repeated rows are copies of each other; rows of one id
with different texts are sets of their own, each with its class. A pair exactly at the threshold is linked. An
empty table gives no rows. Other columns are left out (``near_duplicates``) or pass (``keep_one``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import bounded_batches, byte_slices, join_small, materialise, remove, texts_of, written
from strandline.llm.components import components
from strandline.llm.shingles import min_hashes, mix, shingle_sets

#: Above so many sets that hold a shingle, its pairs are counted by a matrix product.
DENSE = 32
#: About so many shingles make a block; the class of a set's size is bounded by a set's memory, not by this.
ELEMENTS = 1 << 20


def prefix_length(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix, from ``depth`` down, at which a pair at the threshold is found with ``recall``."""
    length = depth
    while length > 1 and 1 - (1 - threshold**length) ** trees < recall:
        length -= 1
    return length


def _keys(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name each set."""
    run = lambda x: np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    ends = np.cumsum(n)
    return tuple((lambda r: (r[ends] - r[ends - n]).astype(np.int64))(run(x)) for x in (h, mix(h ^ np.uint64(0xA5A5A5A5))))


def sketch(docs: DataFrame, trees: int, depth: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, k1, k2, marks): the set's size and names, and 16 bits of each min-hash, tree by tree."""
    source = bounded_batches(docs).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in byte_slices(batches, "text", 1 << 20):
            h, n = shingle_sets(texts_of(batch), words)
            k1, k2 = _keys(h, n)
            some = n > 0
            marks = np.zeros((len(n), trees * depth), ">u2")
            marks[some] = min_hashes(h, n[some], trees * depth) & np.uint32(0xFFFF)
            packed = pa.array([x.tobytes() for x in marks], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(k1), pa.array(k2), packed], ["id", "n", "k1", "k2", "marks"])

    return source.mapInArrow(run, "id long, n long, k1 long, k2 long, marks binary")


def common_prefixes(labels: np.ndarray, before: np.ndarray) -> np.ndarray:
    """For each row of bytes the number of min-hashes (two bytes each) that it shares with the row above it, of the same
    tree (the first byte); ``before`` stands above the first."""
    above = np.concatenate([before[None], labels[:-1]])
    same = np.concatenate([labels == above, np.zeros((len(labels), 1), bool)], axis=1)
    return np.maximum(same.argmin(axis=1) - 1, 0) // 2


def forest(sets: DataFrame, trees: int, depth: int, shortest: int) -> DataFrame:
    """(node, heads): of a set's label in a tree, the first set under the same trie node, by the length of the node's
    prefix less ``shortest`` (null where it is that set itself). Labels that share no such prefix have no row. sets: node, marks."""
    width = 2 * depth
    label = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.concat(F.unhex(F.lpad(F.hex(t), 2, "0")), F.substring(F.col("marks"), 1 + width * t, F.lit(width))))
    rows = sets.select("node", F.explode(label).alias("label")).repartitionByRange("label", "node").sortWithinPartitions("label", "node")
    lengths = np.arange(shortest, depth + 1)

    def run(batches):
        first, last, above = None, None, np.full(1 + width, 255, np.uint8)
        heads = np.zeros(len(lengths), np.int64)
        kind = pa.list_(pa.int64())

        def row(node, head, pid, first, last):
            return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(head, kind), pa.array(pid, pa.int32()), pa.array(first, pa.binary()), pa.array(last, pa.binary())], ["node", "heads", "pid", "first", "last"])

        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy()
            labels = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(node), 1 + width)
            shared = common_prefixes(labels, above)
            if first is None:
                first, shared[0] = (int(node[0]), labels[0].tobytes()), 0
            here = np.empty((len(node), len(lengths)), np.int64)
            for i, d in enumerate(lengths):
                start = np.where(shared < d, np.arange(len(node)), -1)
                at = np.maximum.accumulate(start)
                here[:, i] = np.where(at < 0, heads[i], node[at])
            heads, above, last = here[-1], labels[-1], (int(node[-1]), labels[-1].tobytes())
            some = np.flatnonzero(shared >= shortest)
            told = [[int(x) if shared[k] >= d else None for x, d in zip(here[k], lengths, strict=True)] for k in some]
            if len(some):
                none = [None] * len(some)
                yield row(node[some], told, none, none, none)
        if first is not None:
            yield row([last[0]], [[first[0]]], [TaskContext.get().partitionId()], [first[1]], [last[1]])

    found = materialise(rows.mapInArrow(run, "node long, heads array<bigint>, pid int, first binary, last binary"), "forest")
    edges = found.where("pid is not null").orderBy("pid").collect()  # a row for each partition
    links = []
    for x, y in zip(edges, edges[1:], strict=False):
        shared = common_prefixes(np.frombuffer(y["first"], np.uint8)[None], np.frombuffer(x["last"], np.uint8))[0]
        if shared >= shortest:
            links.append((y["heads"][0], [x["node"] if shared >= d else None for d in lengths.tolist()]))
    return found.where("pid is null").select("node", "heads").union(found.sparkSession.createDataFrame(links, "node long, heads array<bigint>"))


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of each set of ``a`` with each of ``b``."""
    flat = np.concatenate([*a, *b])
    of = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in [*a, *b]])
    values, code = np.unique(flat, return_inverse=True)
    in_a = of < len(a)
    f_a, f_b = (np.bincount(code[x], minlength=len(values)) for x in (in_a, ~in_a))
    out = np.zeros((len(a), len(b)), np.float32)
    common = (f_a > 0) & (f_b > 0)
    dense = common & (np.minimum(f_a, f_b) > DENSE)
    place = np.cumsum(dense) - 1
    keep = dense[code]
    columns = int(dense.sum())
    for at in range(0, columns, 4096):
        here = keep & (place[code] >= at) & (place[code] < at + 4096)
        left, right = np.zeros((len(a), min(4096, columns - at)), np.float32), np.zeros((len(b), min(4096, columns - at)), np.float32)
        left[of[here & in_a], place[code[here & in_a]] - at] = 1
        right[of[here & ~in_a] - len(a), place[code[here & ~in_a]] - at] = 1
        out += left @ right.T
    sparse = (common & ~dense)[code]
    order = np.argsort(code[sparse & ~in_a], kind="stable")
    b_code, b_of = code[sparse & ~in_a][order], of[sparse & ~in_a][order] - len(a)
    a_code, a_of = code[sparse & in_a], of[sparse & in_a]
    starts, reps = np.searchsorted(b_code, a_code), f_b[a_code]
    for at in range(0, len(a_code), 1 << 16):
        part = slice(at, at + (1 << 16))
        n = reps[part]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        cell = np.repeat(a_of[part], n) * len(b) + b_of[np.repeat(starts[part], n) + within]
        out += np.bincount(cell, minlength=out.size).reshape(out.shape)
    return out


def _roots(links_i: np.ndarray, links_j: np.ndarray, count: int) -> np.ndarray:
    """Of each of ``count`` members the smallest that it is linked to through any number of links."""
    label = np.arange(count)
    while True:
        new = label.copy()
        np.minimum.at(new, links_i, label[links_j])
        np.minimum.at(new, links_j, label[links_i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify_block(members: pd.DataFrame, i: int, j: int, threshold: float) -> pd.DataFrame:
    """Each member's links in this block pair (copies counted), the root it hangs on in it, and the least similarity of its
    links here."""
    members = members.drop_duplicates("node").sort_values("node").reset_index(drop=True)
    sets = [np.frombuffer(x, np.uint64) for x in members["sets"]]
    first, second = (np.flatnonzero(members["unit"].to_numpy() == x) for x in (i, j))
    links, least = np.zeros(len(members), np.int64), np.ones(len(members))
    at_i, at_j = [], []
    if len(first) and len(second):
        size, copies = np.array([len(x) for x in sets]), members["copies"].to_numpy()
        shared = overlaps([sets[x] for x in first], [sets[x] for x in second])
        union = size[first][:, None] + size[second][None, :] - shared
        linked = shared >= threshold * union - 1e-6
        if i == j:
            np.fill_diagonal(linked, False)
        links[first] += linked @ copies[second]
        if i != j:
            links[second] += copies[first] @ linked
        row, col = np.nonzero(linked)
        at_i, at_j = first[row], second[col]
        np.minimum.at(least, at_i, shared[row, col] / union[row, col])
    root = _roots(np.asarray(at_i, int), np.asarray(at_j, int), len(members))
    node = members["node"].to_numpy()
    return pd.DataFrame({"node": node, "root": node[root], "links": links, "least": least, "alone": members["alone"].to_numpy()})


def verify(candidates: DataFrame, threshold: float) -> DataFrame:
    """(node, root, links, least, alone) of each member and block pair. candidates: comp, alone, unit, bin, i, j, node,
    copies, sets."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        done = [_verify_block(same, i, j, threshold) for (_, i, j), same in pdf.groupby(["comp", "i", "j"])]
        return pd.concat(done)

    return candidates.groupBy("bin", "i", "j").applyInPandas(run, "node long, root long, links long, least double, alone boolean")


def in_blocks(near: DataFrame, reps: DataFrame, threshold: float, block: int) -> DataFrame:
    """(node, rep, k1, k2, copies, comp, alone, unit, bin, others): where each candidate set is verified, and the units of
    its component that it may have links to. near: node, root."""
    placed = materialise(near.select("node", F.col("root").alias("comp")).join(reps.select("node", "rep", "n", "k1", "k2", "copies"), "node"), "placed")
    step = -float(np.log(threshold))
    placed = placed.withColumn("size", F.floor(F.log("n") / step).cast("int"))
    counts = placed.groupBy("comp", "size").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"))
    whole = Window.partitionBy("comp")  # a component has a row for each class of sizes, some hundred at most
    by_size = whole.orderBy("size")
    parts = F.greatest(F.ceil(F.col("sets") / block), F.ceil(F.col("shingles") / ELEMENTS)).cast("int")
    alone = (F.sum("sets").over(whole) <= block) & (F.sum("shingles").over(whole) <= ELEMENTS)
    counts = counts.select("comp", "size", parts.alias("parts"), alone.alias("alone"))
    beside = lambda f: F.when(f("size").over(by_size) == F.col("size") + (1 if f is F.lead else -1), f("parts").over(by_size)).otherwise(0)
    counts = materialise(counts.select("*", beside(F.lag).alias("before"), beside(F.lead).alias("after")), "classes")
    unit = lambda size, part: F.shiftleft(size.cast("long"), 32) + part
    units = lambda size, parts: F.when(parts > 0, F.transform(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1), lambda p: unit(size, p))).otherwise(F.array().cast("array<bigint>"))
    size = F.col("size")
    others = F.concat(units(size - 1, F.col("before")), units(size, F.col("parts")), units(size + 1, F.col("after")))
    mine = unit(size, F.pmod(F.xxhash64("node"), F.col("parts")))
    total = placed.agg(F.count(F.lit(1)), F.sum("n")).first()
    bins = max(1, -(-total[0] // 512), -(-(total[1] or 0) // ELEMENTS))
    zero = F.lit(0).cast("long")
    found = join_small(placed, counts, ["comp", "size"])
    return found.select(
        "node", "rep", "k1", "k2", "copies", "comp", "alone", F.when(F.col("alone"), zero).otherwise(mine).alias("unit"),
        F.when(F.col("alone"), F.pmod(F.xxhash64("comp"), F.lit(bins))).otherwise(F.col("comp")).alias("bin"), F.when(F.col("alone"), F.array(zero)).otherwise(others).alias("others"),
    )


def checked_links(docs: DataFrame, links: DataFrame, reps: DataFrame, threshold: float, words: int, block: int, id_col: str, text_col: str) -> DataFrame:
    """What ``verify`` finds in the components of ``links`` (node, head)."""
    wanted = in_blocks(components(links, "candidates"), reps, threshold, block)
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text"))
    names = ["node", "comp", "alone", "unit", "bin", "copies", "others"]
    fetched = join_small(texts, wanted, "rep").select(*names, "k1", "k2", "text")

    def sets_of(batches):
        for batch in byte_slices(batches, "text", 1 << 20):
            h, n = shingle_sets(texts_of(batch), words)
            k1, k2 = _keys(h, n)
            at = batch.schema.get_field_index
            same = (k1 == batch.column(at("k1")).to_numpy()) & (k2 == batch.column(at("k2")).to_numpy())
            raw = h.astype("<u8").tobytes()
            ends = 8 * np.cumsum(n)
            sets = pa.array([raw[e - 8 * k : e] for e, k in zip(ends, n, strict=True)], pa.binary())
            whole = pa.RecordBatch.from_arrays([*(batch.column(at(c)) for c in names), sets], [*names, "sets"])
            yield whole.filter(pa.array(same))  # rows of one id may hold several texts: only the set's own counts

    sets = fetched.mapInArrow(sets_of, "node long, comp long, alone boolean, unit long, bin long, copies long, others array<bigint>, sets binary")
    paired = sets.withColumn("o", F.explode("others")).withColumn("i", F.least("unit", "o")).withColumn("j", F.greatest("unit", "o")).drop("o", "others")
    return materialise(verify(paired, threshold), "verified")


def classes(docs: DataFrame, threshold: float = 0.8, words: int = 5, trees: int = 20, depth: int = 8, recall: float = 0.9995, block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(id, class_id, n_links) of each row whose id isn't null, and the prefix length that the data asked for."""
    spark = docs.sparkSession
    base = materialise(sketch(docs, trees, depth, words, id_col, text_col), "sketch")
    reps = base.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("marks").alias("marks"))
    reps = materialise(reps.withColumn("node", F.monotonically_increasing_id()), "sets")
    shortest, length = prefix_length(threshold, trees, depth, recall), depth
    tries = forest(reps.select("node", "marks"), trees, depth, shortest)
    while True:
        before = written(spark)
        links = tries.select("node", F.get("heads", F.lit(length - shortest)).alias("head")).where("head is not null")
        checked = checked_links(docs, links, reps, threshold, words, block, id_col, text_col)
        met = checked.where("links > 0").agg(F.min("least")).first()[0]
        enough = prefix_length(max(threshold, threshold if met is None else met), trees, depth, recall)
        if length <= enough:
            break
        length = enough
        remove(spark, [x for x in written(spark) if x not in before])
    linked = checked.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    across = checked.where("not alone").select("node", "root")
    if not across.isEmpty():
        joined = components(across, "joined").select("node", F.col("root").alias("wide"))
        linked = linked.join(joined, "node", "left").select("node", "links", F.coalesce("wide", "root").alias("root"))
    # Sets of one row without links need no row here: such a row's class is its own id.
    known = materialise(reps.drop("marks").join(linked, "node", "left").where("copies > 1 or root is not null"), "known")
    tops = known.where("root is not null").groupBy("root").agg(F.min("rep").alias("class_id"))
    named = join_small(known, tops, "root", "left").select("k1", "k2", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    found = join_small(base.select("id", "k1", "k2", "n"), named, ["k1", "k2"], "left")
    mine = F.col("n") > 0
    return found.select("id", F.coalesce(F.when(mine, F.col("class_id")), "id").alias("class_id"), F.coalesce(F.when(mine, F.col("links")), F.lit(0)).cast("long").alias("n_links")), length


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(``id_col``, class_id, n_links) of each row: the smallest id of all texts reached through links of Jaccard similarity
    ``threshold`` or more, and the number of other rows linked to this one directly. Options are those of ``classes``."""
    known = classes(docs, id_col=id_col, **options)[0].withColumnRenamed("id", id_col)
    without = docs.where(F.col(id_col).isNull()).select(F.col(id_col).cast("long").alias(id_col), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return known.union(without)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Of each class the document with the smallest id, with its own columns; rows with a null id all stay.
    Rows that share an id are one document, of which one row stays unless each of its texts has a class led by another."""
    id_col = options.get("id_col", "doc_id")
    found = materialise(near_duplicates(docs, **options), "dropped").where(F.col(id_col).isNotNull())
    own = found.groupBy(id_col).agg(F.max(F.col(id_col) == F.col("class_id")).alias("leads"), F.count(F.lit(1)).alias("rows"))
    own = materialise(own.where("not leads or rows > 1"), "leads")
    kept = join_small(docs, own.where("not leads").select(id_col), id_col, "left_anti")
    if own.where("rows > 1").isEmpty():
        return kept
    return kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(kept.where(F.col(id_col).isNull()))
