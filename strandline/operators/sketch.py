"""MinHash sketches as ordinary aggregations over rows of hashes.

A sketch is a struct of its parameters and its hashes (``mins``, as hk, ascending), with the count of each
(``abunds``) if tracked. In number mode it holds the ``num`` smallest distinct hashes, in threshold mode all
that are at most ``max_hash``. Building is a count of (group, hash), which combines in every task, and in
number mode a ranked cut that Spark makes before the shuffle as well as after it; so neither a hot group nor
a hot hash meets in one task whole. Rows that hold arrays of hashes are never taken apart in number mode: each task
puts equal groups together and cuts them while it holds a bounded number of hashes, and what is shuffled is a row for
each group and task, or few more.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.hashing import SEED, bias_of, decode_hash, encode_hash
from strandline.functions.sequence import once
from strandline.operators.compare import KEYS, checked

SKETCH = "struct<num:bigint,ksize:int,is_protein:boolean,seed:decimal(20,0),max_hash:decimal(20,0),mins:array<bigint>,abunds:array<bigint>>"
# The usual parameters of a new sketch.
DEFAULT_NUM, DEFAULT_KSIZE = 1000, 21
#: So many hashes, about, a task holds at once while it puts equal groups together.
HELD = 1 << 20
#: Types of groups that can be told apart in an Arrow batch.
PLAIN = (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def normal_mode(num: int, max_hash: int) -> tuple[int, int]:
    """(num, max_hash) with one of them 0: a threshold wins over a number; neither is an error."""
    if num < 0 or max_hash < 0 or max_hash >= 1 << 64:
        raise ValueError("num and max_hash must not be negative, and max_hash must fit 64 bits")
    if not num and not max_hash:
        raise ValueError("a sketch needs num or max_hash")
    return (0, max_hash) if max_hash else (num, 0)


def max_hash_of(scaled: int | None) -> int:
    """The threshold that keeps one hash in ``scaled``; 0 (off) for none."""
    return min((1 << 64) - 1, (1 << 64) // scaled) if scaled else 0


def cast_sketch(mins: Column, abunds: Column | None = None, num: int = DEFAULT_NUM, ksize: int = DEFAULT_KSIZE, is_protein: bool = False, seed: int = SEED, max_hash: int = 0) -> Column:
    """A sketch struct of these hashes, which must be distinct and ascending."""
    lit = lambda x, kind: F.lit(str(x)).cast(kind)
    return F.struct(
        lit(num, "bigint").alias("num"), lit(ksize, "int").alias("ksize"), F.lit(is_protein).alias("is_protein"),
        lit(seed, "decimal(20,0)").alias("seed"), lit(max_hash, "decimal(20,0)").alias("max_hash"),
        mins.cast("array<bigint>").alias("mins"), (F.lit(None) if abunds is None else abunds).cast("array<bigint>").alias("abunds"),
    )


def new_sketch(track_abundance: bool = False, **parameters) -> Column:
    """An empty sketch."""
    empty = F.array().cast("array<bigint>")
    return cast_sketch(empty, empty if track_abundance else None, **parameters)


def keep_smallest(counted: DataFrame, by: Sequence[str], num: int, hk: str = "hk") -> DataFrame:
    """Of each group the rows of its ``num`` smallest hashes. The hashes of a group must be distinct."""
    rank = Window.partitionBy(*by).orderBy(hk)
    return counted.withColumn("rank_", F.row_number().over(rank)).where(F.col("rank_") <= num).drop("rank_")


def count_hashes(rows: DataFrame, by: Sequence[str], hk: str = "hk", count: str | None = None) -> DataFrame:
    """(by, hk, cnt): how often each group has each hash; with ``count`` its sum, rows of 0 left out."""
    some = rows.where(F.col(hk).isNotNull())
    if count is not None:
        some = some.where(F.col(count) > 0)
    return some.groupBy(*by, F.col(hk).alias("hk")).agg((F.count(F.lit(1)) if count is None else F.sum(count)).alias("cnt"))


def build(rows: DataFrame, by: Sequence[str], num: int = DEFAULT_NUM, max_hash: int = 0, ksize: int = DEFAULT_KSIZE, is_protein: bool = False, seed: int = SEED, track_abundance: bool = False, hk: str = "hk", count: str | None = None) -> DataFrame:
    """(by, sketch) of rows of hashes; counts are exact. Groups without a hash that counts don't appear."""
    num, max_hash = normal_mode(num, max_hash)
    if max_hash:
        rows = rows.where(F.col(hk) <= bias_of(max_hash))
    counted = count_hashes(rows, by, hk, count)
    if num:
        counted = keep_smallest(counted, by, num)
    if not by:
        counted = counted.withColumn("all_", F.lit(0))
    grouped = counted.groupBy(*(by or ["all_"])).agg(F.sort_array(F.collect_list(F.struct("hk", "cnt"))).alias("pairs_"))
    abunds = F.col("pairs_.cnt") if track_abundance else None
    return grouped.select(*by, cast_sketch(F.col("pairs_.hk"), abunds, num, ksize, is_protein, seed, max_hash).alias("sketch"))


def _codes(keys: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """A number of each row, equal where all keys are equal (nulls too), and a row of each number."""
    code = np.zeros(len(keys[0]), np.int64)
    for key in keys:
        told = key.dictionary_encode("encode")
        code = np.unique(code * (len(told.dictionary) + 1) + told.indices.to_numpy(), return_inverse=True)[1]
    return code, np.unique(code, return_index=True)[1]


def _smallest(keys: list[pa.Array], rows: np.ndarray, hk: np.ndarray, cnt: np.ndarray | None, num: int) -> tuple:
    """Each group once, with its ``num`` smallest hashes, ascending, and their summed counts. rows: of each hash its
    row in ``keys``."""
    code, first = _codes(keys)
    group = code[rows]
    order = np.lexsort((hk, group))
    group, hk = group[order], hk[order]
    new = np.ones(len(hk), bool)
    new[1:] = (group[1:] != group[:-1]) | (hk[1:] != hk[:-1])
    starts = np.flatnonzero(new)
    if cnt is not None:
        cnt = np.add.reduceat(cnt[order], starts) if len(starts) else cnt[:0]
    group, hk = group[starts], hk[starts]
    n = np.bincount(group, minlength=len(first))
    keep = np.arange(len(hk)) - np.repeat(np.cumsum(n) - n, n) < num
    return [k.take(pa.array(first)) for k in keys], group[keep], hk[keep], None if cnt is None else cnt[keep]


def combined(rows: DataFrame, by: Sequence[str], num: int, counts: bool) -> DataFrame:
    """(by, hks_, cnts_): of rows (by, hks_, cnts_) with arrays of hashes and their counts, a row for each group and task,
    or several where a task has more groups than it may hold, with the ``num`` smallest hashes there, ascending. Groups
    without hashes stay. counts: whether there is ``cnts_``. Groups are of the types PLAIN."""
    width, lists = len(by), ["hks_", "cnts_"][: 1 + counts]

    def joined(parts: list[tuple]) -> tuple:
        bases = np.cumsum([0, *(len(p[0][0]) for p in parts)])
        keys = [pa.concat_arrays([p[0][k] for p in parts]) for k in range(width)]
        at = np.concatenate([p[1] + b for p, b in zip(parts, bases, strict=False)])
        return _smallest(keys, at, np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts]) if counts else None, num)

    def told(keys: list[pa.Array], at: np.ndarray, hk: np.ndarray, cnt: np.ndarray | None) -> pa.RecordBatch:
        ends = pa.array(np.cumsum([0, *np.bincount(at, minlength=len(keys[0]))]).astype(np.int32))
        arrays = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (hk, cnt)[: 1 + counts]]
        return pa.RecordBatch.from_arrays([*keys, *arrays], [*by, *lists])

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple]:
        sizes = batch.column(width).value_lengths().fill_null(0).to_numpy()
        if counts and not np.array_equal(sizes, batch.column(width + 1).value_lengths().fill_null(0).to_numpy()):
            raise ValueError("a sketch has as many counts as hashes")
        run = np.cumsum(sizes) // HELD
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(a, b - a)
            flat = part.column(width).flatten()
            known = flat.is_valid().to_numpy(zero_copy_only=False)
            hk = flat.fill_null(0).to_numpy()[known]
            cnt = part.column(width + 1).flatten().fill_null(0).to_numpy()[known] if counts else None
            yield _smallest(part.columns[:width], np.repeat(np.arange(b - a), sizes[a:b])[known], hk, cnt, num)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for piece in pieces(batch) if batch.num_rows else ():
                parts.append(piece)
                held += len(piece[0][0]) + len(piece[2])
                if held > HELD:
                    parts = [joined(parts)]
                    held = len(parts[0][0][0]) + len(parts[0][2])
                    if held > HELD // 2:  # little was equal: what comes next is put together by itself
                        yield told(*parts[0])
                        parts, held = [], 0
        if parts:
            yield told(*joined(parts))

    some = rows.select(*by, *lists)
    return some.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in some.schema.fields]))


def plain_groups(rows: DataFrame, by: Sequence[str]) -> bool:
    return all(isinstance(f.dataType, PLAIN) for f in rows.select(*by).schema.fields)


def _of_parts(num: int, counts: bool) -> tuple[Column, Column | None]:
    """(mins, abunds) of ``parts_``, what ``combined`` found of a group."""
    alone, cut = F.size("parts_") == 1, (lambda x: x) if num >= 1 << 31 else (lambda x: F.slice(x, 1, num))
    hks = F.flatten("parts_.hks_")
    if not counts:
        return F.when(alone, F.get("parts_.hks_", F.lit(0))).otherwise(cut(F.sort_array(F.array_distinct(hks)))), None

    def summed(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["hk"] != F.get(s, i - 1)["hk"]))
        total = lambda i, j: F.aggregate(F.slice(s, i + 1, j - i), F.lit(0).cast("bigint"), lambda t, x: t + x["cnt"])
        return once(starts, lambda at: F.transform(cut(at), lambda i, k: F.struct(F.get(s, i)["hk"].alias("hk"), total(i, F.coalesce(F.get(at, k + 1), F.size(s))).alias("cnt"))))

    many = once(F.sort_array(F.arrays_zip(hks.alias("hk"), F.flatten("parts_.cnts_").alias("cnt"))), summed)
    first = lambda name: F.get(f"parts_.{name}", F.lit(0))
    return F.when(alone, first("hks_")).otherwise(F.transform(many, lambda x: x["hk"])), F.when(alone, first("cnts_")).otherwise(F.transform(many, lambda x: x["cnt"]))


def build_arrays(rows: DataFrame, by: Sequence[str], hashes: str, num: int = DEFAULT_NUM, max_hash: int = 0, track_abundance: bool = False, **parameters) -> DataFrame:
    """As ``build``, of rows that each hold an array of hashes. In number mode no row is taken apart: a hash of the
    group's smallest is among the smallest of every task that has it, so each task counts and cuts its groups, and a group's
    rows are put together once they met. In threshold mode each row is counted and cut before it is shuffled."""
    num, max_hash = normal_mode(num, max_hash)
    if num and plain_groups(rows, by):
        group = list(by) or ["all_"]
        arrays = (rows if by else rows.withColumn("all_", F.lit(0))).select(*group, F.col(hashes).cast("array<bigint>").alias("hks_"))
        if track_abundance:
            arrays = arrays.withColumn("cnts_", F.transform("hks_", lambda _: F.lit(1).cast("bigint")))
        found = combined(arrays, group, num, track_abundance).where(F.size("hks_") > 0)
        # Dealt by the group before it is gathered: else each task would sort all its rows to gather them first.
        dealt = found.repartition(*(F.col(c) for c in group)).groupBy(*group)
        met = dealt.agg(F.collect_list(F.struct("hks_", *["cnts_"][:track_abundance])).alias("parts_"))
        return met.select(*by, cast_sketch(*_of_parts(num, track_abundance), num, max_hash=0, **parameters).alias("sketch"))
    mine = F.filter(F.col(hashes), lambda x: x <= F.lit(bias_of(max_hash)) if max_hash else x.isNotNull())
    cut = (lambda x: x) if max_hash or num >= 1 << 31 else (lambda x: F.slice(x, 1, num))
    if not track_abundance:
        some = mine if max_hash else cut(F.sort_array(F.array_distinct(mine)))
        return build(rows.select(*by, F.explode(some).alias("hk")), by, num, max_hash, **parameters)

    def runs(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        counted = lambda at: F.transform(cut(at), lambda i, j: F.struct(F.get(s, i).alias("hk"), (F.coalesce(F.get(at, j + 1), F.size(s)) - i).cast("bigint").alias("row_count_")))
        return once(starts, counted)

    pairs = rows.select(*by, F.explode(once(F.sort_array(mine), runs)).alias("p_")).select(*by, "p_.*")
    return build(pairs, by, num, max_hash, track_abundance=True, count="row_count_", **parameters)


def exploded(sketches: DataFrame, sketch: str = "sketch") -> DataFrame:
    """The other columns with a row (hk, abund) for each hash; abund is 1 where none is tracked."""
    others = [F.col(f"`{c}`") for c in sketches.columns if c != sketch]
    ones = F.transform(F.col(f"{sketch}.mins"), lambda _: F.lit(1).cast("bigint"))
    pairs = F.arrays_zip(F.col(f"{sketch}.mins").alias("hk"), F.coalesce(F.col(f"{sketch}.abunds"), ones).alias("abund"))
    return sketches.select(*others, F.explode(pairs).alias("p_")).select(*others, F.col("p_.hk").alias("hk"), F.col("p_.abund").alias("abund"))


def _met_in_tasks(rows: DataFrame, group: Sequence[str], s: Column, num: int) -> DataFrame:
    """(group, sketch): the sketches of ``s``, those of one group and the same parameters merged in each task and cut to
    ``num``, which no merge of them exceeds. They go through Arrow whole; none is taken apart before it was cut."""
    given = {f"{k}_": s[k] for k in (*KEYS, "num")} | {"tracked_": s["abunds"].isNotNull()}
    told = F.when(s["abunds"].isNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    counts = F.when(F.size(s["abunds"]) == F.size(s["mins"]), s["abunds"]).otherwise(F.transform(s["mins"], lambda _, i: F.coalesce(F.get(s["abunds"], i), told)))
    arrays = rows.where(s["mins"].isNotNull()).select(*group, *(c.alias(k) for k, c in given.items()), s["mins"].alias("hks_"), counts.alias("cnts_"))
    met = combined(arrays, [*group, *given], num, True)
    fields = F.struct(*(F.col(f"{k}_").alias(k) for k in ("num", "ksize", "is_protein", "seed", "max_hash")), F.col("hks_").alias("mins"), F.when(F.col("tracked_"), F.col("cnts_")).alias("abunds"))
    return met.select(*group, fields.cast(SKETCH).alias("sketch"))


def merge_all(sketches: DataFrame, by: Sequence[str], num: int | None = None, sketch: str = "sketch", **expected) -> DataFrame:
    """(by, sketch): the merge of each group's sketches, counts of equal hashes summed. Counts are kept only
    if every sketch of the group tracks them. The group's word size, molecule, threshold and seed stay; sketches that
    differ in one are an error. ``num``: of the merge, or None for the least of the group's. ``expected``: values that
    those parameters must have, if any are given."""
    s = F.col(sketch)
    if unknown := set(expected) - set(KEYS):
        raise TypeError(f"no such parameter: {sorted(unknown)}")
    ones = F.transform(s["mins"], lambda _: F.lit(1).cast("bigint"))
    pairs = F.transform(F.arrays_zip(s["mins"].alias("hk"), F.coalesce(s["abunds"], ones).alias("abund")), lambda x: F.struct(x["hk"].alias("hk"), x["abund"].alias("abund")))
    whole = F.array(F.struct(F.lit(None).cast("bigint").alias("hk"), F.lit(None).cast("bigint").alias("abund")))  # stands for the sketch itself
    group = list(by) or ["all_"]
    rows = sketches.withColumn("all_", F.lit(0)) if not by else sketches
    if num and plain_groups(rows, group):
        rows, s = _met_in_tasks(rows, group, s, num), F.col("sketch")
        ones = F.transform(s["mins"], lambda _: F.lit(1).cast("bigint"))
        pairs = F.transform(F.arrays_zip(s["mins"].alias("hk"), F.coalesce(s["abunds"], ones).alias("abund")), lambda x: F.struct(x["hk"].alias("hk"), x["abund"].alias("abund")))
    rows = rows.select(*group, F.struct(*(s[k].alias(k) for k in KEYS)).alias("p_"), s["num"].alias("num_"), s["abunds"].isNotNull().alias("tracked_"), F.explode(F.concat(pairs, whole)).alias("e_"))
    counted = rows.groupBy(*group, F.col("e_.hk").alias("hk")).agg(F.sum("e_.abund").alias("cnt"), F.min("p_").alias("low_"), F.max("p_").alias("high_"), F.min("num_").alias("num_"), F.min("tracked_").alias("tracked_"))
    least = F.first(F.when(F.col("hk").isNull(), F.col("num_") if num is None else F.lit(num).cast("bigint")), True).over(Window.partitionBy(*group))
    limited = counted.withColumn("num_", least).withColumn("rank_", F.row_number().over(Window.partitionBy(*group).orderBy("hk")))  # the null is the first
    limited = limited.where((F.col("num_") == 0) | (F.col("rank_") <= F.col("num_") + 1))
    of_all = lambda c: F.max(F.when(F.col("hk").isNull(), F.col(c)))
    found = F.sort_array(F.collect_list(F.when(F.col("hk").isNotNull(), F.struct("hk", "cnt"))))
    merged = limited.groupBy(*group).agg(found.alias("pairs_"), of_all("low_").alias("low_"), of_all("high_").alias("high_"), F.max("num_").alias("num_"), of_all("tracked_").alias("tracked_"))
    fields = F.struct(F.col("num_").alias("num"), *(F.col(f"low_.{k}").alias(k) for k in ("ksize", "is_protein", "seed", "max_hash")), F.col("pairs_.hk").alias("mins"), F.when(F.col("tracked_"), F.col("pairs_.cnt")).alias("abunds"))
    wanted = F.col("high_")
    for k, value in expected.items():
        wanted = wanted.withField(k, F.lit(str(value).lower()).cast(T.DataType.fromDDL(SKETCH)[k].dataType))
    return merged.select(*by, checked(F.col("low_"), F.col("high_"), checked(wanted, F.col("high_"), fields.cast(SKETCH))).alias("sketch"))


def add_from(target: DataFrame, other: DataFrame, by: Sequence[str], num: int | None = None, track_abundance: bool | None = None) -> DataFrame:
    """(by, sketch): ``target`` with each hash of ``other`` added once, whatever its count there; nothing is compared, and
    the target's word size, molecule, threshold and seed stay. ``num``: None for the target's. Counts are kept as the target
    does, or as ``track_abundance`` says. Groups that the target hasn't are left out."""
    mine, s = target.select(*by, "sketch"), F.col("sketch")
    ones = F.transform(s["mins"], lambda _: F.lit(1).cast("bigint"))
    stays = F.first(F.col("sketch"), True) if by else F.first("sketch")
    held = mine.groupBy(*by).agg(stays.alias("target_"))
    own = s.withField("abunds", F.coalesce(s["abunds"], ones))
    theirs = other.select(*by, "sketch")
    theirs = theirs.join(held, list(by)) if by else theirs.crossJoin(F.broadcast(held))
    like = F.col("target_").withField("mins", F.filter(s["mins"], lambda x: (F.col("target_.max_hash") == 0) | (x <= encode_hash(F.col("target_.max_hash")))))
    like = like.withField("abunds", ones)
    added = theirs.select(*by, like.alias("sketch"))
    added = added.withColumn("sketch", s.withField("abunds", F.transform(s["mins"], lambda _: F.lit(1).cast("bigint"))))
    merged = merge_all(mine.withColumn("sketch", own).unionByName(added), by, num)
    kept = merged.join(held, list(by)) if by else merged.crossJoin(F.broadcast(held))
    counts = F.col("target_.abunds").isNotNull() if track_abundance is None else F.lit(track_abundance)
    return kept.select(*by, s.withField("abunds", F.when(counts, s["abunds"])).alias("sketch"))


def merge_pair(a: Column, b: Column) -> Column:
    """The merge of two sketches in one row, cut to the first's ``num``; counts only if both have them. Sketches that
    can't be compared are an error."""
    union = F.array_sort(F.array_union(a["mins"], b["mins"]))
    mins = F.when(a["num"] > 0, F.slice(union, 1, a["num"].cast("int"))).otherwise(union)
    count = lambda s, x: F.coalesce(F.get(s["abunds"], (F.array_position(s["mins"], x) - 1).cast("int")), F.lit(0))
    both = a["abunds"].isNotNull() & b["abunds"].isNotNull()
    safe = lambda s, x: F.when(F.array_contains(s["mins"], x), count(s, x)).otherwise(F.lit(0))
    abunds = F.when(both, F.transform(mins, lambda x: (safe(a, x) + safe(b, x)).cast("bigint")))
    return checked(a, b, a.withField("mins", mins).withField("abunds", abunds))


def from_values(values: Column, **parameters) -> Column:
    """A sketch of a column of exact hashes (array of decimals), sorted, distinct, and cut to the mode."""
    num, max_hash = normal_mode(parameters.pop("num", DEFAULT_NUM), parameters.pop("max_hash", 0))
    hks = F.array_sort(F.array_distinct(F.transform(values, encode_hash)))
    hks = F.filter(hks, lambda x: x <= F.lit(bias_of(max_hash))) if max_hash else F.slice(hks, 1, num)
    return cast_sketch(hks, num=num, max_hash=max_hash, **parameters)


def downsample(sketch: Column, max_hash: int) -> Column:
    """The sketch at a lower threshold; its counts go along."""
    top = F.lit(bias_of(max_hash)).cast("bigint")
    kept = F.filter(sketch["mins"], lambda x: x <= top)
    abunds = F.when(sketch["abunds"].isNotNull(), F.slice(sketch["abunds"], 1, F.size(kept)))
    return sketch.withField("mins", kept).withField("abunds", abunds).withField("max_hash", F.lit(str(max_hash)).cast("decimal(20,0)")).withField("num", F.lit(0).cast("bigint"))


def exact_mins(sketch: Column) -> Column:
    """The hashes as exact unsigned decimals."""
    return F.transform(sketch["mins"], decode_hash)


def md5sum(sketch: Column) -> Column:
    """MD5 over the word size and the hashes in decimal, without separators; no other field has a part in it."""
    return F.md5(F.concat(sketch["ksize"].cast("string"), F.array_join(F.transform(exact_mins(sketch), lambda x: x.cast("string")), "")))


def size(sketch: Column) -> Column:
    return F.size(sketch["mins"])


def min_at(sketch: Column, i: int) -> Column:
    return F.get(sketch["mins"], F.lit(i))


def abund_at(sketch: Column, i: int) -> Column:
    """The count at a place; 0 where counts aren't tracked."""
    return F.coalesce(F.get(sketch["abunds"], F.lit(i)), F.lit(0).cast("bigint"))


def tracks_abundance(sketch: Column) -> Column:
    return sketch["abunds"].isNotNull()


def equal(a: Column, b: Column) -> Column:
    """Whether all seven fields are equal, nulls included."""
    return F.forall(F.array(*(a[f].eqNullSafe(b[f]) for f in ("num", "ksize", "is_protein", "seed", "max_hash", "mins", "abunds"))), lambda x: x)
