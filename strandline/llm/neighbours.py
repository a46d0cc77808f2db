"""Approximate nearest neighbours by cross-polytope hashing.

Each table turns unit vectors by three rounds of random signs and a fast Hadamard transform and names the nearest
signed axis; a bucket is named by the axes of one such turn, or of two. A query looks into the buckets whose axes
have the largest sums; what it finds there is ranked by the exact cosine of the original vectors, in double precision.

How many turns, tables and probes is ``tuned`` on a sample of at most ``sample`` vectors and SAMPLE_BYTES, the smallest
by a hash of their id, of which SAMPLE_QUERIES ask: of those settings whose recall in the sample, against brute
force, is ``recall`` or more, the one with the least work. As neighbours in a sample lie further off than in all vectors,
the recall in all is higher. Where no setting gets there, as with vectors that are all but orthogonal to
each other, hashing can't tell neighbours from others, and every query is ranked against all vectors, in blocks. Every
vector is in every table; the sample decides the settings only. ``compared`` says how many candidates a query met,
one found in two tables twice.

Equal vectors are first put together, keeping of each the ``k`` + 1 smallest ids: no query can need more of
them, as ties go to the smaller id. So copies cost nothing, whatever their share. A bucket of more than
``block`` vectors or queries is salted into parts of that size on either side, and every part of the one meets
every part of the other; each meeting hands on a query's best ``k`` only.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids. Vectors of
different lengths never meet. A query that finds fewer than ``k`` in its buckets is ranked against all vectors,
in blocks. Repeated rows (id and vector) count once. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import bounded_batches, join_small, materialise


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row; the width is a power of two. Of a width over 64 the factors
    are transformed one after the other."""
    n = x.shape[1]
    if n > 64:
        parts = hadamard(x.reshape(-1, 64)).reshape(len(x), n // 64, 64)
        return hadamard(parts.transpose(0, 2, 1).reshape(-1, n // 64)).reshape(len(x), 64, n // 64).transpose(0, 2, 1).reshape(len(x), n)
    matrix = np.ones((1, 1))
    while len(matrix) < n:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    return x @ matrix / np.sqrt(n)


def rotated(unit: np.ndarray, table: int, seed: int = 7) -> np.ndarray:
    """The pseudo-rotation of one table, padded to a power of two."""
    width = 1 << max(0, unit.shape[1] - 1).bit_length()
    x = np.zeros((len(unit), width))
    x[:, : unit.shape[1]] = unit
    signs = np.random.default_rng([seed, table, width]).choice(np.array([-1.0, 1.0]), (3, width))
    for s in signs:
        x = hadamard(x * s)
    return x


def buckets(unit: np.ndarray, table: int, probes: int = 1, turns: int = 1) -> np.ndarray:
    """For each row the numbers of its buckets in one table, best first: at one turn its nearest signed axes (axis, or
    width + axis if negative), at two pairs of them by the sum of both."""
    near, value = [], []
    for turn in range(turns):
        y = rotated(unit, table + turn * (1 << 16))
        signed = np.concatenate([y, -y], axis=1)
        few = min(probes, signed.shape[1])
        best = np.argpartition(-signed, few - 1, axis=1)[:, :few]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(signed, best, axis=1), axis=1, kind="stable"), axis=1)
        near.append(best)
        value.append(np.take_along_axis(signed, best, axis=1))
    if turns == 1:
        return near[0]
    few = near[0].shape[1]
    i, j = np.nonzero(np.outer(1 + np.arange(few), 1 + np.arange(few)) <= probes)  # all others have ``probes`` better ones
    best = np.argsort(-(value[0][:, i] + value[1][:, j]), axis=1, kind="stable")[:, :probes]
    return np.take_along_axis(near[0][:, i] * signed.shape[1] + near[1][:, j], best, axis=1)


#: What is tried, in tables, probes and turns; the part of all vectors that one more table must save a query.
TABLES, PROBES, TURNS = (2, 4, 8, 12, 16, 24, 32), (1, 2, 4, 8, 16, 32, 48, 64, 96, 128), (1, 2)
TABLE_WORK = 0.001
SAMPLE_QUERIES, SAMPLE_BYTES = 200, 32 << 20


def tuned(unit: np.ndarray, k: int, recall: float) -> tuple[int, int, int] | None:
    """(turns, tables, probes) of the least work that reach ``recall`` in a sample of unit vectors, or None where that is
    as much as to compare each query with all."""
    asking = unit[:SAMPLE_QUERIES]
    near = asking @ unit.T
    near[np.arange(len(asking)), np.arange(len(asking))] = -np.inf
    k = min(k, len(unit) - 1)
    if k < 1:
        return 1, TABLES[0], 1
    true = np.argpartition(-near, k - 1, axis=1)[:, :k]
    found, least = None, 1.0
    for turns in TURNS:
        rank, met = np.full(true.shape, 1 << 30), np.zeros((len(asking), max(PROBES)))
        for table in range(max(TABLES)):
            own, asked = buckets(unit, table, 1, turns)[:, 0], buckets(asking, table, max(PROBES), turns)
            where = own[true][:, :, None] == asked[:, None, :]
            rank = np.minimum(rank, np.where(where.any(axis=2), where.argmax(axis=2), 1 << 30))
            names, sizes = np.unique(own, return_counts=True)
            at = np.minimum(np.searchsorted(names, asked), len(names) - 1)
            met[:, : asked.shape[1]] += np.cumsum(np.where(names[at] == asked, sizes[at], 0), axis=1)
            if table + 1 in TABLES:
                for probes in PROBES:
                    if probes <= asked.shape[1] and (rank < probes).mean() >= recall:
                        work = met[:, probes - 1].mean() / len(unit) + (table + 1) * TABLE_WORK
                        if work < least:
                            found, least = (turns, table + 1, probes), work
    return found


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, dim, raw): the vectors that take part, as bytes of little-endian floats or doubles."""
    kind = bounded_batches(vectors).schema[vector_col].dataType.elementType.simpleString()
    dtype = "<f4" if kind == "float" else "<f8"
    some = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if kind == "float" else "array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = some.where(F.col("id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))

    def pack(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: (np.asarray(x, dtype) + np.zeros(1, dtype)).tobytes())  # -0.0 reads as 0.0

    return fine.select("id", F.size("v").alias("dim"), F.pandas_udf(pack, "binary")("v").alias("raw"))


def _doubles(raw: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of one length in double precision, and to unit length."""
    x = np.frombuffer(b"".join(raw), "<f4" if len(raw.iloc[0]) == 4 * dim else "<f8").reshape(len(raw), dim).astype(float)
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled, scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _hashed(rows: DataFrame, tables: int, probes: int, turns: int) -> DataFrame:
    """(id, dim, raw, tb): a row for each table and probe; tb is table and bucket in one number."""

    def hash_all(frames):
        for pdf in frames:
            for dim, same in pdf.groupby("dim"):
                for at in range(0, len(same), 2048):
                    part = same.iloc[at : at + 2048]
                    unit = _doubles(part["raw"], dim)[1]
                    yield part.assign(tb=list(np.concatenate([buckets(unit, t, probes, turns) + t * (1 << 40) for t in range(tables)], axis=1).astype(np.int64)))

    return rows.mapInPandas(hash_all, "id long, dim int, raw binary, tb array<bigint>").select("id", "dim", "raw", F.explode("tb").alias("tb"))


#: Pairs scored at a time.
PAIRS = 1 << 17
_NOTHING = {"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0), "compared": np.zeros(0, np.int64)}


def _best(found: list[pd.DataFrame], k: int) -> pd.DataFrame:
    """Of each query its ``k`` best different candidates, ties by id; the first of them carries all it was compared with."""
    if not found:
        return pd.DataFrame(_NOTHING)
    query, vec, score, compared = (np.concatenate([f[c].to_numpy() for f in found]) for c in _NOTHING)
    order = np.lexsort((vec, -score, query))
    query, vec, score, compared = query[order], vec[order], score[order], compared[order]
    first = np.searchsorted(query, query)
    total = np.concatenate([[0], np.cumsum(compared)])
    total = total[np.searchsorted(query, query, "right")] - total[first]
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])
    place = np.cumsum(new) - 1
    place -= place[first]
    some = new & (place < k)
    return pd.DataFrame({"query_id": query[some], "vec_id": vec[some], "score": score[some], "compared": np.where(place == 0, total, 0)[some]})


def _search(k: int):
    """The buckets of a bin, each of bounded size: the ``k`` best of each query in it, by the exact cosine."""

    def named(frame: pd.DataFrame) -> np.ndarray:  # should two buckets share a name, queries of one meet the other's too
        parts = zip(("tb", "qp", "cp"), (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9), strict=True)
        return sum(frame[c].to_numpy().astype(np.int64).astype(np.uint64) * np.uint64(m) for c, m in parts)

    def search(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        found: list[pd.DataFrame] = []
        for dim in queries["dim"].unique():
            q_rows, c_rows = queries[queries["dim"] == dim], candidates[candidates["dim"] == dim]
            if not len(c_rows):
                continue
            q, c = _doubles(q_rows["raw"], int(dim))[0], _doubles(c_rows["raw"], int(dim))[0]
            q_id, c_id, q_key, c_key = q_rows["id"].to_numpy(), c_rows["id"].to_numpy(), named(q_rows), named(c_rows)
            q_sum, c_sum = (q * q).sum(1), (c * c).sum(1)
            order = np.argsort(c_key, kind="stable")
            start, stop = (np.searchsorted(c_key[order], q_key, side) for side in ("left", "right"))
            met = stop - start
            ends = np.cumsum(met)
            for at in range(0, int(ends[-1]), PAIRS):
                pair = np.arange(at, min(at + PAIRS, int(ends[-1])))
                i = np.searchsorted(ends, pair, "right")
                j = order[start[i] + pair - (ends[i] - met[i])]
                other = q_id[i] != c_id[j]
                i, j = i[other], j[other]
                score = np.einsum("ij,ij->i", q[i], c[j]) / np.sqrt(q_sum[i] * c_sum[j])
                found.append(pd.DataFrame({"query_id": q_id[i], "vec_id": c_id[j], "score": score, "compared": np.ones(len(i), np.int64)}))
                if len(found) > 8:
                    found = [_best(found, k)]
        return _best(found, k)

    return search


#: A bin has about so many bytes of vectors, as doubles, of both sides; there are BINS at least, so that tasks have work.
#: Each bin hands on a query's best, so few large ones hand on less than many small ones.
BIN_BYTES, BINS = 16 << 20, 128


def _meet(queries: DataFrame, candidates: DataFrame, k: int, block: int) -> DataFrame:
    """(query_id, vec_id, score, compared) found in common buckets, each bucket in parts of about ``block`` on either
    side. Vectors in buckets that no query looks into go no further. Buckets can be many and small: they are handed
    over in bins."""
    key = ["dim", "tb"]
    parts = lambda df, name: df.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name), F.count(F.lit(1)).alias(f"{name}_n"))
    sizes = materialise(parts(candidates, "c_parts").join(parts(queries, "q_parts"), key), "parts")
    size = sizes.agg(F.sum((F.col("c_parts_n") * F.col("q_parts") + F.col("q_parts_n") * F.col("c_parts")) * F.col("dim") * 8)).first()[0] or 0
    bins = max(BINS, 1 + size // BIN_BYTES)
    hashed = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sizes = sizes.drop("c_parts_n", "q_parts_n")
    bin_of = F.pmod(F.xxhash64(*key, "qp", "cp"), F.lit(bins))
    q = join_small(queries, sizes, key).select("id", *key, "raw", hashed("q_parts").alias("qp"), every("c_parts").alias("cp")).withColumn("bin", bin_of)
    c = join_small(candidates, sizes, key).select("id", *key, "raw", hashed("c_parts").alias("cp"), every("q_parts").alias("qp")).withColumn("bin", bin_of)
    return q.groupBy("bin").cogroup(c.groupBy("bin")).applyInPandas(_search(k), "query_id long, vec_id long, score double, compared long")


def settings(pool: DataFrame, k: int, sample: int, recall: float) -> tuple[int, int, int] | None:
    """What ``tuned`` finds on a sample of the vectors of the commonest length."""
    common = pool.groupBy("dim").count().orderBy(F.col("count").desc(), "dim").first()
    if common is None:
        return 1, TABLES[0], 1
    dim = common["dim"]
    rows = pool.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(max(SAMPLE_QUERIES, min(sample, SAMPLE_BYTES // (8 * dim)))).toPandas()
    return tuned(_doubles(rows["raw"], dim)[1], k, recall)


def nearest(vectors: DataFrame, is_query, k: int = 5, sample: int = 4096, recall: float = 0.92, block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, compared): the ``k`` nearest found of each row that ``is_query`` (a condition on id)."""
    taking_part = materialise(usable(vectors, id_col, vector_col).distinct(), "vectors")
    copies = Window.partitionBy("raw").orderBy("id")
    pool = materialise(taking_part.withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1).drop("n"), "pool")
    queries = taking_part.where(is_query(F.col("id")))
    chosen = settings(pool, k, sample, recall)
    all_of = lambda df: df.withColumn("tb", F.lit(-1).cast("long"))
    together = lambda df: df.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.sum("compared").alias("compared"))
    if chosen is None:
        found = together(_meet(all_of(queries), all_of(pool), k, block))
    else:
        turns, tables, probes = chosen
        found = materialise(together(_meet(_hashed(queries, tables, probes, turns), _hashed(pool, tables, 1, turns), k, block)), "found")
        few = queries.join(found.groupBy("query_id").count().where(F.col("count") >= k), F.col("id") == F.col("query_id"), "left_anti")
        if not few.isEmpty():
            found = together(found.union(_meet(all_of(few), all_of(pool), k, block)))
    whole = Window.partitionBy("query_id")
    ranked = found.withColumn("rank", F.row_number().over(whole.orderBy(F.col("score").desc(), "vec_id"))).withColumn("compared", F.sum("compared").over(whole))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "compared")
