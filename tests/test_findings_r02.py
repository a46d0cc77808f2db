import io
import itertools
import lzma
from contextlib import redirect_stdout

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import bloom, compare, search, sketch
from strandline.sources import codecs, signatures


def plan(df):
    with redirect_stdout(out := io.StringIO()):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("num", [0, 12])
def test_pairs_by_blocks(spark, monkeypatch, num):
    monkeypatch.setattr(compare, "BLOCK", 15, raising=False)
    monkeypatch.setattr(compare, "PAIRS_AT_ONCE", 50, raising=False)
    rng = np.random.default_rng(1)
    sets = {int(i): {7} | set(rng.integers(0, 60, 18).tolist()) for i in rng.permutation(60)}
    rows = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "id long, hk long")
    made = sketch.build(rows, ["id"], num=num, max_hash=0 if num else (1 << 64) - 1)
    want = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = (set(sorted(sets[i])[: num or None]) for i in (a, b))
        union = set(sorted(x | y)[: num or None])
        if (x & y) and len(x & y & union) / len(union) > 0.2:
            want[a, b] = (len(x & y & union), len(union))
    pairs = (compare.jaccard_pairs if num else compare.scaled_jaccard_pairs)(made, threshold=0.2)
    assert {(r["a"], r["b"]): (r["common"], r["size"]) for r in pairs.collect()} == want
    everything = compare.common_pairs(made)
    assert {(r["a"], r["b"]) for r in everything.collect()} >= set(want)
    assert not any("Keys [2]: [a#" in p for p in map(plan, (pairs, everything)))  # no row for each pair and hash is shuffled


def test_report_rounds_as_c(spark):
    parts = [(a / b,) for b in range(1, 101) for a in range(1, b + 1)]
    found = spark.createDataFrame([(1, i, x, "n") for i, (x,) in enumerate(parts)], "query long, rank long, similarity double, name string")
    got = [r["line"] for r in search.report(found).orderBy("rank").collect()]
    duck = duckdb.connect().execute("select printf('%6.1f%%       %-60s', unnest(?::double[]) * 100, 'n')", [[x for (x,) in parts]]).fetchall()
    assert got == [x for (x,) in duck]


def test_lzma_takes_memory_for_its_content(spark, tmp_path):
    text = b"abc" * 1000
    assert codecs.plain(codecs.pack_lzma(text)) == text and codecs.plain(codecs.pack_lzma(b"")) == b""
    assert lzma.decompress(codecs.pack_lzma(text), memlimit=1 << 20) == text  # the level's own dictionary needs 64 MB here


@pytest.mark.parametrize("codec", ["gzip", "lzma"])
def test_signature_files_are_bounded(spark, tmp_path, monkeypatch, codec):
    from strandline.operators import signature

    monkeypatch.setattr(signatures, "FILE_ROWS", 3, raising=False)
    made = spark.range(10).coalesce(1).select(F.col("id").alias("name"), sketch.new_sketch().alias("sketch"))
    signatures.write_signatures(signature.new_signatures(made), str(tmp_path / "out"), codec)
    assert len(list((tmp_path / "out").glob("part-*"))) == 4
    assert signatures.read_signatures(spark, str(tmp_path / "out"), verify_md5=True).count() == 10


def test_filters_are_built_without_a_sort(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("node"), F.xxhash64("id").alias("hk"))
    tables = (99991, 64, 40000)
    built = bloom.build(rows, tables)
    assert "SortAggregate" not in plan(built)
    place = F.col("bin") + 1
    plainly = bloom.bins(rows, tables).groupBy("node", "tbl", F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))
    key = lambda df: sorted((r["node"], r["tbl"], r["bucket"], bytes(r["bitmap"])) for r in df.collect())
    assert key(built) == key(plainly)


def test_unique_hashes_without_a_sort(spark):
    rng = np.random.default_rng(2)
    some = [(1, None if i < 3 else int(i) // 5, int(h)) for i, h in enumerate(rng.integers(-(1 << 62), 1 << 62, 400))]
    some += some[:50]
    rows = spark.createDataFrame(some, "node long, id long, hk long").select("node", "hk", F.struct("id", "hk").alias("pos"))
    tables = (97, 89)
    first = {}
    for _, i, h in some:
        for t, n in enumerate(tables):
            k = (t, (h + (1 << 63)) % n)
            first[k] = min(first.get(k, (9**9, 0)), (-1 if i is None else i, h))
    found = bloom.unique_hashes(rows, tables)
    assert [r["unique_kmers"] for r in found.collect()] == [len(set(first.values()))]
    assert "SortAggregate" not in plan(found)


def test_frames_in_batches(spark):
    from strandline.functions import sequence

    rows = spark.createDataFrame([("ACGTacgtNéACGTTGCA",), ("",), ("AC",), ("\U0001f600ATGGCC",)], "seq string")
    got = [r[0] for r in rows.select(sequence.six_frames(F.col("seq"))).collect()]
    for (seq,), frames in zip([("ACGTacgtNéACGTTGCA",), ("",), ("AC",), ("\U0001f600ATGGCC",)], got, strict=True):
        up = "".join(c.upper() if c.isascii() else c for c in seq)
        back = up[::-1].translate(str.maketrans("ACGT", "TGCA"))
        assert frames == ["".join(sequence.CODONS.get(s[i : i + 3], "") for i in range(f, len(s) - 2, 3)) for s in (up, back) for f in range(3)]
    assert "ArrowEvalPython" in plan(rows.select(sequence.six_frames(F.col("seq"))))


@pytest.mark.parametrize("held", [10, 1 << 20])
def test_groups_are_cut_in_their_tasks(spark, monkeypatch, held):
    monkeypatch.setattr(sketch, "HELD", held, raising=False)
    rng = np.random.default_rng(5)
    some = [(None if i % 7 == 0 else f"g{i % 5}", i % 2 == 0, [int(x) for x in rng.integers(-40, 40, i % 30)] + [None] * (i % 3 == 0)) for i in range(90)] + [("x", True, None), ("y", False, [])]
    arrays = spark.createDataFrame(some, "g string, b boolean, h array<bigint>").repartition(4)
    for by in (["g", "b"], ["g"], []):
        for num in (6, 500):
            for counts in (True, False):
                made = sketch.build_arrays(arrays, by, "h", num=num, track_abundance=counts)
                want = sketch.build(arrays.select("g", "b", F.explode("h").alias("hk")), by, num=num, track_abundance=counts)
                assert sorted(map(str, made.collect())) == sorted(map(str, want.collect()))
                assert "Generate" not in plan(made)  # rows aren't taken apart


@pytest.mark.parametrize("held", [10, 1 << 20])
def test_merges_are_cut_in_their_tasks(spark, monkeypatch, held):
    monkeypatch.setattr(sketch, "HELD", held, raising=False)
    rng = np.random.default_rng(6)
    sets = {i: [int(x) for x in rng.integers(0, 50, 12)] for i in range(40)}
    rows = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "id long, hk long")
    made = sketch.build(rows, ["id"], num=8, track_abundance=True).withColumn("g", F.when(F.col("id") % 4 > 0, F.col("id") % 4)).repartition(3)
    merged = sketch.merge_all(made, ["g"], num=10)
    for r in merged.collect():
        counts = {}
        for i, s in sets.items():
            if (i % 4 or None) == r["g"]:
                for x in sorted(set(s))[:8]:
                    counts[x] = counts.get(x, 0) + s.count(x)
        assert list(zip(r["sketch"]["mins"], r["sketch"]["abunds"], strict=True)) == sorted(counts.items())[:10]
    assert plan(merged).find("MapInArrow") > 0 < plan(merged).find("Generate")
    bare = made.where("g = 1").withColumn("sketch", F.col("sketch").withField("abunds", F.lit(None).cast("array<bigint>")))
    mixed = sketch.merge_all(made.where("g = 2").withColumn("g", F.lit(1)).unionByName(bare.withColumn("g", F.lit(1))), ["g"], num=10).first()["sketch"]
    assert mixed["abunds"] is None and mixed["mins"] == sorted({x for i, s in sets.items() if i % 4 in (1, 2) for x in sorted(set(s))[:8]})[:10]
    empty = spark.range(2).select(F.lit(3).alias("g"), sketch.new_sketch(True).alias("sketch"))
    assert sketch.merge_all(empty, ["g"], num=10).first()["sketch"]["mins"] == []
