import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline import errors
from strandline.functions.sequence import sequence_hashes
from strandline.operators import compare, search, sketch

MERGED = [2996412506971915891, 4448613756639084635, 8373222269469409550, 9390240264282449587, 11085758717695534616, 11668188995231815419, 11760449009842383350, 14682565545778736889]
S = "TGCCGCCCAGCACCGGGTGACTAGGTTGAGCCATGATTAACCTGCAATGA"


def of_sequences(spark, rows, k=10, **options):
    hashes = spark.createDataFrame(rows, "id string, seq string").select("id", F.explode(sequence_hashes(F.col("seq"), k)).alias("hk"))
    return sketch.build(hashes, ["id"], **({"num": 20, "ksize": k} | options))


def exact(df):
    return [[int(x) for x in r[0]] for r in df.select(sketch.exact_mins(F.col("sketch"))).collect()]


def test_merge_golden(spark):
    both = of_sequences(spark, [("a", "TGCCGCCCAGCA"), ("a", "GTCCGCCCAGTGA"), ("b", "TGCCGCCCAGCA"), ("b", "GTCCGCCCAGTGG")])
    assert exact(sketch.merge_all(both, [], num=20, ksize=10)) == [MERGED]
    pair = both.where("id = 'a'").select(F.col("sketch").alias("a")).join(both.where("id = 'b'").select(F.col("sketch").alias("b")))
    assert exact(pair.select(sketch.merge_pair(F.col("a"), F.col("b")).alias("sketch"))) == [MERGED]
    # no counts unless both sides track them
    assert pair.select(sketch.merge_pair(F.col("a"), F.col("b"))["abunds"]).first()[0] is None


def test_compare_golden(spark):
    made = of_sequences(spark, [("a", S), ("b", S), ("b", S), ("c", S), ("c", "GATTGGTGCACACTTAACTGGGTGCCGCGCTGGTGCTGATCCATGAAGTT")])
    found = {(r["a"], r["b"]): r["similarity"] for r in compare.jaccard_pairs(made).collect()}
    assert found[("a", "b")] == 1.0 and found[("a", "c")] == 0.5


def values(spark, sets, **options):
    rows = spark.createDataFrame([(i, int(x)) for i, s in enumerate(sets) for x in s] or [(0, None)], "id long, hk long")
    return sketch.build(rows, ["id"], **options)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-50, 50), max_size=60), st.integers(1, 30))
def test_order_and_repeats_do_not_matter(spark, some, num):
    a, b = (values(spark, [x], num=num, track_abundance=True).select("sketch.mins", "sketch.abunds").collect() for x in (some, sorted(some, reverse=True)))
    assert a == b
    if some:
        want = sorted(set(some))[:num]
        assert a[0]["mins"] == want and a[0]["abunds"] == [some.count(x) for x in want]


def test_modes():
    assert sketch.normal_mode(5, 7) == (0, 7) and sketch.normal_mode(5, 0) == (5, 0)
    with pytest.raises(ValueError):
        sketch.normal_mode(0, 0)
    assert sketch.max_hash_of(2) == 1 << 63 and sketch.max_hash_of(None) == 0


def test_threshold_mode_and_downsample(spark):
    made = values(spark, [range(-10, 10)], num=0, max_hash=(1 << 63) + 3, track_abundance=True)
    assert made.first()["sketch"]["mins"] == list(range(-10, 4))
    less = made.select(sketch.downsample(F.col("sketch"), (1 << 63) - 8).alias("s")).first()["s"]
    assert less["mins"] == [-10, -9, -8] and less["abunds"] == [1, 1, 1]


def test_add_from_counts_once(spark):
    a, b = values(spark, [[1, 1, 2]], num=5, track_abundance=True), values(spark, [[2, 2, 2, 3]], num=5, track_abundance=True)
    got = sketch.add_from(a, b, ["id"], num=5, track_abundance=True).first()["sketch"]
    assert got["mins"] == [1, 2, 3] and got["abunds"] == [2, 2, 1]


def test_errors_in_order(spark):
    empty = F.array().cast("array<bigint>")
    base = {"ksize": 21, "is_protein": False, "max_hash": 5, "seed": 42}
    one = spark.range(1).select(sketch.cast_sketch(empty, num=0, **base).alias("a"))
    for field, value, kind in (("seed", 1, errors.MismatchSeed), ("max_hash", 6, errors.MismatchMaxHash), ("is_protein", True, errors.MismatchDNAProt), ("ksize", 31, errors.MismatchKSizes)):
        base[field] = value
        two = one.withColumn("b", sketch.cast_sketch(empty, num=0, **base))
        with pytest.raises(Exception) as e:
            two.select(compare.checked(F.col("a"), F.col("b"), F.lit(1))).collect()
        assert type(errors.typed(e.value)) is kind


def test_left_num_rules_and_empty_sets(spark):
    lit = lambda xs, num: sketch.cast_sketch(F.array(*map(F.lit, xs)) if xs else F.array(), num=num)
    row = spark.range(1).select(lit([1, 2, 3, 4], 2).alias("a"), lit([1, 3, 4, 5], 4).alias("b"), lit([], 4).alias("e"))
    got = row.select(compare.jaccard(F.col("a"), F.col("b")), compare.jaccard(F.col("b"), F.col("a")), compare.jaccard(F.col("e"), F.col("e")), compare.containment(F.col("e"), F.col("a")), compare.containment(F.col("a"), F.col("b"))).first()
    assert list(got) == [0.5, 0.75, 0.0, None, 0.75]  # unions {1, 2} and {1, 2, 3, 4}


def test_search_is_strict_and_ordered(spark):
    made = values(spark, [range(10), range(5), range(8), range(50, 60)], num=100).withColumn("name", F.concat(F.lit("n"), F.col("id")))
    query = made.where("id = 0").select("id", "sketch")
    found = search.find(made.select("id", "sketch"), query, 0.5)
    assert sorted(r["id"] for r in found.collect()) == [0, 2]
    assert [r["id"] for r in search.top(search.find(made.select("id", "sketch"), query, 0.0), made, n=2).orderBy("rank").collect()] == [0, 2]
    assert [r["id"] for r in search.top(found, made, best_only=True).collect()] == [0]
    contained = search.find(made.select("id", "sketch"), query, 0.9, by_containment=True)
    assert sorted(r["id"] for r in contained.collect()) == [0, 1, 2]
    assert search.find_where(made, query, lambda s, q: compare.jaccard(s, q) > 0.7).count() == 2
    with pytest.raises(ValueError):
        search.find_in({}, query)
    with pytest.raises(ValueError):
        compare.jaccard_pairs(made, threshold=-1)


def test_arrays_are_cut_before_the_shuffle(spark):
    rows = spark.createDataFrame([("a", [5, 1, 1, None, 9]), ("a", [2, 1]), ("b", []), ("c", None)], "id string, h array<bigint>")
    for options in ({"num": 2}, {"num": 0, "max_hash": (1 << 63) + 5}):
        whole = sketch.build(rows.select("id", F.explode("h").alias("hk")), ["id"], **options)
        assert sketch.build_arrays(rows, ["id"], "h", **options).collect() == whole.collect()


def test_merging_keeps_parameters(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5), ("b", 9)], "g string, hk long")
    made = sketch.build(rows, ["g"], num=0, max_hash=(1 << 64) - 1, ksize=31, seed=7, is_protein=True).withColumn("all", F.lit(1))
    merged = sketch.merge_all(made, ["all"]).first()["sketch"]
    assert (merged["ksize"], int(merged["seed"]), merged["num"], int(merged["max_hash"]), merged["is_protein"], merged["mins"]) == (31, 7, 0, (1 << 64) - 1, True, [1, 5, 9])
    added = sketch.add_from(made.where("g = 'a'"), made.where("g = 'b'"), ["all"]).first()["sketch"]
    assert (added["ksize"], int(added["seed"]), added["num"], added["mins"], added["abunds"]) == (31, 7, 0, [1, 5, 9], None)
    least = sketch.merge_all(sketch.build(rows, ["g"], num=2, track_abundance=True).withColumn("all", F.lit(1)), ["all"]).first()["sketch"]
    assert (least["num"], least["mins"], least["abunds"]) == (2, [1, 5], [1, 2])


@pytest.mark.parametrize("other", [{"ksize": 30}, {"is_protein": True}, {"seed": 1}, {"num": 0, "max_hash": 99}])
def test_what_differs_is_not_merged(spark, other):
    rows = spark.createDataFrame([("a", -9223372036854775807)], "g string, hk long")
    two = sketch.build(rows, ["g"]).unionByName(sketch.build(rows, ["g"], **other))
    with pytest.raises(Exception, match="Mismatch"):
        sketch.merge_all(two, ["g"]).collect()
    pair = sketch.build(rows, ["g"]).withColumnRenamed("sketch", "x").join(sketch.build(rows, ["g"], **other).withColumnRenamed("sketch", "y"), "g")
    with pytest.raises(Exception, match="Mismatch"):
        sketch.merge_all(sketch.build(rows, ["g"]), ["g"], ksize=99).collect()
    for made in (sketch.merge_pair(F.col("x"), F.col("y")), compare.jaccard(F.col("x"), F.col("y")), compare.count_common(F.col("x"), F.col("y"))):
        with pytest.raises(Exception, match="Mismatch"):
            pair.select(made.alias("m")).collect()


def test_names_can_be_set(spark):
    from strandline.operators import signature

    made = signature.new_signatures(sketch.build(spark.createDataFrame([("a", 1)], "id string, hk long"), ["id"]), "id")
    got = signature.set_filename(signature.set_name(made, "other"), F.concat("name", F.lit(".fa"))).first()
    assert (got["name"], got["filename"]) == ("other", "other.fa")


def test_counted_arrays_are_the_rows(spark):
    rng = np.random.default_rng(8)
    data = [(i % 3, [int(x) for x in rng.integers(-20, 20, n)]) for i, n in enumerate((0, 1, 30, 60, 5, 40, 2))] + [(1, None), (2, [None, 3, 3])]
    arrays = spark.createDataFrame(data, "g int, hashes array<bigint>")
    rows = arrays.select("g", F.explode("hashes").alias("hk"))
    for options in ({"num": 7}, {"num": 500}, {"num": 0, "max_hash": 2**63 + 4}):
        for counts in (True, False):
            got, want = (sorted(map(str, x.collect())) for x in (sketch.build_arrays(arrays, ["g"], "hashes", track_abundance=counts, **options), sketch.build(rows, ["g"], track_abundance=counts, **options)))
            assert got == want and len(got) == 3
