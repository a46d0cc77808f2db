import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.functions.hashing import biased
from strandline.operators import bloom, search, sketch, tree
from strandline.sources import oxli


def rows(spark, hashes):
    hk = biased(np.array(hashes, np.uint64)).tolist()
    return spark.createDataFrame([("n", i, x) for i, x in enumerate(hk)], "node string, pos int, hk long")


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=20))
def test_what_was_inserted_is_found(spark, hashes):
    r = rows(spark, hashes)
    got = bloom.contains(bloom.build(r), r)
    assert got.count() == len(set(hashes))
    bins = {(x["tbl"], x["bin"]) for x in bloom.bins(r).collect()}
    assert bins == {(i, h % n) for h in hashes for i, n in enumerate(bloom.DEFAULT_TABLES)}


def test_single_table_golden(spark):
    r = rows(spark, [801084876663808])
    assert bloom.contains(bloom.build(r, (10,)), r, (10,)).count() == 1
    assert bloom.unique_hashes(r, (10,)).first()["unique_kmers"] == 1


def test_table_sizes():
    assert bloom.primes_below(100000, 4) == bloom.DEFAULT_TABLES == (99991, 99989, 99971, 99961)


def test_union_and_measures(spark):
    a, b = rows(spark, range(50)), rows(spark, range(25, 75)).withColumn("node", F.lit("m"))
    both = bloom.build(a).union(bloom.build(b))
    assert bloom.occupied(bloom.unite(both), ()).first()["occupied"] == 75 * 4
    s = bloom.similarity(bloom.build(a), bloom.build(b)).first()
    assert (s["shared"], s["either"]) == (100, 300)
    c = bloom.containment(bloom.build(a), bloom.build(b)).first()
    assert c["of_capacity"] == 100 / sum(bloom.DEFAULT_TABLES) and c["of_bits"] == 0.5


def test_oxli_layout(spark, tmp_path):
    sizes = [16, 13]  # 16: the edge where eight divides the size
    raw = oxli.render(sizes, [np.array([0, 15]), np.array([12])], 21)
    back = oxli.parse(raw)
    assert len(raw) == 19 + 8 + 3 + 8 + 2 and raw[:6] == b"OXLI\x04\x02"
    assert back["sizes"] == sizes and [b.tolist() for b in back["bins"]] == [[0, 15], [12]] and back["occupied"] == 3 and back["ksize"] == 21
    (tmp_path / "f").write_bytes(raw)
    read = oxli.read_filters(spark, str(tmp_path / "f"))
    files = oxli.to_files(oxli.to_bitmaps(read), sizes, 21)
    assert bytes(files.first()["content"]) == raw


def leaves(spark, sets):
    made = sketch.build(spark.createDataFrame([(i, x) for i, s in enumerate(sets) for x in s], "id long, hk long"), ["id"], num=500)
    return made.withColumn("pos", F.col("id") + len(sets) - 1)


def test_positions(spark):
    p = spark.createDataFrame([(x,) for x in range(8)], "pos long").select(tree.parent(F.col("pos")), tree.children(F.col("pos")), tree.parent(F.col("pos"), 5)).collect()
    assert [r[0] for r in p] == [None, 0, 0, 1, 1, 2, 2, 3] and p[1][1] == [3, 4] and p[6][2] == 1


def test_tree_search_equals_linear_search(spark):
    rng = np.random.default_rng(1)
    sets = [set(rng.integers(0, 60, 25).tolist()) for _ in range(7)]
    some = leaves(spark, sets)
    asked = some.select("id", "sketch")
    for threshold in (0.1, 0.3, 0.6):
        linear, by_tree = ({tuple(r) for r in x.collect()} for x in (search.find(asked, asked, threshold), tree.tree_find(some, asked, threshold)))
        assert linear == by_tree
    below = {r["pos"]: r["min_n_below"] for r in tree.min_n_below(some).collect()}
    assert below[0] == min(map(len, sets)) and below[2] == min(len(s) for s in sets[-2:] + sets[-4:-2])


def test_scaffold(spark):
    sets = [{1, 2, 3}, {10, 11}, {1, 2, 4}, {10, 12}, {90}]
    made = tree.scaffold(leaves(spark, sets)).collect()
    found = {r["id"]: r["pos"] for r in made if r["is_leaf"]}
    assert sorted(found) == ["0", "1", "2", "3", "4"]
    assert tree.scaffold(leaves(spark, sets).where("id < 0")).count() == 0
    positions = lambda n: sorted(r["pos"] for r in tree.scaffold(leaves(spark, sets[:n])).collect() if r["is_leaf"])
    assert positions(1) == [1] and positions(3) == [3, 5, 6]  # one left alone has a node of its own, so it is as deep as the others
    assert tree._pairing(4, lambda i, j: int({i, j} in ({3, 1}, {2, 0}))) == [(3, 1), (2, 0)]
    assert tree._pairing(3, lambda i, j: 0) == [(2, 0), (1,)]


def families(n, seed, size=30):
    """Sets in families of four that share most of what they hold, next to one another in the tree."""
    rng = np.random.default_rng(seed)
    cores = [rng.integers(0, 10**6, size).tolist() for _ in range(-(-n // 4))]
    return [set(cores[i // 4]) | set(rng.integers(0, 10**6, 6).tolist()) for i in range(n)]


def test_descent_compares_few_and_loses_nothing(spark):
    for n, d, stride in ((21, 2, 2), (13, 3, 8), (1, 2, 8)):
        some = leaves(spark, families(n, n)).withColumn("pos", F.col("id") + (n - 1 if d == 2 else -(-(n - 1) // (d - 1))))
        asked = some.select("id", "sketch")
        linear, by_tree = ({tuple(r) for r in x.collect()} for x in (search.find(asked, asked, 0.3), tree.tree_find(some, asked, 0.3, d=d)))
        came = {tuple(r) for r in tree.reached(some, asked, 0.3, d=d, stride=stride).collect()}
        assert linear == by_tree and {x[:2] for x in linear} <= came and len(linear) >= n
        assert n < 13 or len(came) < n * n / 2


def test_descent_with_empty_and_other_sketches(spark):
    some = leaves(spark, families(6, 3))
    empty = some.where("id = 0").select(F.lit(6).cast("long").alias("id"), sketch.new_sketch(num=500).alias("sketch"), F.lit(11).cast("long").alias("pos"))
    other = some.withColumn("sketch", F.when(F.col("id") == 2, F.col("sketch").withField("ksize", F.lit(31))).otherwise(F.col("sketch"))).unionByName(empty)
    asked = other.select("id", "sketch")
    linear, by_tree = ({tuple(r) for r in x.collect()} for x in (search.find(asked, asked, 0.2), tree.tree_find(other, asked, 0.2)))
    assert linear == by_tree and linear


def plain_tree(sets):
    """Clustering restated over Python sets: (id, position) of the leaves."""
    level = [(set(s), i) for i, s in enumerate(sets)]
    while len(level) > 1 or not isinstance(level[0][1], tuple):
        groups = tree._pairing(len(level), lambda i, j, level=level: len(level[i][0] & level[j][0]))
        level = [(set().union(*(level[i][0] for i in g)), tuple(level[i][1] for i in g)) for g in groups]

    def places(node, pos):
        return {node: pos} if isinstance(node, int) else {k: v for i, x in enumerate(node) for k, v in places(x, 2 * pos + 1 + i).items()}

    return places(level[0][1], 0)


def test_clustering_of_eighty_groups(spark):
    rng = np.random.default_rng(5)
    sets = [set(rng.integers(0, 900, 40).tolist()) | {1} for _ in range(77)] + [{5000}, {5001}, {5002}]
    made = tree.scaffold(leaves(spark, sets)).where("is_leaf").collect()
    assert {int(r["id"]): r["pos"] for r in made} == plain_tree(sets)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.data())
def test_pairs_from_overlaps(n, data):
    shared = {(i, j): data.draw(st.integers(0, 3)) for i in range(n) for j in range(i)}
    some = [(i, j, x) for (i, j), x in shared.items() if x]
    a, b, x = (np.array([r[k] for r in some], np.int64) for k in range(3))
    assert tree.pair_up(n, a, b, x) == tree._pairing(n, lambda i, j: shared[max(i, j), min(i, j)])
