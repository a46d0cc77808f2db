import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.llm import near_duplicates as nd
from strandline.llm import shingles
from strandline.llm.components import components
from tests_llm_data import near, prose


def brute(rows, threshold=0.8):
    """[(id, class, links)] of (id, text) rows."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = defaultdict(lambda: float("inf"))
    for i, (n, _) in enumerate(rows):
        if n is not None:
            least[find(i)] = min(least[find(i)], n)
    return sorted(((n, None if n is None else least[find(i)], links[i]) for i, (n, _) in enumerate(rows)), key=str)


def run(docs, **options):
    return sorted((tuple(r) for r in nd.near_duplicates(docs, **options).collect()), key=str)


def test_word_hashes():
    texts = ["ab c", "", "c\tab\n", "  é é  漢", "ab", "x" * 5000]
    hashes, n = shingles.word_hashes(texts)
    words = [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    assert n.tolist() == [2, 0, 2, 3, 1, 1] and len(hashes) == len(words)
    assert len({(w, h) for w, h in zip(words, hashes.tolist(), strict=True)}) == len(set(words)) == len(set(hashes.tolist()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=12), min_size=1, max_size=6))
def test_shingle_sets(texts):
    h, n = shingles.shingle_sets([" ".join(t) for t in texts])
    parts = np.split(h, np.cumsum(n)[:-1])
    names = {}
    for t, got in zip(texts, parts, strict=True):
        want = {tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} if t else set()
        assert len(want) == len(got) == len(set(got.tolist()))
        assert names.setdefault(frozenset(want), frozenset(got.tolist())) == frozenset(got.tolist())


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40)), min_size=1, max_size=50), st.lists(st.sets(st.integers(0, 40)), min_size=1, max_size=40))
def test_overlaps(a, b):
    sets = lambda xs: [np.array(sorted(x), np.uint64) for x in xs]
    for dense in (1, 32):
        nd.DENSE, old = dense, nd.DENSE
        got = nd.overlaps(sets(a), sets(b))
        nd.DENSE = old
        assert got.tolist() == [[len(x & y) for y in b] for x in a]


def test_prefix_meets_the_recall():
    n = nd.prefix_length(0.8, 20, 6, 0.9995)
    assert n == 5 and 1 - (1 - 0.8**n) ** 20 >= 0.9995 > 1 - (1 - 0.8 ** (n + 1)) ** 20
    assert nd.prefix_length(0.8, 2, 6, 0.9999) == 1


def test_common_prefixes():
    rows = np.array([[0, 1, 2, 3, 4], [0, 1, 2, 3, 9], [0, 1, 2, 3, 9], [1, 1, 2, 3, 9], [1, 7, 2, 3, 9]], np.uint8)
    assert nd.common_prefixes(rows, np.full(5, 255, np.uint8)).tolist() == [0, 1, 2, 0, 0]


def test_prefixes_are_shortened_as_the_data_ask(spark, make_docs):
    """Copies that differ in a word of a thousand are found by whole labels; texts of similarities down to 0.8 are not."""
    close = [prose(i, 1000) for i in range(6)]
    close += [near(t, 50 + i) for i, t in enumerate(close)]
    found, length = nd.classes(make_docs(close))
    assert length == 8 and {r["class_id"] for r in found.collect()} == set(range(6))
    loose = [prose(0, 200)] + [near(prose(0, 200), 70 + i, i) for i in range(6)]
    found, length = nd.classes(make_docs(loose))
    assert length < 8 and sorted(tuple(r) for r in found.collect()) == brute(list(enumerate(loose)))


def test_forest_equals_its_tries(spark):
    """Heads against groups of equal prefixes, with a label that more sets share than a partition holds."""
    r = np.random.default_rng(0)
    marks = [np.concatenate([r.integers(0, 2, 12) if i % 3 else np.zeros(12)]).astype(">u2").tobytes() for i in range(400)]
    sets = spark.createDataFrame([(i, bytearray(m)) for i, m in enumerate(marks)], "node long, marks binary").repartition(7)
    rows = nd.forest(sets, 3, 4, 2).collect()
    for length in (2, 3, 4):
        links = [(x["node"], x["heads"][length - 2]) for x in rows if len(x["heads"]) > length - 2 and x["heads"][length - 2] is not None]
        root = list(range(400))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        want = list(range(400))
        for a, b in links:
            root[find(a)] = find(b)
        groups = {}
        for i, m in enumerate(marks):
            for t in range(3):
                groups.setdefault((t, m[8 * t : 8 * t + 2 * length]), []).append(i)
        for a, b in links:
            assert any(a in g and b in g for g in groups.values())
        got = [find(i) for i in range(400)]
        root = want
        for g in groups.values():
            for x in g:
                root[find(x)] = find(g[0])
        assert len({(a, find(i)) for i, a in enumerate(got)}) == len(set(got)) == len({find(i) for i in range(400)})


def test_one_id_with_several_texts(spark, make_docs):
    a, b = prose(1, 100), prose(2, 100)
    rows = [(1, a, "en", "s"), (5, near(a, 3), "en", "s"), (5, b, "en", "s"), (6, near(b, 4), "en", "s"), (7, near(a, 9), "en", "s")]
    assert run(make_docs(rows)) == brute([(r[0], r[1]) for r in rows])
    assert sorted(r["doc_id"] for r in nd.keep_one(make_docs(rows)).collect()) == [1, 5]


def test_against_brute_force(spark, make_docs):
    base = [prose(i, 60 + i) for i in range(12)]
    texts = base + [near(base[i % 4], 100 + i, i % 9) for i in range(60)] + base[:3] + [base[5]] * 9 + ["one two", "one two", "one", "", None, prose(0, 30) + prose(3, 40)]
    docs = make_docs(texts)
    assert run(docs) == brute(list(enumerate(texts)))


def test_a_chain_and_many_blocks(spark, make_docs):
    words = [f"w{i}" for i in range(140)]
    chain = [" ".join(words[i : i + 100]) for i in range(0, 40, 4)]  # neighbours are alike, the ends are not
    texts = chain + [near(" ".join(words), i, 1) for i in range(40)]
    want = brute(list(enumerate(texts)))
    assert run(make_docs(texts), block=4) == want == run(make_docs(texts))
    assert len({c for _, c, _ in want}) == 2


def test_awkward_rows(awkward):
    rows = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    assert run(awkward) == brute(rows)
    assert nd.near_duplicates(awkward.limit(0)).count() == 0
    kept = nd.keep_one(awkward)
    assert kept.columns == awkward.columns
    ids = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect())
    assert ids == [-1, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13] and nd.keep_one(awkward.limit(0)).count() == 0


@pytest.mark.parametrize("edges,want", [([], {}), ([(1, 1)], {}), ([(1, 2), (2, 1), (3, 2), (9, 8)], {1: 1, 2: 1, 3: 1, 9: 8, 8: 8}), ([(i, i + 1) for i in range(30)], {i: 0 for i in range(31)})])
def test_components(spark, edges, want):
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)


def test_query(spark, sf):
    from strandline.llm.queries import op3_near_duplicates

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op3_near_duplicates(spark, sf).collect()), key=str) == brute(rows)
    assert op3_near_duplicates(spark, sf).agg(F.sum("n_links")).first()[0] > 0
