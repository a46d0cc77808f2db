import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandline.llm import language_model as lm
from strandline.llm import quality_classifier as qc
from tests_llm_data import prose

HAN = [chr(0x4E00 + i) for i in range(400)]


def grams_of(text):
    padded = lm.START * (lm.ORDER - 1) + text
    return [padded[i : i + lm.ORDER] for i in range(len(text))]


def han(seed, shuffled=False):
    """Text of words of three characters each out of a list, or the same characters in any order."""
    r = random.Random(seed)
    text = list("".join("".join(HAN[(7 * w + k) % 400] for k in range(3)) for w in (r.randrange(60) for _ in range(60))))
    if shuffled:
        r.shuffle(text)
    return "".join(text)


def kneser_ney(texts):
    counts = {lm.ORDER: Counter(g for t in texts for g in grams_of(t))}
    for n in range(lm.ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discounts, contexts = {}, {}
    for n, c in counts.items():
        m = Counter(c.values())
        y = m[1] / (m[1] + 2 * m[2]) if m[1] else 0
        discounts[n] = [min(max(k - (k + 1) * y * m[k + 1] / m[k], 0.05), k - 0.05) if m[k] and m[k + 1] else (0.5, 0.75, 0.9)[k - 1] for k in (1, 2, 3)]
        contexts[n] = {}
        for g, x in c.items():
            a, d = contexts[n].get(g[:-1], (0, 0))
            contexts[n][g[:-1]] = (a + x, d + discounts[n][min(x, 3) - 1])

    def p(g):
        if not g:
            return 1 / 0x110000
        total, held = contexts[len(g)].get(g[:-1], (0, 0))
        if not total:
            return p(g[1:])
        x = counts[len(g)].get(g, 0)
        return max(0, x - (discounts[len(g)][min(x, 3) - 1] if x else 0)) / total + held / total * p(g[1:])

    return p


@pytest.mark.parametrize("texts", [[], [""], ["abcdefgh", "", "xyé", "q", "\x00\x00a", "漢字𝒳 漢字𝒳", "aaaaaaaaa"]])
def test_windows(texts):
    which, grams, n = lm.windows(texts)
    assert n.tolist() == [len(t) for t in texts] and len(set(grams)) == len(grams)
    assert [grams[i] for i in which] == [g for t in texts for g in grams_of(t)]


def test_scores_equal_the_formulas(spark, make_docs):
    trained, asked = [prose(i, 40) for i in range(6)] + [han(1)], [prose(77, 60) + "# Zq|é", han(2), "", None, "ж", prose(1, 40)]
    p = kneser_ney(trained)
    blocks, scores = lm.score(lm.train(make_docs(trained)), make_docs(asked), "text", "block_", "row_", {"doc_id": "doc_id"})
    scored = scores.collect()
    assert sorted(r["doc_id"] for r in scored) == list(range(len(asked))) == sorted(r["doc_id"] for r in blocks.collect())
    for r in scored:
        text = asked[r["doc_id"]] or ""
        assert r["n"] == len(text)
        assert math.isclose(r["total"], -sum(math.log(p(g)) for g in grams_of(text)), rel_tol=1e-6)


def test_tables_grow_with_the_text(spark, make_docs):
    small, large = (make_docs(["".join(map(chr, random.Random(i).choices(range(0x4E00, 0x9000), k=3000))) for i in range(n)]) for n in (2, 8))
    assert lm.count(large).count() > 3.9 * lm.count(small).count()


def test_caseless_gibberish_is_rejected(spark, make_docs, labels_of):
    good, bad = [(i, han(i), "zh", "s0") for i in range(120)], [(1000 + i, han(i, True), "zh", "s0") for i in range(10)]
    judged = qc.classify(make_docs(good + bad), labels_of([(i, 1, 0) for i in range(0, 120)]))
    kept = {r["doc_id"]: r["quality"]["kept"] for r in judged.select("doc_id", F.col(judged.columns[-1]).alias("quality")).collect()}
    assert all(kept[i] for i in range(120)) and not any(kept[i] for i in range(1000, 1010))


def test_training_reads_texts_once_and_writes_one_table(spark, make_docs, monkeypatch):
    made, read = [], spark.sparkContext.accumulator(0)
    monkeypatch.setattr(lm, "materialise", lambda df, tag, write=lm.materialise: made.append(tag) or write(df, tag))

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    texts = [prose(i, 40) for i in range(12)]
    model = lm.train(make_docs(texts).select("text").mapInArrow(seen, "text string"))
    assert made == ["model"] and read.value == 12
    for n in range(1, lm.ORDER + 1):
        longer = {g[-n - 1 :] for t in texts for g in grams_of(t)}
        want = Counter(g for t in texts for g in grams_of(t)) if n == lm.ORDER else Counter(g[1:] for g in longer)
        got = {r["gram"]: r["context"] for r in model.where(F.col("order") == n).collect()}
        assert got == {g: g[:-1] for g in want}
    asked = sorted({g for g in grams_of("an others' 漢")})
    found = lm.probabilities(model, spark.createDataFrame([(g,) for g in asked], "gram string"))
    p = kneser_ney(texts)
    assert made == ["model", "asked", "asked"]
    assert {r["gram"]: round(math.log(r["p"]), 9) for r in found.collect()} == {g: round(math.log(p(g)), 9) for g in asked}
