"""Toxicity: a counterfactual-regularised classifier.

A logistic regression over the distinct words of a text. It learns from a bounded, documented sample of
labelled rows (``sample`` at most: the smallest ids by a hash, each with all rows of that id, as far as they fit; an id
whose rows don't is left out). The words it may use are those of
the sample that tell the labels apart best, found by distributed counts and kept only if their chi-square is
beyond 1.5 times the logarithm of the number of words tried, and the identity terms below. Each
labelled sentence that mentions a group is copied with the term swapped for another of its kind; the loss
adds ``fairness`` times the squared difference of the two log-odds (of ``swaps`` pairs at most), so that naming one group or another, or
a neutral mention, doesn't move a score. Labels, language, source and id are never inputs of a score.

Null and empty texts have no words and get the model's base rate. Repeated rows are scored alike. A document
of several labels is toxic if one of them is. Without labels of both kinds the score is the sample's
(smoothed) rate for every text. Other columns of the input are left out.
"""

from __future__ import annotations

import re
from collections.abc import Collection

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import bounded_batches

#: Words that name a group and say nothing bad of it, by kind.
IDENTITY_TERMS = {
    "gender": "woman women man men female male girl girls boy boys frau frauen mann männer femme femmes homme hommes mujer mujeres hombre hombres transgender nonbinary",
    "faith": "muslim muslims christian christians jew jews jewish hindu hindus buddhist buddhists atheist atheists catholic sikh moslem juden christen musulman juif chrétien judío cristiano musulmán",
    "origin": "african asian american european arab arabs mexican latino hispanic indian chinese turkish polish immigrant immigrants refugee refugees foreigner ausländer flüchtlinge étranger inmigrante",
    "colour": "black white brown schwarz weiß noir blanc negro blanco",
    "love": "gay lesbian bisexual straight queer homosexual heterosexual schwul lesbisch homosexuel homosexuelle lesbienne lesbiana",
    "body": "deaf blind disabled autistic old young elderly taub behindert sourd aveugle sordo ciego",
}
_KIND = {word: words.split() for words in IDENTITY_TERMS.values() for word in words.split()}
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def words_of(text: str | None) -> set[str]:
    """The distinct lower-case words of a whole text."""
    return set(_WORD.findall(text.lower())) if text else set()


def swapped_sentences(text: str | None) -> list[tuple[list[str], list[str]]]:
    """(words, words with each identity term replaced by the next of its kind) of each sentence with such a term."""
    pairs = []
    for sentence in _SENTENCE.findall(text.lower()) if text else []:
        words = words_of(sentence)
        if named := words & _KIND.keys():
            turned = {_KIND[w][(_KIND[w].index(w) + 1) % len(_KIND[w])] for w in named}
            pairs.append((sorted(words), sorted((words - named) | turned)))
    return pairs


def fit(rows: list[np.ndarray], y: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], width: int, fairness: float = 100.0, l2: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Weights, the last of them the intercept, by full-batch Adam. rows and pairs: indexes of the words present."""
    w = np.zeros(width + 1)
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    sign = [np.concatenate([np.ones(len(a)), -np.ones(len(b))]) for a, b in pairs]
    pair_flat = np.concatenate([*(np.concatenate(p) for p in pairs), np.zeros(0, np.int64)]).astype(np.int64)
    pair_of = np.repeat(np.arange(len(pairs)), [len(s) for s in sign])
    pair_sign = np.concatenate([*sign, np.zeros(0)])
    share = y.mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)  # both labels count alike
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.bincount(of, w[flat], len(rows)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        grad = np.append(np.bincount(flat, error[of], width), error.sum())
        grad[:-1] += l2 * w[:-1]
        if pairs:
            moved = np.bincount(pair_of, w[pair_flat] * pair_sign, len(pairs)) * (2 * fairness / len(pairs))
            grad[:-1] += np.bincount(pair_flat, moved[pair_of] * pair_sign, width)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def _fitting(ids: Collection, repeats: dict, room: int) -> np.ndarray:
    """For each id, in order, whether its rows still fit in ``room`` after those of the ids taken before."""
    taken = np.zeros(len(ids), bool)
    for i, n in enumerate(repeats.get(x, 0) for x in ids):
        taken[i] = n <= room
        room -= n if taken[i] else 0
    return taken


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, vocabulary: int = 4_000, fairness: float = 100.0, swaps: int = 40_000) -> tuple[dict[str, float], float]:
    """(weight of each word that has one, intercept), from labelled rows whose crc32(doc_id) mod 5 is not 0."""
    spark = bounded_batches(docs).sparkSession
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    schema, ids = chosen.schema, chosen.toPandas()  # at most ``sample`` rows
    few = spark.createDataFrame(ids, schema)
    repeats = docs.select("doc_id").join(F.broadcast(few.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    ids = spark.createDataFrame(ids[_fitting(ids["doc_id"], dict(map(tuple, repeats.collect())), sample)], schema)
    kind = pa.struct([("words", pa.list_(pa.string())), ("pairs", pa.list_(pa.struct([("a", pa.list_(pa.string())), ("b", pa.list_(pa.string()))])))])

    def features(texts: pa.Array) -> pa.Array:
        found = [{"words": sorted(words_of(t)), "pairs": [{"a": a, "b": b} for a, b in swapped_sentences(t)]} for t in texts.to_pylist()]
        return pa.array(found, kind)

    extract = F.arrow_udf(features, "struct<words:array<string>,pairs:array<struct<a:array<string>,b:array<string>>>>")
    known = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").select("y", extract("text").alias("f")).persist()
    total, positive = known.agg(F.count(F.lit(1)), F.sum("y")).first()
    base = ((positive or 0) + 1) / (total + 2)
    if not total or not positive or positive == total:
        known.unpersist()
        return {}, float(np.log(base / (1 - base)))
    seen = known.select("y", F.explode("f.words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k")).where("n >= 2")
    rate = positive / total
    surplus = F.col("k") - F.col("n") * rate
    chi = surplus * surplus / (F.col("n") * rate * (1 - rate))
    seen = seen.withColumn("chi", chi).persist()
    chance = 1.5 * float(np.log(max(2, seen.count())))
    best = [r["word"] for r in seen.where(F.col("chi") > chance).orderBy(F.col("chi").desc(), "word").limit(vocabulary).collect()]
    seen.unpersist()
    at = {word: i for i, word in enumerate(dict.fromkeys([*best, *_KIND]))}
    sent = spark.sparkContext.broadcast(at)

    def indexes(lists: pa.Array) -> pa.Array:
        return pa.array([sorted(sent.value[w] for w in ws or [] if w in sent.value) for ws in lists.to_pylist()], pa.list_(pa.int32()))

    index = F.arrow_udf(indexes, "array<int>")
    table = known.select("y", index("f.words").alias("x")).toArrow()
    rows, y = [np.asarray(x, np.int64) for x in table.column("x").to_pylist()], table.column("y").to_numpy().astype(float)
    turned = known.select(F.explode("f.pairs").alias("p")).orderBy(F.xxhash64("p")).limit(swaps).select(index("p.a").alias("a"), index("p.b").alias("b")).toArrow()
    pairs = [(np.asarray(a, np.int64), np.asarray(b, np.int64)) for a, b in zip(turned.column("a").to_pylist(), turned.column("b").to_pylist(), strict=True)]
    known.unpersist()
    w = fit(rows, y, pairs, len(at), fairness)
    return {word: float(w[i]) for word, i in at.items() if abs(w[i]) > 1e-4}, float(w[-1])


def score(docs: DataFrame, model: tuple[dict[str, float], float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, score, predicted) of each whole text."""
    sent = bounded_batches(docs).sparkSession.sparkContext.broadcast(model)

    def probability(texts: pa.Array) -> pa.Array:
        weights, intercept = sent.value
        used = set(weights)
        z = np.array([intercept + sum(weights[x] for x in sorted(words_of(t) & used)) for t in texts.to_pylist()], float)
        return pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    scored = docs.select(F.col(id_col).alias(id_col), F.arrow_udf(probability, "double")(F.col(text_col).cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
