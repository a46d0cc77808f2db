import zlib

import numpy as np
from pyspark.sql import functions as F

from strandline.llm import toxicity as tx
from tests_llm_data import prose

BAD = ["zzidiot", "zzscum", "zztrash"]


def corpus(make_docs, labels_of, n=400, group="women"):
    texts, labels = [], []
    for i in range(n):
        toxic = int(i % 4 == 0)
        words = prose(i, 40).split(" ")
        if toxic:
            words[7] = BAD[i % 3]
            words[9] = group if i % 8 == 0 else words[9]
        texts.append(" ".join(words))
        labels.append((i, 1, toxic))
    return make_docs(texts), labels_of(labels)


def test_held_out_accuracy(make_docs, labels_of):
    docs, labels = corpus(make_docs, labels_of)
    scored = tx.score(docs, tx.train(docs, labels)).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in scored if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 40 and sum(r["predicted"] == r["toxic"] for r in held) / len(held) >= 0.97


def test_groups_score_alike(make_docs, labels_of):
    docs, labels = corpus(make_docs, labels_of)
    mentions = make_docs([f"the {w} are here. all of them" for w in ("women", "men", "boys", "tables")])

    def z(fairness):
        p = np.array([r["score"] for r in tx.score(mentions, tx.train(docs, labels, fairness=fairness)).orderBy("doc_id").collect()])
        return np.log(p / (1 - p))

    fair, unfair = z(100.0), z(0.0)
    assert unfair[0] - unfair[1] > 0.3 and abs(fair[0] - fair[1]) < 0.1 * (unfair[0] - unfair[1])
    assert fair[0] < 0


def test_swaps():
    assert tx.swapped_sentences(None) == [] and tx.swapped_sentences("no one. here") == []
    (a, b), = tx.swapped_sentences("It was. All Women met!\nEnd")
    assert a == ["all", "met", "women"] and b == sorted(["all", "met", tx._KIND["women"][(tx._KIND["women"].index("women") + 1) % len(tx._KIND["women"])]])


def test_awkward_rows(awkward, labels_of, make_docs):
    model = tx.train(awkward, labels_of([(i, 1, i % 2) for i in range(14)] + [(1, None, None), (None, 1, 1)]))
    scored = tx.score(awkward, model)
    assert scored.columns == ["doc_id", "score", "predicted"] and scored.count() == awkward.count()
    assert scored.where("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0
    assert tx.score(awkward.limit(0), model).count() == 0
    one_kind = tx.train(awkward, labels_of([(1, 1, 0), (3, 1, 0)]))
    nothing = tx.train(awkward, labels_of([]))
    assert tx.score(awkward, one_kind).agg(F.max("score")).first()[0] < 0.5 and tx.score(awkward, nothing).first()["score"] == 0.5


def test_labels_held_out_are_not_learned(make_docs, labels_of):
    docs, labels = corpus(make_docs, labels_of, 200)
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert tx.train(docs, labels) == tx.train(docs, turned)


def test_query(spark, sf):
    from strandline.llm.queries import op1_toxicity

    rows = op1_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_repeated_ids_stay_within_the_sample(make_docs, labels_of, monkeypatch):
    docs, labels = corpus(make_docs, labels_of, 100)
    learned, fit = [], tx.fit
    monkeypatch.setattr(tx, "fit", lambda rows, *rest: learned.append(len(rows)) or fit(rows, *rest))
    open_ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5]
    many = docs.unionByName(docs.where(F.col("doc_id") == open_ids[0]).crossJoin(docs.sparkSession.range(70).select()))
    tx.train(many, labels, sample=60)
    tx.train(docs, labels, sample=60)
    assert learned[0] in (59, 60) and learned[1] == 60
    assert tx._fitting([3, 1, 2, 4], {3: 2, 1: 9, 2: 3, 4: 1}, 5).tolist() == [True, False, True, False]
