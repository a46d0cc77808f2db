import re

from strandline.plans.queries import QUERIES
from test_functions import scalar_murmur


def test_every_word_is_hashed(spark, tmp_path):
    texts = [" ".join("abcdefghij"[i % 10] * n for i, n in enumerate((1, 15, 16, 17, 31, 32, 33, 48, 100))), "Short https://example.org/" + "x9" * 40, None, ""]
    spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for q in ("murmur_words", "murmur_long_words") for r in QUERIES[q](spark, str(tmp_path)).collect()]
    words = {w for x in texts if x for w in re.findall("[a-z0-9]+", x.lower())}
    assert sorted(got) == sorted((w, str(scalar_murmur(w.encode()))) for w in words)
    assert {len(w) > 15 for w in words} == {True, False}


def test_long_words_of_the_tables(spark, sf):
    rows = QUERIES["murmur_long_words"](spark, sf).collect()
    assert rows and all(len(r["word"]) > 15 and int(r["hash"]) == scalar_murmur(r["word"].encode()) for r in rows)
