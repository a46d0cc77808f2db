import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandline.llm.encoders import Encoder, cut_safely
from strandline.llm.packing import pack
from strandline.llm.token_counts import count_tokens

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_are_the_librarys(path):
    r = random.Random(3)
    plain, odd = " \n\t\x0b\r'stremvlld.,!?0123456789aAéÈñß—…|#<>$%xÀÖØöøÿ×÷«»", " \n't\u0085 ́İıﬁ漢字Ω½²aZ0ª😀​"
    texts = ["".join(r.choice(a) for _ in range(r.randint(0, 60))) for a in (plain, odd, plain + odd) for _ in range(1500)]
    texts += ["", " ", "a <|endoftext|>b", "<|startoftext|><|endoftext|>", "don't I'LL", "ab cd  ef " * 20_000, "x" * 100_000, " " * 100_000, "漢 字 " * 40_000]
    library = Tokenizer.from_file(path)
    enc = Encoder(path)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == want
    assert Encoder(path, counts_only=True).encode(texts) == [len(x) for x in want]


def test_cuts_lose_nothing():
    text = "ab  cd ef\n gh " * 9000
    pieces = cut_safely(text, 1000)
    assert "".join(pieces) == text and len(pieces) > 50 and all(p[0] == " " and p[1] != " " for p in pieces[1:])


def test_counts(awkward):
    got = count_tokens(awkward, WORD).collect()
    library = Tokenizer.from_file(WORD)
    rows = [(r["doc_id"], r["text"] or "") for r in awkward.select("doc_id", "text").collect()]
    want = [(i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in rows]
    key = lambda x: (x[0] is None, x)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=str) == sorted(want, key=str)
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got) and key
    assert count_tokens(awkward.limit(0), WORD).count() == 0


def check_pieces(rows, docs, window):
    library = Tokenizer.from_file(BYTE)
    at, seen = 0, {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["sequence_id"] * window + r["offset"] == at and 0 < r["length"] <= window - r["offset"]
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and r["crc"] == zlib.crc32(ids.tobytes())
        at += r["length"]
        seen.setdefault(r["doc_id"], []).append((r["start"], ids, r["doc_tokens"]))
    want = {}
    for i, text in docs:
        want.setdefault(i, []).append(library.encode(text or "", add_special_tokens=False).ids + [0])
    assert at == sum(len(x) for xs in want.values() for x in xs)
    for i, texts in want.items():
        assert sorted(n for s, _, n in seen[i] if s == 0) == sorted(map(len, texts))
        if len(texts) == 1:
            whole = sorted(seen[i], key=lambda x: x[0])
            assert np.concatenate([x[1] for x in whole]).tolist() == texts[0] and [x[0] for x in whole] == np.cumsum([0, *(len(x[1]) for x in whole[:-1])]).tolist()


@pytest.mark.parametrize("parts", [1, 3])
def test_pack(awkward, parts):
    docs = awkward.repartition(parts)
    rows = pack(docs, BYTE).withColumn("crc", F.crc32("ids")).collect()
    check_pieces(rows, [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()], 1024)


def test_pack_edges(awkward, make_docs):
    assert pack(awkward.limit(0), BYTE).count() == 0
    rows = pack(make_docs([None, "", "a"]), BYTE, window=2).withColumn("crc", F.crc32("ids")).collect()
    check_pieces(rows, [(0, None), (1, ""), (2, "a")], 2)


def test_op_queries(spark, sf):
    from strandline.llm import queries

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    counted = {r["doc_id"]: r["n_tokens"] for r in queries.op4_token_counts(spark, sf).collect()}
    library = Tokenizer.from_file(WORD)
    assert counted == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in docs}
    packed = queries.op8_packing(spark, sf)
    assert packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert packed.agg(F.sum("length")).first()[0] == packed.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
