from hypothesis import given
from hypothesis import strategies as st
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline import errors
from strandline.functions import hashing, sequence


def scalar_murmur(data: bytes, seed: int = 42) -> int:
    """A plain restatement of the published function, for comparison."""
    m = (1 << 64) - 1
    rot = lambda x, r: ((x << r) | (x >> (64 - r))) & m

    def fmix(x):
        x = ((x ^ (x >> 33)) * hashing.F1) & m
        x = ((x ^ (x >> 33)) * hashing.F2) & m
        return x ^ (x >> 33)

    h1 = h2 = seed
    whole = len(data) // 16 * 16
    for i in range(0, whole, 16):
        k1, k2 = int.from_bytes(data[i : i + 8], "little"), int.from_bytes(data[i + 8 : i + 16], "little")
        h1 ^= rot(k1 * hashing.C1 & m, 31) * hashing.C2 & m
        h1 = ((rot(h1, 27) + h2) * 5 + hashing.N1) & m
        h2 ^= rot(k2 * hashing.C2 & m, 33) * hashing.C1 & m
        h2 = ((rot(h2, 31) + h1) * 5 + hashing.N2) & m
    tail = data[whole:]
    h2 ^= rot(int.from_bytes(tail[8:], "little") * hashing.C2 & m, 33) * hashing.C1 & m
    h1 ^= rot(int.from_bytes(tail[:8], "little") * hashing.C1 & m, 31) * hashing.C2 & m
    h1, h2 = h1 ^ len(data), h2 ^ len(data)
    h1 = (h1 + h2) & m
    h2 = (h2 + h1) & m
    return (fmix(h1) + fmix(h2)) & m


def test_murmur_golden():
    assert hashing.murmur64(b"ACG") == 1731421407650554201


@given(st.lists(st.binary(max_size=70), max_size=20), st.integers(0, 2**64 - 1))
def test_murmur_equals_the_scalar_form(words, seed):
    assert hashing.murmur64_many(words, seed).tolist() == [scalar_murmur(w, seed) for w in words]


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1))
def test_bias_keeps_order(hashes):
    hk = hashing.biased(np.array(hashes, np.uint64))
    assert hashing.unbiased(hk).tolist() == hashes
    assert sorted(hashes) == hashing.unbiased(np.sort(hk)).tolist()


def test_hash_columns(spark):
    rows = spark.createDataFrame([("ACG",), (None,), ("é",)], "w string")
    got = [r[0] for r in rows.select(hashing.decode_hash(hashing.murmur64_column(F.col("w")))).collect()]
    assert [None if x is None else int(x) for x in got] == [1731421407650554201, None, scalar_murmur("é".encode())]
    edges = spark.createDataFrame([(str(x),) for x in (0, 2**63, 2**64 - 1)], "h string").select(hashing.decode_hash(hashing.encode_hash(F.col("h").cast("decimal(20,0)"))))
    assert [int(r[0]) for r in edges.collect()] == [0, 2**63, 2**64 - 1]
    lists = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "w array<string>").select(hashing.murmur64_array(F.col("w")))
    assert [len(r[0] or []) for r in lists.collect()] == [2, 0, 0]


@given(st.text("ACGTN", max_size=40))
def test_reverse_complement_is_its_own_inverse(s):
    b = np.frombuffer(s.encode(), np.uint8)
    twice = sequence._COMPLEMENT[sequence._COMPLEMENT[b[::-1]][::-1]]
    assert twice.tobytes().decode() == s


@given(st.text("acgtACGTN", max_size=40), st.integers(1, 12))
def test_dna_hashes(s, k):
    up, comp = s.upper(), str.maketrans("ACGT", "TGCA")
    words = [up[i : i + k] for i in range(len(up) - k + 1)]
    want = [scalar_murmur(min(w, w.translate(comp)[::-1]).encode()) for w in words if "N" not in w]
    assert sequence.dna_hashes(s.encode(), k).tolist() == want


def test_protein_skips_unknown_codons():
    assert sequence._translate(np.frombuffer(b"ATGNNNTAAGC", np.uint8)).tobytes() == b"M*"
    assert len(sequence.CODONS) == 64 and [c for c, a in sorted(sequence.CODONS.items()) if a == "*"] == ["TAA", "TAG", "TGA"]


def test_sequence_columns(spark):
    rows = spark.createDataFrame([("ATGR",), ("ATG",), ("",), (None,)], "s string")
    forced = [r[0] for r in rows.select(sequence.sequence_hashes(F.col("s"), 3, force=True)).collect()]
    assert [None if x is None else len(x) for x in forced] == [1, 1, 0, None]
    with pytest.raises(Exception) as e:
        rows.select(sequence.sequence_hashes(F.col("s"), 4)).collect()
    assert isinstance(errors.typed(e.value), errors.InvalidDNA) and errors.error_code(errors.typed(e.value)) == 1101
    assert [r[0] for r in rows.select(F.size(sequence.kmers(F.col("s"), 4))).collect()][:3] == [1, 0, 0]
    assert rows.select(sequence.amino_acids(F.lit("ATGNNNTAAGC"))).first()[0] == "M*"
    assert rows.select(sequence.ascii_upper(F.lit("aß"))).first()[0] == "Aß"
    with pytest.raises(ValueError):
        sequence.sequence_hashes(F.col("s"), 2, is_protein=True)


def test_error_codes():
    assert [int(errors.error_code(x)) for x in (None, errors.MismatchSeed("x"), errors.SketchError("x"), KeyError("x"))] == [0, 104, 2, 4]
    assert int(errors.error_code(UnicodeDecodeError("utf-8", b"", 0, 1, ""))) == 100002


def test_long_sequences_go_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    seq = bytes(rng.choice(list(b"ACGTacgtN"), 3000, p=[0.12] * 8 + [0.04]).tolist())
    whole = [f(x, k).tolist() for f in (sequence.dna_hashes, sequence.protein_hashes) for k in (6, 21) for x in (seq, seq[:20], b"")]
    monkeypatch.setattr(sequence, "PIECE", 100)
    assert [f(x, k).tolist() for f in (sequence.dna_hashes, sequence.protein_hashes) for k in (6, 21) for x in (seq, seq[:20], b"")] == whole


def test_words_of_long_and_odd_sequences(spark):
    """One pass a sequence: two million characters take seconds; characters beyond the basic plane are one each."""
    from pyspark.sql import functions as F

    from strandline.functions import sequence

    odd, long = "a\U0001f600b\nC", "ACGTTGCA" * 250_000
    rows = spark.createDataFrame([(odd,), ("",), (None,), (long,)], "seq string")
    found = rows.select("seq", sequence.kmers(F.col("seq"), 3).alias("k"), sequence.amino_acids(F.col("seq")).alias("p")).select("seq", F.size("k").alias("n"), F.slice("k", 1, 3).alias("k"), "p").collect()
    assert [(r["n"], r["k"]) for r in found] == [(3, [odd[:3], odd[1:4], odd[2:]]), (0, []), (0, []), (len(long) - 2, ["ACG", "CGT", "GTT"])]
    assert [r["p"] for r in found][:3] == ["", "", ""] and found[3]["p"] == "".join(sequence.CODONS[long[i : i + 3]] for i in range(0, len(long) - 2, 3))
