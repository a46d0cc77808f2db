"""64-bit MurmurHash3 (x64, 128-bit variant, first half) of byte strings, and hashes as Spark longs.

Hashes are unsigned and their order matters, so a hash h is kept as ``hk = h - 2^63``: signed order of hk is
unsigned order of h.
"""

from __future__ import annotations

try:
    from _md5 import md5  # the interpreter's own takes half the time of the library's on short strings
except ImportError:
    from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42
BIAS = 1 << 63
_U = np.uint64
# Fixed values of the published hash function.
C1, C2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
N1, N2 = 0x52DCE729, 0x38495AB5
F1, F2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def _fmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(F1)
    x = (x ^ (x >> _U(33))) * _U(F2)
    return x ^ (x >> _U(33))


def _lanes(b: np.ndarray) -> np.ndarray:
    """Up to eight byte columns as one little-endian number a row."""
    out = np.zeros(len(b), np.uint64)
    for i in range(b.shape[1]):
        out |= b[:, i].astype(np.uint64) << _U(8 * i)
    return out


def murmur64_rows(rows: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The hash of each row of a (count, length) byte matrix."""
    count, length = rows.shape
    h1 = np.full(count, seed % (1 << 64), np.uint64)
    h2 = h1.copy()
    blocks = length // 16
    for k in range(blocks):
        at = 16 * k
        h1 ^= _rotl(_lanes(rows[:, at : at + 8]) * _U(C1), 31) * _U(C2)
        h1 = (_rotl(h1, 27) + h2) * _U(5) + _U(N1)
        h2 ^= _rotl(_lanes(rows[:, at + 8 : at + 16]) * _U(C2), 33) * _U(C1)
        h2 = (_rotl(h2, 31) + h1) * _U(5) + _U(N2)
    tail = rows[:, 16 * blocks :]
    if tail.shape[1] > 8:
        h2 ^= _rotl(_lanes(tail[:, 8:]) * _U(C2), 33) * _U(C1)
    if tail.shape[1]:
        h1 ^= _rotl(_lanes(tail[:, :8]) * _U(C1), 31) * _U(C2)
    h1 ^= _U(length)
    h2 ^= _U(length)
    h1 = h1 + h2
    h2 = h2 + h1
    return _fmix(h1) + _fmix(h2)


def murmur64_many(words: list[bytes], seed: int = SEED) -> np.ndarray:
    """The hash of each byte string; strings of one length are hashed together."""
    out = np.zeros(len(words), np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        joined = np.frombuffer(b"".join(words[i] for i in at), np.uint8).reshape(len(at), n)
        out[at] = murmur64_rows(joined, seed)
    return out


def murmur64(word: bytes, seed: int = SEED) -> int:
    return int(murmur64_many([word], seed)[0])


def biased(hashes: np.ndarray) -> np.ndarray:
    """Unsigned hashes as hk."""
    return (hashes ^ _U(BIAS)).view(np.int64)


def unbiased(hk: np.ndarray) -> np.ndarray:
    return np.asarray(hk, np.int64).view(np.uint64) ^ _U(BIAS)


def encode_hash(h: Column) -> Column:
    """An exact decimal hash (0 to 2^64 - 1) as hk."""
    return (h.cast("decimal(20,0)") - F.lit(str(BIAS)).cast("decimal(20,0)")).cast("bigint")


def decode_hash(hk: Column) -> Column:
    """hk as an exact decimal(20,0)."""
    return (hk.cast("decimal(20,0)") + F.lit(str(BIAS)).cast("decimal(20,0)")).cast("decimal(20,0)")


def bias_of(h: int) -> int:
    return h - BIAS


def murmur64_column(word: Column, seed: int = SEED) -> Column:
    """hk of each string (its UTF-8 bytes) or binary; null of null."""

    def run(words: pa.Array) -> pa.Array:
        raw = words.cast(pa.binary()).to_pylist()
        hk = biased(murmur64_many([x or b"" for x in raw], seed))
        return pa.array(hk, mask=np.array([x is None for x in raw], bool))

    return F.arrow_udf(run, "bigint")(word)


def murmur64_array(words: Column, seed: int = SEED, max_hk: int | None = None) -> Column:
    """hk of each element of an array of strings; above ``max_hk`` they are left out before they reach the JVM."""

    def run(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().cast(pa.binary()).to_pylist()
        hk = biased(murmur64_many([x or b"" for x in flat], seed))
        sizes = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64)
        keep = np.ones(len(hk), bool) if max_hk is None else hk <= max_hk
        kept = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(sizes)])]
        return pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), pa.array(hk[keep]))

    return F.arrow_udf(run, "array<bigint>")(words)


def portable_hash(text: Column) -> Column:
    """The first 60 bits of MD5 as a long: the same number in any SQL engine."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def portable_shingles(words: Column, n: int) -> Column:
    """``portable_hash`` of each run of ``n`` words, of a text whose words have a single space between them (an array, in
    order; empty of null and of fewer words)."""

    def run(texts: pa.Array) -> pa.Array:
        digests, sizes = [], []
        for raw in texts.cast(pa.binary()).to_pylist():
            raw = raw or b""
            gaps = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
            starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(raw)]
            found = [md5(raw[a:b]).digest() for a, b in zip(starts, ends[n - 1 :], strict=False)] if raw else []
            digests += found
            sizes.append(len(found))
        hashes = (np.frombuffer(b"".join(digests), ">u8")[::2] >> _U(4)).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(hashes))

    return F.arrow_udf(run, "array<bigint>")(words)
