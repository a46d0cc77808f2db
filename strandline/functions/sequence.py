"""DNA and protein words: validity, complement, canonical k-mers, translation, and their hashes."""

from __future__ import annotations

import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.hashing import SEED, biased, murmur64_rows

# The standard genetic code, codons in the order of T, C, A, G at each place.
CODON_BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate(CODON_BASES) for j, b in enumerate(CODON_BASES) for k, c in enumerate(CODON_BASES)}

_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[ord("a") : ord("z") + 1] -= 32
_COMPLEMENT = np.arange(256, dtype=np.uint8)
for _a, _b in zip("ACGTacgt", "TGCATGCA", strict=True):
    _COMPLEMENT[ord(_a)] = ord(_b)
_BASE = np.full(256, 4, np.uint8)
for _i, _a in enumerate(CODON_BASES):
    _BASE[ord(_a)] = _i
PIECE = 1 << 22  # bytes of a matrix of words
_AMINO = np.frombuffer(AMINO_ACIDS.encode(), np.uint8)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once a row: bound to a lambda's variable, it can't be put into the body of a
    lambda in ``f``, where it would be computed anew for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ascii_upper(seq: Column) -> Column:
    """Upper case of ASCII letters only; lengths never change."""
    return F.translate(seq, string.ascii_lowercase, string.ascii_uppercase)


def kmers(seq: Column, k: int) -> Column:
    """All windows of ``k`` characters; none if the text is shorter. One pass over the text: taking a substring for each
    window would read it from its beginning every time."""
    return F.coalesce(F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1)), F.array().cast("array<string>"))


def is_dna(word: Column) -> Column:
    """Only A, C, G, T in either case; true of the empty word."""
    return word.rlike("^[ACGTacgt]*\\z")


def reverse_complement(seq: Column) -> Column:
    """Reversed, with A and T, C and G exchanged (in upper case); other characters stay."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCATGCA"))


def canonical(kmer: Column) -> Column:
    """The lesser, bytewise, of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def _letters(text: str) -> np.ndarray:
    """A byte for each character; those beyond ASCII, which no codon has, become 0."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, points, 0).astype(np.uint8)


def amino_acids(seq: Column) -> Column:
    """Codons of three translated; an unknown codon is skipped and the chain closes; an incomplete tail is dropped."""

    def run(seqs: pa.Array) -> pa.Array:
        return pa.array([_translate(_letters(x or "")).tobytes().decode() for x in seqs.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(seq)


def six_frames(seq: Column) -> Column:
    """The six translations: three frames forward, then three of the reverse complement."""

    def run(seqs: pa.Array) -> pa.Array:
        out = []
        for x in seqs.to_pylist():
            b = _UPPER[_letters(x or "")]
            out.append([_translate(s[i:]).tobytes().decode() for s in (b, _COMPLEMENT[b[::-1]]) for i in range(3)])
        return pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(seq)


def _translate(b: np.ndarray) -> np.ndarray:
    def part(x: np.ndarray) -> np.ndarray:
        codes = _BASE[x].reshape(-1, 3).astype(np.int64)
        return _AMINO[codes[(codes < 4).all(axis=1)] @ np.array([16, 4, 1])]

    whole = len(b) // 3 * 3
    return np.concatenate([part(b[at : min(whole, at + 3 * PIECE)]) for at in range(0, max(1, whole), 3 * PIECE)])


def _windows(b: np.ndarray, k: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(b, k) if len(b) >= k else np.zeros((0, k), np.uint8)


def _word_hashes(b: np.ndarray, k: int, seed: int, run: Callable[[np.ndarray, int, int], np.ndarray]) -> np.ndarray:
    """``run`` over pieces of ``b`` that overlap by a word less one, so that memory follows the piece and not the sequence."""
    if len(b) < k:
        return np.zeros(0, np.uint64)
    step = max(1, PIECE // k)
    return np.concatenate([run(b[at : at + step + k - 1], k, seed) for at in range(0, len(b) - k + 1, step)])


def _canonical_hashes(b: np.ndarray, k: int, seed: int) -> np.ndarray:
    forward = _windows(b, k)
    backward = _windows(_COMPLEMENT[b[::-1]], k)[::-1]
    bad = np.concatenate([[0], np.cumsum(_BASE[b] > 3)])
    good = bad[k:] - bad[:-k] == 0
    forward, backward = forward[good], backward[good]
    differ = forward != backward
    first = differ.argmax(axis=1)
    at = np.arange(len(forward))
    lesser = (forward[at, first] <= backward[at, first])[:, None]
    return murmur64_rows(np.ascontiguousarray(np.where(lesser, forward, backward)), seed)


def dna_hashes(seq: bytes, k: int, seed: int = SEED) -> np.ndarray:
    """Hashes of the canonical k-mers in order; windows with other characters than ACGT are left out."""
    return _word_hashes(_UPPER[np.frombuffer(seq, np.uint8)], k, seed, _canonical_hashes)


def protein_hashes(seq: bytes, k: int, seed: int = SEED) -> np.ndarray:
    """Hashes of the words of k / 3 residues in all six frames."""
    b = _UPPER[np.frombuffer(seq, np.uint8)]
    strands = (b, _COMPLEMENT[b[::-1]])
    plain = lambda part, n, seed: murmur64_rows(np.ascontiguousarray(_windows(part, n)), seed)
    return np.concatenate([_word_hashes(_translate(s[i:]), k // 3, seed, plain) for s in strands for i in range(3)])


def sequence_hashes(seq: Column, ksize: int, is_protein: bool = False, seed: int = SEED, force: bool = False, max_hk: int | None = None) -> Column:
    """hk of all words of each sequence (an array, in order; null of null).

    DNA with another character than ACGT fails the query with InvalidDNA, or loses the k-mers that hold it if
    ``force``. Hashes above ``max_hk`` are left out before they reach the JVM."""
    if is_protein and ksize < 3:
        raise ValueError("protein words need ksize of at least 3")
    if ksize < 1:
        raise ValueError("ksize must be at least 1")
    hashes = protein_hashes if is_protein else dna_hashes

    def run(seqs: pa.Array) -> pa.Array:
        out = []
        for raw in seqs.cast(pa.binary()).to_pylist():
            hk = None if raw is None else biased(hashes(raw, ksize, seed))
            out.append(hk if hk is None or max_hk is None else hk[hk <= max_hk])
        return pa.array(out, pa.list_(pa.int64()))

    checked = seq
    if not is_protein and not force:
        bad = (F.octet_length(seq) >= ksize) & seq.rlike("[^ACGTacgt]")
        said = F.concat(F.lit("InvalidDNA: invalid DNA character in input: "), F.regexp_extract(seq, "[^ACGTacgt]", 0))
        checked = F.when(bad, F.raise_error(said)).otherwise(seq)
    return F.arrow_udf(run, "array<bigint>")(checked)
