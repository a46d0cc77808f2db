"""Word shingles and their min-hashes, computed for whole Arrow batches at once."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the polynomial hashes and of the 64-bit finaliser.
_P, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_M1, _M2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORDS = 5


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_M1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_M2)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = have = np.multiply.accumulate(steps)
    return have[:n]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word of all texts in order, and each text's number of words.

    A word is a run of characters other than space and U+0009 to U+000D. Its hash is a polynomial in its bytes,
    got from running sums over all bytes; so a word hashes alike wherever it stands."""
    raw = ("\n".join(texts) + "\n").encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8)
    space = _SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    start, stop = edge[0::2], edge[1::2]
    power = _power(_P, len(b) + 1)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], dtype=np.uint64)])
    inverse = _power(pow(_P, -1, 1 << 64), len(b) + 1)
    hashes = mix((run[stop] - run[start]) * inverse[start] + (stop - start).astype(np.uint64))
    ends = np.cumsum([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts]) if not raw.isascii() else np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(start, np.concatenate([[0], ends])))


def shingle_sets(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one text after the other, and their numbers.

    A text of fewer words than ``words``, but at least one, has the one shingle of all its words."""
    w, n = word_hashes(texts)
    first = np.cumsum(n) - n
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    of = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]
    padded = np.concatenate([w, np.zeros(words, np.uint64)])
    length = np.minimum(n, words)[of]
    total = np.zeros(len(of), np.uint64)
    for k, factor in enumerate(_power(_Q, words)):
        total += np.where(k < length, padded[at + k] * factor, np.uint64(0))
    h = mix(total + length.astype(np.uint64))
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], np.bincount(of[new], minlength=len(n))


def min_hashes(h: np.ndarray, n: np.ndarray, functions: int, seed: int = 11) -> np.ndarray:
    """(texts, functions) 32-bit min-hashes of sets of at least one element each."""
    draw = np.random.default_rng(seed)
    flip, odd = draw.integers(0, 1 << 64, functions, np.uint64), draw.integers(0, 1 << 63, functions, np.uint64) * np.uint64(2) + np.uint64(1)
    starts = np.cumsum(n) - n
    out = np.empty((len(n), functions), np.uint32)
    part = np.empty(len(h), np.uint64)
    for k in range(functions):
        np.bitwise_xor(h, flip[k], out=part)
        np.multiply(part, odd[k], out=part)
        out[:, k] = np.minimum.reduceat(part, starts) >> np.uint64(32) if len(n) else 0
    return out
