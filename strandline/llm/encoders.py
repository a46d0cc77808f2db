"""Batch encoders over a vocabulary file of the ``tokenizers`` library.

Texts made of characters whose class and lower case are beyond doubt (all but ``_NOT_PLAIN``), under one of
the two published pre-tokenizers below, take a faster way to the same ids: a byte-level vocabulary whose ids
follow its merges goes into ``tiktoken``, which merges by the same ranks; for the other kind a worker keeps
each pre-token's ids and asks the library only for those it hasn't met. All other texts go through the
library whole. Long ones are cut at single spaces between words, which no pre-token of these vocabularies
crosses.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

# The split patterns of the two public vocabularies, written for the characters of _PLAIN.
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_BYTE_SPLIT = _CONTRACTIONS + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_SPLIT = re.compile(rf"{_CONTRACTIONS}|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")
_NOT_PLAIN = re.compile(r"[^\t\n\x0b\x0c\r -~À-ÿ“”‘’–—…]|[ªµº²³¹¼½¾]")

#: Most pre-tokens that a worker remembers; beyond that it starts anew.
CACHE_ENTRIES = 300_000
#: Longer texts are cut before they go to the library whole.
LONG_TEXT = 1 << 16


def cut_safely(text: str, size: int = LONG_TEXT) -> list[str]:
    """Pieces of about ``size`` characters, cut only before one space that stands between two non-spaces."""
    pieces, start = [], 0
    boundary = re.compile(r"(?<=\S) (?=\S)")
    while len(text) - start > size and (m := boundary.search(text, start + size)):
        pieces.append(text[start : m.start()])
        start = m.start()
    return [*pieces, text[start:]]


class Encoder:
    """Ids or counts of many texts, as the library gives them without added special tokens."""

    def __init__(self, path: str, counts_only: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        ids = [*spec["model"]["vocab"].values()] if isinstance(spec["model"]["vocab"], dict) else [len(spec["model"]["vocab"])]
        self.size = 1 + max([0, *ids, *(x["id"] for x in spec.get("added_tokens", []))])  # the first number that is no id
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.counts_only = counts_only
        self.known: dict = {}
        self.core = self.split = None
        kind = self._kind_of(spec)
        if kind == "bytes":
            self.core = self._ranked(spec)
        elif kind == "words":
            self.split = _WORD_SPLIT

    @functools.cached_property
    def library(self):
        """Loaded once some text needs it."""
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(self.path)
        library.no_padding()
        library.no_truncation()
        return library

    @staticmethod
    def _ranked(spec: dict):
        """The vocabulary in tiktoken, if its ids are 256 bytes and then its merges in order; else None."""
        import tiktoken

        # The printable stand-ins of bytes: themselves if printable in Latin-1, the others from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        special = {x["id"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if i not in special}
        in_order = all(ranks.get(bytes(byte_of[c] for c in a + b)) == 256 + i for i, (a, b) in enumerate(merges))
        if not in_order or len(ranks) != 256 + len(merges):
            return None
        return tiktoken.Encoding("bytes", pat_str=_BYTE_SPLIT, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _kind_of(spec: dict) -> str:
        """Which of the two known pre-tokenizers the file has, if any."""
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if (spec.get("model") or {}).get("type") != "BPE" or spec.get("post_processor"):
            return ""
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            return "bytes"
        kinds = [x.get("type") for x in pre.get("pretokenizers", [])]
        norms = [x.get("type") for x in (norm or {}).get("normalizers", [])]
        if kinds == ["Split", "ByteLevel"] and norms == ["NFC", "Replace", "Lowercase"]:
            first = pre["pretokenizers"][0]
            if first["pattern"].get("Regex") == _CONTRACTIONS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and first["invert"]:
                return "words"
        return ""

    def _value(self, encoding):
        return len(encoding) if self.counts_only else np.asarray(encoding.ids, self.dtype).tobytes()

    def _whole(self, text: str):
        parts = [self._value(e) for e in self.library.encode_batch_fast(cut_safely(text), add_special_tokens=False)]
        return sum(parts) if self.counts_only else b"".join(parts)

    def encode(self, texts: list[str]) -> list:
        """For each text its number of ids, or its ids as little-endian bytes of ``dtype``."""
        split, core, out, plain = self.split, self.core, [None] * len(texts), []
        for i, text in enumerate(texts):
            if not (split or core) or _NOT_PLAIN.search(text) or any(s in text for s in self.special):
                out[i] = self._whole(text)
            elif core:
                ids = [core.encode_to_numpy(x, disallowed_special=()) for x in cut_safely(text)]
                out[i] = sum(map(len, ids)) if self.counts_only else b"".join(x.astype(self.dtype).tobytes() for x in ids)
            else:
                plain.append((i, split.findall(text.lower())))
        if plain:
            new = list(set().union(*(words for _, words in plain)).difference(self.known))
            if len(self.known) + len(new) > CACHE_ENTRIES:
                self.known.clear()
                new = list(set().union(*(words for _, words in plain)))
            for at in range(0, len(new), 4096):
                some = new[at : at + 4096]
                found = self.library.encode_batch_fast(some, add_special_tokens=False)
                self.known.update(zip(some, map(self._value, found), strict=True))
            get = self.known.__getitem__
            for i, words in plain:
                out[i] = sum(map(get, words)) if self.counts_only else b"".join(map(get, words))
        return out


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, counts_only: bool = False) -> Encoder:
    """One encoder for each file and worker."""
    key = (path, counts_only)
    if key not in _encoders:
        _encoders[key] = Encoder(path, counts_only)
    return _encoders[key]
