"""Memoised tokenisation of distinct strings, shared by byte-level BPE and packing."""

from __future__ import annotations

import base64
import unicodedata

import numpy as np

from .arrays import spread

#: Latin, Greek and Cyrillic letters that normal forms and lower case leave single letters.
PLAIN = frozenset(c for c in map(chr, range(0x41, 0x530)) if c.isalpha() and len(c.lower()) == 1 and unicodedata.normalize("NFC", c).lower().isalpha())


class Memo:
    """Token ids of distinct byte strings; it is emptied once it holds `most` strings."""

    def __init__(self, encode_many, most: int = 500_000):
        self.encode_many, self.most = encode_many, most
        self.clear()

    def clear(self):
        self.index: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.ids, self.offsets = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def lookup(self, strings: list[bytes]) -> np.ndarray:
        """The number of each string; self.ids[self.offsets[i]:self.offsets[i + 1]] are the ids of number i."""
        if len(self.index) > self.most:
            self.clear()
        index = self.index
        new = [s for s in strings if s not in index]
        if new:
            ids, lengths = self.encode_many(new)
            for i, s in enumerate(new, len(index)):
                index[s] = i
            self.ids = np.concatenate([self.ids, ids])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])
        return np.fromiter(map(index.__getitem__, strings), np.int64, len(strings))


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def by_marks(counts: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Lengths of consecutive groups of ids, each of which ends at its counts-th marked id."""
    ends = np.flatnonzero(marks)[np.cumsum(counts) - 1] + 1
    return np.diff(ends, prepend=0)


def word_encoder(path: str, block: int = 4000):
    """encode_many for a tokenizers file that drops white space and marks the last id of each of its own words.

    Many strings are encoded a call. Those of PLAIN letters alone are one word, those of ASCII digits one a digit,
    so the marks tell the strings apart; all others, whose normal form may have other word borders than they
    themselves (a capital I with a dot becomes two words), are told apart by the offsets of their ids.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    marks = np.zeros(tokenizer.get_vocab_size(), bool)
    marks[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def plain(words: list[str], counts: list[int]):
        ids = np.array(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        return ids, by_marks(np.array(counts), marks[ids])

    def other(words: list[str]):
        ends = np.cumsum([len(w) + 1 for w in words])
        found = tokenizer.encode(" ".join(words), add_special_tokens=False)
        starts = np.fromiter((o[0] for o in found.offsets), np.int64, len(found.ids))
        return np.array(found.ids, np.uint32), np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(words))

    def encode_many(strings: list[bytes]):
        words = [s.decode("utf-8") for s in strings]
        counts = np.array([1 if PLAIN.issuperset(w) else len(w) if w.isascii() and w.isdigit() else 0 for w in words])
        parts, lengths, order = [], np.zeros(len(words), np.int64), []
        for kind in (np.flatnonzero(counts), np.flatnonzero(counts == 0)):
            for at in range(0, len(kind), block):
                own = kind[at : at + block]
                given = [words[i] for i in own]
                ids, lengths[own] = plain(given, counts[own]) if counts[own[0]] else other(given)
                parts.append(ids)
                order.append(own)
        order = np.concatenate(order)
        sorted_lengths = lengths[order]
        starts = np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(sorted_lengths) - sorted_lengths
        return np.concatenate(parts)[spread(starts, lengths)], lengths

    return encode_many
