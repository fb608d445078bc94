"""Words of a text as 64-bit hashes, with numpy; used inside tasks, one text at a time."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# One number per byte value, and lower case for A-Z.
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

# Bytes that belong to words; all bytes of characters beyond ASCII do.
BETWEEN_SPACES = np.array([b not in (0x20, *range(0x09, 0x0E)) for b in range(256)])
LETTERS_AND_DIGITS = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A for b in range(256)])


def _powers(n: int) -> np.ndarray:
    """_MULTIPLIER to the power of 0 .. n - 1."""
    out = np.full(n, _MULTIPLIER, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(64)


def word_hashes(text: str | None, in_word: np.ndarray) -> np.ndarray:
    """A hash for each word of the text, A-Z in lower case."""
    if not text:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    member = np.concatenate(([False], in_word[raw], [False]))
    edges = np.flatnonzero(member[1:] != member[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    inside = np.arange(total) - np.repeat(first, lengths)
    powers = _POWERS if (longest := int(lengths.max())) <= len(_POWERS) else _powers(longest)
    terms = _BYTES[raw[member[1:-1]]] * powers[inside]
    return mixed(np.add.reduceat(terms, first) + lengths.astype(np.uint64) * _MULTIPLIER)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k words in a row; none if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = mixed(out * _MULTIPLIER + words[j:j + n])
    return out


def shingles(text: str | None, k: int, in_word: np.ndarray = BETWEEN_SPACES) -> np.ndarray:
    """The sorted distinct k-word shingles; one of all words if there are fewer than k."""
    words = word_hashes(text, in_word)
    return np.unique(gram_hashes(words, min(k, len(words)))) if len(words) else words
