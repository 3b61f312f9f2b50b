"""Vectorised hashing of words and characters of many texts at once."""

from __future__ import annotations

from functools import cache

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, a zero after each text, and the end of each text in that array."""
    lower = [t.lower() for t in texts]
    flat = np.frombuffer("\0".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.cumsum(np.fromiter(map(len, lower), np.int64, len(lower)) + 1)


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(1 << 16)] + [True])


@cache
def _word_characters() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(1 << 16)] + [True])


def is_letter(flat: np.ndarray) -> np.ndarray:
    return _letters()[np.minimum(flat, 1 << 16)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


@cache
def _powers() -> np.ndarray:
    out, x = [], 1
    for _ in range(256):
        out.append(x)
        x = x * _BASE % 2**64
    return np.array(out, np.uint64)


def word_hashes(flat: np.ndarray, ends: np.ndarray, stem: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, hash of its first `stem` characters, row of its text); a word is a run of letters or digits."""
    inside = _word_characters()[np.minimum(flat, 1 << 16)]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = np.nonzero(start)[0]
    if not len(first):
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(0, np.int64)
    number = np.cumsum(start) - 1
    place = np.arange(len(flat)) - first[np.maximum(number, 0)]
    term = np.where(inside, (flat.astype(np.uint64) + np.uint64(1)) * _powers()[place % 256], np.uint64(0))
    whole = np.add.reduceat(term, first)
    term[place >= stem] = 0
    return mix(whole), mix(np.add.reduceat(term, first) + np.uint64(7)), np.searchsorted(ends, first, side="right")
