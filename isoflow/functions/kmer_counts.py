"""Distinct k-mers of many sequences at once, as numbers in the base of their letters."""

from __future__ import annotations

from collections import Counter

import numpy as np

LETTERS = 1 << 18
"""Letters that are looked at together; a longer sequence is a group of its own."""


def groups(sequences: list[str]):
    """Neighbouring sequences of bounded size together: first and last index."""
    first = size = 0
    for i, s in enumerate(sequences):
        size += len(s)
        if size >= LETTERS or i + 1 == len(sequences):
            yield first, i + 1
            first, size = i + 1, 0


def distinct(sequences: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Owner (index of the sequence), k-mer (index into the names), how often, and the names of the k-mers of each sequence."""
    flat = np.frombuffer("".join(sequences).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    sizes = np.array([len(s) for s in sequences], dtype=np.int64)
    alphabet, letters = np.unique(flat, return_inverse=True)
    base = max(2, len(alphabet))
    if base ** k * max(1, len(sequences)) >= 1 << 62:  # too many to number
        found = [Counter(s[i : i + k] for i in range(len(s) - k + 1)) for s in sequences]
        names = sorted(set().union(*found))
        place = {name: i for i, name in enumerate(names)}
        rows = [(i, place[name], n) for i, c in enumerate(found) for name, n in c.items()]
        owner, kmer, n = (np.array(c, dtype=np.int64) for c in zip(*rows)) if rows else (np.empty(0, np.int64),) * 3
        return owner, kmer, n, names
    room = max(0, len(flat) - k + 1)
    code = np.zeros(room, dtype=np.int64)
    for j in range(k):
        code = code * base + letters[j : j + room]
    owner = np.repeat(np.arange(len(sizes)), sizes)[:room]
    inside = np.arange(room) + k <= np.cumsum(sizes)[owner] if room else np.empty(0, bool)
    key = owner[inside] * base**k + code[inside]
    if base**k * len(sequences) <= 4 * room + (1 << 16):  # few enough to count in place
        n = np.bincount(key, minlength=1)
        key = np.flatnonzero(n)
        n = n[key]
    else:
        key, n = np.unique(key, return_counts=True)
    owner, code = key // base**k, key % base**k
    codes, kmer = np.unique(code, return_inverse=True)
    digits = [alphabet[np.minimum(codes // base ** (k - 1 - j) % base, len(alphabet) - 1)] for j in range(k)] if len(codes) else []
    names = ["".join(map(chr, d)) for d in np.stack(digits, axis=1).tolist()] if digits else []
    return owner, kmer, n, names
