"""Vectorised hashing of words and byte strings inside a task, over one flat buffer of many texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CODES = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class PrefixHash:
    """Polynomial prefix hashes modulo 2**64: the hash of any substring in constant time."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(CODES[data] * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def grams(self, n: int) -> np.ndarray:
        """Hashes of all substrings of length ``n``, by start."""
        m = max(0, len(self.sums) - n)
        return (self.sums[n:] - self.sums[:m]) * self.down[:m]


class FlatWords:
    """Words (maximal runs of bytes other than space and tab to carriage return) of many texts.

    ``data`` holds the texts one after another, each closed by a newline; ``doc_starts`` their
    places; ``starts``, ``ends`` and ``doc`` the words' places and texts.
    """

    def __init__(self, texts: Sequence[bytes], lower: bool):
        data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        self.data = LOWER[data] if lower else data
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.doc_starts = np.cumsum(sizes) - sizes
        blank = BLANK[self.data]
        edge = np.diff(blank.astype(np.int8), prepend=np.int8(1))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.blank = blank
        self.doc = np.searchsorted(self.doc_starts, self.starts, side="right") - 1
        self.hash = PrefixHash(self.data)

    def room(self) -> np.ndarray:
        """For each byte, how many bytes of its word are left from it on; 0 outside words."""
        left = np.zeros(len(self.data), dtype=np.int64)
        sizes = self.ends - self.starts
        inside = ~self.blank
        left[inside] = np.repeat(self.ends, sizes) - np.flatnonzero(inside)
        return left


def chunks(texts: Sequence[str | None], limit: int = 1 << 19, split: bool = True) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Texts in groups of about ``limit`` bytes: their indices and UTF-8 bytes; null counts as empty.

    With ``split``, a longer text comes as several pieces of the same index, cut at blanks.
    """
    owner: list[int] = []
    parts: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        while True:
            cut = len(raw)
            if split and len(raw) > limit:
                cut = max(raw.rfind(b" ", 0, limit), raw.rfind(b"\n", 0, limit)) + 1
                if cut == 0:
                    nxt = [p for p in (raw.find(b" ", limit), raw.find(b"\n", limit)) if p >= 0]
                    cut = min(nxt) + 1 if nxt else len(raw)
            owner.append(i)
            parts.append(raw[:cut])
            size += cut
            if size >= limit:
                yield np.array(owner), parts
                owner, parts, size = [], [], 0
            raw = raw[cut:]
            if not raw:
                break
    if owner:
        yield np.array(owner), parts
