"""Edit distances by bit-parallel dynamic programming: a column of the table is a few 64-bit words.

A pattern is a row of bits; one step takes a letter of the text and updates the vertical differences
of the whole column with a handful of word operations (Myers, 1999; over several words as in
Hyyrö, 2003).  Here a step is taken for many patterns and texts at once as numpy arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_ONE, _TOP = np.uint64(1), np.uint64(63)
CELLS, ROWS = 1 << 22, 1 << 13
"""Letters of texts, and texts, that are looked at together."""


class Letters:
    """Strings as rows of letter numbers; letters outside ``alphabet`` share the last number."""

    def __init__(self, strings: list[str], alphabet: np.ndarray):
        self.length = np.array([len(s) for s in strings], dtype=np.int64)
        flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        at = np.minimum(np.searchsorted(alphabet, flat), max(0, len(alphabet) - 1))
        known = alphabet[at] == flat if len(alphabet) else np.zeros(len(flat), dtype=bool)
        self.code = np.full((len(strings), int(self.length.max(initial=0))), len(alphabet), dtype=np.int64)
        self.code[np.arange(self.code.shape[1]) < self.length[:, None]] = np.where(known, at, len(alphabet))

    def reversed(self) -> Letters:
        """The same strings from their ends on."""
        out = object.__new__(Letters)
        out.length, places = self.length, self.length[:, None] - 1 - np.arange(self.code.shape[1])
        out.code = np.where(places >= 0, np.take_along_axis(self.code, np.maximum(places, 0), axis=1), self.code.max(initial=0))
        return out


def alphabet_of(strings: list[str]) -> np.ndarray:
    return np.unique(np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype="<u4"))


def masks(patterns: Letters, letters: int) -> np.ndarray:
    """For each pattern and letter the bits of the places that hold it: patterns x letters x words."""
    rows, width = patterns.code.shape
    out = np.zeros((rows, letters + 1, max(1, -(-width // 64))), dtype=np.uint64)
    for j in range(width):
        has = np.flatnonzero(patterns.length > j)
        out[has, patterns.code[has, j], j // 64] |= _ONE << np.uint64(j % 64)
    out[:, letters] = 0  # a letter that no pattern has
    return out


class Column:
    """The current column of each pair; ``score`` is its last entry.

    Anchored at the start of the text, the first row counts letters of the text; else it is 0 and a
    match may begin anywhere.
    """

    def __init__(self, lengths: np.ndarray, words: int, shape: tuple, anchored: bool):
        self.plus = [np.full(shape, ~np.uint64(0)) for _ in range(words)]
        self.minus = [np.zeros(shape, dtype=np.uint64) for _ in range(words)]
        self.score = np.broadcast_to(lengths, shape).astype(np.int32)
        self.first = np.uint64(anchored)
        self.word, self.bit = (lengths - 1) // 64, ((lengths - 1) % 64).astype(np.uint64)
        self.single = words == 1

    def step(self, equal: list[np.ndarray]) -> np.ndarray:
        up, down = self.first, np.uint64(0)
        for w, eq in enumerate(equal):
            pv, mv = self.plus[w], self.minus[w]
            xv = eq | mv
            eq = eq | down
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            rise, fall = (ph >> self.bit) & _ONE, (mh >> self.bit) & _ONE
            change = rise.astype(np.int32) - fall.astype(np.int32)
            self.score += change if self.single else np.where(self.word == w, change, 0)
            up, down, ph, mh = ph >> _TOP, mh >> _TOP, (ph << _ONE) | up, (mh << _ONE) | down
            self.plus[w], self.minus[w] = mh | ~(xv | ph), ph & xv
        return self.score


def _scores(patterns: Letters, bits: np.ndarray, texts: Letters, anchored: bool) -> Iterator[np.ndarray]:
    """The score of each pattern in its own text after one letter, two letters, and so on."""
    rows = np.arange(len(patterns.length))
    column = Column(patterns.length, bits.shape[2], rows.shape, anchored)
    for j in range(texts.code.shape[1]):
        yield column.step([bits[rows, texts.code[:, j], w] for w in range(bits.shape[2])])


def _search(texts: list[str], probes: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance (above ``k``: no match), start and end of the best infix match of each probe in its text."""
    alphabet = alphabet_of(probes)
    text, probe = Letters(texts, alphabet), Letters(probes, alphabet)
    best = np.full(len(texts), k + 1, dtype=np.int32)
    for j, score in enumerate(_scores(probe, masks(probe, len(alphabet)), text, False)):
        best = np.where((text.length > j) & (score < best), score, best)
    back, turned = text.reversed(), probe.reversed()
    start = np.zeros(len(texts), dtype=np.int64)
    for j, score in enumerate(_scores(turned, masks(turned, len(alphabet)), back, False)):
        start = np.where((text.length > j) & (score == best), text.length - 1 - j, start)
    tails = Letters([t[a : a + len(p) + k] for t, a, p in zip(texts, start.tolist(), probes)], alphabet)
    end = np.full(len(texts), -1, dtype=np.int64)
    for j, score in enumerate(_scores(probe, masks(probe, len(alphabet)), tails, True)):
        end = np.where((end < 0) & (tails.length > j) & (score == best), start + j + 1, end)
    return best, start, end


def _searcher(k: int):
    """Matches as arrays of at most one: null inputs and texts without a match have none."""

    @F.pandas_udf("array<struct<distance:int,start:int,end:int>>")
    def search(seq: pd.Series, probe: pd.Series) -> pd.Series:
        asked = np.flatnonzero((seq.notna() & probe.notna()).to_numpy())
        sizes = np.array([len(seq.iloc[i]) for i in asked], dtype=np.int64)
        order = np.argsort(sizes, kind="stable")
        asked, sizes = asked[order], sizes[order]
        found: list = [None] * len(seq)
        at = 0
        while at < len(asked):  # texts of similar length together, as far as they fit
            n = int(np.searchsorted(np.maximum(sizes[at:], 1) * np.arange(1, len(asked) - at + 1), CELLS, side="right"))
            group = asked[at : at + min(max(1, n), ROWS)]
            best, start, end = _search(seq.iloc[group].tolist(), probe.iloc[group].tolist(), k)
            for i, *match in zip(group.tolist(), best.tolist(), start.tolist(), end.tolist()):
                if match[0] <= k:
                    found[i] = [dict(zip(("distance", "start", "end"), match))]
            at += len(group)
        return pd.Series(found, dtype=object)

    return search


def find_approx(seq, probe, k: int):
    """Best infix match of ``probe`` with at most ``k`` edits: ``(distance, start, end)``, the first of the best ones.

    Start and end count from 0, end exclusive; of equal distances the smallest start, then the smallest end.
    Exact matches, and texts in which none of ``k + 1`` parts of the probe stands (one of them would be free of
    edits), are settled without leaving the JVM; the others are searched by bit-parallel columns.
    """
    n, m = F.length(seq), F.length(probe)
    place = F.call_function("locate", probe, seq)
    whole = F.when(place > 0, F.struct(F.lit(0).alias("distance"), (place - 1).alias("start"), (place - 1 + m).alias("end")))
    if k == 0:
        return whole
    size = F.greatest(F.floor(m / (k + 1)).cast("int"), F.lit(1))
    gate = m <= k
    for j in range(k + 1):
        length = size if j < k else F.greatest(m - size * k, F.lit(1))
        gate = gate | F.contains(seq, F.substr(probe, size * j + 1, length))
    near = _searcher(k)(F.when((place == 0) & (n > 0) & (n >= m - k) & gate, seq), probe)
    return F.coalesce(whole, F.get(near, F.lit(0)))


TILE = 1024, 16
"""Patterns and texts whose columns are stepped together: they stay in a core's cache."""


def _tile(bits: np.ndarray, below: np.ndarray, length: np.ndarray, code: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Distances of some texts (``code``: letters by place, ``ends``: their lengths) to some patterns, as texts x patterns.

    ``bits`` is words x letters x patterns: a step copies rows of it.  The last entry of a column is the letters of
    the text so far plus the differences of the column, so nothing is kept up while stepping; all work is done in place.
    """
    words, shape = len(bits), (len(ends), len(length))
    plus, minus = [np.full(shape, ~np.uint64(0)) for _ in range(words)], [np.zeros(shape, dtype=np.uint64) for _ in range(words)]
    eq, zero, ph = (np.empty(shape, dtype=np.uint64) for _ in range(3))
    out = np.broadcast_to(length, shape).astype(np.int32)  # to empty texts
    for j in range(int(ends.max(initial=0))):
        up, down = _ONE, np.uint64(0)
        for w in range(words):
            pv, mv, last = plus[w], minus[w], w + 1 == words
            np.take(bits[w], code[j], axis=0, out=eq, mode="clip")
            if w:
                eq |= down
            np.bitwise_and(eq, pv, out=zero)
            zero += pv
            zero ^= pv
            zero |= eq
            zero |= mv  # no difference on the diagonal
            np.bitwise_or(zero, pv, out=ph)
            np.invert(ph, out=ph)
            ph |= mv
            pv &= zero  # the falls
            after = None if last else (ph >> _TOP, pv >> _TOP)
            ph += ph
            ph |= up
            pv += pv
            if w:
                pv |= down
            np.bitwise_and(ph, zero, out=mv)
            ph |= zero
            np.invert(ph, out=ph)
            pv |= ph
            if after:
                up, down = after
        done = np.flatnonzero(ends == j + 1)
        if len(done):
            total = np.full((len(done), shape[1]), j + 1, dtype=np.int32)
            for w in range(words):
                total += np.bitwise_count(plus[w][done] & below[w])
                total -= np.bitwise_count(minus[w][done] & below[w])
            out[done] = total
    return out


def _tiles(patterns: list[str], texts: list[str], tile: tuple[int, int]) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Tiles of patterns and texts with their distances, as texts x patterns."""
    alphabet = alphabet_of(patterns)
    pattern, text = Letters(patterns, alphabet), Letters(texts, alphabet)
    bits = masks(pattern, len(alphabet)).transpose(2, 1, 0)
    held = np.clip(pattern.length - 64 * np.arange(len(bits))[:, None], 0, 64)  # the places that the pattern has
    below = np.where(held == 64, ~np.uint64(0), (_ONE << np.minimum(held, 63).astype(np.uint64)) - _ONE)
    for a in range(0, len(patterns), tile[0]):
        ours = slice(a, a + tile[0])
        own, low = np.ascontiguousarray(bits[:, :, ours]), np.ascontiguousarray(below[:, ours])
        for b in range(0, len(texts), tile[1]):
            theirs = slice(b, b + tile[1])
            yield ours, theirs, _tile(own, low, pattern.length[ours], np.ascontiguousarray(text.code[theirs].T), text.length[theirs])


def distances(patterns: list[str], texts: list[str]) -> np.ndarray:
    """Levenshtein distance of every pattern to every text, as patterns x texts."""
    out = np.zeros((len(patterns), len(texts)), dtype=np.int32)
    for ours, theirs, part in _tiles(patterns, texts, TILE):
        out[ours, theirs] = part.T
    return out


def nearest(patterns: list[str], texts: list[str], tile: tuple[int, int] = TILE) -> np.ndarray:
    """Levenshtein distance of every pattern to the nearest of the texts; both should be sorted by length."""
    out = np.full(len(patterns), np.iinfo(np.int32).max, dtype=np.int32)
    for ours, _, part in _tiles(patterns, texts, tile):
        out[ours] = np.minimum(out[ours], part.min(axis=0))
    return out


BULK, BULK_LETTERS = 2048, 1000
"""Texts of one length from which a bit stands for a text, and their longest length."""
BLOCK_TEXTS, BLOCK_BITS = 1 << 16, 1 << 25
"""Texts, and bits of their letters, that are looked at together."""
BAND_WORDS = 4096
"""Words of an entry of the table: texts times references that are stepped together."""
PILOT = 128
"""Texts whose distances say how far from the diagonal the others are looked at."""


def _differ(code: np.ndarray, letters: int) -> np.ndarray:
    """Which texts have another letter at a place, a bit each: (letter, place) x words."""
    rows, width = code.shape
    padded = np.full((width, -(-rows // 64) * 64), -1, dtype=np.int16)
    padded[:, :rows] = code.T
    bits = np.packbits(padded != np.arange(letters, dtype=np.int16)[:, None, None], axis=2, bitorder="little")
    return bits.view(np.uint64).reshape(letters * width, padded.shape[1] // 64)


def _sums(rows: np.ndarray) -> list[np.ndarray]:
    """The number of bits that are set in each place of ``rows``, as binary digits from the lowest."""
    digits = []
    while len(rows):
        carried = []
        while len(rows) > 2:
            n = len(rows) // 3
            a, b, c, left = rows[:n], rows[n : 2 * n], rows[2 * n : 3 * n], rows[3 * n :]
            odd = a ^ b
            carried.append((a & b) | (odd & c))
            rows = np.concatenate([odd ^ c, left])
        if len(rows) == 2:
            carried.append(rows[:1] & rows[1:])
            rows = rows[:1] ^ rows[1:]
        digits.append(rows[0])
        rows = np.concatenate(carried) if carried else rows[:0]
    return digits


class Band:
    """The table of references of ``m`` letters and texts of ``n``, diagonal by diagonal, as far as ``most`` edits reach.

    A bit stands for a text.  An entry differs from the one above it and from the one to its left by -1, 0 or 1, kept as
    two bits that are set unless the difference is 1 (``up``) or -1 (``down``); those of an antidiagonal follow from those
    of the one before it.  A path that leaves the band has more than ``most`` edits, so smaller distances are exact;
    others are not too small.
    """

    def __init__(self, m: int, n: int, most: int, shape: tuple[int, int]):
        end = n - m  # the diagonal of the last entry
        free = (most - abs(end)) // 2
        first, last = min(0, end) - free, max(0, end) + free
        size = (last - first + 4) // 2 + 1  # with one at either side, where differences are 1
        self.n, self.least, self.shape = n, abs(end), shape
        self.up, self.down = (np.empty((2, 2, size, *shape), dtype=np.uint64) for _ in range(2))
        (up_v, up_h), (down_v, down_h) = self.up, self.down
        rows, places, self.steps, seen = [], [], [], 0
        zero, spare = (np.empty((size, *shape), dtype=np.uint64) for _ in range(2))
        self.kept = np.empty((min(m, n), *shape), dtype=np.uint64)
        for s in range(2, m + n + 1):
            low, high = max(first, 2 - s, s - 2 * m), min(last, s - 2, 2 * n - s)
            low += (low - s) % 2
            own = np.arange(low, high + 1, 2)
            if not len(own):
                continue
            at, odd, cells = (low - first + 1) // 2, (low - first + 1) % 2, len(own)
            rows.append((s - own) // 2 - 1)
            places.append((s + own) // 2 - 1)
            here, left, above = slice(at, at + cells), slice(at - 1 + odd, at - 1 + odd + cells), slice(at + odd, at + odd + cells)
            before = (up_v[1 - odd][left], down_v[1 - odd][left], up_h[1 - odd][above], down_h[1 - odd][above])
            after = (up_v[odd][here], down_v[odd][here], up_h[odd][here], down_h[odd][here])
            keep = None
            if end in own:
                keep, seen = (self.kept[seen], zero[(end - low) // 2]), seen + 1
            self.steps.append((slice(sum(map(len, rows)) - cells, sum(map(len, rows))), zero[:cells], spare[:cells], before, after, keep))
        self.rows, self.places = np.concatenate(rows), np.concatenate(places)

    def distances(self, differ: np.ndarray, refs: np.ndarray) -> np.ndarray:
        """Distances of texts (``differ``) to references (letter numbers), as references x texts."""
        each = refs.T[self.rows] * self.n + self.places[:, None]
        self.up[:], self.down[:] = 0, ~np.uint64(0)
        for own, zero, spare, (up_v, down_v, up_h, down_h), (new_up_v, new_down_v, new_up_h, new_down_h), keep in self.steps:
            np.take(differ, each[own], axis=0, out=zero, mode="clip")
            zero &= down_v
            zero &= down_h  # set where the diagonal grows
            np.bitwise_or(up_v, zero, out=new_down_h)
            np.bitwise_and(up_v, zero, out=spare)
            np.bitwise_xor(down_v, spare, out=new_up_h)
            np.bitwise_or(up_h, zero, out=new_down_v)
            np.bitwise_and(up_h, zero, out=spare)
            np.bitwise_xor(down_h, spare, out=new_up_v)
            if keep:
                keep[0][...] = keep[1]
        kind = np.uint8 if self.least + len(self.kept) < 256 else np.uint16
        out = np.full((self.shape[0], 64 * self.shape[1]), self.least, dtype=kind)
        for i, digit in enumerate(_sums(self.kept)):
            out += np.unpackbits(digit.view(np.uint8), axis=1, bitorder="little").astype(kind, copy=False) << kind(i)
        return out


def _nearest_within(texts: list[str], refs: dict[int, np.ndarray], alphabet: np.ndarray, most: int) -> np.ndarray:
    """Distances of texts of one length to the nearest of ``refs``, letter numbers by length: exact up to ``most``, else not too small."""
    n, differ = len(texts[0]), _differ(Letters(texts, alphabet).code, len(alphabet))
    words = differ.shape[1]
    best = np.full(len(texts), np.iinfo(np.int32).max, dtype=np.int32)
    for m in sorted(refs, key=lambda m: abs(n - m)):
        if abs(n - m) > most:
            break
        if not m:
            best = np.minimum(best, n)
            continue
        size, band = max(1, BAND_WORDS // words), None
        for a in range(0, len(refs[m]), size):
            part = refs[m][a : a + size]
            if band is None or len(part) != size:
                band = Band(m, n, most, (len(part), words))
            best = np.minimum(best, band.distances(differ, part).min(axis=0)[: len(texts)])
    return best


def _nearest_of_length(texts: list[str], refs: dict[int, np.ndarray], all_refs: list[str], alphabet: np.ndarray, tile: tuple[int, int]) -> np.ndarray:
    """:func:`nearest` for many texts of one length: most of them within the distances of a few, then those that are farther."""
    most = int(np.quantile(nearest(texts[:PILOT], all_refs, tile), 0.95))
    out = _nearest_within(texts, refs, alphabet, most)
    far = np.flatnonzero(out > most)
    some, reach = [texts[i] for i in far], int(out[far].max(initial=0))
    if len(far) >= PILOT and reach <= len(texts[0]):
        out[far] = _nearest_within(some, refs, alphabet, reach)  # no distance is above what was found
    else:
        out[far] = nearest(some, all_refs, tile)
    return out


def nearest_in_bulk(texts: list[str], refs: list[str], tile: tuple[int, int] = TILE) -> np.ndarray:
    """Levenshtein distance of every text to the nearest of ``refs``, which are sorted by length; equal texts are compared once."""
    place: dict[str, int] = {}
    back = np.array([place.setdefault(t, len(place)) for t in texts], dtype=np.int64)
    own = list(place)
    size = np.array([len(t) for t in own], dtype=np.int64)
    order = np.argsort(size, kind="stable")
    alphabet = alphabet_of(refs)
    lengths = np.array([len(r) for r in refs])
    codes = {m: Letters([refs[i] for i in np.flatnonzero(lengths == m)], alphabet).code for m in np.unique(lengths).tolist()}
    out, rest = np.zeros(len(own), dtype=np.int32), []
    for group in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        n = len(own[group[0]]) if len(group) else 0
        if len(group) < BULK or not 0 < n <= BULK_LETTERS:
            rest += group.tolist()
            continue
        block = max(BULK, min(BLOCK_TEXTS, BLOCK_BITS // (n * max(1, len(alphabet)))))
        for a in range(0, len(group), block):
            some = group[a : a + block]
            out[some] = _nearest_of_length([own[i] for i in some], codes, refs, alphabet, tile)
    out[rest] = nearest([own[i] for i in rest], refs, tile)
    return out[back]
