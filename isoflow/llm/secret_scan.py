"""Secrets in texts: three patterns, and strings that look random by a battery of tests.

A candidate is a maximal run of 16 or more letters, digits and ``+ / - _`` that no pattern match covers.  Its
encoding is the smallest alphabet that holds all its symbols.  Three statistics of its symbols, in the
order of that alphabet, are held against two models:

* the sum of squared symbol counts (chi-squared uniformity),
* changes between the lower and the upper half of the alphabet (runs),
* products of neighbouring symbols (serial correlation).

Under randomness all three have known moments; a candidate that any test rejects is no secret.
Under ordinary writing their moments follow from how often each symbol follows each other one in
the whole corpus.  How far a candidate lies from ordinary writing is its p-value, and it takes
length to be far.  False discoveries are controlled within bands of lengths by Benjamini and
Hochberg's rule over all candidates of the corpus, from counts of p-values in buckets (rounded up).
What reaches the driver is the table of symbol pairs and one threshold a band, whatever the input.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isoflow.llm.common import materialize, table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX, LEAST_RUN = 12, 18, 16, 16

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "".join(sorted(DIGITS + LOWER + UPPER + "+/-_"))
ENCODINGS = {
    "decimal": DIGITS, "hex": DIGITS + "abcdef", "upper hex": DIGITS + "ABCDEF", "lower": LOWER, "upper": UPPER, "base32": "234567" + UPPER,
    "lower 36": DIGITS + LOWER, "upper 36": DIGITS + UPPER, "letters": UPPER + LOWER, "base62": DIGITS + UPPER + LOWER,
    "base64": "+/" + DIGITS + UPPER + LOWER, "base64url": "-_" + DIGITS + UPPER + LOWER,
}
"""Alphabets from small to large, in the order of ASCII.  Numbers are never called secrets: ordinary ones are as even."""
BANDS = (16, 24, 32, 48, 96)
"""Shortest lengths of the bands in which false discoveries are controlled."""
DISCOVERY, REJECTION, DISPERSION = 0.01, 0.001, 1.5
"""Share of false discoveries, level of the battery, and how much wider ordinary writing scatters than independent symbols."""
STEPS, LAST = 10, 300
"""Buckets of p-values to a power of ten, and the last bucket."""
GROUP = 1 << 22
"""Characters that are looked at together; a longer text is a group of its own."""

_NONE = len(SYMBOLS)
_SYMBOL = np.full(129, _NONE, dtype=np.uint8)
_SYMBOL[[ord(c) for c in SYMBOLS]] = np.arange(_NONE)
_HEX = np.zeros(129, dtype=bool)
_HEX[[ord(c) for c in DIGITS + "abcdef"]] = True
_SIZES = np.array([len(a) for a in ENCODINGS.values()])
_CODE = np.zeros((len(ENCODINGS), _NONE), dtype=np.int64)
_HOLDS = np.zeros(_NONE, dtype=np.int64)
for _e, _alphabet in enumerate(ENCODINGS.values()):
    for _i, _c in enumerate(sorted(_alphabet)):
        _CODE[_e, SYMBOLS.index(_c)] = _i
        _HOLDS[SYMBOLS.index(_c)] |= 1 << _e


def _groups(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Neighbouring texts, by first and last index, and their code points (128 for all others), each text closed by one more."""
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= GROUP or i + 1 == len(texts):
            codes = np.frombuffer(("\n".join(texts[first : i + 1]) + "\n").encode("utf-32-le", "surrogatepass"), dtype="<u4")
            yield first, i + 1, np.minimum(codes, 128).astype(np.uint8)
            first, size = i + 1, 0


def _runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true that are long enough; the last entry is false."""
    edges = np.flatnonzero(np.diff(mask.view(np.int8), prepend=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def symbol_pairs(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each symbol follows each other one, over all texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((_NONE + 1) ** 2, dtype=np.int64)
        for batch in batches:
            for _, _, codes in _groups(batch["text"].tolist()):
                symbols = _SYMBOL[codes].astype(np.int32)
                total += np.bincount(symbols[:-1] * (_NONE + 1) + symbols[1:], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"pair": seen, "n": total[seen]})

    pairs = docs.select(F.coalesce(docs[text], F.lit("")).alias("text")).mapInPandas(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    table = np.zeros((_NONE + 1) ** 2)
    for row in pairs.collect():  # at most 67 * 67 rows
        table[row["pair"]] = row["n"]
    return table.reshape(_NONE + 1, _NONE + 1)[:_NONE, :_NONE]


class Ordinary:
    """Moments of the three statistics in ordinary writing, for each encoding."""

    def __init__(self, pairs: np.ndarray):
        self.squares, self.cubes, self.change, self.product, self.spread = (np.zeros(len(ENCODINGS)) for _ in range(5))
        for e, alphabet in enumerate(ENCODINGS.values()):
            at = [SYMBOLS.index(c) for c in sorted(alphabet)]
            own = pairs[np.ix_(at, at)] + 1 / len(at)  # as if each symbol had followed once
            own = own / own.sum()
            q = (own.sum(axis=0) + own.sum(axis=1)) / 2
            u = _standard(np.arange(len(at)), len(at))
            side = np.arange(len(at)) * 2 >= len(at)
            products = np.outer(u, u)
            self.squares[e], self.cubes[e] = (q**2).sum(), (q**3).sum()
            self.change[e] = own[side[:, None] != side[None, :]].sum()
            self.product[e] = (own * products).sum()
            self.spread[e] = (own * products**2).sum() - self.product[e] ** 2


def _standard(code, size):
    """Codes of mean 0 and variance 1 under randomness."""
    return (code - (size - 1) / 2) / np.sqrt((size * size - 1) / 12)


def battery(symbols: np.ndarray, starts: np.ndarray, model: Ordinary) -> tuple[np.ndarray, np.ndarray]:
    """Encoding (-1: none) and bucket of each candidate, from the symbols of all, one after another.

    The bucket is that of the p-value against ordinary writing, 0 for what the battery rejects as random.
    """
    n = np.diff(np.append(starts, len(symbols)))
    held = np.bitwise_and.reduceat(_HOLDS[symbols], starts)
    encoding = np.where(held > 0, np.log2(np.maximum(held & -held, 1)).astype(np.int64), -1)
    e = np.maximum(encoding, 0)
    size, owner = _SIZES[e], np.repeat(np.arange(len(n)), n)
    code = _CODE[e[owner], symbols]
    counts = np.bincount(owner * 64 + code, minlength=64 * len(n)).reshape(-1, 64)
    inside = owner[1:] == owner[:-1]
    of = owner[1:][inside]
    upper = code * 2 >= size[owner]
    u = _standard(code, size[owner])
    changes = np.bincount(of, (upper[1:] != upper[:-1])[inside], minlength=len(n))
    products = np.bincount(of, (u[1:] * u[:-1])[inside], minlength=len(n))
    squares, steps = (counts.astype(np.float64) ** 2).sum(axis=1), n - 1.0

    # against randomness: chi-squared by Wilson and Hilferty's root, two-sided runs and serial correlation
    freedom = size - 1.0
    chi = (np.cbrt((size / n * squares - n) / freedom) - (1 - 2 / (9 * freedom))) / np.sqrt(2 / (9 * freedom))
    worst = np.maximum(chi, np.maximum(np.abs(changes - steps / 2) / np.sqrt(steps / 4), np.abs(products) / np.sqrt(steps)))
    sides = np.where(worst == chi, 1, 2)
    random = 3 * sides * _tail(worst) >= REJECTION

    # against ordinary writing, towards randomness
    pairs, m2, m3 = n * steps / 2, model.squares[e], model.cubes[e]
    spread = np.sqrt(pairs * (m2 - m2**2) + n * steps * (n - 2.0) * np.maximum(m3 - m2**2, 0))
    equal = (pairs * m2 - (squares - n) / 2) / np.maximum(spread, 1e-9)
    root = lambda share: np.arcsin(np.sqrt(share))
    change = model.change[e]
    apart = 2 * np.sqrt(steps) * (root((changes + 3 / 8) / (steps + 3 / 4)) - root(change)) * np.where(change < 0.5, 1, -1)
    serial = (model.product[e] * steps - products) / np.sqrt(np.maximum(steps * model.spread[e], 1e-9)) * np.where(model.product[e] >= 0, 1, -1)
    p = _tail((equal + apart + serial) / 3 / DISPERSION)
    bucket = np.minimum(np.floor(-np.log10(np.maximum(p, 1e-300)) * STEPS), LAST).astype(np.int64)
    return np.where(encoding == list(ENCODINGS).index("decimal"), -1, encoding), np.where(random, bucket, 0)


def _tail(z: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(v / math.sqrt(2)) / 2 for v in z])


_FOUND = "base array<struct<start:int,kind:int,stop:int>>, tested array<struct<start:int,stop:int,band:int,bucket:int>>"


def _scan(model: Ordinary):
    def patterns(text: str) -> list[tuple[int, int, int]]:
        spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
        if "AKIA" in text:
            spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
        return spans

    @F.pandas_udf(f"struct<{_FOUND.replace('base ', 'base:').replace('tested ', 'tested:')}>")
    def scan(column: pd.Series) -> pd.DataFrame:
        texts = column.tolist()
        base = [patterns(t) for t in texts]
        tested: list[list] = [[] for _ in texts]
        for first, last, codes in _groups(texts):
            begins = np.cumsum([0, *(len(t) + 1 for t in texts[first:last])])
            doc_of = lambda at: np.searchsorted(begins, at, side="right") - 1  # noqa: B023, E731
            starts, ends = _runs(_HEX[codes], LEAST_HEX)
            for d, a, b in zip(doc_of(starts).tolist(), starts.tolist(), ends.tolist()):
                base[first + d].append((a - int(begins[d]), 2, b - int(begins[d])))
            for d in range(first, last):
                base[d].sort()
            symbols = _SYMBOL[codes]
            starts, ends = _runs(symbols < _NONE, LEAST_RUN)
            docs = doc_of(starts)
            covers = {}
            open_ = []
            for d, a, b in zip(docs.tolist(), starts.tolist(), ends.tolist()):
                if d not in covers:
                    spans = base[first + d]
                    covers[d] = ([s[0] for s in spans], list(accumulate((s[2] for s in spans), max)))
                at = bisect_right(covers[d][0], a - int(begins[d])) - 1
                open_.append(at < 0 or covers[d][1][at] < b - int(begins[d]))
            open_ = np.array(open_, dtype=bool)
            starts, ends, docs = starts[open_], ends[open_], docs[open_]
            if not len(starts):
                continue
            n = ends - starts
            at = np.cumsum(n) - n
            places = np.arange(n.sum()) + np.repeat(starts - at, n)
            encoding, bucket = battery(symbols[places], at, model)
            padded = (codes[ends] == 61).astype(int)
            padded += padded * (codes[np.minimum(ends + 1, len(codes) - 1)] == 61)
            band = np.searchsorted(BANDS, n, side="right") - 1
            for d, a, b, e, c, k in zip(docs.tolist(), starts.tolist(), (ends + padded).tolist(), encoding.tolist(), bucket.tolist(), band.tolist()):
                if e >= 0:
                    tested[first + d].append((a - int(begins[d]), b - int(begins[d]), k, c))
        return pd.DataFrame({"base": base, "tested": tested})

    return scan


def thresholds(tested: DataFrame, discovery: float = DISCOVERY) -> dict[int, int]:
    """The smallest bucket of each band that is a discovery, from rows ``band, bucket``; bands without any are absent.

    Counts by bucket come first, so the windows see at most a few hundred rows of a band.
    """
    counts = tested.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("band")
    reached = F.sum("n").over(whole.orderBy(F.desc("bucket")))
    p = F.pow(F.lit(10.0), -F.col("bucket") / STEPS)
    found = counts.withColumns({"reached": reached, "all": F.sum("n").over(whole)}).where((F.col("bucket") > 0) & (p * F.col("all") <= discovery * F.col("reached")))
    return {r["band"]: r["cut"] for r in found.groupBy("band").agg(F.min("bucket").alias("cut")).collect()}


def scan_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", discovery: float = DISCOVERY) -> DataFrame:
    """``doc_id, spans``: for every row an array of ``(start, kind, stop)`` in order, code points, ends exclusive.

    ``kind`` counts in ``KINDS``: assignments, access keys and hexadecimal runs by pattern, random strings by
    the battery.  A random string has padding of up to two ``=`` in its span.  A null or empty text has no
    spans, repeated rows have the same ones each (and count as often in the statistics), and null
    ids stay null.  An empty table gives an empty result.  Only the two named columns are read.
    """
    model = Ordinary(symbol_pairs(docs, text))
    found = docs.select(docs[doc_id].alias("doc_id"), _scan(model)(F.coalesce(docs[text], F.lit(""))).alias("found")).select("doc_id", "found.*")
    found = materialize(found, "secrets")
    cuts = thresholds(found.select(F.explode("tested").alias("t")).select("t.band", "t.bucket"), discovery)
    random = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    if cuts:
        cut = lambda t: F.coalesce(*[F.when(t["band"] == band, F.lit(low)) for band, low in cuts.items()], F.lit(LAST + 1))
        kept = F.filter("tested", lambda t: t["bucket"] >= cut(t))
        random = F.transform(kept, lambda t: F.struct(t["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), t["stop"].alias("stop")))
    return found.select("doc_id", F.array_sort(F.concat("base", random)).alias("spans"))


def spelled(spans: Column) -> Column:
    """Spans as ``kind:start:stop``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(spelled(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"),
    )
