"""Removal of long repeated byte strings by hash-compared suffix sorting.

A byte goes when it lies in a string of ``length`` bytes that starts at two places of the corpus.
The work is cut into independent suffix sorts as follows.

* Anchors.  In every string of ``length`` bytes the gram of ``gram`` bytes with the smallest hash,
  the leftmost of equals, is its anchor.  Equal strings have equal anchors at the same place, so
  only strings around equal grams need comparing.  About one position in seventy is an anchor,
  and only hashes of grams and of their contexts (all strings that can hold the gram) travel.
* Anchors whose gram occurs once are dropped.  Anchors with equal contexts repeat as a whole.
* The others are sorted: suffixes that start before or at the gram are put in order by a mergesort
  that runs on all groups of a task at once.  Two suffixes are compared by a binary search for
  their common extension on prefix polynomial hashes, so a comparison takes a logarithmic number
  of steps.  Neighbours that are equal as far as a repeat needs are compared byte by byte before
  they count.  The sorts first tell which ranges of starts can hold a repeat at all and halve
  those, so most of the suffixes need not be sorted.
* A gram with more contexts than a task should sort is taken apart in the same way by joins: its range
  of starts is halved, contexts part by the bytes that all strings of a half share, those alike in
  all that these strings span are settled together, and only groups that are still too large are
  halved again.  At a single start all that is left is equal strings.

Grams and contexts are named by 64-bit hashes; contexts are taken as equal only where both agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoflow.llm.common import discard, materialize, table
from isoflow.llm.hashing import PrefixHash, mix

LENGTH, GRAM = 200, 64
SEGMENT = 4 << 20
"""Bytes of a text that are scanned at a time; longer texts are scanned in overlapping segments."""
CHUNK = 1 << 20
TASK_CONTEXTS = 15000
"""Contexts that one sorting group is meant to hold; it bounds memory and time of a sort."""
SPLIT_CONTEXTS = 5_000
"""Contexts of one gram, or of one half of its starts, that are sorted together; larger groups are halved first."""


def segments(raw: bytes, length: int, size: int = SEGMENT) -> Iterator[tuple[int, int, int, int]]:
    """``(from, to, own_from, own_to)``: bytes to scan and the positions whose anchors are reported."""
    for own in range(0, max(1, len(raw)), size):
        end = min(own + size, len(raw))
        yield max(0, own - 2 * length), min(len(raw), end + 2 * length), own, end


def anchors(parts: list[tuple[bytes, int, int, int]], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``(part, position, gram hash, context hash)`` of the anchors of ``(bytes, offset, own_from, own_to)``."""
    data = np.frombuffer(b"".join(p[0] for p in parts), dtype=np.uint8)
    sizes = np.array([len(p[0]) for p in parts])
    begins = np.cumsum(sizes) - sizes
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    hashes = PrefixHash(data)
    grams = mix(hashes.grams(gram))
    width = length - gram + 1
    value = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
    blocks = -(-len(value) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(value)] = value
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.concatenate([np.arange(b, b + n - length + 1) for b, n in zip(begins, sizes) if n >= length] or [np.zeros(0, np.int64)])
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    least = np.minimum(behind[starts], ahead[starts + width - 1]) & np.uint64((1 << 24) - 1)
    at = least.astype(np.int64)
    at = at[np.diff(at, prepend=-1) != 0]
    part = np.searchsorted(begins, at, side="right") - 1
    lo, hi = np.maximum(at - (length - gram), begins[part]), np.minimum(at + length, begins[part] + sizes[part])
    context = mix(hashes.of(lo, hi) ^ mix(((at - lo) * 4096 + (hi - lo)).astype(np.uint64)))
    offset, own_from, own_to = (np.array([p[k] for p in parts])[part] for k in (1, 2, 3))
    position = at - begins[part] + offset
    own = (position >= own_from) & (position < own_to)
    return part[own], position[own], grams[at[own]].view(np.int64), context[own].view(np.int64)


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(keys, parts):
            part, position, grams, contexts = anchors(parts, length, gram)
            row, row2 = (np.array([key[k] for key in keys], dtype=kind)[part] for k, kind in ((0, np.int64), (1, np.int32)))
            return pd.DataFrame({"gram": grams, "context": contexts, "row": row, "row2": row2, "pos": position.astype(np.int32)})

        for batch in batches:
            keys, parts, size = [], [], 0
            for *row, text in zip(batch["row"].tolist(), batch["row2"].tolist(), batch["text"].tolist()):
                raw = text.encode("utf-8", "surrogatepass")
                for a, b, own_from, own_to in segments(raw, length):
                    keys.append(row)
                    parts.append((raw[a:b], a, own_from, own_to))
                    size += b - a
                    if size >= CHUNK:
                        yield flush(keys, parts)
                        keys, parts, size = [], [], 0
            if parts:
                yield flush(keys, parts)

    return run


class SuffixOrder:
    """Comparison of suffixes of one buffer, each cut to a length, by common extension."""

    def __init__(self, data: np.ndarray):
        self.data, self.hash = data, PrefixHash(data)

    def extension(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Length of the common extension, ``limit`` at most: a binary search on prefix hashes."""
        low, high = np.zeros(len(a), np.int64), limit.astype(np.int64)
        whole = self.hash.of(a, a + limit) == self.hash.of(b, b + limit)
        low = np.where(whole, limit, low)
        open_ = np.flatnonzero(~whole)
        x, y, lo, hi = a[open_], b[open_], low[open_], high[open_] - 1
        while len(lo) and (lo < hi).any():
            middle = (lo + hi + 1) >> 1
            same = self.hash.of(x, x + middle) == self.hash.of(y, y + middle)
            lo, hi = np.where(same, middle, lo), np.where(same, hi, middle - 1)
        low[open_] = lo
        return low

    def less(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        e = self.extension(a, b, limit)
        step = np.minimum(e, limit - 1)
        return np.where(e >= limit, or_equal, self.data[a + step] < self.data[b + step])

    def same_bytes(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray, part: int = 20_000) -> np.ndarray:
        """Verification: whether the strings are equal byte by byte."""
        out = np.zeros(len(a), dtype=bool)
        for n in np.unique(limit):
            view = np.lib.stride_tricks.sliding_window_view(self.data, n)
            at = np.flatnonzero(limit == n)
            for k in range(0, len(at), part):
                one = at[k : k + part]
                out[one] = (view[a[one]] == view[b[one]]).all(axis=1)
        return out

    def mergesort(self, suffixes: np.ndarray, limit: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """The order that sorts ``suffixes`` within each of the adjacent ``groups``, bottom up.

        All suffixes of a group have one limit.  In every round each element finds its rank in the
        neighbouring run by binary search.
        """
        n = len(suffixes)
        order = np.arange(n)
        if not n:
            return order
        first = np.flatnonzero(np.diff(groups, prepend=groups[0] - 1) != 0)
        size = np.diff(np.append(first, n))
        start, end = np.repeat(first, size), np.repeat(first + size, size)
        place = np.arange(n)
        run = 1
        while run < size.max():
            number = (place - start) // run
            left = number % 2 == 0
            mine = start + number * run
            other_from = np.where(left, mine + run, mine - run)
            other_to = np.minimum(np.where(left, mine + 2 * run, mine), end)
            at = np.flatnonzero(other_from < other_to)
            low, high = other_from[at].copy(), other_to[at].copy()
            mark, most, on_left = suffixes[order[at]], limit[order[at]], left[at]
            while True:
                active = np.flatnonzero(low < high)
                if not len(active):
                    break
                middle = (low[active] + high[active]) >> 1
                ahead = self.less(suffixes[order[middle]], mark[active], most[active], ~on_left[active])
                low[active] = np.where(ahead, middle + 1, low[active])
                high[active] = np.where(ahead, high[active], middle)
            target = place.copy()
            target[at] = np.where(on_left, at, at - run) + (low - other_from[at])
            moved = np.empty(n, dtype=order.dtype)
            moved[target] = order
            order = moved
            run *= 2
        return order

    def classes(self, suffixes: np.ndarray, limit: np.ndarray, groups: np.ndarray, verify: bool) -> np.ndarray:
        """A number for each suffix, the same for equal suffixes of a group: neighbours in sorted order are compared.

        Suffixes whose hash no other of the group has are numbered first and not sorted.
        """
        n = len(suffixes)
        out = np.arange(n)
        key = mix(self.hash.of(suffixes, suffixes + limit) ^ mix(groups.astype(np.uint64)))
        _, which, counts = np.unique(key, return_inverse=True, return_counts=True)
        left = np.flatnonzero(counts[which] > 1)
        if not len(left):
            return out
        left = left[np.argsort(groups[left], kind="stable")]
        order = left[self.mergesort(suffixes[left], limit[left], groups[left])]
        a, b = order[:-1], order[1:]
        near = np.flatnonzero(groups[a] == groups[b])
        a, b = a[near], b[near]
        equal = self.extension(suffixes[a], suffixes[b], limit[a]) >= limit[a]
        if verify:
            equal[equal] = self.same_bytes(suffixes[a[equal]], suffixes[b[equal]], limit[a[equal]])
        new = np.ones(len(order), dtype=np.int64)
        new[near[equal] + 1] = 0
        out[order] = n + np.cumsum(new)
        return np.unique(out, return_inverse=True)[1]


def repeated_extents(
    groups: np.ndarray, lefts: np.ndarray, contexts: list[bytes], wanted: np.ndarray, starts: tuple[np.ndarray, np.ndarray],
    length: int = LENGTH,
) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted context, the smallest and largest number of bytes before its gram at which a
    string starts that another context of its group holds at the same place (-1 and -1 if none does).
    ``starts`` are the smallest and largest numbers to look at.

    Strings that start ``lo`` to ``hi`` bytes before the gram share a core, from ``lo`` bytes before
    it on; contexts whose core is like no other's have no such string.  Contexts that also agree in
    all that these strings span share them all.  What is left undecided is halved.
    """
    n = len(contexts)
    sizes = np.array([len(c) for c in contexts])
    begins = np.cumsum(sizes) - sizes
    order = SuffixOrder(np.frombuffer(b"".join(contexts), dtype=np.uint8))
    at, rights = begins + lefts, sizes - lefts
    lowest, highest = np.full(n, length + 1), np.full(n, -1)
    one = np.arange(n)
    group = np.unique(groups, return_inverse=True)[1].astype(np.int64)
    lo, hi = starts
    asks = wanted.copy()

    def crowd(group, asks):
        """Members of groups of at least two of which one still asks."""
        counts, asking = np.bincount(group), np.bincount(group, weights=asks) > 0
        return np.flatnonzero((counts[group] > 1) & asking[group])

    first = True
    while len(one):
        fits = np.flatnonzero((lefts[one] >= lo) & (rights[one] >= length - hi))
        one, group, lo, hi, asks = (x[fits] for x in (one, group, lo, hi, asks))
        if not len(one):
            break
        if not first:
            group = order.classes(at[one] - lo, length - (hi - lo), group, False)
        else:
            group = np.unique(group, return_inverse=True)[1]
        first = False
        keep = crowd(group, asks)
        one, group, lo, hi, asks = (x[keep] for x in (one, group, lo, hi, asks))
        spans = np.flatnonzero((lefts[one] >= hi) & (rights[one] >= length - lo))
        if len(spans):
            same = order.classes(at[one[spans]] - hi[spans], length + hi[spans] - lo[spans], group[spans], True)
            shared = spans[np.bincount(same)[same] > 1]
            np.minimum.at(lowest, one[shared], lo[shared])
            np.maximum.at(highest, one[shared], hi[shared])
        asks = asks & ~((lowest[one] <= lo) & (highest[one] >= hi)) & (lo < hi)
        keep = crowd(group, asks) if len(one) else one
        one, group, lo, hi, asks = (x[keep] for x in (one, group, lo, hi, asks))
        middle = (lo + hi) // 2
        one, asks = np.concatenate([one, one]), np.concatenate([asks, asks])
        group = np.concatenate([2 * group, 2 * group + 1])
        lo, hi = np.concatenate([lo, middle + 1]), np.concatenate([middle, hi])
        asks = asks & ~((lowest[one] <= lo) & (highest[one] >= hi))
    return np.where(highest < 0, -1, lowest), highest


_CONTEXT = "gram long, n long, row long, row2 int, pos int, left int, bytes binary"


def _cut_contexts(length: int, gram: int):
    columns = [c.split()[0] for c in _CONTEXT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, row2, text, wanted in zip(batch["row"].tolist(), batch["row2"].tolist(), batch["text"].tolist(), batch["wanted"]):
                raw = text.encode("utf-8", "surrogatepass")
                for w in wanted:
                    p = w["pos"]
                    lo = max(0, p - (length - gram))
                    out.append((w["gram"], w["n"], row, row2, p, p - lo, raw[lo : p + length]))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=columns)

    return run


def _sort_group(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        group = pdf.groupby(["gram", "lo", "hi", "core"], sort=False).ngroup().to_numpy()
        single, pos = pdf["n"].to_numpy() == 1, pdf["pos"].to_numpy(np.int64)
        starts = pdf["lo"].to_numpy(np.int64), pdf["hi"].to_numpy(np.int64)
        low, high = repeated_extents(group, pdf["left"].to_numpy(np.int64), pdf["bytes"].tolist(), single, starts, length)
        keep = (high >= 0) & single
        return pd.DataFrame({"row": pdf["row"].to_numpy(np.int64)[keep], "row2": pdf["row2"].to_numpy(np.int32)[keep], "start": (pos - high)[keep], "end": (pos - low + length)[keep]})

    return run


def _halved(large: DataFrame, length: int) -> DataFrame:
    """The rows of ``large`` at each half of their range ``lo`` to ``hi``, with the bytes ``core`` that the strings starting
    there share and, where a context holds them all, the bytes ``whole`` that these strings span."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    parts = F.when(F.col("lo") == F.col("hi"), F.array(F.struct("lo", "hi"))).otherwise(F.array(F.struct("lo", middle.alias("hi")), F.struct((middle + 1).alias("lo"), "hi")))
    rows = large.withColumn("part", F.explode(parts)).withColumns({"lo": F.col("part.lo"), "hi": F.col("part.hi")}).drop("part", "core")
    right = F.length("bytes") - F.col("left")
    rows = rows.where((F.col("left") >= F.col("lo")) & (right >= length - F.col("hi")))
    spans = (F.col("left") >= F.col("hi")) & (right >= length - F.col("lo"))
    return rows.withColumns({
        "core": F.substring("bytes", F.col("left") - F.col("lo") + 1, length - F.col("hi") + F.col("lo")),
        "whole": F.when(spans, F.substring("bytes", F.col("left") - F.col("hi") + 1, length + F.col("hi") - F.col("lo"))),
    })


def _apart(large: DataFrame, length: int, split: int) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """Spans found while groups of contexts are halved until they are small, these small groups, and the tables behind both."""
    key = ["gram", "lo", "hi", "core"]
    spans, small, tables = [], [], []
    place = F.struct("row", "row2", "pos")
    while not large.isEmpty():
        rows = materialize(_halved(large, length), "halves")
        alike = rows.where("whole is not null").groupBy("gram", "lo", "hi", "whole").agg(F.count(F.lit(1)).alias("same"), F.min(place).alias("first")).where("same > 1")
        alike = materialize(alike, "alike")
        marked = rows.join(alike, ["gram", "lo", "hi", "whole"], "left")
        settled = marked.where("same is not null")
        spans.append(materialize(settled.where("n = 1").select("row", "row2", (F.col("pos") - F.col("hi")).alias("start"), (F.col("pos") - F.col("lo") + length).alias("end")), "spans"))
        columns = [*key, "n", "row", "row2", "pos", "left", "bytes"]
        rest = marked.where("same is null").select(*columns).unionByName(settled.where(place == F.col("first")).withColumn("n", F.lit(2).cast("long")).select(*columns))
        rest = materialize(rest, "rest")
        sizes = rest.groupBy(*key).agg(F.count(F.lit(1)).alias("g"), F.min("n").alias("n1")).where("g > 1 and n1 = 1")
        sized = materialize(rest.join(sizes.drop("n1"), key), "sized")
        for old in (rows, alike, rest):
            discard(old)
        small.append(sized.where(F.col("g") <= split).drop("g"))
        large = sized.where(F.col("g") > split).drop("g")
        tables.append(sized)
    return spans, small, tables


def _cut_out(kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for one, text, spans in zip(batch["doc_id"], batch["text"].tolist(), batch["spans"]):
                raw = text.encode("utf-8", "surrogatepass")
                kept, removed, runs, done = [], 0, [], 0
                if spans is not None:
                    for s, e in sorted((x["start"], min(x["end"], len(raw))) for x in spans):
                        if runs and s <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], e)
                        else:
                            runs.append([s, e])
                for s, e in runs:
                    kept.append(raw[done:s])
                    removed += e - s
                    done = e
                kept.append(raw[done:])
                rest = b"".join(kept)
                out.append((one, rest, len(raw), removed, len(runs), hashlib.sha256(rest).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, split: int = SPLIT_CONTEXTS) -> DataFrame:
    """``row, row2, start, end``: byte spans of ``rows (row long, row2 int, text)`` made of repeated strings; they may overlap.

    Rows with the same key must be equal rows.
    """
    mine = ["row", "row2"]
    found = rows.where(F.octet_length("text") >= length).select(*mine, "text").mapInPandas(_anchor_rows(length, gram), "gram long, context long, row long, row2 int, pos int")
    found = materialize(found, "anchors")
    shared = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("c0"), F.max("context").alias("c1")).where("n > 1")
    shared = materialize(shared.select("gram", (F.col("c0") == F.col("c1")).alias("single")), "grams")
    repeats = materialize(found.join(shared, "gram"), "repeats")
    discard(found)
    several = repeats.where("not single")
    classes = several.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*mine, "pos")).alias("first"))
    classes = materialize(classes.select("gram", "context", "n", "first.*"), "classes")
    whole = repeats.where("single").select(*mine, "pos").unionByName(several.join(classes.where("n > 1").select("gram", "context"), ["gram", "context"]).select(*mine, "pos"))
    spans = whole.select(*mine, F.greatest(F.col("pos") - (length - gram), F.lit(0)).alias("start"), (F.col("pos") + length).alias("end")).distinct()

    wanted = classes.groupBy(*mine).agg(F.collect_list(F.struct("gram", "n", "pos")).alias("wanted"))  # the anchors of one text
    once = rows.groupBy(*mine).agg(F.first("text").alias("text"))  # equal rows combine before they are shuffled
    contexts = once.join(wanted, mine).mapInPandas(_cut_contexts(length, gram), _CONTEXT)
    contexts = materialize(contexts.withColumns({"lo": F.lit(0), "hi": F.lit(length - gram), "core": F.lit(b"")}), "contexts")
    large = materialize(classes.groupBy("gram").count().where(F.col("count") > split).select("gram"), "large_grams")
    usual, tables = contexts, []
    if not large.isEmpty():
        hint = F.broadcast if large.count() <= 100_000 else (lambda df: df)
        settled, small, tables = _apart(contexts.join(hint(large), "gram", "left_semi"), length, split)
        usual = contexts.join(hint(large), "gram", "left_anti")
        for part in settled:
            spans = spans.unionByName(part)
        for part in small:
            usual = usual.unionByName(part)
    n_groups = max(1, -(-classes.count() // TASK_CONTEXTS))
    bucket = F.pmod(F.xxhash64("gram", "lo", "hi", "core"), F.lit(n_groups))
    sorted_spans = usual.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(_sort_group(length), "row long, row2 int, start long, end long")
    done = materialize(spans.unionByName(sorted_spans), "spans")
    for old in (shared, repeats, classes, contexts, large, *tables):
        discard(old)
    return done


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text: str = "text", doc_id: str = "doc_id",
    split: int = SPLIT_CONTEXTS,
) -> DataFrame:
    """``doc_id, kept (binary), n_bytes, n_removed, n_spans, kept_sha256`` for every input row.

    A null text is empty.  Rows repeated with the same id repeat each other like any others.
    Texts shorter than ``length`` bytes are kept whole.  An empty table gives an empty result.
    Only the two named columns are read.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    id_text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), own.alias("text"), F.xxhash64(id_text, own).alias("row"), F.hash(own, id_text).alias("row2"))  # 96 bits
    spans = repeated_spans(rows, length, gram, split).distinct().groupBy("row", "row2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    run, schema = _cut_out(docs.schema[doc_id].dataType.simpleString())
    return rows.join(spans, ["row", "row2"], "left").select("doc_id", "text", "spans").mapInPandas(run, schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
