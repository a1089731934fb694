"""Fill-in-the-middle transformation with cuts at token boundaries.

The boundaries of a text (the places, counted in code points, where a token ends, and 0) form a set of
integers that is kept as a Roaring-style set: the upper bits of a place choose a container, and
a container of 65,536 places is a sorted array, a bitmap or a list of runs, whichever is smallest.
The containers' cumulative cardinalities find the container of the k-th boundary, a select inside the
container its place, so a cut after k tokens is one container search and one local select.
A document is transformed by itself, without any shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoflow.llm.common import table

MARKS = ("<P>", "<S>", "<M>")
SEED = "1"
TRANSFORMED = 90
"""Documents in a hundred that are transformed."""
SUFFIX_FIRST = 20
"""Transformed documents in a hundred whose suffix comes first."""

CHUNK_BITS = 16
ARRAY, BITMAP, RUNS = "array", "bitmap", "runs"


class Container:
    """Places below 2**16 in ascending order, as an array, a bitmap or runs."""

    def __init__(self, low: np.ndarray):
        breaks = np.flatnonzero(np.diff(low.astype(np.int32)) != 1)
        sizes = {ARRAY: 2 * len(low), BITMAP: 1 << (CHUNK_BITS - 3), RUNS: 4 * (len(breaks) + 1)}
        self.kind = min(sizes, key=sizes.get)
        self.cardinality = len(low)
        if self.kind == ARRAY:
            self.places = low.astype(np.uint16)
        elif self.kind == RUNS:
            first = np.concatenate([[0], breaks + 1])
            self.starts = low[first].astype(np.uint16)
            self.before = first.astype(np.uint16)  # members of earlier runs
        else:
            bits = np.zeros(1 << CHUNK_BITS, dtype=np.uint8)
            bits[low] = 1
            self.words = np.packbits(bits, bitorder="little").view(np.uint64)
            self.upto = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)

    def select(self, k: int) -> int:
        """The ``k``-th member, from 0."""
        if self.kind == ARRAY:
            return int(self.places[k])
        if self.kind == RUNS:
            run = int(np.searchsorted(self.before, k, side="right")) - 1
            return int(self.starts[run]) + k - int(self.before[run])
        word = int(np.searchsorted(self.upto, k, side="right"))
        inside = k - (int(self.upto[word - 1]) if word else 0)
        bits = np.unpackbits(self.words[word : word + 1].view(np.uint8), bitorder="little")
        return 64 * word + int(np.flatnonzero(bits)[inside])


class BoundarySet:
    """A set of ascending places with ``select``; its containers are looked up by cumulative cardinality."""

    def __init__(self, places: np.ndarray):
        chunks = places >> CHUNK_BITS
        first = np.flatnonzero(np.diff(chunks, prepend=-1))
        ends = [*first[1:], len(places)]
        self.keys = chunks[first]
        self.containers = [Container(places[a:b] & ((1 << CHUNK_BITS) - 1)) for a, b in zip(first, ends)]
        self.upto = np.cumsum([c.cardinality for c in self.containers])

    def __len__(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def select(self, k: int) -> int:
        """The ``k``-th place in ascending order, from 0."""
        at = int(np.searchsorted(self.upto, k, side="right"))
        inside = k - (int(self.upto[at - 1]) if at else 0)
        return (int(self.keys[at]) << CHUNK_BITS) + self.containers[at].select(inside)


def boundaries(text: str) -> BoundarySet:
    """0 and the end of every token: a run of letters A-Z and a-z, or any other single code point."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = ((codes | 32) - 97) < 26  # unsigned: what is below wraps round
    cut = np.ones(len(codes) + 1, dtype=bool)
    cut[1:-1] = ~(letter[1:] & letter[:-1])
    return BoundarySet(np.flatnonzero(cut))


def _transform(transformed: int, suffix_first: int, marks: tuple[str, str, str]):
    before, after, middle = marks

    def cut(text: str, draws: tuple[int, int, int, int]) -> tuple:
        found = boundaries(text)
        n = len(found) - 1
        if not text or draws[2] % 100 >= transformed or any(m in text for m in marks):
            return n, "plain", None, None, text
        a, b = sorted(found.select(h % (n + 1)) for h in draws[:2])
        head, mid, tail = text[:a], text[a:b], text[b:]
        if draws[3] % 100 < suffix_first:
            return n, "spm", a, b - a, f"{after}{tail}{before}{head}{middle}{mid}"
        return n, "psm", a, b - a, f"{before}{head}{after}{tail}{middle}{mid}"

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def apply(text: pd.Series, h1: pd.Series, h2: pd.Series, h3: pd.Series, h4: pd.Series) -> pd.DataFrame:
        rows = [cut(t, (a, b, c, d)) for t, a, b, c, d in zip(text, h1, h2, h3, h4)]
        frame = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return frame.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return apply


def fill_in_middle(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: str = SEED, transformed: int = TRANSFORMED,
    suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row.

    ``n`` counts tokens.  Both cuts, and whether and how a text is transformed, come from the SHA-256
    of seed and id, so reruns agree.  ``form`` is plain (the text as it is: also an empty or null one and
    one that holds a mark), psm or spm; the lengths of prefix and middle are null if plain.  A
    null id draws like an empty one, repeated rows are transformed alike, an empty table gives an
    empty result, and only the two named columns are read, whatever others are called.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[doc_id].cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    done = _transform(transformed, suffix_first, marks)(F.coalesce(docs[text], F.lit("")), *draws)
    return docs.select(docs[doc_id].alias("doc_id"), done.alias("_done")).select("doc_id", "_done.*")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that :func:`fill_in_middle` had before it, from what it returned.

    A transformed text holds no mark of its own, and no mark can arise across a cut, since "<" only
    begins one; so splitting at the marks gives the parts back.
    """
    parts = F.split(output, "|".join(map(re.escape, marks)), -1)
    # prefix, middle and suffix among the parts, of which the first is empty
    psm, spm = (F.concat(*[F.try_element_at(parts, F.lit(i)) for i in places]) for places in ((2, 4, 3), (3, 4, 2)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256(concat('1:', CAST(doc_id AS VARCHAR))) AS x FROM documents
), h AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, ('0x' || substr(x, 1, 8))::UBIGINT::BIGINT AS h1,
    ('0x' || substr(x, 9, 8))::UBIGINT::BIGINT AS h2, ('0x' || substr(x, 17, 8))::UBIGINT::BIGINT AS h3, ('0x' || substr(x, 25, 8))::UBIGINT::BIGINT AS h4
  FROM d
), c AS (
  SELECT *, CAST(len(w) AS BIGINT) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT doc_id, t, n, form, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf FROM c
)
SELECT doc_id, n, form, CAST(CASE WHEN form <> 'plain' THEN length(pre) END AS BIGINT) AS prefix_chars,
  CAST(CASE WHEN form <> 'plain' THEN length(mid) END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
