"""Exact deduplication with counting quotient filters and byte verification.

Every input partition builds a counting quotient filter of its 64-bit text fingerprints: the
high bits of a fingerprint (its quotient) are kept as a count per quotient, the low bits (the
remainder) as sorted runs, each with a counter.  Filters are cut at segment borders of the
quotient space, and the pieces of one segment are merged losslessly by their sorted remainders.
A fingerprint is thereby one entry per partition however often it occurs, so hot groups of copies
are pre-aggregated before anything is shuffled.  Fingerprints with a count above one route their
rows, and only those, to a grouping by the whole normalised text, which compares bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoflow.llm.common import discard, materialize, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEGMENT_ENTRIES = 500_000
"""Fingerprints that one merged filter segment is meant to hold; it bounds a merge task."""
QUOTIENT_BITS = 16
"""Quotient bits inside a segment."""
BROADCAST_ROWS = 250_000
"""Repeated fingerprints up to which the routing join is broadcast; beyond, it is a shuffle join."""

_PIECE = "segment long, quotients binary, counts binary, remainders binary, counters binary"


def build_filter(fingerprints: np.ndarray, counters: np.ndarray, low_bits: int) -> tuple[np.ndarray, ...]:
    """A counting quotient filter of uint64 fingerprints below 2**(QUOTIENT_BITS + low_bits).

    Returns occupied quotients, run lengths, the runs' sorted remainders and their counters.
    """
    keys, inverse = np.unique(fingerprints, return_inverse=True)
    totals = np.zeros(len(keys), dtype=np.int64)
    np.add.at(totals, inverse, counters)
    quotients, runs = np.unique(keys >> np.uint64(low_bits), return_counts=True)
    remainders = keys & np.uint64((1 << low_bits) - 1)
    return quotients.astype(np.uint32), runs.astype(np.uint32), remainders, totals


def expand_filter(quotients: np.ndarray, runs: np.ndarray, remainders: np.ndarray, low_bits: int) -> np.ndarray:
    """The fingerprints a filter stands for: nothing is lost, quotient and remainder are the whole."""
    return (np.repeat(quotients.astype(np.uint64), runs) << np.uint64(low_bits)) | remainders


def merge_filters(filters: list[tuple[np.ndarray, ...]], low_bits: int) -> tuple[np.ndarray, ...]:
    """Merge filters of one segment: equal remainders of a quotient add their counters."""
    keys = np.concatenate([expand_filter(q, n, r, low_bits) for q, n, r, _ in filters])
    counters = np.concatenate([c for *_, c in filters])
    return build_filter(keys, counters, low_bits)


def _partition_filters(segment_bits: int):
    low_bits = 64 - segment_bits - QUOTIENT_BITS

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counters = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        pending: list[np.ndarray] = []

        def fold(keys, counters, pending):
            new = np.concatenate(pending)
            joined = np.concatenate([keys, new])
            weights = np.concatenate([counters, np.ones(len(new), dtype=np.int64)])
            keys, inverse = np.unique(joined, return_inverse=True)
            totals = np.zeros(len(keys), dtype=np.int64)
            np.add.at(totals, inverse, weights)
            return keys, totals

        for batch in batches:
            pending.append(batch["fp"].to_numpy(dtype=np.int64).view(np.uint64))
            if sum(map(len, pending)) > 1_000_000:
                keys, counters = fold(keys, counters, pending)
                pending = []
        if pending:
            keys, counters = fold(keys, counters, pending)
        if not len(keys):
            return
        shift = np.uint64(64 - segment_bits)
        segments = keys >> shift if segment_bits else np.zeros(len(keys), dtype=np.uint64)
        inside = keys & np.uint64((1 << (64 - segment_bits)) - 1)
        borders = np.flatnonzero(np.diff(segments, prepend=segments[0] + np.uint64(1)))
        for a, b in zip(borders, [*borders[1:], len(keys)]):
            q, n, r, c = build_filter(inside[a:b], counters[a:b], low_bits)
            yield pd.DataFrame({"segment": [int(segments[a])], "quotients": [q.tobytes()], "counts": [n.tobytes()], "remainders": [r.tobytes()], "counters": [c.tobytes()]})

    return build


def _merge_segment(segment_bits: int):
    low_bits = 64 - segment_bits - QUOTIENT_BITS

    def merge(pieces: pd.DataFrame) -> pd.DataFrame:
        filters = [
            (
                np.frombuffer(p.quotients, np.uint32), np.frombuffer(p.counts, np.uint32), np.frombuffer(p.remainders, np.uint64),
                np.frombuffer(p.counters, np.int64),
            )
            for p in pieces.itertuples()
        ]
        q, n, r, c = merge_filters(filters, low_bits)
        keys = expand_filter(q, n, r, low_bits)[c > 1]
        if segment_bits:
            keys = keys | (np.uint64(int(pieces["segment"].iloc[0])) << np.uint64(64 - segment_bits))
        return pd.DataFrame({"fp": keys.view(np.int64), "copies": c[c > 1]})

    return merge


def repeated_fingerprints(fingerprints: DataFrame, n_rows: int, segment_entries: int = SEGMENT_ENTRIES) -> DataFrame:
    """``(fp, copies)`` of the fingerprints that occur more than once in column ``fp``."""
    segment_bits = min(32, max(3, int(np.ceil(np.log2(max(1, n_rows / segment_entries))))))
    pieces = fingerprints.select("fp").mapInPandas(_partition_filters(segment_bits), _PIECE)
    return pieces.groupBy("segment").applyInPandas(_merge_segment(segment_bits), "fp long, copies long")


def normalise(text):
    """Null counts as empty; only A-Z are lower-cased."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def copy_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``text_sha256, keep_id, group_size`` of the groups of equal texts, and whether they may be broadcast."""
    base = docs.select(F.col(doc_id).alias("doc_id"), normalise(F.col(text)).alias("norm"))
    base = base.withColumn("fp", F.xxhash64("norm"))
    n_rows = docs.count()
    repeated = materialize(repeated_fingerprints(base, n_rows), "repeated")
    small = repeated.count() <= broadcast_rows
    route = F.broadcast(repeated.select("fp")) if small else repeated.select("fp")
    groups = (
        base.join(route, "fp", "left_semi")
        .groupBy("fp", "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    groups = materialize(groups, "groups")
    discard(repeated)
    return groups, small


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z.  Of equal texts the row with the
    largest ``doc_id`` stays; null ids rank below all others.  Rows repeated with the same id
    are counted one by one in ``group_size`` and all carry ``kept = true`` if that id stays.
    A null text equals an empty one.  An empty table gives an empty result.
    Only the two named columns are read; any others, whatever their names, play no part.
    """
    groups, small = copy_groups(docs, text, doc_id, broadcast_rows)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(normalise(F.col(text)), 256).alias("text_sha256"))
    return rows.join(F.broadcast(groups) if small else groups, "text_sha256", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with one row of each group of equal texts, that of the largest id, whatever its columns are called.

    Rows are dropped one by one, not by id: another text of the same id stays.  Null ids rank below
    all others, and of several rows with the largest id (or all null) one stays.
    """
    groups, small = copy_groups(docs, text, doc_id, broadcast_rows)
    marks = groups.select(F.col("text_sha256").alias("_group"), F.col("keep_id").alias("_keep"))
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[doc_id].alias("_id"), F.sha2(normalise(docs[text]), 256).alias("_sha"))
    stay = own.join(F.broadcast(marks) if small else marks, F.col("_sha") == F.col("_group"), "left").where(F.col("_group").isNull() | F.col("_id").eqNullSafe(F.col("_keep")))
    twice = materialize(stay.where(F.col("_group").isNotNull()).groupBy("_sha").count().where("count > 1").select(F.col("_sha").alias("_twice")), "twice")
    if twice.isEmpty():
        return stay.select("_row.*")
    twice = F.broadcast(twice) if small else twice
    marked = stay.join(twice, F.col("_sha") == F.col("_twice"), "left")
    return marked.where("_twice is null").select("_row.*").unionByName(marked.where("_twice is not null").dropDuplicates(["_sha"]).select("_row.*"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
), g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
