"""Functions of nucleotide sequences as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from isoflow.functions.edits import find_approx  # noqa: F401

# The IUPAC nucleotide codes.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "[AG]", "Y": "[CT]", "S": "[CG]", "W": "[AT]", "K": "[GT]", "M": "[AC]", "B": "[CGT]",
    "D": "[AGT]", "H": "[ACT]", "V": "[ACG]", "N": "[ACGT]",
}


def reverse_complement(seq):
    """Null for anything but ACGT."""
    return F.when(seq.rlike("^[ACGT]*$"), F.reverse(F.translate(seq, "ACGT", "TGCA")))


def safe_substr(seq, start, stop):
    """Bases ``start`` to ``stop`` (from 1, both included), null where the sequence is too short."""
    return F.when((F.length(seq) >= stop) & (start >= 1), F.substr(seq, start, stop - start + 1))


BLOCK = 256
"""Places of a block, in which single places are looked up."""


def blocks(seq, width: int):
    """The sequence in blocks that hold all substrings of length ``width`` which start at their ``BLOCK`` places."""
    last = F.floor(F.greatest(F.length(seq) - 1, F.lit(0)) / BLOCK).cast("int")
    return F.when(seq.isNotNull(), F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(seq, i * BLOCK + 1, F.lit(BLOCK + width - 1))))


def windows(seq, size: int):
    """Consecutive pieces ``(window, seq)`` of ``size`` bases that cover the sequence, numbered from 0; the last may be shorter.

    One pass of a pattern cuts them; substr would count from the start of the sequence for each.
    """
    parts = F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.transform(parts, lambda s, i: F.struct(i.alias("window"), s.alias("seq")))


def kmers(seq, k: int):
    """All substrings of length ``k`` in order; none for shorter sequences.

    The sequence is bound once as a lambda variable, so that an expression for it is not evaluated
    for each place.  It is cut into overlapping blocks, since substr counts from the start.
    """

    def parts(s):
        n = F.length(s) - k + 1
        return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.flatten(F.transform(F.array(seq), lambda s: blocks(s, k))), parts))


def motif_regex(motif: str) -> str:
    """An IUPAC motif (U counting as T) as a regular expression."""
    return "".join(IUPAC[c] for c in re.sub("U", "T", motif.upper()))


def motif_count(seq, motif: str):
    """Matches that do not overlap."""
    return F.regexp_count(seq, F.lit(motif_regex(motif)))


def one_hot(seq, alphabet: str = "ACGT"):
    """One 0/1 row per base, columns in the order of ``alphabet``; other letters give zeros."""
    return F.transform(F.split(seq, ""), lambda b: F.array(*[F.when(b == c, 1).otherwise(0) for c in alphabet]))


def mismatches(a, b):
    """Hamming distance of two strings of equal length, null otherwise."""
    pairs = F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y"))
    return F.when(F.length(a) == F.length(b), F.size(F.filter(pairs, lambda p: p["x"] != p["y"])))
