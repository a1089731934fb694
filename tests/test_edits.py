"""Bit-parallel edit distances and searches against the plain dynamic programme."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from isoflow.functions import edits


def table(a, b):
    """Levenshtein distance, row by row."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ACé漢", max_size=150), min_size=1, max_size=5), st.lists(st.text("ACé🎉", max_size=150), min_size=1, max_size=5))
def test_distances_equal_the_table(patterns, texts):
    assert edits.distances(patterns, texts).tolist() == [[table(a, b) for b in texts] for a in patterns]


@pytest.mark.parametrize("length", [1, 63, 64, 65, 127, 128, 129, 200])
def test_borders_of_words(length):
    rng = random.Random(length)
    a = "".join(rng.choice("ACGT") for _ in range(length))
    others = [a, a[1:], a + "A", a[::-1], "", "".join(rng.choice("ACGT") for _ in range(length))]
    assert edits.distances([a], others).tolist() == [[table(a, b) for b in others]]


def best_infix(text, probe, k):
    near = [(table(text[i:j], probe), i, j) for i in range(len(text)) for j in range(i + 1, len(text) + 1) if abs(j - i - len(probe)) <= k]
    near = [t for t in near if t[0] <= k]
    return min(near) if near else None


@pytest.mark.parametrize("k", [1, 2, 4])
def test_search_equals_trying_all_places(spark, k):
    rng = random.Random(k)
    rows = []
    for i in range(250):
        probe = "".join(rng.choice("ACGT") for _ in range(rng.choice([1, 2, 5, 9, 14])))
        text = "".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 40)))
        changed = list(probe)
        for _ in range(rng.randint(0, k)):
            changed[rng.randrange(len(changed))] = rng.choice(["", "A", "GG"])
        at = rng.randint(0, len(text))
        rows.append((i, text[:at] + "".join(changed) * (rng.random() < 0.7) + text[at:], probe))
    got = spark.createDataFrame([*rows, (900, None, "A"), (901, "A", None)], "id int, s string, p string").repartition(3)
    got = {r.id: r.h for r in got.select("id", edits.find_approx(F.col("s"), F.col("p"), k).alias("h")).collect()}
    assert got.pop(900) is None and got.pop(901) is None
    want = {i: best_infix(s, p, k) for i, s, p in rows}
    assert {i: h and tuple(h) for i, h in got.items()} == want and any(want.values()) and not all(want.values())


def test_search_with_long_probes():
    rng = np.random.default_rng(2)
    dna = lambda n: "".join(rng.choice(list("ACGT"), n))
    probe = dna(150)
    text = dna(90) + probe[:70] + "T" + probe[71:120] + probe[122:] + dna(60)
    best, start, end = edits._search([text, dna(300)], [probe, probe], 4)
    assert (best[0], start[0], best[1]) == (table(text[90 : end[0]], probe), 90, 5) and best[0] <= 3
