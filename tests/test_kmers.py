"""k-mers numbered in blocks, against slices."""

import random
from collections import Counter

import pytest

from isoflow.functions import kmer_counts
from isoflow.operators import sequences


@pytest.mark.parametrize("k", [1, 3, 4, 31, 40])
def test_distinct_kmers_against_slices(k):
    rng = random.Random(k)
    seqs = ["".join(rng.choice("ACGTé") for _ in range(rng.choice([0, 1, 2, 3, 50, 300]))) for _ in range(40)] + ["A" * 90, ""]
    owner, kmer, n, names = kmer_counts.distinct(seqs, k)
    got = {(o, names[i]): c for o, i, c in zip(owner.tolist(), kmer.tolist(), n.tolist())}
    assert got == {(i, x): c for i, s in enumerate(seqs) for x, c in Counter(s[j : j + k] for j in range(len(s) - k + 1)).items()}
    assert kmer_counts.distinct([""], k)[3] == [] and kmer_counts.distinct([], k)[3] == []


def test_enrichment_and_frequency_with_gaps(spark, monkeypatch):
    monkeypatch.setattr(kmer_counts, "LETTERS", 100)
    rng = random.Random(1)
    rows = [(i, rng.choice([True, False, None]), rng.choice(["en", "de"]), None if i % 9 == 0 else "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 60)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, grp boolean, lang string, seq string").repartition(3)
    got = {r.kmer: (r.a, r.b, r.c, r.d) for r in sequences.kmer_enrichment(df, 2).collect()}
    sets = [(g, {s[i : i + 2] for i in range(len(s) - 1)} if s else set()) for _, g, _, s in rows]
    n1, n0 = sum(g is True for g, _ in sets), sum(g is False for g, _ in sets)
    want = {}
    for x in set().union(*(s for _, s in sets)):
        a, c = (sum(g is v and x in s for g, s in sets) for v in (True, False))
        want[x] = (a, n1 - a, c, n0 - c)
    assert got == want
    frequency = {(r.lang, r.kmer): r.frequency for r in sequences.kmer_frequency(df, 2).collect()}
    for lang in ("en", "de"):
        own = [s for _, _, g, s in rows if g == lang and s and len(s) >= 2]
        for x in {s[i : i + 2] for s in own for i in range(len(s) - 1)}:
            assert frequency[lang, x] == pytest.approx(sum(sum(s[i : i + 2] == x for i in range(len(s) - 1)) / (len(s) - 1) for s in own) / len(own))
