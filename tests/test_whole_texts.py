"""Queries over whole texts, on a small table; the expected rows are found in plain Python."""

import random
import re
from collections import Counter

import pytest

from isoflow.plans import registry

BASES = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGT" * 6 + "AC")


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = []
    for i, n in enumerate((3, 60, 199, 200, 201, 530, 1700, 0, 340, 348)):
        text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABC .\n") for _ in range(2 * n))
        rows.append((i, text, "en" if i % 2 else "de", "web", 2 * n))
    folder = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], r[0] % 3 % 2, 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, {r[0]: (r[2], re.sub("[^A-Z]", "", r[1].upper()).translate(BASES)) for r in rows}


def run(spark, texts, name):
    return registry.queries()[name](spark, texts[0]).collect()


def cut(seq, size):
    return [seq[a : a + size] for a in range(0, len(seq), size)]


def test_every_letter_is_counted(spark, texts):
    seqs = texts[1]
    assert max(len(s) for _, s in seqs.values()) > 1000
    got = {(r.lang, r.base): r.n for r in run(spark, texts, "base_composition")}
    assert got == {(g, b): sum(s.count(b) for k, s in seqs.values() if k == g) for g in ("de", "en") for b in "ACGT"}
    assert {r.doc_id: r.rc for r in run(spark, texts, "reverse_complement")} == {i: s[::-1].translate(str.maketrans("ACGT", "TGCA")) for i, (_, s) in seqs.items()}
    grams = Counter(s[k : k + 4] for _, s in seqs.values() for k in range(len(s) - 3))
    assert {r.kmer: r.n for r in run(spark, texts, "kmers")} == grams


def test_motifs_are_found_everywhere(spark, texts):
    seqs = texts[1]
    hits = {(r.doc_id, r.motif): r.n for r in run(spark, texts, "motif_hits")}
    assert {i: hits[(i, "YCAY")] for i in seqs} == {i: len(re.findall("[CT]CA[CT]", s)) for i, (_, s) in seqs.items()}
    n = Counter(g for g, _ in seqs.values())
    starts = Counter((g, k + 1) for g, s in seqs.values() for k in range(len(s) - 3) if re.fullmatch("[CT]CA[CT]", s[k : k + 4]))
    assert {(r.lang, r.position): r.share for r in run(spark, texts, "motif_profile")} == pytest.approx({k: c / n[k[0]] for k, c in starts.items()}, abs=1e-5)


def test_substitutions_of_every_window(spark, texts):
    windows = {(i, w): (g, p) for i, (g, s) in texts[1].items() for w, p in enumerate(cut(s, 200))}
    parents = {g: min((-len(p), i, w, p) for (i, w), (k, p) in windows.items() if k == g)[3] for g in ("de", "en")}
    want = {(i, w, k + 1, a, b) for (i, w), (g, p) in windows.items() for k, (a, b) in enumerate(zip(parents[g], p)) if a != b}
    got = [(r.doc_id, r.window, r.position, r.from_base, r.to_base) for r in run(spark, texts, "substitutions")]
    assert len(got) == len(want) and set(got) == want


def test_regions_cover_every_text(spark, texts):
    rows = run(spark, texts, "adjusted_regions")
    for i, (_, s) in texts[1].items():
        parts = {r.window: r for r in rows if r.doc_id == i}
        assert sorted(parts) == list(range(len(cut(s, 170))))
        whole = [p for p in cut(s, 170) if len(p) == 170]
        assert [parts[w].adj_up + parts[w].adj_exon + parts[w].adj_down for w in range(len(whole))] == whole
    assert len(run(spark, texts, "splice_motifs")) == len(rows)


def test_every_window_is_a_read(spark, texts):
    reads = {f"{i}_{w}": p for i, (_, s) in texts[1].items() for w, p in enumerate(cut(s, 54))}
    listed = {p[10:24] for k, p in reads.items() if int(k.split("_")[0]) % 2 == 0 and len(p) >= 24}
    want = {(k, p[10:24], p[:10]) for k, p in reads.items() if int(k.split("_")[0]) % 3 == 0 and p[10:24] in listed and len(p) >= 24}
    got = {(r.read_id, r.cb, r.umi) for r in run(spark, texts, "extract_umi")}
    assert want <= got and {k for k, *_ in got} <= set(reads)
    called = run(spark, texts, "call_events")
    assert sorted(r.read_id for r in called) == sorted(f"{i}_{w}" for i, (_, s) in texts[1].items() for w, _ in enumerate(cut(s, 174)))
    assert run(spark, texts, "run_stats")[0].total_reads == len(called)


def test_kmer_statistics_see_whole_texts(spark, texts):
    seqs = texts[1]
    n = Counter(g for g, s in seqs.values() if len(s) >= 3)
    want = Counter()
    for g, s in seqs.values():
        for k in range(len(s) - 2):
            want[(g, s[k : k + 3])] += 1 / (len(s) - 2) / n[g]
    assert {(r.lang, r.kmer): r.frequency for r in run(spark, texts, "kmer_frequency")} == pytest.approx(dict(want), abs=1e-5)
    group = {i for i in seqs if i % 3 % 2 == 0}
    grams = {i: {s[k : k + 4] for k in range(len(s) - 3)} for i, (_, s) in seqs.items()}
    assert {r.kmer: r.a for r in run(spark, texts, "kmer_enrichment")} == {k: sum(k in grams[i] for i in group) for k in set().union(*grams.values())}


def test_substitution_shares_are_of_all_designs(spark, texts):
    subs = Counter((r.position, r.to_base) for r in run(spark, texts, "substitutions"))
    n = sum(len(cut(s, 200)) for _, s in texts[1].values())
    assert {(r.position, r.to_base): r.share for r in run(spark, texts, "substitution_profile")} == pytest.approx({k: c / n for k, c in subs.items()}, abs=1e-6)


def test_one_hot_holds_every_base_and_lane(spark, texts):
    got = {r.doc_id: (r.a, r.c, r.g, r.t) for r in run(spark, texts, "one_hot")}
    assert got == {i: tuple("".join("01"[b == c] for b in s) for c in "ACGT") for i, (_, s) in texts[1].items()}


def test_matrix_has_every_condition(spark):
    folder = "/root/testdata/sf0.01"
    got = registry.queries()["to_matrix"](spark, folder)
    assert sorted(got.columns) == sorted(["event"] + [f"c{c}" for c in range(25)])
    from isoflow.plans.count_queries import means

    assert {(r.event, f"c{r.condition}"): r.psi for r in means(spark, folder).collect() if r.psi is not None} == pytest.approx({(r.event, c): r[c] for r in got.collect() for c in got.columns if c != "event" and r[c] is not None}, abs=1e-5)
