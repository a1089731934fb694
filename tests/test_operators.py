import gzip
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoflow.functions import keys, sequences
from isoflow.operators import contrasts, counts, psi, reads, specificity, stats
from isoflow.operators import sequences as seq_ops
from isoflow.sources import tables


def test_greedy_merge_of_near_offsets(spark):
    rows = [("s", "c", "e", u, d, n) for (u, d), n in {(0, 0): 10, (1, 0): 4, (2, 0): 3, (2, 1): 1}.items()]
    df = spark.createDataFrame(rows, "sample string, condition string, idx string, up_off int, down_off int, cnt long")
    got = {(r.up_off, r.down_off): r.cnt for r in counts.merge_near_offsets(df).collect()}
    assert got == {(0, 0): 14, (2, 0): 4}


def test_greedy_merge_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(s, "c", "e", u, d, rng.randint(1, 30)) for s in "ab" for u in range(-4, 5) for d in range(-3, 4) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "sample string, condition string, idx string, up_off int, down_off int, cnt long")
    want = {}
    for s in "ab":
        left = sorted((-n, u, d) for x, _, _, u, d, n in rows if x == s)
        while left:
            _, u, d = left[0]
            near = [x for x in left if abs(x[1] - u) <= 1 and abs(x[2] - d) <= 1]
            want[s, u, d] = -sum(x[0] for x in near)
            left = [x for x in left if x not in near]
    got = {(r.sample, r.up_off, r.down_off): r.cnt for r in counts.merge_near_offsets(df).collect()}
    assert got == want


def loop_merge(cells, radius=1):
    """Kept offsets and their sums for rows ``(up, down, count)``, one row after another."""
    top, total = {}, {}
    for u, d, n in cells:
        top[u, d] = max(n, top.get((u, d), n))
        total[u, d] = total.get((u, d), 0) + n
    steps = range(-radius, radius + 1)
    kept, rank = {}, {}
    for u, d in sorted(top, key=lambda p: (-top[p], p)):
        near = [(u + a, d + b) for a in steps for b in steps if (u + a, d + b) in kept]
        to = min(near, key=rank.get) if near else (u, d)
        rank.setdefault(to, len(rank))
        kept[to] = kept.get(to, 0) + total[u, d]
    return kept


@pytest.mark.parametrize("radius", [1, 2])
def test_tiles_merge_as_the_loop_does(spark, radius):
    rng = random.Random(radius)
    groups = {
        "random": [(rng.randint(-40, 40), rng.randint(-40, 40), rng.randint(1, 50)) for _ in range(2500)],
        "falling": [(i, 0, 1000 - i) for i in range(300)],
        "equal": [(u, d, 7) for u in range(30) for d in range(30)],
        "small": [(0, 0, 5), (1, 1, 5), (3, 3, 9)],
        None: [(rng.randint(0, 20), rng.randint(0, 20), rng.randint(1, 9)) for _ in range(200)],
    }
    df = spark.createDataFrame([("s", "c", e, *r) for e, rows in groups.items() for r in rows], "sample string, condition string, idx string, up_off int, down_off int, cnt long")
    got = {(r.idx, r.up_off, r.down_off): r.cnt for r in counts.merge_near_offsets(df, radius=radius, folded=100, tile=16).collect()}
    assert got == {(e, *p): n for e, rows in groups.items() for p, n in loop_merge(rows, radius).items()}


def test_one_element_with_many_offsets(spark):
    rng = np.random.default_rng(8)
    rows = list(zip(rng.integers(0, 700, 100_000).tolist(), rng.integers(0, 700, 100_000).tolist(), rng.integers(1, 1000, 100_000).tolist()))
    df = spark.createDataFrame([("s", "c", "e", *r) for r in rows], "sample string, condition string, idx string, up_off int, down_off int, cnt long")
    got = {(r.up_off, r.down_off): r.cnt for r in counts.merge_near_offsets(df).collect()}
    assert got == loop_merge(rows)


def test_chimera_correction(spark):
    df = spark.createDataFrame([("s", "e", "INCLUDED", 70), ("s", "e", "SKIPPED", 20), ("s", "e", "UNSPLICED", 10), ("s", "f", "SKIPPED", 5), ("s", "g", "INCLUDED", 90), ("s", "g", "SKIPPED", 2)], "sample string, idx string, mode string, cnt long")
    rates = spark.createDataFrame([("s", 0.1)], "sample string, rate double")
    got = {(r.idx, r.mode): r.cnt_scaled for r in counts.chimera_correct_v3(df, rates).collect()}
    assert got == {("e", "INCLUDED"): 70, ("e", "SKIPPED"): 13, ("e", "UNSPLICED"): 6, ("f", "SKIPPED"): 4, ("g", "INCLUDED"): 90, ("g", "SKIPPED"): 0}


def test_log_psi_and_its_inverse(spark):
    df = spark.createDataFrame([(30, 10), (0, 5), (7, 0)], "included long, skipped long")
    rows = psi.log_psi(df).withColumn("back", psi.unlog_psi(F.col("log_psi"))).collect()
    assert rows[0].log_psi == pytest.approx(math.log2(751 / 251))
    assert [r.back for r in rows] == pytest.approx([0.75, 0.0, 1.0], abs=2e-3)


def test_tau_and_upsilon(spark):
    x = [0.1, 0.5, 1.0, 0.2]
    df = spark.createDataFrame([("e", i, v) for i, v in enumerate(x)] + [("z", i, v) for i, v in enumerate([0.0, 0.0, 0.0, 0.0, 0.1])] + [("e", 9, None)], "event string, condition int, psi double")
    got = {r.event: r for r in specificity.specificity_scores(df, 3).collect()}
    assert got["e"].tau == pytest.approx(0.733333, abs=1e-6) and got["e"].upsilon == pytest.approx(0.733333, abs=1e-6)
    assert got["e"].upsilon_reverse == pytest.approx(0.491228, abs=1e-6) and got["z"].tau == pytest.approx(1.0)
    assert specificity.specificity_scores(df, 6).where("tau is not null").count() == 0


def test_other_metrics_on_toy_vectors(spark):
    vectors = [[1, 1, 1, 1, 1.1], [1.3, 1.4, 1.5, 1.6, 1.7], [1, 2, 2, 2, 2]]
    df = spark.createDataFrame([(str(k), i, float(v)) for k, x in enumerate(vectors) for i, v in enumerate(x)], "event string, condition int, psi double")
    got = {int(r.event): r for r in specificity.specificity_metrics(df).collect()}
    for k, values in enumerate(vectors):
        x, n = np.array(values, float), len(values)
        p = x / x.sum()
        h = -(p * np.log2(p)).sum()
        s = np.sort(x)
        assert got[k].gini == pytest.approx(((2 * np.arange(1, n + 1) - n - 1) * s).sum() / (n * s.sum()) * n / (n - 1))
        assert got[k].shannon == pytest.approx((np.log2(n) - h) / np.log2(n))
        assert got[k].simpson == pytest.approx(((p**2).sum() - 1 / n) / (1 - 1 / n))
        spm = x / np.sqrt((x**2).sum())
        assert got[k].spm_dpm == pytest.approx(spm.std(ddof=1) * np.sqrt(n)) and got[k].spm == pytest.approx(spm.max())


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("c", 0.01), ("c", 0.04), ("c", 0.03), ("c", 0.5), ("c", None), ("d", 0.2)], "contrast string, p double")
    got = [(r.contrast, r.p, r.fdr) for r in stats.bh_adjust(df, by=("contrast",)).collect()]
    want = {("c", 0.01): 0.04, ("c", 0.04): 0.16 / 3, ("c", 0.03): 0.16 / 3, ("c", 0.5): 0.5, ("d", 0.2): 0.2}
    assert {(c, p): f for c, p, f in got if p is not None} == pytest.approx(want)
    assert [f for _, p, f in got if p is None] == [None]


def test_tails(spark):
    df = spark.createDataFrame([(2.0, 10.0), (0.0, 5.0), (-3.5, 3.0), (None, 3.0)], "t double, df double")
    p = [r[0] for r in df.select(stats.t_tail(F.col("t"), F.col("df"))).collect()]
    assert p[:3] == pytest.approx([0.0733880, 1.0, 0.0394860], abs=1e-5) and p[3] is None
    z = spark.createDataFrame([(1.959964,), (0.0,)], "z double")
    assert [r[0] for r in z.select(stats.normal_tail(F.col("z"))).collect()] == pytest.approx([0.05, 1.0], abs=1e-6)
    x = spark.createDataFrame([(3.841459,)], "x double")
    assert x.select(stats.chi2_1_tail(F.col("x"))).first()[0] == pytest.approx(0.05, abs=1e-6)


def test_fisher():
    assert seq_ops._fisher(3, 1, 1, 3) == pytest.approx(0.485714, abs=1e-6)
    assert seq_ops._fisher(10, 0, 0, 10) == pytest.approx(2 / math.comb(20, 10))


TARGET = "ACTGATGATGTGGACCTGGAACAGGTGCGGCAGCTGGTGCCTCG"


def test_approximate_search(spark):
    cases = [("ATGATGTGGACCTGGAACAG", 1), ("GTGCGGCAGCTGGTGCCTCG", 1), ("ATGATGTGGTCCTGGAACAG", 1), ("ATGATGTGGCCTGGAACAG", 1), ("TTTTTTTTTTTTTTTT", 1), ("ATGATGTGGTCCTGGAACAG", 0)]
    want = [(0, 4, 24), (0, 24, 44), (1, 4, 24), (1, 4, 24), None, None]
    for (probe, k), hit in zip(cases, want):
        got = spark.createDataFrame([(TARGET,)], "s string").select(sequences.find_approx(F.col("s"), F.lit(probe), k).alias("h")).first().h
        assert (tuple(got) if got else None) == hit, probe


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def best_infix(text, probe, k):
    """First of the best windows with at most ``k`` edits, by trying all."""
    tried = [(edits(text[i : i + n], probe), i, i + n) for i in range(len(text) + 1) for n in range(max(1, len(probe) - k), len(probe) + k + 1) if i + n <= len(text)]
    best = min((t for t in tried if t[0] <= k), default=None)
    return best


def call_one(c, element, seq):
    """The caller's rules, one read at a time: (outcome, up, down, const, size)."""
    drop = lambda why: (why, None, None, None, None)
    if element is None:
        return drop("bc_not_found")
    hit = best_infix(seq, c.upstream_anchor, 1)
    if hit is None:
        return drop("no_upstream")
    rest = seq[hit[2] :]
    at = c.intron.find(rest[:20]) if rest else -1
    if at >= 0:
        return ("UNSPLICED", at, None, None, None)
    start, const = rest.find(c.downstream_exon[:20]), 0
    if start < 0:
        for i in range(len(c.const_intron) + len(c.downstream_exon)):
            start = rest.find(c.const_intron + c.downstream_exon[i : i + 20])
            if start >= 0:
                const = i - len(c.const_intron)
                break
        else:
            return drop("no_downstream")
    if start <= 2:
        return ("SKIPPED", None, None, const, start)
    up, exon, down = element
    hit = best_infix(up + exon + down + c.const_intron, rest[:start], 1 if start > 20 else 0)
    return ("INCLUDED", hit[1] - len(up), hit[2] - len(up) - len(exon), const, start) if hit else drop("chimera")


def test_event_caller_follows_its_rules(spark):
    rng = random.Random(3)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    c = reads.Construct(dna(20), dna(60), dna(45), dna(30))
    elements = {f"BC{i}": (dna(30), dna(rng.choice([15, 40, 60])), dna(30)) for i in range(4)}
    library = spark.createDataFrame([(k, f"e{k}", *v) for k, v in elements.items()], "cb string, idx string, up_intron string, exon string, down_intron string")

    def changed(s):
        i = rng.randrange(len(s))
        return rng.choice([s[:i] + rng.choice("ACGT") + s[i + 1 :], s[:i] + s[i + 1 :], s[:i] + rng.choice("ACGT") + s[i:]])

    rows = [("empty", "BC0", ""), ("only_anchor", "BC0", c.upstream_anchor), ("short_rest", "BC0", c.upstream_anchor + c.intron[7:16]), ("lost", "BC1", dna(80)), ("unknown", "BCX", c.upstream_anchor + dna(30))]
    for n in range(120):
        cb = f"BC{rng.randrange(4)}"
        up, exon, down = elements[cb]
        middle = rng.choice([exon, exon[3:], (up + exon + down)[22:70], "", dna(2), dna(3), dna(45), changed(exon), exon[:12]])
        tail = rng.choice([c.downstream_exon, c.downstream_exon, changed(c.downstream_exon[:20]), c.const_intron + c.downstream_exon[6:], c.const_intron, c.intron[rng.randrange(9) :]])
        anchor = rng.choice([c.upstream_anchor, c.upstream_anchor, changed(c.upstream_anchor)])
        rows.append((f"r{n}", cb, dna(rng.randrange(6)) + anchor + middle + tail))
    df = spark.createDataFrame([(n, cb, str(i % 7), s) for i, (n, cb, s) in enumerate(rows)], "read_id string, cb string, umi string, seq string")
    called = reads.call_events(df, library, c).cache()
    got = {r.read_id: (r.outcome, r.up_off, r.down_off, r.const_off, r.insert_size) for r in called.collect()}
    want = {n: call_one(c, elements.get(cb), s) for n, cb, s in rows}
    assert got == want
    seen = {w[0] for w in want.values()}
    assert seen == {"bc_not_found", "no_upstream", "no_downstream", "UNSPLICED", "SKIPPED", "INCLUDED", "chimera"} and {w[3] for w in want.values()} > {None, 0}

    run, calls = reads.run_stats(called).first(), list(want.values())
    n = lambda test: sum(map(test, calls))
    umis = {(cb, i % 7, w) for i, ((_, cb, _), w) in enumerate(zip(rows, calls)) if w[0].isupper()}
    aligned, chimeras, included = n(lambda w: w[0].isupper() or w[0] == "chimera"), n(lambda w: w[0] == "chimera"), n(lambda w: w[0] == "INCLUDED")
    assert len(run) == 13 and (run.total_reads, run.total_aligned_reads, run.total_umi_count) == (len(rows), aligned, len(umis))
    assert (run.bc_not_found, run.skipped_reads, run.chimera_reads) == (1, n(lambda w: w[0] == "SKIPPED"), chimeras)
    assert (run.unspliced_counter, run.minor_splice_counter) == (n(lambda w: w[:2] == ("UNSPLICED", 0)), n(lambda w: w[0] == "UNSPLICED" and w[1] != 0))
    assert (run.perfect_middle_exon, run.everything_passed_with_middle_exon) == (n(lambda w: w[:3] == ("INCLUDED", 0, 0)), included)
    assert run.duplication_rate == pytest.approx(len(umis) / aligned) and run.perc_chimera_reads == pytest.approx(chimeras / (chimeras + included))


def test_approximate_search_against_trying_all(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(150):
        probe = "".join(rng.choice("ACGT") for _ in range(rng.choice([1, 2, 5, 9, 20])))
        text = "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 4, 30])))
        i = rng.randrange(len(probe))
        text += rng.choice([probe, probe[:i] + probe[i + 1 :], probe[:i] + "G" + probe[i:], probe[:i] + "T" + probe[i + 1 :], ""]) + "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 6])))
        rows.append((text, probe))
    for k in (0, 1, 2):
        got = spark.createDataFrame(rows, "s string, p string").select(sequences.find_approx(F.col("s"), F.col("p"), k).alias("h")).collect()
        assert [tuple(r.h) if r.h else None for r in got] == [best_infix(s, p, k) for s, p in rows]


def test_insertion_lengths(spark):
    rows = [("e", "c", "u", "xxLEFTabcRIGHT"), ("e", "c", "u", "LEFTaRIGHT"), ("e", "c", "u", "LEFTbRIGHTRIGHT"), ("e", "c", "v", "LEFTRIGHT"), ("e", "c", "w", "RIGHTLEFT"), ("f", "c", "u", "none")]
    got = {tuple(r) for r in reads.insertion_lengths(spark.createDataFrame(rows, "idx string, cb string, umi string, seq string"), "LEFT", "RIGHT").collect()}
    assert got == {("e", "c", "u", 1, 3), ("e", "c", "v", 0, 1)}


def test_umi_extraction_splits_the_reads(spark):
    a1, a2 = "TTGCTAGGACCGGCCTTAAAGC", "CTACTTA"
    good = "ACGTACGTAC" + a1 + "AAAACCCCGGGGTT" + a2 + "TTTT"
    rows = [("ok", good), ("one_off", good.replace("TTGCTA", "TTGCTT")), ("bad_anchor", "ACGTACGTAC" + "A" * 22 + good[32:]), ("unlisted", good.replace("AAAACCCC", "AAAACCCA")), ("short", "ACGT")]
    df = spark.createDataFrame(rows, "read_id string, seq string")
    ok, failed = reads.extract_umi(df, spark.createDataFrame([("AAAACCCCGGGGTT",)], "cb string"), a1, a2)
    assert {r.read_id: (r.umi, r.cb) for r in ok.collect()} == {k: ("ACGTACGTAC", "AAAACCCCGGGGTT") for k in ("ok", "one_off")}
    assert {r.read_id for r in failed.collect()} == {"bad_anchor", "unlisted", "short"}


def test_nearest_barcode(spark):
    rng = random.Random(4)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    asked, listed = ["AAAA", "AAAT", "GGGG", "AAA", "AAAAT"] + [dna(5) for _ in range(80)], ["AAAA", "AATT"] + [dna(rng.choice([4, 5, 6])) for _ in range(30)]
    got = {r.cb: (r.nearest, r.distance) for r in reads.nearest_barcode(spark.createDataFrame([(a,) for a in asked], "cb string"), spark.createDataFrame([(b,) for b in listed], "cb string")).collect()}
    best = {a: min((edits(a, b), b) for b in listed) for a in asked}
    assert got == {a: (b, d) if d <= 1 else (None, None) for a, (d, b) in best.items()}


def test_library_deduplication(spark):
    base = "ACGTTGCAACGGTTAACCGGATATCGCGTA"
    lib = spark.createDataFrame([("a", base), ("b", base[3:25]), ("c", "TTTTTTTTTTTTTTTTTT"), ("d", base[4:20]), ("e", base)], "idx string, exon string")
    kept, alt = reads.dedupe_library(lib)
    assert {r.idx for r in kept.collect()} == {"a", "c"} and {r.alt: r.ref for r in alt.collect()} == {"b": "a", "d": "a", "e": "a"}
    short = spark.createDataFrame([("a", base), ("f", base[5:9]), ("g", "TTTTTTT"), ("h", "CCCCC")], "idx string, exon string")
    kept, alt = reads.dedupe_library(short)
    assert {r.idx for r in kept.collect()} == {"a", "g", "h"} and {r.alt: r.ref for r in alt.collect()} == {"f": "a"}


def test_junction_lists_and_library_regions(spark, tmp_path):
    from isoflow.operators import designs

    rows = [("chr1", "-", "g", "s", 10, 30, 0, 5, 50, 60, "30,0,x", "10,0,7"), ("chr1", "+", "g", "s", 10, 30, 0, 5, 50, 60, "3", "1"), ("chr2", "+", "g", "s", 10, 30, 0, 5, 50, 60, "100,50", "0,50")]
    df = spark.createDataFrame(rows, "chr string, strand string, GeneID string, geneSymbol string, exonStart_0base long, exonEnd long, upstreamES long, upstreamEE long, downstreamES long, downstreamEE long, IJC_SAMPLE_1 string, SJC_SAMPLE_1 string")
    got = {r.chr: r for r in designs.junction_events(df, 20).collect()}
    assert set(got) == {"chr1", "chr2"} and got["chr1"].id == "chr1-10-30-0-5-50-60" and got["chr1"].name == "g;s;chr1-10-30-0-5-50-60"
    assert got["chr1"].psi_list == [0.75, None, None] and got["chr1"].psi == 0.75 and got["chr1"].mean_count == 20
    assert (got["chr1"].up_intron_length, got["chr1"].down_intron_length, got["chr1"].exon_length) == (20, 5, 20)
    assert (got["chr2"].up_intron_length, got["chr2"].down_intron_length, got["chr2"].psi) == (5, 20, 0.75)
    assert [r.psi for r in designs.junction_psi(df).collect()] == [0.75, 0.75, 0.75]
    library = spark.createDataFrame([("e1", "ACGT", "GG"), ("e2", "TT", None)], "ID string, librarySequence string, skippedExonSeq string")
    parts = tables.library_regions(library, ("librarySequence", "skippedExonSeq"))
    assert {k: [tuple(r) for r in v.orderBy("id").collect()] for k, v in parts.items()} == {"librarySequence": [("e1", "ACGT"), ("e2", "TT")], "skippedExonSeq": [("e1", "GG"), ("e2", None)]}
    tables.write_fasta(parts["librarySequence"], str(tmp_path / "library"))
    assert {tuple(r) for r in tables.read_fasta(spark, str(tmp_path / "library")).collect()} == {("e1", "ACGT"), ("e2", "TT")}


def test_keys(spark):
    row = spark.createDataFrame([("e1__INCLUDED__0:-3:x__113", "gene_a_INCLUDED_5", "A549-rep4")], "index string, name string, sample string")
    r = keys.parse_sample_name(keys.unpack_name(keys.split_offset(keys.split_event_key(row, ["idx", "mode", "offset", "insert"])))).first()
    assert (r.idx, r.mode, r.up_off, r.down_off, r.const_off, r.base_name, r.name_mode, r.name_offset, r.condition, r.rep) == ("e1", "INCLUDED", 0, -3, None, "gene_a", "INCLUDED", "5", "A549", "rep4")
    assert keys.remap_reps(spark.createDataFrame([("rep4",), ("rep2",)], "rep string")).collect()[0].rep == "rep1"


def test_sequence_functions(spark):
    df = spark.createDataFrame([("ACGTT",), ("ACN",), ("",)], "s string")
    s = F.col("s")
    rows = df.select(sequences.reverse_complement(s), sequences.kmers(s, 4), sequences.safe_substr(s, F.lit(2), F.lit(4)), sequences.one_hot(F.substring(s, 1, 2), "AGCT")).collect()
    assert [tuple(r)[:3] for r in rows] == [("AACGT", ["ACGT", "CGTT"], "CGT"), (None, [], None), ("", [], None)]
    assert rows[0][3] == [[1, 0, 0, 0], [0, 0, 1, 0]]
    assert sequences.motif_regex("UGYN") == "TG[CT][ACGT]"


def test_replicate_lists(spark):
    df = spark.createDataFrame([("s2", "c", "e", 3, 1), ("s1", "c", "e", 5, 2), ("s3", "d", "e", 7, 0)], "sample string, condition string, event string, included long, skipped long")
    got = {r.condition: (r.included, r.skipped) for r in contrasts.pack_replicates(df, ("condition", "event")).collect()}
    assert got == {"c": ([5, 3], [2, 1]), "d": ([7, 0], [0, 0])}
    lists = contrasts.unpack_lists(spark.createDataFrame([("1,2.5,x",)], "v string"), ["v"]).first().v
    assert lists == [1.0, 2.5, None]


def test_smoothing_against_numpy(spark):
    rng = np.random.default_rng(0)
    values = rng.normal(size=17)
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(values)], "grp string, pos int, v double")
    got = [r.smooth for r in stats.gaussian_smooth(df, "grp", "pos", "v").orderBy("pos").collect()]
    kernel = np.exp(-0.5 * (np.arange(-4, 5) / 1.1) ** 2)
    padded = np.pad(values, 4, mode="symmetric")
    assert got == pytest.approx(np.convolve(padded, kernel / kernel.sum(), mode="valid"))


def test_split_has_no_key_on_both_sides(spark):
    df = spark.range(2000).select((F.col("id") % 200).alias("cb"))
    out = stats.group_split(df, "cb")
    assert out.groupBy("cb").agg(F.countDistinct("is_test").alias("n")).where("n > 1").count() == 0
    assert 0.1 < out.agg(F.avg(F.col("is_test").cast("double"))).first()[0] < 0.3


def test_files(spark, tmp_path):
    with gzip.open(tmp_path / "a.fastq.gz", "wt") as f:
        f.write("@r1_BC_UMI\nACGT\n+\nIIII\n@r2_BC_UMI\nTT\n+\nII\n")
    (tmp_path / "b.fastq").write_text("@r3\nGG\n+\nII\n")
    got = {r.read_id: (r.seq, r.qual) for r in tables.read_fastq(spark, [str(tmp_path / "a.fastq.gz"), str(tmp_path / "b.fastq")]).collect()}
    assert got == {"r1_BC_UMI": ("ACGT", "IIII"), "r2_BC_UMI": ("TT", "II"), "r3": ("GG", "II")}
    df = spark.createDataFrame([("a", "ACGT"), ("b", "TTT")], "id string, seq string")
    tables.write_fasta(df, str(tmp_path / "fa"))
    assert sorted(map(tuple, tables.read_fasta(spark, str(tmp_path / "fa")).collect())) == [("a", "ACGT"), ("b", "TTT")]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "s1.csv").write_text("total_reads,10\nchimera,0.5\n")
    assert tables.sample_stats(spark, str(tmp_path / "logs"), ["total_reads", "chimera"]).first().asDict() == {"filename": "s1.csv", "total_reads": 10.0, "chimera": 0.5}
    (tmp_path / "res" / "X_all").mkdir(parents=True)
    (tmp_path / "res" / "X_all" / "fdr.txt").write_text("ExonID\tFDR\na\t0.001\nb\t0.5\n")
    assert [tuple(r) for r in tables.combine_results(spark, str(tmp_path / "res" / "*"), "ExonID string, FDR double").collect()] == [("a", 0.001, "X_all")]


def test_quantile_normalise_uses_every_rank(spark):
    rng = np.random.default_rng(5)
    samples = {"a": rng.random(2400), "b": rng.random(1700) ** 2, "c": np.round(rng.random(300), 2), "d": np.array([0.4])}
    rows = [(s, i, float(x)) for s, v in samples.items() for i, x in enumerate(v)] + [("a", -1, None)]
    got = {(r.sample, r.event): r.normalised for r in psi.quantile_normalise(spark.createDataFrame(rows, "sample string, event int, psi double")).collect()}
    at = np.linspace(0, 1, 2400)
    mean = np.mean([np.interp(at, np.linspace(0, 1, len(v)), np.sort(v)) if len(v) > 1 else np.full(2400, v[0]) for v in samples.values()], axis=0)
    want = {}
    for s, v in samples.items():
        place = [(np.sum(v < x) + (np.sum(v == x) - 1) / 2) / (len(v) - 1) if len(v) > 1 else 0.5 for x in v]
        want |= {(s, i): float(y) for i, y in enumerate(np.interp(place, at, mean))}
    assert got == pytest.approx(want, abs=1e-9)
    assert len({got[("a", i)] for i in range(2400)}) == 2400


def test_ranks_and_false_discovery_over_buckets(spark):
    rng = np.random.default_rng(11)
    rows = [(int(g), None if rng.random() < 0.03 else float(round(v, 3))) for g, v in zip(rng.choice([0, 0, 0, 1, 2], 4000), rng.random(4000))] + [(None, 0.5), (None, 0.25), (3, None)]
    df = spark.createDataFrame(rows, "g int, p double").withColumn("id", F.monotonically_increasing_id())
    for by in ((), ("g",)):
        got = stats.with_average_rank(stats.bh_adjust(df, by=by), "p", "rank", by).collect()
        assert len(got) == len(rows)
        groups = {}
        for r in got:
            groups.setdefault(r.g if by else 0, []).append(r)
        for part in groups.values():
            known = np.array([r.p for r in part if r.p is not None])
            ordered = np.sort(known)
            best, want = 1.0, {}
            for k in range(len(ordered), 0, -1):
                best = min(best, ordered[k - 1] * len(ordered) / k)
                want.setdefault(ordered[k - 1], best)
            for r in part:
                if r.p is None:
                    assert r.fdr is None and r.rank is None
                else:
                    assert r.fdr == pytest.approx(want[r.p], rel=1e-9)
                    assert r.rank == pytest.approx(((ordered < r.p).sum() + 1 + (ordered <= r.p).sum()) / 2)


def test_rank_correlation_against_numpy(spark):
    rng = np.random.default_rng(12)
    x, y = np.round(rng.normal(size=900), 1), np.round(rng.normal(size=900), 1)
    rank = lambda v: np.array([((v < a).sum() + 1 + (v <= a).sum()) / 2 for a in v])
    r = stats.correlate(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double"), "x", "y").first()
    assert r.pearson == pytest.approx(np.corrcoef(x, y)[0, 1]) and r.spearman == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1]) and r.n == 900


def test_gene_event_correlations_in_blocks(spark):
    rng = np.random.default_rng(13)
    psi = {(e, c): float(rng.random()) for e in range(7) for c in range(6) if rng.random() < 0.7} | {(9, c): 0.5 for c in range(6)} | {(8, 0): 0.1}
    gene = {(g, c): float(rng.normal()) for g in range(5) for c in range(1, 7)}
    means = spark.createDataFrame([(e, c, v) for (e, c), v in psi.items()] + [(0, 99, None)], "event int, condition int, psi double")
    expression = spark.createDataFrame([(g, c, v) for (g, c), v in gene.items()], "gene int, cell_line int, value double")
    for block in (512, 2):
        got = {(r.event, r.gene): (r.r, r.n) for r in stats.gene_event_correlation(means, expression, block).collect()}
        want = {}
        for e in {e for e, _ in psi}:
            for g in range(5):
                both = [c for c in range(7) if (e, c) in psi and (g, c) in gene]
                if both:
                    a, b = np.array([psi[e, c] for c in both]), np.array([gene[g, c] for c in both])
                    want[e, g] = (None if len(both) < 2 or a.std() == 0 else float(np.corrcoef(a, b)[0, 1]), len(both))
        assert got.keys() == want.keys()
        for k, (r, n) in want.items():
            assert got[k][1] == n and (got[k][0] is None if r is None else got[k][0] == pytest.approx(r, abs=1e-9))


def test_fisher_of_large_tables():
    def all_tables(a, b, c, d):
        n1, n0, m = a + b, c + d, a + c
        p = {x: math.comb(n1, x) * math.comb(n0, m - x) for x in range(max(0, m - n0), min(n1, m) + 1)}
        return sum(v for v in p.values() if v <= p[a] * (1 + 1e-7)) / math.comb(n1 + n0, m)

    rng = random.Random(5)
    for _ in range(300):
        t = [rng.randrange(rng.choice([2, 12, 80])) for _ in range(4)]
        assert seq_ops._fisher(*t) == pytest.approx(all_tables(*t), rel=1e-6), t
    assert 0 <= seq_ops._fisher(50_000_000, 50_000_000, 50_010_000, 49_990_000) < 0.2


def test_error_function():
    x = np.linspace(0, 12, 500)
    assert np.allclose(stats._erfc(x), [math.erfc(v) for v in x], rtol=1e-9, atol=1e-300)


def test_edit_distances_by_segments(spark):
    rng = random.Random(6)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    library = [dna(rng.choice([0, 1, 2, 5, 12, 20])) for _ in range(40)]
    designs = [dna(rng.choice([0, 1, 3, 12, 20])) for _ in range(40)]
    for s in library * 2:
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(s) + 1)
            s = rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("ACGT") + s[i:], s[:i] + rng.choice("ACGT") + s[i + 1 :]])
        designs.append(s)
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "seq string")
    designs += [dna(70), dna(140), "é" * 9, None]
    best = {s: min(edits(s, r) for r in library) for s in designs if s is not None}
    assert max(best.values()) > 50
    for most in (0, 1, 3):
        got = {r.seq: r.distance for r in seq_ops.min_edit_distance(frame(designs), frame(library + [None]), most).collect()}
        assert got == best | {None: None}
    assert {r.distance for r in seq_ops.min_edit_distance(frame(designs), frame(library).where("false")).collect()} == {None}
    assert seq_ops.min_edit_distance(frame(designs).where("false"), frame(library)).count() == 0


def test_edit_distances_over_many_blocks(spark, monkeypatch):
    rng = random.Random(16)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    library, designs = [dna(rng.randint(30, 80)) for _ in range(60)], [dna(rng.randint(30, 80)) for _ in range(50)]
    monkeypatch.setattr(seq_ops, "BLOCK_SEQUENCES", 16)
    monkeypatch.setattr(seq_ops, "TILE", (3, 5))
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "seq string")
    got = {r.seq: r.distance for r in seq_ops.min_edit_distance(frame(designs), frame(library)).collect()}
    assert got == {s: min(edits(s, r) for r in library) for s in designs}


def test_components_against_numpy(spark):
    from isoflow.operators import models

    rng = np.random.default_rng(14)
    x = rng.random((6, 30)) + np.outer(np.arange(6), rng.random(30))
    gaps = {(1, 3), (4, 7)}
    rows = [(c, f"e{e}", float(x[c, e])) for c in range(6) for e in range(30) if (c, e) not in gaps]
    z = x.copy()
    for c, e in gaps:
        z[c, e] = np.mean([x[c, k] for k in range(30) if (c, k) not in gaps])
    z = (z - z.mean(axis=0)) / z.std(axis=0, ddof=1)
    u, s, v = np.linalg.svd(z, full_matrices=False)
    scores, shares, loadings = models.psi_pca(spark.createDataFrame(rows, "condition int, event string, psi double"), 2)
    assert shares == pytest.approx((s[:2] ** 2 / (s**2).sum()).tolist())
    got = np.array([r.pc for r in scores.orderBy("condition").collect()])
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-8)
    weights = {r.event: r.loading for r in loadings.collect()}
    assert np.allclose([np.abs(weights[f"e{e}"]) for e in range(30)], np.abs(v[:2].T), atol=1e-8)
    top = [r.event for r in models.top_loadings(loadings, 0, 5).collect()]
    assert top == [f"e{e}" for e in np.argsort(-np.abs(v[0]), kind="stable")[:5]]


def test_random_draws_hang_on_the_rows_alone(spark):
    rows = [(i, "ACGT" * (i % 5 + 1)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, seq string")
    one = {(r.replicate, r.kmer): r.n for r in seq_ops.kmer_background(df, 3, 40).collect()}
    assert one == {(r.replicate, r.kmer): r.n for r in seq_ops.kmer_background(df.repartition(7, "seq"), 3, 40).collect()}
    draws = {r: sorted((h, i) for i, h in df.select("doc_id", F.xxhash64("doc_id", F.lit(r), F.lit(0)).alias("h")).collect())[:40] for r in (1, 2, 3)}
    want = {}
    for r, part in draws.items():
        for _, i in part:
            s = rows[i][1]
            for k in range(len(s) - 2):
                want[r, s[k : k + 3]] = want.get((r, s[k : k + 3]), 0) + 1
    assert one == want


def test_effect_blocks_against_numpy(spark):
    rng = np.random.default_rng(15)
    length, wide = 60, rng.normal(0, 0.05, (3, 60, 4))
    wide[0, 20:26] -= 0.9
    wide[1, 40:45] += 0.8
    rows = [(1, f"e{e}", p + 1, b, float(wide[e, p, k])) for e in range(3) for p in range(length) for k, b in enumerate("ACGT") if rng.random() < 0.9]
    deltas = spark.createDataFrame(rows, "condition int, idx string, position int, nucleotide string, delta double")
    lengths = spark.createDataFrame([(f"e{e}", length) for e in range(3)], "idx string, length int")
    matrix = np.zeros((3, length, 4))
    for _, e, p, b, v in rows:
        matrix[int(e[1]), p - 1, "ACGT".index(b)] = v
    got = {(r.idx, r.position): (r.A, r.C, r.G, r["T"], r.effect) for r in seq_ops.effect_matrix(deltas, lengths).collect()}
    for e in range(3):
        for p in range(length):
            assert got[f"e{e}", p + 1] == pytest.approx([*matrix[e, p], -matrix[e, p].sum() / 3])
    kernel = np.exp(-0.5 * (np.arange(-4, 5) / 1.1) ** 2)
    kernel /= kernel.sum()
    want = set()
    for e in range(3):
        effect = -matrix[e].sum(axis=1) / 3
        smooth = np.convolve(np.pad(effect, 4, mode="symmetric"), kernel, "valid")
        spread = (np.percentile(smooth, 75) - np.percentile(smooth, 25)) / 1.349
        z = (smooth - np.median(smooth)) / spread
        for direction in (1, -1):
            at = np.flatnonzero(z * direction > 3)
            for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                if len(run) >= 3 and effect[run].mean() * direction >= 0.25:
                    want.add((f"e{e}", direction, int(run[0]) + 1, int(run[-1]) + 2))
    assert {(r.idx, r.direction, r.start, r.stop) for r in seq_ops.effect_blocks(deltas, lengths).collect()} == want and len(want) >= 2


def test_differential_test_counts_replicates(spark):
    rows = [("a", "s1", 500, 500), ("a", "s2", 510, 490), ("b", "s3", 700, 300), ("b", "s4", 690, 310)]
    noisy = [("a", "s1", 100, 900), ("a", "s2", 910, 90), ("b", "s3", 980, 20), ("b", "s4", 410, 590)]
    table = spark.createDataFrame([(c, s, e, i, k) for e, part in (("even", rows), ("noisy", noisy)) for c, s, i, k in part], "condition string, sample string, event string, included long, skipped long")
    sides = spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], "condition string, contrast string, side int")
    got = {r.event: r for r in contrasts.differential_test(table, sides, 0.0).collect()}
    for event, part in (("even", rows), ("noisy", noisy)):
        chi = sum((i - (i + k) * p) ** 2 / ((i + k) * p * (1 - p)) for c in "ab" for p in [sum(r[2] for r in part if r[0] == c) / 2000] for o, _, i, k in part if o == c)
        assert got[event].df == 2 and got[event].dispersion == pytest.approx(max(1.0, chi / 2))
    assert got["even"].p < 0.01 < 0.2 < got["noisy"].p
    x = (got["even"].g / got["even"].dispersion) ** 0.5
    assert got["even"].p == pytest.approx(1 - x / (2 + x * x) ** 0.5, rel=1e-6)  # Student's t with two degrees of freedom
    single = contrasts.differential_test(table.where("sample in ('s1', 's3') and event = 'even'"), sides, 0.0).first()
    assert single.dispersion is None and single.p == pytest.approx(math.erfc((single.g / 2) ** 0.5), rel=1e-6)


def test_interval_test_against_a_grid(spark):
    rng = np.random.default_rng(21)
    cells = rng.integers(0, 60, (60, 4))
    cells[:4] = [[0, 30, 25, 0], [40, 0, 0, 40], [0, 0, 5, 5], [50, 0, 20, 1]]
    rows = [(c, f"{c}", f"e{e}", int(cells[e][2 * k]), int(cells[e][2 * k + 1])) for e in range(60) for k, c in enumerate("ab")]
    table = spark.createDataFrame(rows, "condition string, sample string, event string, included long, skipped long")
    sides = spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], "condition string, contrast string, side int")
    grid = np.linspace(0, 1, 20_001)

    def level(i, s, p):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(i > 0, i * np.log(p), 0.0) + np.where(s > 0, s * np.log(1 - p), 0.0)

    got = {r.event: r.g for r in contrasts.pooled_g(table, sides, 0.1).collect()}
    for e, (i1, s1, i2, s2) in enumerate(cells.tolist()):
        if i1 + s1 == 0 or i2 + s2 == 0 or abs(i1 / (i1 + s1) - i2 / (i2 + s2)) <= 0.1:
            assert got[f"e{e}"] == 0
            continue
        best = level(i1, s1, i1 / (i1 + s1)) + level(i2, s2, i2 / (i2 + s2))
        borders = [level(i1, s1, grid[2000:]) + level(i2, s2, grid[:-2000]), level(i1, s1, grid[:-2000]) + level(i2, s2, grid[2000:])]
        assert got[f"e{e}"] == pytest.approx(2 * (best - max(b.max() for b in borders)), rel=1e-3, abs=1e-3)


def test_interval_test_keeps_its_level(spark):
    """Shares 0.1 apart at most, replicates that scatter more than counting would: no more than 5 in 100 below 0.05."""
    rng = np.random.default_rng(22)
    rows = []
    for e in range(1500):
        base = rng.uniform(0.15, 0.75)
        for k, c in enumerate("ab"):
            for r in range(3):
                p = rng.beta(80 * (base + 0.1 * k), 80 * (1 - base - 0.1 * k))
                i = int(rng.binomial(200, p))
                rows.append((c, f"{c}{r}", f"e{e}", i, 200 - i))
    table = spark.createDataFrame(rows, "condition string, sample string, event string, included long, skipped long")
    sides = spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], "condition string, contrast string, side int")
    found = contrasts.differential_test(table, sides).collect()
    assert len(found) == 1500 and np.mean([r.p < 0.05 for r in found]) < 0.06
    apart = table.withColumn("included", F.when(F.col("condition") == "b", F.least(F.col("included") + 60, F.lit(200))).otherwise(F.col("included"))).withColumn("skipped", 200 - F.col("included"))
    assert np.mean([r.fdr < 0.05 for r in contrasts.differential_test(apart, sides).collect()]) > 0.5


def test_motif_test_tail_and_smoothing(spark):
    rng = np.random.default_rng(23)
    seqs_ = ["".join(rng.choice(list("ACGT"), rng.integers(5, 40))) for _ in range(200)]
    rows = [(i, "en" if i % 3 else "de", s, float(rng.normal() + 0.4 * ("ACG" in s))) for i, s in enumerate(seqs_)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, seq string, x double")
    for r in seq_ops.motif_test(df, ["ACG", "TT"], "x").collect():
        grid = np.linspace(r.t, r.t + 400, 2_000_001)
        density = math.exp(math.lgamma((r.df + 1) / 2) - math.lgamma(r.df / 2)) / math.sqrt(r.df * math.pi) * (1 + grid**2 / r.df) ** (-(r.df + 1) / 2)
        assert r.p == pytest.approx(np.trapezoid(density, grid), abs=1e-6) and r.fdr >= r.p
    longest = max(map(len, seqs_))
    for share in (0.1, 0.3):
        size = max(3, math.ceil(longest * share))
        mid = math.ceil(size / 2)
        weights = np.array([*range(1, mid + 1), *range(size - mid, 0, -1)], float)
        weights /= weights.sum()
        got = {(r.lang, r.position): (r.n, r.smooth) for r in seq_ops.motif_counts_smoothed(df, "AC", 2, share=share).collect()}
        assert len(got) == 2 * longest
        for lang in ("en", "de"):
            counts_ = np.array([sum(s[p : p + 2] == "AC" for _, g, s, _ in rows if g == lang) for p in range(longest)])
            for p in range(longest):
                a, c = p + size // 2 - size + 1, p + size // 2
                smooth = float(counts_[a : c + 1] @ weights) if a >= 0 and c < longest else None
                assert got[lang, p + 1][0] == counts_[p] and got[lang, p + 1][1] == (None if smooth is None else pytest.approx(smooth))


def test_tables_go_when_their_block_ends(spark):
    from isoflow.sources.scratch import temporary, written

    stays = written(spark.range(3).toDF("x"), "stays")
    with temporary(spark):
        goes = written(stays.withColumn("y", F.col("x") + 1), "goes")
        assert goes.count() == 3
        files = goes.inputFiles()
    import os

    assert not any(os.path.exists(f.removeprefix("file://")) for f in files) and stays.count() == 3


def test_log_odds(spark):
    r = spark.createDataFrame([(0.2,)], "p double").select(psi.logit(F.col("p")).alias("x"), psi.inverse_logit(psi.logit(F.col("p"))).alias("p"), psi.logit(F.lit(1.0)).alias("n")).first()
    assert r.x == pytest.approx(math.log(0.25)) and r.p == pytest.approx(0.2) and r.n is None


def test_two_component_mixture_separates(spark):
    from isoflow.operators import models

    rows = [("g", f"c{i}", v) for i, v in enumerate([0.1, 0.2, 0.15, 0.12, 5.0, 5.1, 4.9, 5.2])]
    got = {r.cell_line: r.cluster for r in models.gmm_1d(spark.createDataFrame(rows, "gene string, cell_line string, value double")).collect()}
    assert got == {f"c{i}": 1 + (i >= 4) for i in range(8)}


def test_fastq_files_of_many_splits(spark, tmp_path):
    rng = random.Random(9)
    want = {}
    for name, n in (("a.fastq", 700), ("b.fastq", 3), ("c.fastq", 250)):
        rows = [(f"{name}{i}_BC_UMI", "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 90)))) for i in range(n)]
        text = "".join(f"@{r}\n{s}\n+\n{'I' * len(s)}\n" for r, s in rows)
        (tmp_path / name).write_text(text)
        want |= {r: (s, "I" * len(s), name) for r, s in rows}
    found = tables.read_fastq(spark, str(tmp_path / "*.fastq"), split_bytes=5000)
    assert found.rdd.getNumPartitions() > 20
    got = {r.read_id: (r.seq, r.qual, r.file.rsplit("/", 1)[1]) for r in found.collect()}
    assert got == want
