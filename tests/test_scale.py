"""Operators whose work must not grow faster than their results."""

import random
from itertools import accumulate

import numpy as np
import pytest

from isoflow.functions import edits
from isoflow.functions.fingerprints import Rolling
from isoflow.operators import reads, sequences, stats


def test_replicate_r2_in_blocks_equals_numpy(spark):
    rng = random.Random(3)
    samples = {s: s % 2 for s in range(30)}
    psi = {(s, e): (0.25 if s in (4, 6) else rng.random()) for s in samples for e in "abcdefg" if rng.random() < 0.7}
    psi |= {(28, "only"): 0.5, (26, "only"): 0.1}
    df = spark.createDataFrame([(s, samples[s], e, v) for (s, e), v in psi.items()] + [(2, 0, "a2", None)], "sample long, condition int, event string, psi double")
    want = {}
    for a in samples:
        for b in samples:
            shared = [e for e in [*"abcdefg", "only"] if (a, e) in psi and (b, e) in psi]
            if a < b and samples[a] == samples[b] and shared:
                x, y = ([psi[s, e] for e in shared] for s in (a, b))
                flat = len(shared) == 1 or len(set(x)) == 1 or len(set(y)) == 1
                want[samples[a], a, b] = (None if flat else pytest.approx(np.corrcoef(x, y)[0, 1] ** 2, abs=1e-9), len(shared))
    for block in (4, 512):
        out = stats.replicate_r2(df, block=block)
        assert "FlatMapCoGroups" in out._jdf.queryExecution().optimizedPlan().toString()  # no row for each pair and event
        got = {(r.condition, r.a, r.b): (r.r2, r.n) for r in out.collect()}
        assert got == want and any(r is None for r, _ in want.values())


@pytest.mark.parametrize("few", [0, 4096])
def test_nearest_distances_with_and_without_segments(spark, monkeypatch, few):
    monkeypatch.setattr(sequences, "FEW_REFS", few)
    rng = random.Random(5)
    word = lambda low, high: "".join(rng.choices("ACGT", k=rng.randint(low, high)))
    refs, asked = [word(0, 140) for _ in range(40)], [word(0, 140) for _ in range(60)]
    asked += refs[:5] + [r[1:] for r in refs[5:9]]
    want = edits.distances(asked, refs).min(axis=1).tolist()
    assert edits.nearest(sorted(asked, key=len), sorted(refs, key=len)).tolist() == [dict(zip(asked, want))[s] for s in sorted(asked, key=len)]
    calls = []
    monkeypatch.setattr(sequences, "_within", lambda *a, _f=sequences._within: calls.append(1) or _f(*a))
    frame = lambda x: spark.createDataFrame([(s,) for s in x], "seq string")
    got = {r.seq: r.distance for r in sequences.min_edit_distance(frame(asked), frame(refs)).collect()}
    assert got == dict(zip(asked, want)) and bool(calls) == (few == 0)  # no offers of segments for a small library


def test_nearest_distances_in_bulk(monkeypatch):
    for name, n in (("BULK", 40), ("BLOCK_TEXTS", 100), ("PILOT", 8)):
        monkeypatch.setattr(edits, name, n)
    stepped = []
    monkeypatch.setattr(edits.Band, "distances", lambda band, *a, _f=edits.Band.distances: stepped.append(band.n) or _f(band, *a))
    rng = random.Random(21)
    word = lambda n: "".join(rng.choices("ACGT", k=n))
    for n in (1, 6, 30, 64, 90, 300):
        refs = sorted([word(rng.randint(0, 2 * n)) for _ in range(25)] + [word(n) for _ in range(5)], key=len)
        texts = [word(n) for _ in range(130)] + [word(rng.randint(0, n)) for _ in range(30)] + ["é" * n, refs[0], refs[-1], *refs[:3]]
        texts += [s[:i] + "A" + s[i + 2 :] + "C" for s in refs if len(s) == n for i in range(0, n, 7)]  # some are near
        assert edits.nearest_in_bulk(texts, refs).tolist() == edits.distances(texts, refs).min(axis=1).tolist()
        assert edits.nearest_in_bulk([], refs).tolist() == []
    assert {6, 30, 64, 90, 300} <= set(stepped)
    assert edits.nearest_in_bulk([word(4) for _ in range(60)], [""]).tolist() == [4] * 60


def test_small_libraries_go_to_the_designs(spark, monkeypatch):
    rng = random.Random(22)
    word = lambda n: "".join(rng.choices("ACGT", k=n))
    refs, asked = [word(rng.randint(20, 60)) for _ in range(30)], [word(60) for _ in range(300)] + [word(rng.randint(0, 60)) for _ in range(40)]
    rows = [(i % 7, s) for i, s in enumerate(asked * 2)] + [(0, None), (1, None), (1, refs[0])]
    designs, library = spark.createDataFrame(rows, "doc_id long, seq string"), spark.createDataFrame([(r,) for r in refs], "seq string")
    out = sequences.min_edit_distance(designs, library)
    want = dict(zip(asked, edits.distances(asked, refs).min(axis=1).tolist())) | {None: None, refs[0]: 0}
    plain = lambda df: sorted((r.doc_id, r.seq or "", -1 if r.distance is None else r.distance) for r in df.collect())
    assert plain(out) == sorted((i, s or "", -1 if want[s] is None else want[s]) for i, s in rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "Join" not in plan and "Aggregate" not in plan  # every sequence was shuffled five times
    for name, n in (("FEW_REFS", 0), ("BLOCK_SEQUENCES", 16), ("TILE", (3, 5))):
        monkeypatch.setattr(sequences, name, n)
    assert plain(sequences.min_edit_distance(designs, library)) == plain(out)


def test_exons_offer_only_what_is_sought(spark):
    rng = random.Random(6)
    dna = lambda n: "".join(rng.choices("ACGT", k=n))
    long = [dna(rng.randint(300, 600)) for _ in range(60)]
    inner = [e[a : a + n] for n in (9, 20, 31, 32, 33, 63, 64, 100, 255, 256, 299) for e, a in [(rng.choice(long), rng.randint(0, 1))]]
    exons = dict(enumerate(long + inner + [dna(40), long[3], long[3]]))
    library = spark.createDataFrame(list(exons.items()), "idx long, exon string")
    want = {(a, b) for a, x in exons.items() for b, y in exons.items() if a != b and x in y and (len(y) > len(x) or b < a)}
    rows = [tuple(r) for r in reads.contained_exons(library).collect()]
    assert set(rows) == want and len(rows) == len(want) > len(inner)
    sought = reads._sought(spark.createDataFrame(list(enumerate(inner)), "alt long, a string"))
    levels = sorted({reads._level(len(e))[0] for e in inner})
    offered = reads._offered(spark.createDataFrame(list(enumerate(long)), "ref long, b string"), levels, reads._table(sought))
    assert offered.count() < 40  # all substrings of 1, 2, 4, ... letters before: over 100,000


@pytest.mark.parametrize("often, few, share", [(64, 500_000, 2000), (2, 500_000, 3), (2, 5, 3), (0, 500_000, 1)])
def test_contained_exons_shuffle_no_pairs(spark, monkeypatch, often, few, share):
    monkeypatch.setattr(reads, "OFTEN", often)
    monkeypatch.setattr(reads, "FEW_SHORT", few)
    rng = random.Random(19)
    dna = lambda n: "".join(rng.choices("ACGT", k=n))
    line = dna(120)
    exons = [dna(rng.randint(0, 90)) + line + dna(rng.randint(0, 90)) for _ in range(30)] + [line[a : a + n] for n in (1, 9, 11, 12, 14, 15, 16, 24, 31, 32, 40, 64, 100) for a in (0, 3, 20)]
    exons += [line[:40]] * 5 + [line[5:18]] * 4 + ["", None, "ACGTACGTACGT" * 3, "ACGTACGTACGTACG", "ACGTACGTACGTA\0ACG", "TACGTACGTACGTA", "ACGTACGTACGT\0ACGTACGTACGTA\0ACGT", "é漢" * 20, "漢é漢é漢é漢é漢é漢é漢"]
    named = {f"e{i:03d}": e for i, e in enumerate(exons)}
    library = spark.createDataFrame(list(named.items()), "idx string, exon string").repartition(5)
    want = sorted((a, b) for a, x in named.items() for b, y in named.items() if a != b and x and y and x in y and (len(y) > len(x) or b < a))
    out = reads.contained_exons(library, share)
    assert sorted(map(tuple, out.collect())) == want and len(want) > 1500
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == (3 if often else 2) and "Aggregate" not in plan  # pairs were joined with the members of both sides


def test_reads_meet_few_elements_however_frequent_their_seeds(spark, monkeypatch):
    rng = random.Random(8)
    dna = lambda n: "".join(rng.choices("ACGT", k=n))
    common = dna(50)
    library = {f"e{i:03d}": dna(20) + common + dna(50) for i in range(200)}
    queries = [(f"r{i:03d}", e, x[10:100]) for i, (e, x) in enumerate(library.items())] + [("only", "e000", common), ("again", "e001", common)]
    met = []
    monkeypatch.setattr(reads, "_meeting", lambda *a, _f=reads._meeting: met.append(_f(*a)) or met[-1])
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    got = {r.read_id: r.mapped for r in reads.best_hits(frame(queries, ("read_id", "idx", "seq")), frame(list(library.items()), ("idx", "exon"))).collect()}
    assert got == {r: e for r, e, _ in queries[:-2]} | {"only": "e000", "again": "e000"}
    assert sum(m.count() for m in met) < 3 * len(library)  # about 200 x 200 before


def test_reads_meet_only_what_may_hold_all_their_seeds(spark, monkeypatch):
    rng = random.Random(18)
    dna = lambda n: "".join(rng.choices("ACGT", k=n))
    blocks = [dna(30) for _ in range(6)]
    exons = sorted({"".join(rng.choices(blocks, k=4)) for _ in range(150)})  # no seed of theirs is rare
    library = {f"e{i:03d}": x for i, x in enumerate(exons)}
    queries = [(f"r{e}", e, x) for e, x in library.items()] + [("odd", "e000", exons[0][:60] + dna(40) + exons[0][60:]), ("bits", "e001", exons[1][3:50] + "A"), ("few", "e002", "ACG")]
    met = []
    monkeypatch.setattr(reads, "_meeting", lambda *a, _f=reads._meeting: met.append(_f(*a).cache()) or met[-1])
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    got = {r.read_id: (r.mapped, r.chain) for r in reads.best_hits(frame(queries, ("read_id", "idx", "seq")), frame(list(library.items()), ("idx", "exon"))).collect()}

    def seeds(x):
        prints = Rolling(x).all(15).tolist()
        return [prints[at] for at in sorted({min((h, i) for i, h in enumerate(prints[a : a + 5], a))[1] for a in range(max(0, len(prints) - 4))})]

    def longest(a, b):
        best = [0] * (len(b) + 1)
        for p in a:
            best = list(accumulate([0] + [max(best[j + 1], (best[j] + 1) * (p == q)) for j, q in enumerate(b)], max))
        return best[-1]

    there = {e: seeds(x) for e, x in library.items()}
    want = {}
    for r, _, x in queries:
        n, e = min((-longest(seeds(x), s), e) for e, s in there.items())
        want |= {r: (e, -n)} if n <= -2 else {}
    assert got == want and len(want) == len(queries) - 1
    assert met[0].count() < 2 * len(library)  # about 12 with the rarest seed of each before


def test_kmer_totals_count_keys_once_and_in_tasks(spark):
    rows = [(1, "ACGTACGT"), (2, "ACGTT"), (2, "ACGTA"), (None, "ACGTA"), (3, ""), (4, None), (5, "ACG")]
    out = sequences.kmer_totals(spark.createDataFrame(rows, "doc_id long, seq string"), 4)
    want = {}
    for key, s in rows:
        for i in range(len(s or "") - 3):
            n, docs = want.setdefault(s[i : i + 4], [0, set()])
            want[s[i : i + 4]][0] += 1
            docs |= {key} - {None}
    assert {r.kmer: (r.n, r.n_docs) for r in out.collect()} == {x: (n, len(docs)) for x, (n, docs) in want.items()}
    assert "MapInPandas" in out._jdf.queryExecution().optimizedPlan().toString()


def test_kmer_counting_holds_little_at_once():
    import tracemalloc

    from isoflow.functions import kmer_counts

    seqs = ["ACGTTGCA" * 250] * 2000  # 4 million letters, of a batch of texts
    tracemalloc.start()
    for first, last in kmer_counts.groups(seqs):
        kmer_counts.distinct(seqs[first:last], 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000


def test_windows_are_written_once_and_stay_where_they_are(spark, tmp_path):
    from isoflow.functions.sequences import windows
    from isoflow.plans import registry

    docs = [(1, "abcd" * 120, "en"), (2, "abcc" * 60, "en"), (3, "bbbb", "en"), (4, "dcba" * 55, None), (5, None, "en"), (6, "", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "'web' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = registry.queries()["substitutions"](spark, str(tmp_path))
        plan = out._jdf.queryExecution().executedPlan().toString()
        rows = [tuple(r) for r in out.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # half of all windows met one parent in one task
    assert not any("documents.parquet" in f for f in out.inputFiles())  # texts were cleaned and cut twice
    first = "ACGT" * 50
    texts = {i: s.upper().translate(str.maketrans("ABCD", "ACGT")) for i, s, g in docs if s and g}
    want = [(i, w, "en", k + 1, first[k], b) for i, s in texts.items() for w in range(-(-len(s) // 200)) for k, b in enumerate(s[200 * w : 200 * w + 200]) if b != first[k]]
    assert sorted(rows) == sorted(want)
    odd = spark.createDataFrame([("a\n\U0001f600bc\r",), ("",), (None,)], "s string")
    assert [r.w for r in odd.select(windows(odd.s, 2).alias("w")).collect()] == [[(0, "a\n"), (1, "\U0001f600b"), (2, "c\r")], [], None]


def test_kmer_queries_hand_python_few_bytes_at_once(spark, monkeypatch):
    monkeypatch.setattr(sequences, "BATCH_BYTES", 1 << 16)
    rows = spark.range(3000, numPartitions=1).selectExpr("id AS doc_id", "id % 2 = 0 AS grp", "'en' AS lang", "repeat('ACGTTGCA', 250) AS seq")
    got = sequences.kmer_enrichment(rows, 4).collect()
    assert len(got) == 8 and all((r.a, r.b, r.c, r.d) == (1500, 0, 1500, 0) for r in got)
    sizes = rows.select("seq").mapInPandas(lambda batches: (b.agg(lambda s: s.str.len().sum()).to_frame("n") for b in batches), "n long")
    n = [r.n for r in sizes.collect()]
    assert sum(n) == 6_000_000 and max(n) < 100_000  # one batch of 6 million letters before


def test_tasks_of_false_discovery_do_not_grow(spark, monkeypatch):
    table = spark.range(4000).selectExpr("id", "id % 50 AS g", "(id * 37 % 101) / 101D AS p")
    ordered = lambda df: {r.id: r.fdr for r in df.collect()}
    want = ordered(stats.bh_adjust(table, by=("g",)))
    monkeypatch.setattr(stats, "TASK_ROWS", 200)
    got = stats.bh_adjust(table, by=("g",))
    assert ordered(got) == want and got.rdd.getNumPartitions() == 20  # as many as the session's shuffles before, whatever the size
    monkeypatch.setattr(stats, "FEW", 10)
    asked = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    monkeypatch.setattr(stats, "written", lambda df, name, _w=stats.written: seen.append((name, spark.conf.get("spark.sql.shuffle.partitions"))) or _w(df, name))
    assert ordered(stats.bh_adjust(table, by=("g",))) == pytest.approx(want)
    assert {n for name, n in seen if name != "tested"} == {"20"} and seen[-1][0] == "adjusted" and spark.conf.get("spark.sql.shuffle.partitions") == asked


def test_motif_starts_are_summed_in_tasks(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, rng.choice(["en", "de", None]), rng.choice([None, "", "TCAT" * rng.randint(1, 9), "".join(rng.choices("ACGTé", k=rng.randint(0, 700)))])) for i in range(150)]
    spark.createDataFrame(rows, "doc_id long, lang string, seq string").repartition(3).write.parquet(f"{tmp_path}/s")
    table = spark.read.parquet(f"{tmp_path}/s")
    hit = lambda s, p: s[p] in "CT" and s[p + 1 : p + 3] == "CA" and s[p + 3] in "CT"
    want = {}
    for _, g, s in rows:
        for p in range(len(s or "") - 3):
            if g and hit(s, p):
                want[g, p + 1] = want.get((g, p + 1), 0) + 1
    total = {g: sum(x == g for _, x, _ in rows) for g in ("en", "de")}
    profile = sequences.motif_profile(table, "YCAY", 4)
    assert {(r.lang, r.position): r.share for r in profile.collect()} == pytest.approx({k: n / total[k[0]] for k, n in want.items()})
    smooth = sequences.motif_counts_smoothed(table, "YCAY", 4)
    longest = max(len(s or "") for _, _, s in rows)
    got = {(r.lang, r.position): r.n for r in smooth.collect()}
    assert len(got) == 3 * longest and {k: n for k, n in got.items() if n} == want
    assert not any(str(tmp_path) in f for f in profile.inputFiles() + smooth.inputFiles())  # sequences are read once, each place was looked up
    assert sequences.motif_counts_smoothed(table.where("false"), "YCAY", 4).count() == 0


def test_alternative_sites_need_no_grid_of_samples(spark):
    from isoflow.operators import contrasts as K

    rng = random.Random(10)
    rows = [(s, s % 3, i, u, d, rng.choice([0, 1, 5, 30])) for s in range(40) for i in "xy" for u in range(3) for d in range(2) if rng.random() < 0.4]
    counts = spark.createDataFrame(rows, "sample long, condition int, idx string, up_off int, down_off int, cnt long")
    pairs = spark.createDataFrame([(i, 0, 0, u, d) for i in "xyz" for u in range(3) for d in range(2) if u or d], "idx string, major_up int, major_down int, minor_up int, minor_down int")
    sides = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("a", 2, 2), ("b", 1, 1), ("b", 2, 1)], "contrast string, side int, condition int")
    key = lambda r: (r.contrast, r.idx, r.minor_up, r.minor_down)
    want = {key(r): (r.share1, r.share2) for r in K.altss_contrast(K.altss_share(counts, pairs), sides, 0.0).collect()}
    sums = K.altss_sums(counts, pairs)
    got = {key(r): (r.share1, r.share2) for r in K.altss_contrast_of_sums(sums, sides, 0.0).collect()}
    cnt = {(s, i, u, d): n for s, _, i, u, d, n in rows}
    brute = {}
    for i, u, d in {(i, u, d) for _, _, i, u, d, _ in rows if u or d}:
        of = [[a / (a + b) for s in range(40) if s % 3 in c for a, b in [(cnt.get((s, i, 0, 0), 0), cnt.get((s, i, u, d), 0))] if a + b] for c in ((0,), (1, 2))]
        brute["a", i, u, d] = tuple(sum(x) / len(x) for x in of)
    assert set(got) == set(want) and {k: v for k, v in got.items() if k[0] == "a"} == {k: pytest.approx(v) for k, v in brute.items()}
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert "NestedLoop" not in sums._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in sums._jdf.queryExecution().executedPlan().toString()
