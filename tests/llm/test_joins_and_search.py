import hashlib
import itertools
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from isoflow.llm import ann, jaccard_join, license_scan, suffix_dedup, url_filter
from isoflow.llm.components import connected_components
from tests.conftest import TESTDATA
from tests.llm.conftest import ODD

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_components(rows):
    sets = []
    for i, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
        sets.append((i, frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) > 4 else frozenset([tuple(words)] if words else [])))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, (i, s)), (b, (j, t)) in itertools.combinations(enumerate(sets), 2):
        if s and t and 100 * len(s & t) >= 80 * len(s | t):
            parent[find(a)] = find(b)
    smallest = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            smallest[find(a)] = min(i, smallest.get(find(a), i))
    return Counter((i, len(s), smallest.get(find(a))) for a, (i, s) in enumerate(sets))


def test_jaccard_components_of_odd_documents(odd_docs, no_docs):
    got = Counter(map(tuple, jaccard_join.jaccard_components(odd_docs).collect()))
    assert got == brute_components([(r[0], r[1]) for r in ODD])
    assert jaccard_join.jaccard_components(no_docs).count() == 0


def test_jaccard_components_with_small_blocks_and_shuffle_joins(spark):
    rng = np.random.default_rng(4)
    rows = []
    for family in range(12):
        base = [f"w{rng.integers(0, 500)}" for _ in range(int(rng.integers(6, 160)))]
        for _ in range(8):
            words = list(base)
            for _ in range(int(rng.integers(0, 6))):
                words[int(rng.integers(0, len(words)))] = f"x{rng.integers(0, 500)}"
            rows.append((len(rows) + 1, " ".join(words[: len(words) - int(rng.integers(0, 4))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, jaccard_join.jaccard_components(docs, block=3, broadcast_rows=0).collect()))
    assert got == brute_components(rows)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    for n in (4, 9, 30, 200, 1500):
        for _ in range(40):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            drop = int(rng.integers(0, n // 9 + 1))
            b = np.concatenate([a[drop:], rng.integers(0, 1 << 63, drop, dtype=np.uint64)])
            assert jaccard_join.hamming(jaccard_join.bit_sketch(a), jaccard_join.bit_sketch(b)) <= 2 * drop
            if 100 * (n - drop) >= 80 * (n + drop) and drop:
                assert set(jaccard_join.join_keys(a)) & set(jaccard_join.join_keys(b))


def test_every_linked_pair_shares_a_key():
    """Differences as large as a link allows, and sets so small that whole sketches may stay empty."""
    rng = np.random.default_rng(15)
    for n in [*range(4, 60), 100, 333, 1000]:
        for extra in {0, n // 8, n // 4}:
            most = jaccard_join.allowed(n, n + extra)
            drop = (most - extra) // 2
            for _ in range(60 if n < 60 else 6):
                a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
                b = np.concatenate([a[drop:], rng.integers(0, 1 << 63, drop + extra, dtype=np.uint64)])
                if drop >= 0 and 100 * (n - drop) >= 80 * (n + drop + extra):
                    assert set(jaccard_join.join_keys(a)) & set(jaccard_join.join_keys(b)), (n, extra)


def test_sets_at_risk_offer_their_empty_words():
    """Tokens that all fall on one word under each seed leave every other word empty."""
    def places(t):
        (level, words, _), *_ = jaccard_join.levels(4, 80, 100)
        spread = [jaccard_join.mix(t + np.uint64((s * 2 + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) for s in range(-(-jaccard_join.SEED_WORDS // words))]
        return np.stack([((x >> np.uint64(32)) * np.uint64(words)) >> np.uint64(32) for x in spread])

    tokens = np.random.default_rng(16).integers(0, 1 << 63, 300_000, dtype=np.uint64)
    where = places(tokens)
    same = tokens[(where == where[:, :1]).all(axis=0)]
    assert len(same) >= 9
    a, b = same[:4], np.concatenate([same[:4], same[5:6]])
    assert set(jaccard_join.join_keys(a)) & set(jaccard_join.join_keys(b))
    (_, words, most), *_ = jaccard_join.levels(4, 80, 100)
    assert len(jaccard_join.join_keys(a)) >= words


def near_family(n, seed=17):
    rng = np.random.default_rng(seed)
    base = [f"w{rng.integers(0, 900)}" for _ in range(150)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(int(rng.integers(0, 9))):
            words[int(rng.integers(0, 150))] = f"x{rng.integers(0, 100_000)}"
        rows.append((i, " ".join(words)))
    return rows


def test_candidates_of_a_family_grow_with_its_size(spark, monkeypatch):
    seen = []
    whole = jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda pairs, *rest: (seen.append(pairs.count()), whole(pairs, *rest))[1])
    counts = []
    for n in (150, 600):
        seen.clear()
        rows = near_family(n)
        got = Counter(map(tuple, jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
        counts.append(sum(seen))
        if n == 150:
            assert got == brute_components(rows)
    assert counts[1] <= 4.4 * counts[0]


def test_one_row_of_each_near_group_stays(spark):
    words = [f"w{i}" for i in range(100)]
    near = " ".join(words)
    rows = [(5, near, "a"), (9, near + " end", "b"), (5, "another text with more than five words in it", "c"), (5, near, "d"), (None, near + " tail", "e"), (None, "x y", "f"), (3, "x y", "g"), (7, None, "h"), (7, None, "h"), (8, "", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _md5 string")
    for limit in (250_000, 0):
        kept = sorted(map(tuple, jaccard_join.without_near_copies(docs, broadcast_rows=limit).drop("_md5").collect()), key=repr)
        assert kept == sorted([(5, near), (5, rows[2][1]), (3, "x y"), (7, None), (7, None), (8, "")], key=repr)
    assert jaccard_join.without_near_copies(docs.where("false")).columns == docs.columns


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (200, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def brute_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        mark = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        kept = bytes(b for b, m in zip(r, mark) if not m)
        out.append((len(r), sum(mark), sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup_of_odd_documents(odd_docs, no_docs):
    got = Counter(map(tuple, suffix_dedup.remove_repeats(odd_docs).drop("kept").collect()))
    assert got == Counter((r[0], *w) for r, w in zip(ODD, brute_repeats([r[1] for r in ODD], 200)))
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_suffix_dedup_of_spliced_texts(spark):
    rng = np.random.default_rng(6)
    pool = ["".join(rng.choice(list("abcde "), 90)) for _ in range(12)]
    rows = [(i, "".join(pool[int(k)][int(rng.integers(0, 30)) : int(rng.integers(50, 90))] for k in rng.integers(0, 12, int(rng.integers(0, 12))))) for i in range(120)]
    want = {i: w for (i, _), w in zip(rows, brute_repeats([t for _, t in rows], 40))}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for split in (3000, 2):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, 40, 12, split=split).collect()}
        assert got == want


def test_suffix_dedup_of_copies_lists_each_span_once(spark, monkeypatch):
    text = "".join(np.random.default_rng(3).choice(list("abcdefgh "), 4000))
    docs = spark.createDataFrame([(1, text)] * 40 + [(2, text[:2000])], "doc_id long, text string")
    seen = []
    whole = suffix_dedup.repeated_spans
    monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda *a: (seen.append(whole(*a)), seen[-1])[1])
    got = {(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == {(1, 4000, 4000), (2, 2000, 2000)}
    assert seen[0].count() < 200


def test_long_texts_are_scanned_in_segments():
    rng = np.random.default_rng(7)
    raw = rng.integers(97, 101, 5000, dtype=np.uint8).tobytes()
    whole = suffix_dedup.anchors([(raw, 0, 0, len(raw))], 40, 12)
    cut = suffix_dedup.anchors([(raw[a:b], a, c, d) for a, b, c, d in suffix_dedup.segments(raw, 40, 700)], 40, 12)
    assert sorted(zip(whole[1], whole[2], whole[3])) == sorted(zip(cut[1], cut[2], cut[3]))


def test_suffix_mergesort():
    rng = np.random.default_rng(8)
    data = rng.integers(97, 99, 3000, dtype=np.uint8)
    order = suffix_dedup.SuffixOrder(data)
    suffixes, groups = rng.integers(0, 2900, 500), np.sort(rng.integers(0, 40, 500))
    ranked = order.mergesort(suffixes, np.full(500, 50), groups)
    raw = data.tobytes()
    keys = [(groups[i], raw[suffixes[i] : suffixes[i] + 50]) for i in ranked]
    assert keys == sorted(keys)


def brute_search(ids, x, query_ids, k):
    out = {}
    for q in query_ids:
        v = x[list(ids).index(q)]
        scored = sorted((-float((x[i] * v).sum()), int(ids[i])) for i in range(len(ids)) if ids[i] != q)
        out[q] = [b for _, b in scored[:k]]
    return out


def test_search_beyond_the_range_of_doubles(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, 1.0]), (2, [-1e300, 1.0]), (3, [1.0, 1.0]), (4, [1e-300, 0.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == [1, 3, 4, 2]


def test_leaves_share_blocks_and_large_ones_have_several():
    first, parts = ann.deal_blocks({0: 3, 1: 4, 2: 25, 3: 1, 5: 9}, 6, 10)
    assert first.tolist() == [0, 0, 1, 4, 4, 4] and parts.tolist() == [1, 1, 3, 1, 1, 1]


def test_search_recall_and_order(spark):
    got = ann.op6_ann_search(spark, f"{TESTDATA}/sf0.01").toPandas()
    table = spark.read.parquet(f"{TESTDATA}/sf0.01/embeddings.parquet").toPandas()
    want = brute_search(table.vec_id.to_numpy(), np.stack(table.embedding).astype(float), [i for i in table.vec_id if i % 20 == 0], 20)
    found = got.sort_values(["query_id", "rank"]).groupby("query_id")["vec_id"].apply(list).to_dict()
    assert np.mean([len(set(found[q]) & set(w)) / len(w) for q, w in want.items()]) >= 0.9
    assert (got.groupby("query_id")["score"].diff().dropna() <= 0).all()


def test_search_edge_cases(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (2, [0.5, 0.5], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [None, 1.0], 1), (7, [float("inf"), 1.0], 1), (8, [1.0], 1), (None, [1.0, 1.0], 1), (20, [0.0, 1.0], 1), (40, None, 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf int")
    got = ann.search(vectors, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 2, 0.5), (0, 4, 20, 0.0), (20, 1, 2, 0.5), (20, 2, 0, 0.0), (20, 3, 1, 0.0), (20, 4, 1, 0.0)]
    assert ann.search(vectors.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_search_with_many_copies_in_small_blocks(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 8))
    x[100:300] = x[100]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(vectors, F.col("vec_id") % 20 == 0, recall=1.1, block=16).toPandas()
    found = got.sort_values(["query_id", "rank"]).groupby("query_id")["vec_id"].apply(list).to_dict()
    assert found == brute_search(np.arange(400), x, [i for i in range(400) if i % 20 == 0], 20)


def test_url_rules(spark):
    rules = spark.createDataFrame(url_filter.RULES + [("", "/", "block"), ("net", "", "block"), (None, "/", "block")], "host string, path string, verdict string")
    cases = [
        (1, "https://EXAMPLE.org/es/x", "example.org", "/es/x", "example.org/es/", "block"),
        (2, "http://www.example.org/en/1?q#f", "www.example.org", "/en/1", "example.org/en/1", "block"),
        (3, "http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        (4, "http://a.com/de/", "a.com", "/de/", "com/de/", "block"),
        (5, "http://a.com", "a.com", "", None, "allow"),
        (6, None, "", "", None, "allow"),
        (7, "no scheme", "", "", None, "allow"),
        (8, "x://org?://b", "org", "", None, "allow"),
        (9, "x://h.net", "h.net", "", "net", "block"),
        (9, "x://h.net", "h.net", "", "net", "block"),
        (None, "x://a.org/", "a.org", "/", "org/", "allow"),
        (10, "x://" + "a." * 3000 + "org/p", "a." * 3000 + "org", "/p", "org/", "allow"),
    ]
    pages = spark.createDataFrame([(i, u, "h", "p", 1) for i, u, *_ in cases], "page_id long, url string, host string, path string, row int")
    got = Counter(map(tuple, url_filter.filter_urls(pages, rules).collect()))
    assert got == Counter((i, *rest) for i, _, *rest in cases)
    assert url_filter.filter_urls(pages.where("false"), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.where("false")).collect()} == {"allow"}


def test_licences_are_inherited_from_the_nearest_directory(spark):
    rows = [
        ("a/LICENSE", "Some text\nReleased under the MIT License.\n"),
        ("a/x.py", "code"),
        ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("a/b/c/y.py", None),
        ("a/b/z.py", "# Licensed under the Apache License, Version 2.0."),
        ("d/e.py", ""),
        ("f.py", "see the licence text somewhere else, version 2 of it " * 2000),
        (None, "Released under the MIT License."),
        ("a/x.py", "code"),
    ]
    files = spark.createDataFrame([(p, t, 1) for p, t in rows], "path string, text string, line int")
    got = sorted([(r.path, r.own_license, r.license, r.licensed_by) for r in license_scan.scan_licenses(files).collect()], key=repr)
    assert got == sorted([
        ("a/LICENSE", "MIT", "MIT", None), ("a/x.py", None, "MIT", "a"), ("a/x.py", None, "MIT", "a"), ("a/b/COPYING", "GPL-3.0", "GPL-3.0", None), ("a/b/c/y.py", None, "GPL-3.0", "a/b"),
        ("a/b/z.py", "Apache-2.0", "Apache-2.0", None), ("d/e.py", None, None, None), ("f.py", None, None, None), (None, None, None, None),
    ], key=repr)
    assert license_scan.scan_licenses(files.where("false")).count() == 0


def test_headers_and_licence_files_are_compared_as_a_whole(spark):
    from isoflow.llm.license_texts import TEMPLATES

    texts = dict(reversed([(name, text) for name, text in TEMPLATES if len(text) > 200]))
    wrap = lambda text, mark, n=9: "\n".join(mark + " ".join(text.split()[k : k + n]) for k in range(0, len(text.split()), n))
    rows = [
        ("p/LICENSE", "MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + wrap(texts["MIT"], "")),
        ("q/LICENSE.txt", "Copyright (c) 2019, The Authors\n" + wrap(texts["BSD-3-Clause"], "  ")),
        ("q/deep/er/main.c", "int main() {}"),
        ("r/a.py", "#!/usr/bin/env python\n" + wrap(texts["Apache-2.0"], "# ") + "\n\nimport os\n"),
        ("r/b.c", "/*\n" + wrap(texts["GPL-3.0"], " * ", 7) + "\n */\nint x;"),
        ("r/c.py", "x = 1\n\n# SPDX-License-Identifier: MIT\ny = 2"),
        ("r/d.txt", "Some words first. Released under the MIT License. All rights reserved by someone else in this long sentence of words."),
        ("r/e.txt", "prose " * 60 + "\nLicensed under the\nApache License,\nVersion 2.0.\n" + "prose " * 60),
        ("r/f.txt", "A licence is mentioned, and software, in a long sentence about the history of copyright and the public."),
        ("s/COPYING", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\n" + "words of the long text " * 300),
        ("s/x/y.c", None),
    ]
    got = {r.path: (r.own_license, r.license) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {
        "p/LICENSE": ("MIT", "MIT"), "q/LICENSE.txt": ("BSD-3-Clause", "BSD-3-Clause"), "q/deep/er/main.c": (None, "BSD-3-Clause"), "r/a.py": ("Apache-2.0", "Apache-2.0"), "r/b.c": ("GPL-3.0", "GPL-3.0"),
        "r/c.py": ("MIT", "MIT"), "r/d.txt": ("MIT", "MIT"), "r/e.txt": ("Apache-2.0", "Apache-2.0"), "r/f.txt": (None, None), "s/COPYING": ("GPL-3.0", "GPL-3.0"), "s/x/y.c": (None, "GPL-3.0"),
    }


def test_licence_ties_go_to_the_template_listed_first(spark):
    files = spark.createDataFrame([("a", "Use it under the same words.")], "path string, text string")
    for names in (("A", "B"), ("B", "A")):
        assert license_scan.scan_licenses(files, [(n, "under the same words") for n in names], 0.1).first().own_license == names[0]


def test_relatives_and_versions_of_a_licence_are_told_apart(spark):
    named = {
        "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999": "LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": "LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE": "LGPL",
        "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007": "AGPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 2": "GPL-2.0", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991": "GPL-2.0",
        "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": "GPL-3.0", "GNU General Public License v3.0": "GPL-3.0", "GNU GENERAL PUBLIC LICENSE": "GPL", "Attribution-ShareAlike 4.0": "CC-BY-SA-4.0",
        "Creative Commons Attribution-ShareAlike 4.0 International": "CC-BY-SA-4.0", "Attribution-NoDerivatives 4.0 International": "CC-BY-ND-4.0", "Creative Commons Attribution 4.0 International": "CC-BY-4.0",
        "Creative Commons Attribution-NonCommercial 4.0 International": "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International": None, "Licensed under CC BY-NC-ND 4.0.": None,
        "The Apache Software License, Version 1.1": "Apache-1.1", "Apache License\nVersion 2.0, January 2004": "Apache-2.0", "Licensed under the Apache License, Version 1.0.": None,
        "Mozilla Public License Version 1.1": "MPL-1.1", "Mozilla Public License Version 2.0": "MPL-2.0", "This is not released under the MIT License.": None, "It isn't released under the MIT License": None,
        "Released under the MIT License.": "MIT", "SPDX-License-Identifier: ISC": "ISC", "SPDX-License-Identifier: LGPL-2.1": "LGPL-2.1", "SPDX-License-Identifier: Zlib": None, "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
    }
    rows = [(f"d{i}/LICENSE", text) for i, text in enumerate(named)] + [(f"x/{i}.txt", f"some other words {i} of a file in the tree\nand a line") for i in range(200)]
    got = {r.path: r.own_license for r in license_scan.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {text: got[f"d{i}/LICENSE"] for i, text in enumerate(named)} == named
    assert not any(got[f"x/{i}.txt"] for i in range(200))
