import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from isoflow.llm import exact_dedup, mixing, packing
from tests.conftest import TESTDATA
from tests.llm.conftest import ODD

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_duplicates_against_brute_force(spark, odd_docs, no_docs):
    groups = defaultdict(list)
    for r in ODD:
        groups[(r[1] or "").translate(LOW)].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        best = max(ids, key=lambda i: -1 if i is None else i)
        for i in ids:
            want[(i, best, len(ids), i == best, hashlib.sha256(text.encode()).hexdigest())] += 1
    for limit in (250_000, 0):  # the broadcast and the shuffle join
        got = Counter(map(tuple, exact_dedup.exact_duplicates(odd_docs, broadcast_rows=limit).collect()))
        assert got == want
    assert exact_dedup.exact_duplicates(no_docs).count() == 0


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(0)
    low = 64 - 3 - exact_dedup.QUOTIENT_BITS
    keys = rng.integers(0, 1 << 61, 2000, dtype=np.uint64)
    keys[1000:1500] = keys[:500]
    parts = np.array_split(rng.permutation(keys), 7)
    filters = [exact_dedup.build_filter(p, np.ones(len(p), np.int64), low) for p in parts]
    q, n, r, c = exact_dedup.merge_filters(filters, low)
    values, counts = np.unique(keys, return_counts=True)
    assert (exact_dedup.expand_filter(q, n, r, low) == values).all() and (c == counts).all()


def test_word_cache_gives_the_tokenizers_ids():
    bpe = packing.ByteBpe(packing.tokenizer_file())
    texts = [r[1] or "" for r in ODD] + ["a  b\n\nc \t d", "don't  we'll", "tail ", " lead", "\xa0nb\x85sp", "x" * 70 + " 12,5%", "ɏ ɐ ʀ", "Zoë's naïve"]
    for text in texts:
        ids = bpe.tokenizer.encode(text, add_special_tokens=False).ids
        assert bpe.encode(text) == np.asarray(ids, dtype="<u4").tobytes(), text


def check_packing(rows, ids_of, capacity):
    """Pieces of a document join to its ids; sequences are gapless and hold no more than the capacity."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc_id, ids in ids_of.items():
        pieces = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert sum(p.length for p in pieces) == len(ids) // 4 and all(p.length == capacity for p in pieces[1:])
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)])
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def test_packing_odd_documents(spark, odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs, packing.tokenizer_file(), capacity=64).collect()
    bpe, end = packing.ByteBpe(packing.tokenizer_file()), b"\0\0\0\0"
    once = {r[0]: r[1] for r in ODD if r[0] != 5}
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        end_at = 0
        for offset, length in sorted(places):
            assert offset == end_at
            end_at += length
        assert end_at <= 64
    for i, text in once.items():
        ids = bpe.encode(text or "") + end
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [(p.start, p.length) for p in pieces] == packing.cut(len(ids) // 4, 64)
        assert all(p.ids_crc32 == zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)]) for p in pieces)
    assert sum(r.doc_id == 5 for r in rows) == 2
    assert packing.pack_documents(no_docs, packing.tokenizer_file()).count() == 0


def test_packing_is_near_the_bound(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")
    rows = packing.pack_documents(docs, packing.tokenizer_file(), block_items=60).collect()
    bpe = packing.ByteBpe(packing.tokenizer_file())
    used = check_packing(rows, {r.doc_id: bpe.encode(r.text or "") + b"\0\0\0\0" for r in docs.collect()}, packing.CAPACITY)
    assert used <= -(-sum(r.length for r in rows) // packing.CAPACITY) + 2


def test_crossover_and_mutation_keep_every_piece():
    rng = np.random.default_rng(1)
    lengths = rng.integers(300, 1400, 200)
    population = packing.founders(lengths, 2048, 4, rng)
    for _ in range(20):
        a, b = population[0], population[int(rng.integers(0, 4))]
        for child in (packing.crossover(a, b, lengths, 2048, rng), packing.mutate(a, lengths, 2048, rng)):
            assert len(child) == 200 and child.min() >= 0
            assert np.bincount(child, weights=lengths).max() <= 2048
    start = packing.fitness(population[0], lengths, 2048)
    assert packing.fitness(packing.evolve(population, lengths, 2048, 20, rng)[0], lengths, 2048) <= start


def test_mixing_odd_documents(spark, odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == len(ODD)
    sizes = {r[0]: len(re.findall("[^\x20\x09-\x0d]+", r[1] or "")) for r in ODD}
    totals = defaultdict(int)
    for r in ODD:
        totals[r[3]] += len(re.findall("[^\x20\x09-\x0d]+", r[1] or ""))
    for r in rows:
        assert r.size == sizes[r.doc_id] and r.source_size == totals[r.source] and r.taken <= 2 * r.size
        assert r.target <= 2 * r.source_size + 1e-6 and r.taken == r.size * r.copies
    targets = {r.source: r.target for r in rows}
    assert sum(targets.values()) == pytest.approx(1.5 * sum(totals.values()))
    assert sorted(map(tuple, mixing.mix(odd_docs).collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    emitted = mixing.emit(odd_docs)
    assert emitted.columns == odd_docs.columns and emitted.count() == sum(r.copies for r in rows)
    assert mixing.mix(no_docs).count() == 0 and mixing.emit(no_docs).count() == 0


def test_targets_are_filled_by_weight_below_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), ("d", 50), (None, 200)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    weight = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}
    cap = {"a": 20, "b": 2000, "c": 2000, "d": 100, None: 400}
    left, open_ = 1.5 * 2260, set(cap)
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > cap[s]}
        if not full:
            break
        left -= sum(cap[s] for s in full)
        open_ -= full
    assert got == pytest.approx({s: level * weight[s] if s in open_ else cap[s] for s in cap})


def test_added_tokens_are_encoded_as_in_the_file(spark):
    from tokenizers import Tokenizer

    fresh, bpe = Tokenizer.from_file(packing.tokenizer_file()), packing.ByteBpe(packing.tokenizer_file())
    texts = ["end <|endoftext|> x", "<|endoftext|>", "<|endoftext|><|endoftext|>", "a  b\n\n<|endoftext|>c", "漢字 <|endoftext|>", "<|endoftext| >", "<|endoftext"]
    want = [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [437, 220, 50256, 2124]
    assert [np.frombuffer(bpe.encode(t), "<u4").tolist() for t in texts] == want
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), packing.tokenizer_file()).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in rows} == {i: (len(w) + 1, zlib.crc32(np.asarray(w + [0], "<u4").tobytes())) for i, w in enumerate(want)}


def test_extra_copies_come_with_the_fraction(spark):
    """Sources of one document each: how often the extra copy is drawn is the fraction of their rate."""
    rows = [(i, "a b c", f"s{i:04d}") for i in range(1200)] + [(-1, "w " * 900, "t")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("doc_id >= 0").collect()
    by_rate = defaultdict(list)
    for r in got:
        by_rate[round(r.rate % 1, 6)].append(r.copies - int(r.rate))
    checked = 0
    for fraction, drawn in by_rate.items():
        if 0 < fraction < 1 and len(drawn) > 100:
            checked += 1
            assert abs(np.mean(drawn) - fraction) < 4 * (fraction * (1 - fraction) / len(drawn)) ** 0.5
    assert checked


def test_sources_come_near_their_targets(spark):
    rng = np.random.default_rng(20)
    rows = [(i, "w " * int(rng.integers(1, 60)), f"s{min(3, int(rng.integers(0, 9)))}") for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    for _, part in got.groupby("source"):
        fraction = part.rate.iloc[0] % 1
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 4 * (fraction * (1 - fraction) * (part["size"] ** 2).sum()) ** 0.5 + 1e-6


def test_one_row_of_each_group_of_copies_stays(spark):
    rows = [(5, "A", "p"), (9, "a", "q"), (5, "B", "r"), (None, "c", "s"), (None, "C", "t"), (3, "c", "u"), (None, "d", "v"), (None, "D", "w"), (7, None, "x"), (7, "", "y"), (1, "alone", "z"), (2, "e", "1"), (2, "e", "1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _sha string")
    for limit in (250_000, 0):
        got = Counter((r.doc_id, (r.text or "").lower()) for r in exact_dedup.without_copies(docs, broadcast_rows=limit).collect())
        assert got == Counter([(9, "a"), (5, "b"), (3, "c"), (None, "d"), (7, ""), (1, "alone"), (2, "e")])
    assert exact_dedup.without_copies(docs).columns == docs.columns and exact_dedup.without_copies(docs.where("false")).count() == 0


def test_evolution_reaches_bounds_that_its_founders_miss():
    better = 0
    for seed in (12, 23, 25, 32, 34, 42, 49, 58):
        rng = np.random.default_rng(seed)
        lengths = []
        for _ in range(int(rng.integers(6, 20))):
            lengths += np.diff(np.concatenate([[0], np.sort(rng.choice(np.arange(1, 100), 3, replace=False)), [100]])).tolist()
        lengths, bound = np.array(lengths), sum(lengths) // 100
        population = sorted(packing.founders(lengths, 100, 4, np.random.default_rng(1)), key=lambda c: packing.fitness(c, lengths, 100))
        before = packing.fitness(population[0], lengths, 100)[0]
        best = packing.evolve(population, lengths, 100, 40, np.random.default_rng(2))[0]
        assert np.bincount(best, weights=lengths).max() <= 100
        better += before > bound and packing.fitness(best, lengths, 100)[0] == bound
    assert better >= 5


def test_islands_pack_a_block_that_its_founders_do_not(spark):
    """Through Spark: no island ends at once, elites migrate, and the packing found meets the bound."""
    rng = np.random.default_rng(42)
    lengths = []
    for _ in range(int(rng.integers(6, 20))):
        lengths += np.diff(np.concatenate([[0], np.sort(rng.choice(np.arange(1, 100), 3, replace=False)), [100]])).tolist()
    items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "uid long, length long")
    rows = packing.pack(items, 100, epochs=4, generations=20).collect()
    fills = defaultdict(int)
    for r in rows:
        fills[r.bin] += lengths[r.uid]
    assert len(rows) == len(lengths) and max(fills.values()) <= 100
    founders = [c for island in range(3) for c in packing.founders(np.array(lengths), 100, 4, np.random.default_rng([0, island]))]
    assert len(fills) == sum(lengths) // 100 < min(packing.fitness(c, np.array(lengths), 100)[0] for c in founders)
