import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from isoflow.llm import prefix_trie as trie
from tests.conftest import TESTDATA

SCHEMA = "conv_id long, turn long, role string, text string, path string, depth string, turns string"


def brute(sequences):
    """Nodes of ``{conv_id: [(role, text), ...]}`` by one dictionary of prefixes."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, own in members.items():
        cost = (len(own) - 1) * len(node[-1][1]) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += cost
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(own), len(node), min(members[node[:-1]]) if node else -1, len(own), kids.get(node, 0), leaves[node], saved[node], sha(ends.get(node, [])))
        for node, own in members.items()
    )


def rebuild(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(own)] for c, own in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - c % 100 if c >= 0 else c + -c % 100  # the remainder is truncated, as in SQL
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def rows_of(nodes):
    return sorted(tuple(-1 if v is None else v for v in r) for r in nodes.collect())


def of(spark, sequences):
    rows = [(c, i, role, text, "x", "x", "x") for c, turns in sequences.items() for i, (role, text) in enumerate(turns)]
    return trie.gathered(spark.createDataFrame(rows, SCHEMA).repartition(5))


@pytest.mark.parametrize("block_rows", [5, 40, 10_000])
def test_blocks_of_any_size_give_the_same_nodes(spark, block_rows, monkeypatch):
    monkeypatch.setattr(trie, "LEAST_ROWS", 1)
    rng = random.Random(block_rows)
    sequences = {}
    for c in range(300):
        kind = rng.random()
        length = rng.randint(1, 6) if kind < 0.7 else 3
        sequences[c] = [("user", "same first turn")] * 3 if kind >= 0.7 else [("user" if d % 2 else "bot", rng.choice("abé") * (1 + d)) for d in range(length)]
    sequences[300] = [("user", "long")] * 400
    sequences[301] = [("user", "long")] * 399 + [("bot", "other")]
    assert rows_of(trie.prefix_trie(of(spark, sequences), block_rows)) == brute(sequences)


def test_odd_conversations_against_brute_force(spark):
    rows = [
        (0, 1, "user", "hello"), (0, 0, "user", "first"), (0, None, None, None), (0, 2, "bot", "x"), (0, 2, "bot", "x"),
        (1, 0, "user", "first"), (2, 0, None, "first"), (3, 5, "user", ""), (3, 6, "userfirst", ""), (3, 6, "user", "first"),
        (None, 0, "user", "no conversation"), (250, 0, "user", "absent base"), (7, 0, "user", "first"), (-5, 1, "user", "minus"), (205, 1, "a", "b" * 40_000),
    ]
    rows += [(c, t, "user", f"t{t}") for c in range(400, 460) for t in range(c % 9)]
    got = trie.prefix_trie(trie.rebuilt(trie.gathered(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA))))
    want = rebuild(rows)
    assert rows_of(got) == brute(want) and min(want) == -5
    assert trie.prefix_trie(trie.gathered(spark.createDataFrame([], SCHEMA))).count() == 0


def test_hashes_of_ids_do_not_depend_on_chunks(spark):
    members = spark.range(5000).selectExpr("if(id % 3 = 0, 'hot', concat('e', id % 50)) end", "id * 7 - 900 conv_id")
    ids = defaultdict(list)
    for r in members.collect():
        ids[r.end].append(r.conv_id)
    got = {r.end: r.ends for r in trie.end_hashes(members.repartition(6)).collect()}
    assert got == {e: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for e, v in ids.items()}


def test_given_conversations_against_brute_force(spark):
    folder = f"{TESTDATA}/sf0.01"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    assert rows_of(trie.op13_prefix_trie(spark, folder)) == brute(rebuild(rows))
