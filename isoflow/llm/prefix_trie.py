"""Prefix trie of conversations by union-find over sorted neighbours.

A conversation is one row: 16 bytes of SHA-256 for each of its turns, one after another.  Equal
conversations are grouped first, so a hot group of copies is one row with a count.  The distinct ones
are sorted across the cluster.  In a block of sorted rows the common prefix of two neighbours (in
turns) is an edge; edges are taken in descending depth, and an edge that merges two components
creates the branching node at its depth, with the unary nodes between a component's top and that depth.
A node that holds neither the first nor the last row of its block is complete.  What is left of a block
is contracted onto those two rows: for each depth, the sums of all that hangs on their prefixes.
The contracted rows of all blocks are sorted and merged in the same way, until one block holds
them all; with thousands of rows a block that takes two or three rounds at any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoflow.llm.common import discard, materialize, table

TURN = 16
"""Bytes of a turn in a path."""
BLOCK_ROWS, BLOCK_BYTES, LEAST_ROWS = 10_000, 1 << 24, 64
"""A block ends at so many rows, or bytes of paths once it has ``LEAST_ROWS`` rows."""
NO_ENDS = hashlib.sha256(b"").hexdigest()

SUMS = ("cnt", "smallest", "kids", "leaves", "saved", "ends")
_HANGING = "depths array<int>, cnt array<long>, smallest array<long>, kids array<long>, leaves array<long>, saved array<long>, ends array<string>"
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_LEVEL = f"{_NODE}, node_key binary, parent_key binary, path binary, chars array<long>, {_HANGING}"
_COLUMNS = [c.split()[0] for c in _LEVEL.split(", ")]


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths share from their start, by bisection over equal prefixes."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low * TURN : mid * TURN] == b[low * TURN : mid * TURN] else (low, mid - 1)
    return low


def prefix_keys(path: bytes) -> list[bytes]:
    """A key for each prefix of a path, the empty one first, in one pass."""
    state, keys = hashlib.blake2b(digest_size=16), []
    for at in range(0, len(path) + 1, TURN):
        keys.append(state.copy().digest())
        state.update(path[at : at + TURN])
    return keys


class Sums:
    """What is known to hang on the node at one depth of a component's common prefix."""

    __slots__ = ("cnt", "smallest", "kids", "leaves", "saved", "ends", "waiting")

    def __init__(self, cnt=0, smallest=None, kids=0, leaves=0, saved=0, ends=None):
        self.cnt, self.smallest, self.kids, self.leaves, self.saved, self.ends = cnt, smallest, kids, leaves, saved, ends
        self.waiting: list[dict] = []  # finished children that wait for the name of their parent

    def add(self, other: Sums) -> None:
        self.cnt += other.cnt
        self.smallest = other.smallest if self.smallest is None else self.smallest if other.smallest is None else min(self.smallest, other.smallest)
        self.kids, self.leaves, self.saved = self.kids + other.kids, self.leaves + other.leaves, self.saved + other.saved
        self.ends = self.ends or other.ends
        self.waiting += other.waiting


class Component:
    """Neighbouring rows that are merged: their sums by depth, and the depth their common prefix is finished down to."""

    def __init__(self, row: int, top: int, sums: dict[int, Sums], is_open: bool):
        self.row, self.top, self.sums, self.open = row, top, sums, is_open
        self.tail: dict[int, Sums] = {}  # of an open component that holds the block's last row as well: its own deeper part


class Block:
    """Sorted rows, their forest, and what of it stays open."""

    def __init__(self, rows: list, last: bool, keyed: bool):
        self.rows, self.keyed, self.last = rows, keyed, last
        self.nodes: list[dict] = []
        self.keys: dict[int, list[bytes]] = {}
        ends = () if last else (0, len(rows) - 1)
        self.forest = [
            Component(i, len(r.path) // TURN, {int(d): Sums(*map(_plain, v)) for d, *v in zip(r.depths, *(getattr(r, c) for c in SUMS))}, i in ends)
            for i, r in enumerate(rows)
        ]
        self.parent = list(range(len(rows)))

    def key(self, row: int, depth: int) -> bytes:
        if row not in self.keys:
            self.keys[row] = prefix_keys(self.rows[row].path)
        return self.keys[row][depth]

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def finish(self, component: Component, depth: int) -> tuple[dict, Sums]:
        """The node at ``depth`` of a component, whose sums are complete, and what it adds to its parent."""
        s = component.sums.pop(depth)
        own = (s.cnt - 1) * int(self.rows[component.row].chars[depth - 1]) if depth else 0
        node = {
            "conv_id": s.smallest, "depth": depth, "n_convs": s.cnt, "n_children": s.kids, "n_leaves": s.leaves if s.kids else 1,
            "saved_tokens": s.saved + own, "ends_sha256": s.ends or NO_ENDS,
        }
        if self.keyed:
            node["node_key"] = self.key(component.row, depth)
        for child in s.waiting:
            child["parent_conv_id"] = s.smallest
        self.nodes.append(node)
        up = Sums(s.cnt, s.smallest, 1, node["n_leaves"], node["saved_tokens"])
        up.waiting.append(node)
        return node, up

    def lift(self, component: Component, depth: int) -> None:
        """Finish the nodes of a component from its top down to just above ``depth``."""
        for d in range(component.top, depth, -1):
            component.sums.setdefault(d - 1, Sums()).add(self.finish(component, d)[1])
        component.top = min(component.top, depth)

    def merge(self, edge: int, depth: int) -> None:
        """The rows on both sides of an edge share exactly ``depth`` turns, and deeper edges are done."""
        left, right = self.find(edge), self.find(edge + 1)
        a, b = self.forest[left], self.forest[right]
        for side in (a, b):
            if not side.open:
                self.lift(side, depth)
        if a.open and b.open:
            a.tail = {d: s for d, s in b.sums.items() if d > depth}
            b.sums = {d: s for d, s in b.sums.items() if d <= depth}
        if b.open and not a.open or a.open == b.open and not a.open and len(b.sums) > len(a.sums):
            left, right, a, b = right, left, b, a
        for d, s in b.sums.items():
            if d in a.sums:
                a.sums[d].add(s)
            else:
                a.sums[d] = s
        self.parent[right], self.forest[right] = left, None

    def grow(self) -> Component:
        edges = [common_turns(x.path, y.path) for x, y in zip(self.rows, self.rows[1:])]
        for edge in sorted(range(len(edges)), key=lambda e: -edges[e]):
            self.merge(edge, edges[edge])
        return self.forest[self.find(0)]

    def contracted(self, row: int, sums: dict[int, Sums]) -> dict:
        """A row with all that hangs on its prefixes; children that wait there get the parent's key."""
        for depth, s in sums.items():
            for child in s.waiting:
                child["parent_key"] = self.key(row, depth)
        held = sorted(sums)
        return {"path": self.rows[row].path, "chars": self.rows[row].chars, "depths": held} | {c: [getattr(sums[d], c) for d in held] for c in SUMS}

    def result(self) -> pd.DataFrame:
        whole = self.grow()
        if self.last:
            self.lift(whole, 0)
            self.finish(whole, 0)
            out = self.nodes
        else:
            out = [self.contracted(0, whole.sums)]
            if len(self.rows) > 1:
                out.append(self.contracted(len(self.rows) - 1, whole.tail))
            out = self.nodes + out
        return pd.DataFrame({c: pd.Series([r.get(c) for r in out], dtype=object) for c in _COLUMNS})


def _plain(value):
    return None if value is None or value != value else value if isinstance(value, str) else int(value)


def _level(last: bool, keyed: bool, block_rows: int):
    def forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list = []
        size = 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                rows.append(row)
                size += len(row.path)
                if not last and (len(rows) >= block_rows or size >= BLOCK_BYTES and len(rows) >= LEAST_ROWS):
                    yield Block(rows, last, keyed).result()
                    rows, size = [], 0
        if rows:
            yield Block(rows, last, keyed).result()

    return forests


def gathered(turns: DataFrame) -> DataFrame:
    """``conv_id, turns`` from rows ``conv_id, turn, role, text``: the turns in order, as structs of turn, digest and chars.

    A null turn comes first, ties go by the digest of role and text; a null role or text counts as
    empty.  Rows without a conversation are left out.
    """
    role, text = F.coalesce(turns["role"], F.lit("")), F.coalesce(turns["text"], F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TURN)
    narrow = turns.where(turns["conv_id"].isNotNull()).select(
        turns["conv_id"].alias("conv_id"), F.struct(turns["turn"].alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars")).alias("t")
    )
    return narrow.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def end_hashes(members: DataFrame) -> DataFrame:
    """``end, ends``: the SHA-256 of the ids of each ``end``, ascending and comma-joined, from rows ``end, conv_id``.

    Ids are sorted across the cluster and joined to chunks in order, so that a group of any size comes
    to the task that hashes it as few rows, which it reads one after another.
    """

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                end, ids = batch["end"].to_numpy(), batch["conv_id"].to_numpy()
                first = [0, *(np.flatnonzero(end[1:] != end[:-1]) + 1)]
                joined = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(first, [*first[1:], len(ids)])]
                yield pd.DataFrame({"end": end[first], "first": ids[first], "joined": joined})

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            done = []
            for end, joined in zip(batch["end"], batch["joined"]):
                if end == current:
                    state.update(b",")
                else:
                    if state:
                        done.append((current, state.hexdigest()))
                    current, state = end, hashlib.sha256()
                state.update(joined.encode())
            yield pd.DataFrame(done, columns=["end", "ends"])
        if state:
            yield pd.DataFrame([(current, state.hexdigest())], columns=["end", "ends"])

    in_order = members.select("end", "conv_id").repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id")
    pieces = in_order.mapInPandas(chunks, "end string, first long, joined string")
    return pieces.repartition("end").sortWithinPartitions("end", "first").mapInPandas(hashes, "end string, ends string")


SMALL = 100_000
"""Open nodes up to which the names of parents are broadcast; beyond, they are joined by a shuffle."""


def prefix_trie(convs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The trie of ``convs (conv_id, turns)``, turns as from :func:`gathered`: one row per node.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256`` (of the ids that end at the node).  A node is a
    distinct sequence of first turns; conversations without turns end at the root.  Conversations of
    one id must come once.  No conversations, no nodes.  A row holds 16 bytes a turn of its conversation.
    """
    block_rows = max(3, block_rows)  # of each block two rows are left
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    paths = convs.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars"))
    members = materialize(paths.withColumn("end", F.sha2("path", 256)), "members")
    distinct = members.groupBy("end").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"), F.first("path").alias("path"), F.first("chars").alias("chars"))
    zero = F.array(F.lit(0).cast("long"))
    rows = distinct.join(end_hashes(members), "end").select(
        "path", "chars", F.array(F.size("chars")).alias("depths"), F.array("n").alias("cnt"), F.array("first").alias("smallest"),
        zero.alias("kids"), zero.alias("leaves"), zero.alias("saved"), F.array("ends").alias("ends"),
    )
    rows, levels = materialize(rows, "sequences"), []
    discard_later = [members]
    while True:
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("path")).alias("bytes")).first()
        last = size["n"] <= LEAST_ROWS or size["n"] <= block_rows and size["bytes"] <= BLOCK_BYTES
        dealt = rows.coalesce(1) if last else rows.repartitionByRange("path")
        level = materialize(dealt.sortWithinPartitions("path").mapInPandas(_level(last, bool(levels), block_rows), _LEVEL), "level")
        levels.append(level)
        discard_later.append(rows)
        if last:
            break
        rows = materialize(level.where("conv_id is null").select("path", "chars", *[c.split()[0] for c in _HANGING.split(", ")]), "contracted")
    for done in discard_later:
        discard(done)
    columns = [c.split()[0] for c in _NODE.split(", ")]
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    nodes = nodes.where("conv_id is not null").select(*columns, "node_key", "parent_key")
    if len(levels) == 1:
        return nodes.select(columns)
    names = nodes.where("node_key is not null").select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("_name"))
    names = F.broadcast(names) if names.limit(SMALL + 1).count() <= SMALL else names
    named = nodes.join(names, "parent_key", "left")
    return named.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_name")).select(columns)


GROUP, HEADS = 100, 6


def rebuilt(convs: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """Each conversation with its first h turns replaced by those of the first of its group, h = crc32(id) % heads.

    The group's first conversation is that of id c - c % group; where it is absent there are none to take.
    """
    base = convs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, heads - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    both = convs.withColumn("_h", h).join(base, F.col("conv_id") - F.col("conv_id") % group == F.col("_base"), "left")
    nothing = F.slice("turns", 1, 0)
    head = F.when(F.col("_h") > 0, F.slice(F.coalesce("_head", nothing), F.lit(1), F.col("_h"))).otherwise(nothing)
    return both.select("conv_id", F.concat(head, F.slice("turns", F.col("_h") + 1, F.size("turns"))).alias("turns"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = materialize(gathered(table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie(rebuilt(convs))


# CRC-32 of the decimal id: SQL has no such function, so bytes and bits are folded as its polynomial says.
OP13_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), s AS (
  SELECT c.conv_id, 0 AS part, k, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND k <= h
  UNION ALL SELECT c.conv_id, 1, k, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND k > h
), r AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS depth FROM s
), p AS (
  SELECT conv_id, depth, length(text) AS chars,
    sha256(string_agg(sha256(length(role) || ':' || role || text), '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING)) AS node
  FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c
), q AS (
  SELECT *, lag(node) OVER w AS parent, lead(node) OVER w IS NULL AS is_end FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
), n AS (
  SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS own,
    sha256(coalesce(string_agg(CASE WHEN is_end THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM q GROUP BY depth, node
), k AS (SELECT parent, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY parent
), f AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.parent = n.node
), o AS (
  SELECT q.conv_id, q.depth, q.node,
    sum(coalesce(f.own, 0)) OVER w AS saved, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) OVER w AS leaves
  FROM q LEFT JOIN f ON f.conv_id = q.conv_id AND f.depth = q.depth WINDOW w AS (PARTITION BY q.conv_id ORDER BY q.depth DESC ROWS UNBOUNDED PRECEDING)
), u AS (SELECT node, sum(saved) AS saved, sum(leaves) AS leaves FROM o GROUP BY node)
SELECT f.conv_id, f.depth, g.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN u ON u.node = f.node LEFT JOIN f AS g ON f.depth > 0 AND g.node = f.parent
"""
