"""Approximate nearest neighbours by inner product with a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is then routed to a leaf.  A query walks the
tree best bin first: a priority queue holds the open branches by an upper bound of the inner
products in them (product with the centre plus the query's norm times the radius), and leaves are
visited in that order.  How many leaves a query visits is calibrated: for a bounded set of queries
the true neighbours are found by a scan of all vectors, and the number of visits is widened until
their leaves are reached with the wanted recall.

Neighbouring leaves share blocks of bounded size, and a leaf that holds very many vectors (copies
of one, say) is cut into several, so it is spread over tasks.  A query goes once to each block that
holds a leaf it visits, and its best of each block are ranked.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isoflow.llm.common import discard, materialize, table

NEIGHBOURS = 20
SAMPLE = 100_000
"""Vectors that the tree is fitted on, at most: a share of all by the hash of their id, then the smallest hashes.
Up to this number leaves multiply with the vectors."""
BRANCHES, LEAF = 8, 120
"""Children of a node; sample vectors at which a node is split no more."""
CALIBRATION = 256
"""Queries that calibrate the number of visits: those with the smallest hash of their id."""
RECALL = 0.93
BLOCK = 4096
"""Vectors, and queries, of one comparison on average."""


@dataclass
class Node:
    centre: np.ndarray
    children: list["Node"]
    leaf: int
    radius: float = 0.0
    number: int = 0


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        which = nearest(x, centres)
        for c in range(len(centres)):
            if (which == c).any():
                centres[c] = x[which == c].mean(axis=0)
    return centres, nearest(x, centres)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)


def fit_tree(x: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, seed: int = 5) -> tuple[Node, int]:
    """The root and the number of leaves."""
    rng, count, number = np.random.default_rng(seed), 0, 0

    def grow(part: np.ndarray) -> Node:
        nonlocal count, number
        centre = part.mean(axis=0)
        node = Node(centre, [], -1, float(np.sqrt(((part - centre) ** 2).sum(axis=1).max())), number)
        number += 1
        if len(part) > leaf:
            _, which = _kmeans(part, branches, rng)
            groups = [part[which == c] for c in range(branches) if (which == c).any()]
            if len(groups) > 1:
                node.children = [grow(g) for g in groups]
                return node
        node.leaf, count = count, count + 1
        return node

    return grow(x), count


def route(root: Node, x: np.ndarray) -> np.ndarray:
    """The leaf of each vector: the nearest centre at each level."""
    out = np.zeros(len(x), dtype=np.int64)

    def down(node: Node, rows: np.ndarray) -> None:
        if not node.children:
            out[rows] = node.leaf
        elif len(rows):
            which = nearest(x[rows], np.stack([c.centre for c in node.children]))
            for c, child in enumerate(node.children):
                down(child, rows[which == c])

    down(root, np.arange(len(x)))
    return out


def upper_bounds(root: Node, q: np.ndarray) -> np.ndarray:
    """For each query and node, by its number, the largest inner product that the branch can hold."""
    nodes = [root]
    for node in nodes:
        nodes += node.children
    order = sorted(nodes, key=lambda node: node.number)
    centres, radii = np.stack([node.centre for node in order]), np.array([node.radius for node in order])
    with np.errstate(all="ignore"):
        return q @ centres.T + np.sqrt((q * q).sum(axis=1))[:, None] * radii


def visits(root: Node, bounds: np.ndarray) -> Iterator[int]:
    """Leaves in best-bin-first order: by the upper bounds of one query."""
    queue: list[tuple[float, int, Node]] = [(0.0, 0, root)]
    bounds = (-bounds).tolist()
    while queue:
        node = heapq.heappop(queue)[2]
        if not node.children:
            yield node.leaf
        for child in node.children:
            heapq.heappush(queue, (bounds[child.number], child.number, child))


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision; equal vectors get equal scores wherever they stand."""
    return np.ascontiguousarray(x * q).sum(axis=1)


def best_pairs(
    q: np.ndarray, q_rows: np.ndarray, x: np.ndarray, x_ids: np.ndarray, x_rows: np.ndarray, k: int,
    open_: np.ndarray | None = None, part: int = 20_000,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its ``k`` nearest among ``x`` without its own row: places in ``q`` and ``x``, and scores.

    ``open_`` says which pairs count.  A matrix product finds those that may be among them; these are
    scored exactly, ties to smaller ids.
    """
    with np.errstate(all="ignore"):
        rough = np.nan_to_num(q @ x.T, nan=-np.finfo(float).max, posinf=np.finfo(float).max, neginf=-np.finfo(float).max)
        out = q_rows[:, None] == x_rows[None, :]
        if open_ is not None:
            out |= ~open_
        rough[out] = -np.inf
        bar = np.partition(rough, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(q), -np.inf)
        slack = np.nan_to_num(1e-10 * np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1).max()), posinf=0.0)
        at_q, at_x = np.nonzero((rough >= (bar - slack)[:, None]) & (rough > -np.inf))
        scores = np.concatenate([exact_scores(x[at_x[a : a + part]], q[at_q[a : a + part]]) for a in range(0, len(at_q), part)] or [np.zeros(0)])
    order = np.lexsort((x_rows[at_x], x_ids[at_x], -scores, at_q))
    at_q, at_x, scores = at_q[order], at_x[order], scores[order]
    first = np.searchsorted(at_q, at_q)
    near = np.arange(len(at_q)) - first < k
    return at_q[near], at_x[near], scores[near]


def matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in vectors])


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``row, vec_id, v``: every row with an id but those whose vector is null, zero, not finite or of another size than most."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.where(v.isNotNull() & F.col("vec_id").isNotNull()).where(~bad & F.exists(v, lambda x: x != 0))
    width = rows.agg(F.mode(F.size("v"), True).alias("d")).first()["d"]
    return rows.where(F.size("v") == (width or 0)).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")


def build_index(rows: DataFrame, n_rows: int, sample: int = SAMPLE) -> tuple[Node, int]:
    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        x = pd.concat(parts, ignore_index=True).sort_values(["draw", "row"])[:sample].sort_values("row")
        yield pd.DataFrame({"tree": [pickle.dumps(fit_tree(matrix(x["v"])))]})

    draw = F.xxhash64("vec_id", "row", F.lit(3))
    below = min(1.0, (sample + 8 * sample**0.5) / max(1, n_rows))
    picked = rows.withColumn("draw", draw).where(F.col("draw") <= F.lit(min(2**63 - 1, int(-(2**63) + below * (2**64 - 1)))))
    found = picked.repartition(1).mapInPandas(learn, "tree binary").first()
    return pickle.loads(found.tree) if found else (Node(np.zeros(0), [], 0), 1)


def calibrate(
    indexed: DataFrame, queries: DataFrame, tree: Node, n_leaves: int, k: int, recall: float, n_queries: int = CALIBRATION,
) -> tuple[int, float]:
    """Visits that reach the wanted share of the true neighbours of some queries, and that share."""
    picked = queries.orderBy(F.xxhash64("vec_id", F.lit(9)), "row").limit(n_queries).collect()
    if not picked:
        return 1, 1.0
    rows, q = np.array([r.row for r in picked]), matrix([r.v for r in picked])
    shared = indexed.sparkSession.sparkContext.broadcast((rows, q))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, q = shared.value
        for batch in batches:
            if len(batch):
                at, near, scores = best_pairs(q, rows, matrix(batch["v"]), batch["vec_id"].to_numpy(np.int64), batch["row"].to_numpy(np.int64), k)
                yield pd.DataFrame({"query": rows[at], "vec_id": batch["vec_id"].to_numpy()[near], "leaf": batch["leaf"].to_numpy()[near], "score": scores})

    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    truth = indexed.mapInPandas(scan, "query long, vec_id long, leaf long, score double").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("query", "leaf").collect()
    wanted: dict[int, list[int]] = {}
    for r in truth:
        wanted.setdefault(r.query, []).append(r.leaf)
    places = []
    for row, bounds in zip(rows, upper_bounds(tree, q)):
        order_of = {leaf: n for n, leaf in enumerate(visits(tree, bounds))}
        places += [order_of[leaf] for leaf in wanted.get(int(row), [])]
    ranks, width = np.array(places, dtype=np.int64), 1
    while width < n_leaves and (ranks < width).mean() < recall:
        width = min(n_leaves, max(width + 1, width * 20 // 19))
    return width, float((ranks < width).mean()) if len(ranks) else 1.0


def deal_blocks(counts: dict[int, int], n_leaves: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each leaf: small neighbours share one, large leaves have several."""
    first, parts, number, filled = np.zeros(n_leaves, np.int64), np.ones(n_leaves, np.int64), 0, 0
    for leaf in range(n_leaves):
        n = counts.get(leaf, 0)
        if filled and filled + n > block:
            number, filled = number + 1, 0
        first[leaf], parts[leaf] = number, max(1, -(-n // block))
        if parts[leaf] > 1:
            number, filled = number + parts[leaf], 0
        else:
            filled += n
    return first, parts


def search(
    vectors: DataFrame, is_query, k: int = NEIGHBOURS, recall: float = RECALL, vec_id: str = "vec_id",
    embedding: str = "embedding", block: int = BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found for every row where ``is_query`` holds.

    ``is_query`` is a column over ``vec_id``.  Nearness is the inner product, ties go to smaller
    ids.  Vectors that are null or zero or hold null or non-finite components, vectors of another
    size than most and null ids take no part.  Rows that share an id are vectors of their own, each
    a candidate for the others and, where ``is_query`` holds, a query.  Products beyond the range of
    doubles are infinite and rank by their sign.  With fewer candidates than ``k`` all are returned.
    Empty tables give empty results.  Only the two named columns are read.
    """
    rows = materialize(usable(vectors, vec_id, embedding), "vectors")
    n_rows = rows.count()
    tree, n_leaves = build_index(rows, n_rows)
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast(tree)  # at most SAMPLE / LEAF leaves and their centres, some MB

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(leaf=route(shared.value, matrix(batch["v"])))

    indexed = materialize(rows.mapInPandas(assign, "row long, vec_id long, v array<double>, leaf long"), "indexed")
    discard(rows)
    queries = indexed.where(is_query)
    width, _ = calibrate(indexed, queries, tree, n_leaves, k, recall)
    counts = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}  # one number per leaf of the tree
    first, parts = deal_blocks(counts, n_leaves, block)
    dealt = sc.broadcast((first, parts, counts))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, parts, _ = dealt.value
        for batch in batches:
            leaf = batch["leaf"].to_numpy(np.int64)
            yield batch.assign(block=first[leaf] + batch["row"].to_numpy(np.int64) % parts[leaf])

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, parts, counts = dealt.value
        for batch in batches:
            at, blocks, wanted = [], [], []
            bounds = upper_bounds(shared.value, matrix(batch["v"])) if len(batch) else []
            for i in range(len(batch)):
                seen, held, leaves = 0, 0, []
                for leaf in visits(shared.value, bounds[i]):
                    if leaf in counts:
                        leaves.append(leaf)
                    seen, held = seen + 1, held + counts.get(leaf, 0)
                    if seen >= width and held > k:
                        break
                leaves = np.sort(np.array(leaves, dtype=np.int64))
                of = np.repeat(first[leaves], parts[leaves])
                of += np.arange(len(of)) - np.repeat(np.cumsum(parts[leaves]) - parts[leaves], parts[leaves])
                order = np.argsort(of, kind="stable")
                numbers, begin = np.unique(of[order], return_index=True)
                at += [i] * len(numbers)
                blocks += numbers.tolist()
                wanted += np.split(np.repeat(leaves, parts[leaves])[order], begin[1:])
            yield pd.DataFrame({"block": blocks, "row": batch["row"].to_numpy()[at], "query_id": batch["vec_id"].to_numpy()[at], "q": batch["v"].to_numpy()[at], "leaves": wanted})

    held = indexed.mapInPandas(place, "row long, vec_id long, v array<double>, leaf long, block long")
    asked = materialize(queries.mapInPandas(visit, "block long, row long, query_id long, q array<double>, leaves array<long>"), "visits")
    asked_counts = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("asked_parts"))
    held = held.join(asked_counts, "block").withColumn("a", F.explode(F.expr("sequence(0, asked_parts - 1)"))).drop("asked_parts")
    asks = asked.join(asked_counts, "block").withColumn("a", F.pmod(F.xxhash64("row"), F.col("asked_parts")).cast("int")).drop("asked_parts")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []})]
        if len(left) and len(right):
            ids, own, x = left["vec_id"].to_numpy(np.int64), left["row"].to_numpy(np.int64), matrix(left["v"])
            leaves, column = np.unique(left["leaf"].to_numpy(np.int64), return_inverse=True)
            q, asking, names = matrix(right["q"]), right["row"].to_numpy(np.int64), right["query_id"].to_numpy(np.int64)
            seen = np.stack([np.isin(leaves, w) for w in right["leaves"]])
            for a in range(0, len(q), 256):
                one = slice(a, a + 256)
                at, near, scores = best_pairs(q[one], asking[one], x, ids, own, k, None if seen[one].all() else seen[one][:, column])
                out.append(pd.DataFrame({"query": asking[one][at], "query_id": names[one][at], "vec_id": ids[near], "score": scores}))
        return pd.concat(out, ignore_index=True)

    keys = ["block", "a"]
    found = held.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(compare, "query long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
