"""N-gram Jaccard join with parity sketches.

A document is the set of its word shingles.  Two sets with Jaccard similarity of at least ``s``
differ in at most ``(1 - s) / (1 + s)`` of their summed sizes.  The hashed tokens of a set are
XORed into sketches: a token changes one word (or bit) of a sketch, so the number of places in
which two sketches differ is a lower bound of the symmetric difference.

* Join sketch: at each size band a set is XORed into more words than the largest difference
  allowed there, and every word that holds a token is a join key.  A linked pair leaves a word
  untouched (pigeonhole); a set that may have only empty words left untouched, under every one
  of the band's seeds, offers its empty words too, and only pairs of two such sets need those.
* Bit sketch: candidates whose Hamming distance exceeds the allowed difference are dropped.
* The exact sets of the rest are compared.

Equal sets are one class from the start, named by a 128-bit hash of the set.  Within a join key no
list of all pairs is made.  First every class is compared with the hubs of its keys, the members
that share most with others, by bit sketches and with the closest one as a whole; the linked ones
make components.  Then the members of
different components that share a key are compared by their bit sketches inside a task.  Of the
pairs that pass the bound, first the closest one of each two components is verified and links are
followed, then all that are left between different components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoflow.llm.common import discard, materialize, table
from isoflow.llm.components import connected_components
from isoflow.llm.hashing import FlatWords, chunks, mix

SHINGLE = 5
NUMERATOR, DENOMINATOR = 80, 100
BAND = 1.7
SPARE = 1.15
"""Words of a join sketch over the largest difference, so that some empty words do no harm."""
SEED_WORDS = 16
"""Small sketches are made under as many seeds as bring them to this number of words."""
BLOCK = 2000
"""Members of a key that are compared within one task; larger keys are cut into pairs of blocks."""
TASK_BLOCKS = 8
"""Blocks of members that one task of comparisons is meant to hold."""
PAIRS = 50_000
"""Pairs of sketches that a task compares at a time."""
BROADCAST_ROWS = 250_000
"""Rows up to which a list of documents or classes is broadcast."""
BROADCAST_KEYS = 50_000
"""Shared keys up to which the join against them is broadcast."""
CLOSEST_ROUNDS = 1
"""Rounds in which only the closest pair of each two components is verified, before all that are left are."""
_PAIR = ("a", "b", "ca", "cb", "distance")
_EDGES = BAND ** np.arange(0, 60)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts, size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """``(index, sorted distinct 64-bit shingle hashes)`` of every text with a word."""
    for owner, parts in chunks(texts, split=False):
        flat = FlatWords(parts, lower=True)
        words, doc = mix(flat.hash.of(flat.starts, flat.ends) + (flat.ends - flat.starts).astype(np.uint64)), flat.doc
        if not len(words):
            continue
        n = len(words) - size + 1
        if n > 0:
            h = words[:n].copy()
            for k in range(1, size):
                h = h * _FACTOR + words[k : k + n]
            ok = doc[:n] == doc[size - 1 :]
            h, d = mix(h[ok]), doc[:n][ok]
        else:
            h, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        counts = np.bincount(doc, minlength=len(parts))
        first = np.cumsum(counts) - counts
        short = []
        for i in np.flatnonzero((counts > 0) & (counts < size)):
            v = np.uint64(int(counts[i]))
            for w in words[first[i] : first[i] + counts[i]]:
                v = np.uint64((int(v) * int(_FACTOR) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            short.append((i, v))
        if short:
            d = np.concatenate([d, np.array([i for i, _ in short])])
            h = np.concatenate([h, mix(np.array([v for _, v in short], dtype=np.uint64))])
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[new], d[new]
        borders = np.searchsorted(d, np.arange(len(parts) + 1))
        for i in range(len(parts)):
            if borders[i] < borders[i + 1]:
                yield int(owner[i]), h[borders[i] : borders[i + 1]]


def class_id(tokens: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of a set: two independent sums of mixed tokens, each joined with the size."""
    with np.errstate(over="ignore"):
        one = np.bitwise_xor.reduce(tokens) ^ mix(np.array([np.uint64(len(tokens)) + np.add.reduce(tokens)]))[0]
        two = np.add.reduce(mix(tokens ^ _FACTOR)) + np.uint64(len(tokens))
        named = mix(np.array([one, two]))
    return int(named[0].astype(np.int64)), int(named[1].astype(np.int64))


def allowed(a: int, b: int, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> int:
    """Largest symmetric difference of linked sets of these sizes."""
    return (a + b) * (denominator - numerator) // (denominator + numerator)


def levels(n: int, numerator: int, denominator: int) -> list[tuple[int, int, int]]:
    """``(level, words of the sketch, largest difference of this set)`` where a set of size ``n`` meets others.

    A pair meets at the band of its smaller set: a set is at its own band and, as the larger one of
    a pair, at those bands below whose sets it can still be similar to.
    """
    own = int(np.searchsorted(_EDGES, n, side="right")) - 1
    out = []
    for level in range(own, -1, -1):
        largest = int(np.ceil(_EDGES[level + 1])) - 1  # of the smaller sets here
        if level < own and n * numerator > largest * denominator:
            break
        most = allowed(largest, largest * denominator // numerator, numerator, denominator)
        if most:
            mine = allowed(n, n * denominator // numerator if level == own else largest, numerator, denominator)
            out.append((level, int(np.ceil(most * SPARE)) + 1, mine))
    return out


def join_keys(tokens: np.ndarray, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> np.ndarray:
    """The distinct words of the join sketches that a set offers, named by level, seed and place."""
    out = []
    for level, words, most in levels(len(tokens), numerator, denominator):
        sketches, safe = [], False
        for seed in range(-(-SEED_WORDS // words)):
            spread = mix(tokens + np.uint64((seed * 2 + 1) * int(_FACTOR) & 0xFFFFFFFFFFFFFFFF))
            place = (((spread >> np.uint64(32)) * np.uint64(words)) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            held, first = np.unique(place[order], return_index=True)
            sketches.append((seed, held, np.bitwise_xor.reduceat(tokens[order], first)))
            safe |= len(held) > most
        for seed, held, values in sketches:
            name = np.uint64((level << 40) | (seed << 20))
            out.append(mix(values + mix(name + held.astype(np.uint64))))
            if not safe:
                empty = np.setdiff1d(np.arange(words), held)
                out.append(mix(mix(name + empty.astype(np.uint64)) ^ _FACTOR))
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, np.int64)


def bit_sketch(tokens: np.ndarray) -> bytes:
    """Parity of the tokens by place: a power of two of bits, at least four times the set's size."""
    bits = max(256, 1 << int(4 * len(tokens) - 1).bit_length())
    parity = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def fold_sketch(sketch: bytes, size: int) -> np.ndarray:
    """The sketch of the same set with fewer places: upper half XOR lower half."""
    v = np.frombuffer(sketch, np.uint8)
    while len(v) > size:
        v = v[: len(v) // 2] ^ v[len(v) // 2 :]
    return v


def hamming(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    return int(np.bitwise_count(fold_sketch(a, size) ^ fold_sketch(b, size)).sum())


def distances(sketches: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, numerator: int, denominator: int) -> np.ndarray:
    """Hamming distances of the pairs ``(left, right)`` of rows; -1 where a bound on sizes or distance excludes a link."""
    a, b = sizes[left], sizes[right]
    ok = np.flatnonzero((a * denominator >= b * numerator) & (b * denominator >= a * numerator))
    out = np.full(len(left), -1)
    distance = np.bitwise_count(sketches[left[ok]] ^ sketches[right[ok]]).sum(axis=1, dtype=np.int64)
    out[ok] = np.where(distance <= (a[ok] + b[ok]) * (denominator - numerator) // (denominator + numerator), distance, -1)
    return out


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal neighbours."""
    first = np.flatnonzero(np.diff(values, prepend=values[0] - 1) != 0) if len(values) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(values)))


def unit_pairs(first: np.ndarray, count: np.ndarray, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within each run of rows, at most about ``most`` at a time."""
    rows = np.repeat(first + count, count) - np.arange(count.sum()) - 1 - np.repeat(first - np.cumsum(count) + count, count)  # partners after each row
    at = np.concatenate([np.arange(f, f + c) for f, c in zip(first, count)]) if len(first) else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(rows)])
    begin = 0
    while begin < len(at):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + most, side="right")) - 1)
        n = rows[begin:end]
        left = np.repeat(at[begin:end], n)
        yield left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        begin = end


def signatures(docs: DataFrame, shingle: int, numerator: int, denominator: int) -> DataFrame:
    """``row, doc_id, text_md5, n, c1, c2, keys, sketch`` of every row; sets without tokens have no class."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            n, texts = len(batch), batch["text"].tolist()
            sizes, ones, twos, keys, sketches = np.zeros(n, np.int64), [None] * n, [None] * n, [None] * n, [None] * n
            for i, tokens in shingle_sets(texts, shingle):
                sizes[i], keys[i], sketches[i] = len(tokens), join_keys(tokens, numerator, denominator), bit_sketch(tokens)
                ones[i], twos[i] = class_id(tokens)
            md5 = [hashlib.md5((t or "").encode("utf-8", "surrogatepass")).hexdigest() for t in texts]
            yield pd.DataFrame({"row": np.arange(row, row + n), "doc_id": batch["doc_id"], "text_md5": md5, "n": sizes, "c1": pd.array(ones, dtype="Int64"), "c2": pd.array(twos, dtype="Int64"), "keys": keys, "sketch": sketches})
            row += n

    return docs.mapInPandas(run, f"row long, doc_id {kind}, text_md5 string, n long, c1 long, c2 long, keys array<long>, sketch binary")


def token_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``c1, c2, tokens`` of every row with a word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(*class_id(t), t.view(np.int64)) for _, t in shingle_sets(batch["text"].tolist(), shingle)]
            yield pd.DataFrame(found, columns=["c1", "c2", "tokens"])

    return texts.select("text").mapInPandas(run, "c1 long, c2 long, tokens array<long>")


def closest_hubs(pairs: DataFrame, known: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Of pairs ``(node, hub)`` those whose sizes and bit sketches (``known (node, n, sketch)``) may belong to
    linked sets, for each node the one with the closest hub, as ``a, b`` with ``a < b``."""
    left, right = (known.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in ("node", "hub"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = batch["n_node"].to_numpy(np.int64), batch["n_hub"].to_numpy(np.int64)
            distance = np.fromiter(map(hamming, batch["s_node"], batch["s_hub"]), dtype=np.int64, count=len(batch))
            keep = distance <= (a + b) * (denominator - numerator) // (denominator + numerator)
            yield batch.assign(distance=distance).loc[keep, ["node", "hub", "distance"]]

    sized = pairs.join(left, "node").join(right, "hub").where(f"n_node * {denominator} >= n_hub * {numerator} and n_hub * {denominator} >= n_node * {numerator}")
    best = sized.mapInPandas(run, "node long, hub long, distance long").groupBy("node").agg(F.min(F.struct("distance", "hub")).alias("best"))
    return best.select(F.least("node", "best.hub").alias("a"), F.greatest("node", "best.hub").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs ``(a, b)`` whose exact similarity reaches the threshold."""
    left, right = (sets.select(F.col("node").alias(c), F.col("tokens").alias(f"tokens_{c}")) for c in "ab")
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", common.alias("common"), F.size("tokens_a").alias("n_a"), F.size("tokens_b").alias("n_b"))
    return both.where(F.col("common") * denominator >= (F.col("n_a") + F.col("n_b") - F.col("common")) * numerator).select("a", "b")


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a.astype(np.uint64)) * _FACTOR + mix(b.astype(np.uint64) ^ _FACTOR)


def cross_pairs(members: DataFrame, hubs: DataFrame, placed: DataFrame, numerator: int, denominator: int, block: int, closest: bool) -> DataFrame:
    """Candidate pairs ``(a, b)`` of different components that share a key in ``members (key, node)``.

    ``hubs (key, hub)`` names each key's hub and ``placed (node, comp, n, sketch, tried)`` describes
    the nodes.  Keys of one hub go to one task as far as it can hold them, so that a sketch travels
    few times; keys above ``block`` are cut into blocks, each pair of which is a task's share.  Nothing
    but pairs that pass the bounds and were not ``tried`` (an array of partners with larger numbers)
    leaves a task, with ``closest`` only one for each two components.
    """

    def compare(units: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        """Of rows sorted by unit: every pair in it, or, in a unit of two blocks, every pair across them."""
        if not len(units):
            return pd.DataFrame(columns=list(_PAIR))
        units = units.sort_values(["key", "i", "j"], kind="stable").reset_index(drop=True)
        unit = (units[["key", "i", "j"]] != units[["key", "i", "j"]].shift()).any(axis=1).cumsum().to_numpy()
        own, i, j = (units[c].to_numpy(np.int64) for c in ("own", "i", "j"))
        ids = nodes["node"].to_numpy(np.int64)
        order = np.argsort(ids)
        which = order[np.searchsorted(ids, units["node"].to_numpy(np.int64), sorter=order)]
        comp, sizes = (nodes[c].to_numpy(np.int64) for c in ("comp", "n"))
        sketches = nodes["sketch"].tolist()
        known = nodes.loc[nodes["tried"].notna(), ["node", "tried"]]
        tried = np.concatenate([pair_keys(np.full(len(t), n), np.asarray(t)) for n, t in zip(known["node"], known["tried"])]) if len(known) else np.zeros(0, np.uint64)
        first, count = runs_of(unit)
        width = np.fromiter(map(len, sketches), dtype=np.int64, count=len(ids))
        least = np.repeat(np.minimum.reduceat(width[which], first), count)
        found = []
        for size in np.unique(least):
            at = np.flatnonzero(least == size)
            used, place = np.unique(which[at], return_inverse=True)
            bits = np.stack([fold_sketch(sketches[k], size) for k in used]).view(np.uint64)
            for a, b in unit_pairs(*runs_of(unit[at])):
                x, y = at[a], at[b]
                open_ = (comp[which[x]] != comp[which[y]]) & ((i[x] == j[x]) | (own[x] != own[y]))
                a, b = place[a[open_]], place[b[open_]]
                distance = distances(bits, sizes[used], a, b, numerator, denominator)
                ok = np.flatnonzero(distance >= 0)
                x, y, distance = used[a[ok]], used[b[ok]], distance[ok]
                swap = ids[x] > ids[y]
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                new = ~np.isin(pair_keys(ids[x], ids[y]), tried)
                x, y, distance = x[new], y[new], distance[new]
                part = pd.DataFrame({"a": ids[x], "b": ids[y], "ca": np.minimum(comp[x], comp[y]), "cb": np.maximum(comp[x], comp[y]), "distance": distance})
                found.append(part.sort_values(["distance", "a", "b"]).drop_duplicates(["ca", "cb"] if closest else ["a", "b"]))
        out = pd.concat(found, ignore_index=True)
        return out.sort_values(["distance", "a", "b"]).drop_duplicates(["ca", "cb"] if closest else ["a", "b"])

    sizes = members.join(placed.select("node", "comp"), "node").groupBy("key").agg(F.count(F.lit(1)).alias("g"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
    sizes = materialize(sizes.select("key", "g", F.ceil(F.col("g") / block).cast("int").alias("blocks")).join(hubs, "key"), "open_keys")
    shares = sizes.groupBy("hub").agg(F.sum(F.col("g") * F.col("blocks")).alias("rows"))
    total = shares.agg(F.sum("rows")).first()[0] or 0
    shares = shares.select("hub", F.ceil(F.col("rows") / (TASK_BLOCKS * block)).cast("int").alias("shares"))
    rows = members.join(sizes.join(shares, "hub"), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    bucket = F.pmod(F.xxhash64("hub", F.pmod(F.xxhash64("key", "i", "j"), F.col("shares"))), F.lit(max(1, -(-int(total) // (TASK_BLOCKS * block)))))
    rows = materialize(rows.select(bucket.alias("bucket"), "key", "i", "j", "own", "node"), "units")
    nodes = rows.select(F.col("bucket").alias("of"), F.col("node").alias("seen")).distinct().join(placed, F.col("seen") == placed["node"]).drop("seen")
    found = rows.groupBy("bucket").cogroup(nodes.groupBy("of")).applyInPandas(compare, ", ".join(f"{c} long" for c in _PAIR))
    if closest:
        return found.groupBy("ca", "cb").agg(F.min(F.struct("distance", "a", "b")).alias("p")).select("p.a", "p.b")
    return found.select("a", "b").distinct()


def linked_rows(
    docs: DataFrame, shingle: int = SHINGLE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, text: str = "text",
    doc_id: str = "doc_id", block: int = BLOCK, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``doc_id, text_md5, n, component`` of every row; the component is a number, null without words."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    hint = lambda df, n: F.broadcast(df) if n <= broadcast_rows else df
    signed = materialize(signatures(narrow, shingle, numerator, denominator), "signatures")
    classes = materialize(signed.where("c1 is not null").groupBy("c1", "c2").agg(F.min("row").alias("node")), "classes")
    nodes = hint(classes.select(F.col("node").alias("row")), classes.count())

    offered = signed.join(nodes, "row", "left_semi").select(F.col("row").alias("node"), F.explode("keys").alias("key"))
    shared = materialize(offered.groupBy("key").agg(F.count(F.lit(1)).alias("g")).where("g > 1"), "shared_keys")
    n_shared = shared.count()
    members = materialize(offered.join(F.broadcast(shared) if n_shared <= min(BROADCAST_KEYS, broadcast_rows) else shared, "key"), "members")
    weights = members.groupBy("node").agg(F.sum("g").alias("weight"))
    known = materialize(
        signed.join(hint(weights, weights.count()), signed["row"] == weights["node"]).select("node", "n", "weight", "sketch", "text_md5"),
        "known",
    )

    ranked = members.join(known.select("node", "weight"), "node")
    hubs = materialize(ranked.groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("hub")), "hubs")
    stars = members.join(hubs, "key").where("node <> hub").select("node", "hub").distinct()
    stars = materialize(closest_hubs(stars, known, numerator, denominator), "stars")
    links = materialize(verified(stars, _sets(stars, narrow, known, classes, signed, shingle, hint), numerator, denominator), "links")
    comps, tried, old = connected_components(links), stars, [stars, links]
    for n_round in range(CLOSEST_ROUNDS + 1):
        partners = tried.groupBy("a").agg(F.collect_set("b").alias("tried")).withColumnRenamed("a", "node")  # a key or two components add one each
        placed = known.select("node", "n", "sketch").join(comps, "node", "left").join(partners, "node", "left")
        placed = materialize(placed.withColumn("comp", F.coalesce("component", "node")).drop("component"), "placed")
        cross = materialize(cross_pairs(members.select("key", "node"), hubs, placed, numerator, denominator, block, n_round < CLOSEST_ROUNDS), "cross")
        if cross.isEmpty():
            break
        more = materialize(verified(cross, _sets(cross, narrow, known, classes, signed, shingle, hint), numerator, denominator), "links")
        links, tried = links.unionByName(more), tried.unionByName(cross)
        comps = connected_components(links)
        old += [placed, cross, more]

    named = classes.join(comps, "node", "left").select("c1", "c2", F.coalesce("component", "node").alias("component"))
    named = materialize(named, "named")
    for done in (shared, members, hubs, known, classes, *old):
        discard(done)
    return signed.select("doc_id", "text_md5", "n", "c1", "c2").join(named, ["c1", "c2"], "left").select("doc_id", "text_md5", "n", "component")


def _sets(pairs: DataFrame, narrow: DataFrame, known: DataFrame, classes: DataFrame, signed: DataFrame, shingle: int, hint) -> DataFrame:
    """``node, tokens`` of the nodes of some pairs, from one reading of their texts."""
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    asked = materialize(known.select("node", "text_md5").join(asked, "node", "left_semi").join(classes, "node"), "asked")
    n = asked.count()
    texts = narrow.withColumn("text_md5", F.md5(F.coalesce("text", F.lit("")))).join(hint(asked.select("text_md5"), n), "text_md5", "left_semi")
    found = token_sets(texts, shingle).join(hint(asked.select("c1", "c2", "node"), n), ["c1", "c2"])
    return materialize(found.groupBy("node").agg(F.first("tokens").alias("tokens")), "sets")


def jaccard_components(
    docs: DataFrame, shingle: int = SHINGLE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, text: str = "text",
    doc_id: str = "doc_id", block: int = BLOCK, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every input row.

    Words are maximal runs of characters other than space and tab to carriage return, A-Z
    lower-cased; fewer words than a shingle make one token, none (or a null text) make an empty
    set, which is linked with nothing and has its own id as component.  Repeated rows are equal
    sets.  Rows with a null id link like others; a component is named by its smallest id that is
    not null, and by null if it has none.  An empty table gives an empty result.  Only the two
    named columns are read.
    """
    rows = linked_rows(docs, shingle, numerator, denominator, text, doc_id, block, broadcast_rows)
    least = rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def without_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS, **options) -> DataFrame:
    """``docs`` with one row of each component of linked texts: that with the smallest id, then text hash.

    Rows are dropped one by one, not by id: rows of one id with different texts are judged apart,
    null ids come last, and of several rows equal in id and text one stays.  Texts without words
    stay, each repeated or not.  All columns are kept, whatever their names.
    """
    rows = materialize(linked_rows(docs, text=text, doc_id=doc_id, **options).where("component is not null"), "linked")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_md5")
    best = rows.groupBy("component").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("size")).where("size > 1")
    grouped = rows.join(best, "component").withColumn("stays", order.eqNullSafe(F.col("best")))
    judged = materialize(
        grouped.groupBy("doc_id", "text_md5").agg(F.first("stays").alias("stays"), F.count(F.lit(1)).alias("copies")).where("not stays or copies > 1"),
        "judged",
    )
    marks = judged.select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5"), "stays")
    marks = F.broadcast(marks) if judged.count() <= broadcast_rows else marks
    own = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[doc_id].alias("_own"),
        F.md5(F.coalesce(docs[text], F.lit(""))).alias("_own_md5"),
    )
    joined = own.join(marks, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_own_md5") == F.col("_md5")), "left")
    single = joined.where("stays is null").select("_row.*")
    if judged.where("stays").isEmpty():
        return single
    repeated = joined.where("stays").dropDuplicates(["_own", "_own_md5"]).select("_row.*")
    return single.unionByName(repeated)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS l FROM w
), s AS (SELECT doc_id, len(l) AS n, unnest(l) AS shingle FROM l
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, b FROM reach r JOIN links ON other = a
), smallest AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_shingles, component_id FROM l JOIN smallest USING (doc_id)
"""
