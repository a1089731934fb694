"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents are tokenised where they lie; only lengths travel.  Pieces shorter than a sequence are
dealt by hash into blocks of bounded size.  Each block is evolved on several islands: a
chromosome assigns pieces to sequences, crossover injects whole well-filled sequences of one
parent into the other, drops the sequences that would hold a piece twice and best-fits the
displaced pieces.  Between epochs the best chromosome of an island migrates to the next island
of its block by a join.  Sequences that stay unfilled are dissolved, dealt anew over all blocks
and packed once more.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoflow.llm.common import discard, materialize, table

CAPACITY = 2048
BLOCK_ITEMS = 4096
"""Pieces of a block on average; it bounds the memory and time of one evolution."""
ISLANDS, POPULATION, EPOCHS, GENERATIONS = 3, 4, 2, 8
FULL = 0.99
"""Sequences filled to less than this share are dissolved once and packed again."""
CACHE_WORDS, CACHE_UNITS = 200_000, 400_000


def _letters_and_digits() -> tuple[str, str]:
    """Regex classes of letters and numbers below U+0250."""
    kinds = {"L": [], "N": []}
    for c in map(chr, range(0x250)):
        if unicodedata.category(c)[0] in kinds:
            kinds[unicodedata.category(c)[0]].append(re.escape(c))
    return "".join(kinds["L"]), "".join(kinds["N"])


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteBpe:
    """Ids of a byte-level BPE given as a ``tokenizers`` file, with bounded caches.

    A text is split at spaces; a unit (a space and what follows it) is split into words by the
    tokenizer's own pattern, and each new word is merged once.  Texts with two white-space
    characters in a row, where units would not be independent, are split into words as a whole;
    texts with characters from U+0250 on, where the pattern would depend on a version of Unicode,
    are encoded whole by ``tokenizers``, as are texts that hold an added token.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte, special = _byte_letters(), {t["content"] for t in spec.get("added_tokens", [])}
        self.added = sorted(special)
        ranks = {bytes(to_byte[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        letters, digits = _letters_and_digits()
        space = r"\t-\r \x85\xa0"
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{space}{letters}{digits}]+|[{space}]+(?![^{space}])|[{space}]+")
        self.below = bytes(range(0xCA))  # UTF-8 bytes of characters below U+0280; the few from U+0250 on are tested apart
        self.blank = bytes.maketrans(b"\t\n\v\f\r", b"     ")
        self.cache: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}

    def _words(self, text: str) -> bytes:
        words, cache = self.words.findall(text), self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in words:
            if w not in cache:
                cache[w] = array("I", self.merge(w)).tobytes()
        return b"".join([cache[w] for w in words])

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        raw = text.encode()
        if any(t in text for t in self.added) or raw.translate(None, self.below) or b"\xc9" in raw and re.search("[\u0250-\u027f]", text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if b"  " in raw.translate(self.blank) or "\x85" in text or "\xa0" in text:
            return self._words(text)
        first, *rest = text.split(" ")
        head, units = self._words(first), self.units
        try:
            return head + b"".join([units[u] for u in rest])
        except KeyError:
            if len(units) > CACHE_UNITS:
                units.clear()
            for u in rest:
                if u not in units:
                    units[u] = self._words(" " + u)
            return head + b"".join([units[u] for u in rest])


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: all but the first have the full length."""
    first = n_ids % capacity or capacity
    return [(0, first)] + [(a, capacity) for a in range(first, n_ids, capacity)]


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, uid``: uid is unique for each piece of each row."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        bpe, uid = ByteBpe(tokenizer_path), TaskContext.get().partitionId() << 33
        end = np.zeros(1, dtype="<u4").tobytes()
        for batch in batches:
            out = []
            for one, body in zip(batch["doc_id"], batch["text"]):
                ids = bpe.encode(body or "") + end
                for k, (a, n) in enumerate(cut(len(ids) // 4, capacity)):
                    out.append((one, k, a, n, zlib.crc32(ids[4 * a : 4 * (a + n)]), uid))
                    uid += 1
            columns = list(zip(*out)) if out else [[]] * 6
            yield pd.DataFrame(dict(zip(("doc_id", "piece", "start", "length", "ids_crc32", "uid"), columns)))

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, uid long")


# Chromosomes: an int32 array with the bin of each item of a block.


def best_fit(order, lengths, bins: np.ndarray, fills: list[int], capacity: int) -> None:
    """Put the items of ``order`` one after another where least space remains; changes bins and fills.

    A bit set holds the free spaces that occur, so the tightest one is found by a shift.
    """
    free: dict[int, list[int]] = {}
    mask = 0
    for b, fill in enumerate(fills):
        if 0 < fill < capacity:
            free.setdefault(capacity - fill, []).append(b)
            mask |= 1 << (capacity - fill)
    for i in order:
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                mask &= ~(1 << space)
        else:
            b, space = len(fills), capacity
            fills.append(0)
        bins[i] = b
        fills[b] += size
        if space > size:
            free.setdefault(space - size, []).append(b)
            mask |= 1 << (space - size)


def _fills(bins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.bincount(bins, weights=lengths).astype(np.int64)


def compact(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def fitness(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Smaller is better: the number of bins, then how evenly the fills are spread."""
    fills = _fills(bins, lengths)
    fills = fills[fills > 0] / capacity
    return len(fills), -float((fills**2).sum())


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Inject a random half of b's well-filled bins into a; best-fit what that displaces, longest first."""
    fills = _fills(b, lengths)
    well = np.flatnonzero(fills >= np.quantile(fills[fills > 0], 0.5))
    inject = np.zeros(len(fills), dtype=bool)
    inject[well[rng.random(len(well)) < 0.5]] = True
    taken = inject[b]
    broken = np.zeros(int(a.max()) + 1, dtype=bool)
    broken[a[taken]] = True
    displaced = np.flatnonzero(broken[a] & ~taken)
    child = np.where(taken, b + len(broken), a).astype(np.int32)
    child[displaced] = -1
    stay = child >= 0
    child[stay] = compact(child[stay])
    now = _fills(child[stay], lengths[stay]).tolist() if stay.any() else []
    best_fit(displaced[np.argsort(-lengths[displaced], kind="stable")], lengths, child, now, capacity)
    return child


def mutate(a: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Dissolve the emptiest bin and a few random ones and best-fit their items."""
    fills = _fills(a, lengths)
    gone = np.zeros(len(fills), dtype=bool)
    gone[np.argmin(np.where(fills > 0, fills, capacity + 1))] = True
    gone[rng.integers(0, len(fills), size=max(2, len(fills) // 50))] = True
    child = a.copy()
    out = np.flatnonzero(gone[a])
    child[out] = -1
    stay = child >= 0
    child[stay] = compact(child[stay])
    now = _fills(child[stay], lengths[stay]).tolist() if stay.any() else []
    best_fit(out[np.argsort(-lengths[out], kind="stable")], lengths, child, now, capacity)
    return child


def founders(lengths: np.ndarray, capacity: int, size: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Best-fit decreasing, and best-fit over orders that are disturbed more and more."""
    out = []
    for k in range(size):
        keys = lengths * (1 + 0.15 * k * rng.random(len(lengths)))
        bins, fills = np.zeros(len(lengths), dtype=np.int32), []
        best_fit(np.argsort(-keys, kind="stable"), lengths, bins, fills, capacity)
        out.append(bins)
    return out


def evolve(population: list[np.ndarray], lengths: np.ndarray, capacity: int, generations: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The best ``len(population)`` chromosomes after some generations; it ends early at the bound of total length."""
    bound, size = -(-int(lengths.sum()) // capacity), max(2, len(population))
    scored = sorted(((fitness(c, lengths, capacity), k, c) for k, c in enumerate(population)), key=lambda x: x[:2])
    for g in range(generations):
        if scored[0][0][0] <= bound:
            break
        a, b = scored[0][2], scored[1 + int(rng.integers(0, len(scored) - 1))][2] if len(scored) > 1 else scored[0][2]
        children = [
            crossover(a, b, lengths, capacity, rng), mutate(crossover(b, a, lengths, capacity, rng), lengths, capacity, rng),
            mutate(a, lengths, capacity, rng),
        ]
        scored += [(fitness(c, lengths, capacity), size + 3 * g + k, c) for k, c in enumerate(children)]
        scored = sorted(scored, key=lambda x: x[:2])[:size]
    return [c for *_, c in scored[: len(population)]]


_STATE = "block long, island int, bins_used int, uids binary, lengths binary, population array<binary>"


def _state_row(block: int, island: int, uids, lengths, population, capacity) -> dict:
    return {
        "block": block, "island": island, "bins_used": fitness(population[0], lengths, capacity)[0], "uids": uids.tobytes(),
        "lengths": lengths.astype(np.int64).tobytes(), "population": [c.astype(np.int32).tobytes() for c in population],
    }


def pack(
    items: DataFrame, capacity: int, block_items: int = BLOCK_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS,
    generations: int = GENERATIONS, population: int = POPULATION,
) -> DataFrame:
    """``uid, block, bin, fill, offset`` for items ``uid long, length long`` (1 to ``capacity``)."""
    n_blocks = max(1, -(-items.count() // block_items))

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid")
        block, uids, lengths = int(pdf["block"].iloc[0]), pdf["uid"].to_numpy(np.int64), pdf["length"].to_numpy(np.int64)
        rows = []
        for island in range(islands):
            rng = np.random.default_rng([block, island])
            first = sorted(founders(lengths, capacity, population, rng), key=lambda c: fitness(c, lengths, capacity))
            rows.append(_state_row(block, island, uids, lengths, first, capacity))
            if rows[-1]["bins_used"] <= -(-int(lengths.sum()) // capacity):
                break  # one island with a perfect packing is enough
        return pd.DataFrame(rows)

    def epoch(number: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for r in batch.itertuples():
                    lengths, uids = np.frombuffer(r.lengths, np.int64), np.frombuffer(r.uids, np.int64)
                    members = [np.frombuffer(c, np.int32) for c in r.population] + ([np.frombuffer(r.migrant, np.int32)] if r.migrant is not None else [])
                    best = evolve(members, lengths, capacity, generations, np.random.default_rng([r.block, r.island, number]))
                    rows.append(_state_row(r.block, r.island, uids, lengths, best[:population], capacity))
                yield pd.DataFrame(rows, columns=["block", "island", "bins_used", "uids", "lengths", "population"])

        return run

    def unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                lengths, uids, bins = np.frombuffer(r.lengths, np.int64), np.frombuffer(r.uids, np.int64), np.frombuffer(r.best, np.int32)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(lengths[order])
                new = np.diff(bins[order], prepend=-1) != 0
                before = (ends - lengths[order])[new][np.cumsum(new) - 1]
                yield pd.DataFrame({"uid": uids[order], "block": r.block, "bin": bins[order].astype(np.int64), "fill": _fills(bins, lengths)[bins[order]], "offset": ends - lengths[order] - before})

    dealt = items.select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(n_blocks)).alias("block"))
    state = materialize(dealt.groupBy("block").applyInPandas(found, _STATE), "founders")
    for number in range(epochs):
        migrants = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.element_at("population", 1).alias("migrant"))
        next_state = materialize(state.join(migrants, ["block", "island"], "left").mapInPandas(epoch(number), _STATE), f"epoch{number}")
        discard(state)
        state = next_state
    best = state.groupBy("block").agg(F.min_by(F.struct("uids", "lengths", F.element_at("population", 1).alias("best")), F.struct("bins_used", "island")).alias("b"))
    return best.select("block", "b.*").mapInPandas(unfold, "uid long, block long, bin long, fill long, offset long")


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS, text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one row per piece of every input row.

    A null text is an empty one: its only id is the closing 0.  Repeated rows are packed one by
    one.  Documents longer than ``capacity`` are cut, the first piece being the shorter one; full
    pieces are sequences of their own.  An empty table gives an empty result.  Only the two named
    columns are read.
    """
    pieces = materialize(tokenised_pieces(docs, tokenizer_path, capacity, text, doc_id), "pieces")
    items = pieces.where(F.col("length") < capacity).select("uid", "length")
    first = materialize(pack(items, capacity, block_items), "packed")
    poor = F.col("fill") < int(FULL * capacity)
    again = materialize(pack(first.where(poor).join(items, "uid").select("uid", "length"), capacity, block_items), "packed_again")
    count = lambda df: df.select("block", "bin").distinct().count()
    placed = first.withColumn("level", F.lit(0))
    if count(again) < count(first.where(poor)):
        placed = placed.where(~poor).unionByName(again.withColumn("level", F.lit(1)))
    number = (F.col("level") * F.lit(1 << 61) + F.col("block") * F.lit(1 << 20) + F.col("bin")).cast("long")
    placed = placed.select("uid", number.alias("sequence_id"), "offset")
    whole = pieces.where(F.col("length") >= capacity).select("*", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return pieces.where(F.col("length") < capacity).join(placed, "uid").unionByName(whole).drop("uid")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())
