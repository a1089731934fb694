"""Sequence analytics: k-mers, motifs, substitutions, logos, designs, saturation mutagenesis."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoflow.functions import kmer_counts
from isoflow.functions.edits import BLOCK_TEXTS, CELLS, TILE, nearest_in_bulk
from isoflow.functions.edits import nearest as nearest_of
from isoflow.functions.sequences import IUPAC, kmers, motif_count
from isoflow.operators.psi import psi_of
from isoflow.sources.scratch import written


BATCH_BYTES = 4 << 20
"""Bytes of a batch of whole texts that a Python worker holds; a longer text is a batch of its own."""


def _small_batches(table: DataFrame) -> None:
    """Session setting: texts go to Python in batches of bounded bytes, since 10,000 rows may be any size and a worker holds them several times over."""
    table.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def kmer_totals(table: DataFrame, k: int = 4, key: str = "doc_id", seq: str = "seq") -> DataFrame:
    """``kmer, n, n_docs``: how often each k-mer occurs, and in how many keys.

    Sequences of a key that occurs once are counted within tasks, and only sums leave them; a key of several rows
    is brought together first.  A null key is none.
    """
    _small_batches(table)
    rows = table.where(F.length(seq) >= k).select(F.col(key).alias("key"), F.col(seq).alias("seq"))
    several = written(table.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("rows")).where("key is not null and rows > 1").select("key"), "several")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seqs, own = batch["seq"].tolist(), batch["key"].notna().to_numpy()
            for first, last in kmer_counts.groups(seqs):
                owner, kmer, n, names = kmer_counts.distinct(seqs[first:last], k)
                if names:
                    yield pd.DataFrame({"kmer": names, "n": np.bincount(kmer, n, minlength=len(names)).astype(np.int64), "n_docs": np.bincount(kmer, own[first:last][owner], minlength=len(names)).astype(np.int64)})

    once = rows.join(several, "key", "left_anti").select("key", "seq").mapInPandas(count, "kmer string, n long, n_docs long")
    more = rows.join(several, "key", "left_semi").select("key", F.explode(kmers(F.col("seq"), k)).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("n_docs"))
    return once.unionByName(more).groupBy("kmer").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def kmer_enrichment(groups: DataFrame, k: int = 4, group: str = "grp", seq: str = "seq") -> DataFrame:
    """Sequences with and without each k-mer in the group (``grp`` true) and outside: ``kmer, a, b, c, d``."""
    _small_batches(groups)
    rows = groups.select(F.col(group).cast("boolean").alias("g"), F.col(seq).alias("seq"))
    totals = rows.agg(F.count_if("g").alias("n1"), F.count_if(~F.col("g")).alias("n0"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seqs, g = batch["seq"].tolist(), batch["g"].map({True: 1, False: 0}).fillna(-1).to_numpy(int)
            for first, last in kmer_counts.groups(seqs):
                owner, kmer, _, names = kmer_counts.distinct(seqs[first:last], k)
                side = g[first:last][owner]
                yield pd.DataFrame({"kmer": names, **{c: np.bincount(kmer[side == v], minlength=len(names)) for c, v in (("a", 1), ("c", 0))}})

    seen = rows.where("seq is not null").mapInPandas(count, "kmer string, a long, c long").groupBy("kmer").agg(F.sum("a").alias("a"), F.sum("c").alias("c"))
    out = seen.crossJoin(F.broadcast(totals))  # one row
    return out.select("kmer", "a", (F.col("n1") - F.col("a")).alias("b"), "c", (F.col("n0") - F.col("c")).alias("d"))


def _fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p-value: tables at most as likely as this one, margins fixed.

    Tables are as likely as this one or less from it outwards and from its counterpart on the other
    side of the mode, which is found by halving; each side is summed until nothing is added any more.
    """
    n1, n0, m = a + b, c + d, a + c
    low, high = max(0, m - n0), min(n1, m)
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    log = lambda x: choose(n1, x) + choose(n0, m - x) - choose(n1 + n0, m)
    mode = min(high, max(low, (n1 + 1) * (m + 1) // (n1 + n0 + 2)))
    limit = log(a) + 1e-7

    def tail(x: int, step: int) -> float:
        """Sum of the probabilities from ``x`` on, away from the mode."""
        total, end = 0.0, high if step > 0 else low
        while (end - x) * step >= 0:
            at = x + step * np.arange(min(4096, (end - x) * step + 1), dtype=float)
            ratio = (n1 - at) * (m - at) / ((at + 1) * (n0 - m + at + 1)) if step > 0 else at * (n0 - m + at) / ((n1 - at + 1) * (m - at + 1))
            terms = np.exp(log(x)) * np.concatenate([[1.0], np.cumprod(ratio[:-1])])
            total += terms.sum()
            if terms[-1] <= 1e-18 * total:
                break
            x += step * len(at)
        return total

    def first(near: int, far: int) -> int | None:
        """The table nearest to the mode on one side that is no more likely than this one."""
        if log(far) > limit:
            return None
        while abs(far - near) > 1:
            middle = (near + far) // 2
            near, far = (near, middle) if log(middle) <= limit else (middle, far)
        return far

    if log(mode) <= limit:
        return 1.0
    sides = [(first(mode, high), 1), (first(mode, low), -1)]
    return min(1.0, sum(tail(x, step) for x, step in sides if x is not None))


def _fisher_series(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([_fisher(*map(int, x)) for x in zip(a, b, c, d)])


def fisher_p(a, b, c, d):
    """Fisher's two-sided p-value of the table (a, b; c, d)."""
    return F.pandas_udf(_fisher_series, "double")(a, b, c, d)


def kmer_test(groups: DataFrame, k: int = 4) -> DataFrame:
    """:func:`kmer_enrichment` with the sample odds ratio, Fisher's p-value and FDR."""
    from isoflow.operators.stats import bh_adjust

    t = kmer_enrichment(groups, k)
    odds = F.try_divide(F.col("a") * F.col("d"), F.col("b") * F.col("c"))
    return bh_adjust(t.withColumns({"log2_odds": F.when(odds > 0, F.log2(odds)), "p": fisher_p("a", "b", "c", "d")}))


def kmer_frequency(table: DataFrame, k: int = 3, by: str = "lang", seq: str = "seq") -> DataFrame:
    """Mean share of each k-mer among a sequence's k-mers, absent k-mers counting as 0."""
    _small_batches(table)
    sizes = table.where(F.length(seq) >= k).groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    kind = table.schema[by].dataType.simpleString()

    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for group, own in batch.groupby(by, dropna=False, sort=False):
                seqs = own[seq].tolist()
                for first, last in kmer_counts.groups(seqs):
                    owner, kmer, n, names = kmer_counts.distinct(seqs[first:last], k)
                    places = np.array([max(1, len(s) - k + 1) for s in seqs[first:last]])
                    yield pd.DataFrame({by: [group] * len(names), "kmer": names, "s": np.bincount(kmer, n / places[owner], minlength=len(names))})

    shares = table.where(F.length(seq) >= k).select(by, seq).mapInPandas(share, f"{by} {kind}, kmer string, s double")
    sums = shares.groupBy(by, "kmer").agg(F.sum("s").alias("s"))
    return sums.join(sizes, by).select(by, "kmer", (F.col("s") / F.col("n")).alias("frequency"))


def kmer_background(table: DataFrame, replicates: int, n: int, k: int = 3, seq: str = "seq", key: str = "doc_id", seed: int = 0) -> DataFrame:
    """k-mer counts of ``replicates`` random draws of ``n`` sequences, all in one job.

    A draw has the sequences with the smallest hashes of key and replicate, so it hangs on the rows
    alone.  A cut-off by the number of sequences leaves little more than ``n`` of each draw to order.
    """
    below = min(1.0, (n + 8 * n**0.5 + 50) / max(1, table.count()))
    cut = F.lit(min(2**63 - 1, int(-(2**63) + below * (2**64 - 1))))
    draw = lambda r: F.xxhash64(F.col(key), r, F.lit(seed))
    near = F.filter(F.sequence(F.lit(1), F.lit(replicates)), lambda r: draw(r) <= cut)
    ids = table.select(key, seq, F.explode(near).alias("replicate"))
    w = Window.partitionBy("replicate").orderBy(draw(F.col("replicate")), key, seq)
    drawn = ids.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    return drawn.select("replicate", F.explode(kmers(F.col(seq), k)).alias("kmer")).groupBy("replicate", "kmer").agg(F.count(F.lit(1)).alias("n"))


def motif_hits(table: DataFrame, motifs, seq: str = "seq") -> DataFrame:
    """Presence and count of each motif in each sequence."""
    hits = F.explode(F.array(*[F.struct(F.lit(m).alias("motif"), motif_count(F.col(seq), m).alias("n")) for m in motifs]))
    return table.withColumn("_hit", hits).select(*table.columns, "_hit.motif", "_hit.n", (F.col("_hit.n") > 0).alias("present"))


def _motif_starts(table: DataFrame, motif: str, by: str, seq: str) -> DataFrame:
    """``by, position, n``: how often the motif starts at each position (from 1) of the sequences of a group.

    Besides, one row at position 0 with their number and one at -1 with the longest length, if any is known.  Sums over
    a task leave it, not the places of each sequence; the rows are written, so that sequences are evaluated once.
    """
    _small_batches(table)
    letters = [[ord(c) for c in IUPAC[m].strip("[]")] for m in re.sub("U", "T", motif.upper())]
    width = len(letters)
    kind = table.schema[by].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, totals, longest = {}, {}, {}
        for batch in batches:
            for group, own in batch.groupby("_by", dropna=False, sort=False):
                group = None if pd.isna(group) else group
                seqs = own["seq"].dropna().tolist()
                totals[group] = totals.get(group, 0) + len(own)
                for first, last in kmer_counts.groups(seqs):
                    flat = np.frombuffer("".join(seqs[first:last]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
                    sizes = np.array([len(s) for s in seqs[first:last]], dtype=np.int64)
                    longest[group] = max(longest.get(group, 0), int(sizes.max()))
                    room = max(0, len(flat) - width + 1)
                    found = np.ones(room, dtype=bool)
                    for j, allowed in enumerate(letters):
                        found &= np.isin(flat[j : j + room], allowed)
                    at = np.flatnonzero(found)
                    ends = np.cumsum(sizes)
                    owner = np.searchsorted(ends, at, side="right")
                    at, owner = at[at + width <= ends[owner]], owner[at + width <= ends[owner]]
                    n = np.bincount(at - ends[owner] + sizes[owner])
                    before = sums.get(group, np.zeros(0, dtype=np.int64))
                    more, less = (n, before) if len(n) > len(before) else (before, n)
                    sums[group] = more.astype(np.int64)
                    sums[group][: len(less)] += less
        for group, n in totals.items():
            starts = sums.get(group, np.zeros(0, dtype=np.int64))
            at = np.flatnonzero(starts)
            known = [longest[group]] if group in longest else []
            yield pd.DataFrame({"_by": pd.Series([group] * (len(at) + 1 + len(known)), dtype=object), "position": np.concatenate([at + 1, [0], [-1] * len(known)]).astype(np.int32), "n": np.concatenate([starts[at], [n], known]).astype(np.int64)})

    parts = table.select(F.col(by).alias("_by"), F.col(seq).alias("seq")).mapInPandas(count, f"_by {kind}, position int, n long")
    total = F.when(F.col("position") < 0, F.max("n")).otherwise(F.sum("n"))
    return written(parts.groupBy("_by", "position").agg(total.alias("n")).withColumnRenamed("_by", by), "starts")


def motif_profile(table: DataFrame, motif: str, width: int, by: str = "lang", seq: str = "seq") -> DataFrame:
    """Share of a group's sequences in which the motif, of ``width`` letters, starts at each position."""
    starts = _motif_starts(table, motif, by, seq)
    sizes = starts.where("position = 0").select(by, F.col("n").alias("total"))
    return starts.where("position > 0").join(sizes, by).select(by, "position", (F.col("n") / F.col("total")).alias("share"))


def motif_counts_smoothed(table: DataFrame, motif: str, width: int, by: str = "lang", seq: str = "seq", share: float = 0.1) -> DataFrame:
    """``by, position, n, smooth`` for all positions up to the longest sequence: how many sequences of a group have
    the motif there, and the weighted mean over a triangular window of ``share`` of that length (3 at
    least); null where the window is cut off.

    Weights rise and fall by one a place, so the sum over a window comes from running sums of the counts
    and of position times count, whatever its width.
    """
    starts = _motif_starts(table, motif, by, seq)
    longest = starts.where("position = -1").agg(F.max("n")).first()[0] or 0
    size = max(3, math.ceil(round(longest * share, 9)))
    middle, after = math.ceil(size / 2), size // 2
    total = sum(range(1, middle + 1)) + sum(range(1, size - middle + 1))
    grid = starts.where("position = 0").select(by, F.explode(F.sequence(F.lit(1), F.lit(max(1, longest)))).alias("position")).where(F.lit(longest > 0))
    found = starts.where("position > 0").select(F.col(by).alias("_by"), F.col("position").alias("_at"), "n")
    dense = grid.join(found, (F.col(by) == F.col("_by")) & (F.col("position") == F.col("_at")), "left").select(by, "position", F.coalesce("n", F.lit(0)).alias("n"))
    series = Window.partitionBy(by).orderBy("position")
    upto = series.rowsBetween(Window.unboundedPreceding, 0)
    dense = dense.withColumns({"_x": F.sum("n").over(upto), "_y": F.sum(F.col("n") * F.col("position")).over(upto)})
    first, last = F.col("position") + after - size + 1, F.col("position") + after

    def between(c, a, b):
        """Sum from ``a`` to ``b`` places on, both included."""
        at = lambda k: F.col(c) if k == 0 else F.lead(c, k).over(series) if k > 0 else F.coalesce(F.lag(c, -k).over(series), F.lit(0))
        return at(b) - at(a - 1)

    start, top = after - size + 1, after - size + middle
    rising = between("_y", start, top) - (first - 1) * between("_x", start, top)
    falling = (last + 1) * between("_x", top + 1, after) - between("_y", top + 1, after)
    return dense.withColumn("smooth", F.when((first >= 1) & (last <= longest), (rising + falling) / total)).drop("_x", "_y")


def motif_test(table: DataFrame, motifs, value: str, seq: str = "seq") -> DataFrame:
    """:func:`motif_ttest` with the one-sided p-value of a larger mean where the motif is, and the FDR over the motifs."""
    from isoflow.operators.stats import bh_adjust, t_tail

    two = t_tail(F.col("t"), F.col("df"))
    tested = motif_ttest(table, motifs, value, seq).withColumn("_two", two)
    return bh_adjust(tested.withColumn("p", F.when(F.col("t") > 0, F.col("_two") / 2).otherwise(1 - F.col("_two") / 2)).drop("_two"))


def motif_ttest(table: DataFrame, motifs, value: str, seq: str = "seq") -> DataFrame:
    """Welch's t of a value between sequences with and without each motif."""
    rows = motif_hits(table.select(seq, value), motifs, seq)
    side = lambda f, p: f(F.when(F.col("present") == p, F.col(value)))
    a = rows.groupBy("motif").agg(*[side(f, p).alias(f"{n}{int(p)}") for p in (True, False) for n, f in (("mean", F.avg), ("var", F.var_samp), ("n", F.count))])
    v1, v0 = F.try_divide("var1", "n1"), F.try_divide("var0", "n0")
    t = F.try_divide(F.col("mean1") - F.col("mean0"), F.sqrt(v1 + v0))
    df = F.try_divide(F.pow(v1 + v0, F.lit(2)), F.try_divide(v1 * v1, F.col("n1") - 1) + F.try_divide(v0 * v0, F.col("n0") - 1))
    return a.select("motif", "mean1", "mean0", "n1", "n0", t.alias("t"), df.alias("df"))


FEW_PARENTS = 100_000
"""Parents up to which they are broadcast to their designs."""


def substitutions(designs: DataFrame, parents: DataFrame, key: str = "parent") -> DataFrame:
    """Positions (from 1) at which a design differs from its parent of the same length.

    Few parents go to their designs, which stay where they are: a parent may have any share of them.
    """
    parents = written(parents.select(key, F.col("seq").alias("parent_seq")), "parents")
    parents = F.broadcast(parents) if parents.count() <= FEW_PARENTS else parents
    both = designs.join(parents, key).where(F.length("seq") == F.length("parent_seq"))
    bases = F.arrays_zip(F.split("parent_seq", "").alias("from_base"), F.split("seq", "").alias("to_base"))
    kept = [c for c in designs.columns if c != "seq"]
    rows = both.select(*kept, F.posexplode(bases).alias("place", "b")).where("b.from_base <> b.to_base")
    return rows.select(*kept, (F.col("place") + 1).alias("position"), "b.from_base", "b.to_base")


def substitution_profile(subs: DataFrame, n_designs: int) -> DataFrame:
    """Share of designs with each substituted base at each position."""
    return subs.groupBy("position", "to_base").agg((F.count(F.lit(1)) / n_designs).alias("share"))


def logo_matrix(table: DataFrame, width: int, seq: str = "seq", alphabet: str = "ACGT") -> DataFrame:
    """Share and height in bits of each base at each of the first ``width`` positions."""
    places = F.explode(F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.struct(i.alias("position"), F.substr(F.col(seq), i, F.lit(1)).alias("base"))))
    rows = table.where(F.length(seq) >= width).select(places.alias("p")).select("p.*").where(F.col("base").isin(list(alphabet)))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("position"))
    counts = rows.groupBy("position", "base").agg(F.count(F.lit(1)).alias("n")).withColumn("share", share)
    bits = F.lit(math.log2(len(alphabet))) + F.sum(F.col("share") * F.log2("share")).over(Window.partitionBy("position"))
    return counts.withColumn("bits", F.col("share") * bits).drop("n")


def base_composition(table: DataFrame, seq: str = "seq", by: str = "lang", alphabet: str = "ACGT") -> DataFrame:
    """Bases of each group, absent ones as 0."""
    counts = table.groupBy(by).agg(*[F.coalesce(F.sum(F.length(seq) - F.length(F.replace(seq, F.lit(b)))), F.lit(0)).alias(b) for b in alphabet])
    return counts.select(by, F.explode(F.array(*[F.struct(F.lit(b).alias("base"), F.col(b).alias("n")) for b in alphabet])).alias("x")).select(by, "x.*")


def min_edit_distance(designs: DataFrame, library: DataFrame, most: int = 3) -> DataFrame:
    """``designs`` with the smallest Levenshtein distance of ``seq`` to any of the library.

    A library of up to ``FEW_REFS`` sequences goes to the designs, which are spread and compared with all of it where they
    are.  For a larger one near sequences come first: what lies within ``most`` edits is found by joins on shared segments,
    and the sequences left over are compared with the library in blocks.  A null sequence has no distance, nor has any if
    the library is empty; equal sequences of a task are compared once.
    """
    refs = written(library.select(F.col("seq").alias("ref")).where("ref is not null").distinct(), "library")
    number, letters = refs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("ref")), F.lit(0))).first()
    if number <= FEW_REFS and letters <= FEW_LETTERS:
        return _to_few(designs, sorted((r["ref"] for r in refs.collect()), key=len))
    asked = written(designs.select("seq").where("seq is not null").distinct(), "asked")
    near = written(_within(asked, refs, most), "near")
    far = _in_blocks(asked.join(near, "seq", "left_anti"), refs)
    best = near.unionByName(far).withColumnRenamed("seq", "_seq")
    return designs.join(best, F.col("seq") == F.col("_seq"), "left").drop("_seq")


def _to_few(designs: DataFrame, refs: list[str]) -> DataFrame:
    """``designs`` with the distance to the nearest of a small library, sorted by length, without joins."""
    if not refs:
        return designs.withColumn("distance", F.lit(None).cast("int"))
    spark, tile = designs.sparkSession, TILE
    _small_batches(designs)
    shared = spark.sparkContext.broadcast(refs)

    @F.pandas_udf("int")
    def distance(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def together(held: list[pd.Series]) -> Iterator[pd.Series]:
            rows = pd.concat(held, ignore_index=True)
            asked = np.flatnonzero(rows.notna().to_numpy())
            out = pd.Series(pd.NA, index=rows.index, dtype="Int32")
            if len(asked):
                out.iloc[asked] = nearest_in_bulk(rows.iloc[asked].tolist(), shared.value, tile)
            at = np.cumsum([0, *map(len, held)])
            yield from (out.iloc[a:b] for a, b in zip(at, at[1:]))

        held, rows, letters = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, letters = rows + len(batch), letters + int(batch.str.len().sum())
            if rows >= BLOCK_TEXTS or letters >= CELLS:
                yield from together(held)
                held, rows, letters = [], 0, 0
        if held:
            yield from together(held)

    spread = designs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "seq")  # a file may be one task
    return spread.sortWithinPartitions("seq").withColumn("distance", distance("seq"))


def _within(asked: DataFrame, refs: DataFrame, most: int) -> DataFrame:
    """``seq, distance`` of the sequences that have one of ``refs`` within ``most`` edits.

    A library sequence is cut into ``most + 1`` segments, of which one is free of edits; designs offer
    their substrings of that length near its place, and only pairs that share one are compared.
    Sequences of up to ``most`` bases have segments that may be empty: those pairs meet by length.
    """
    segments = most + 1
    at = lambda length, i: F.floor(length * i / segments).cast("int")
    refs = refs.withColumn("n", F.length("ref"))
    cut = [F.struct(F.lit(i).alias("i"), F.substr("ref", at(F.col("n"), i) + 1, at(F.col("n"), i + 1) - at(F.col("n"), i)).alias("part")) for i in range(segments)]
    refs = refs.select("ref", "n", F.explode(F.array(*cut)).alias("s")).select("ref", "n", "s.*")
    asked = asked.withColumn("n", F.explode(F.sequence(F.greatest(F.length("seq") - most, F.lit(0)), F.length("seq") + most)))
    offers = []

    def part_at(i, size):
        return lambda p: F.struct(F.lit(i).alias("i"), F.substr("seq", p + 1, size).alias("part"))

    for i in range(segments):
        start, size = at(F.col("n"), i), at(F.col("n"), i + 1) - at(F.col("n"), i)
        shift = F.length("seq") - F.col("n")  # a segment moves by the edits before it, and so does what follows it from the end
        begin = F.greatest(F.lit(0), start - i, start + shift - (most - i))
        end = F.least(F.length("seq") - size, start + i, start + shift + (most - i))
        places = F.when(begin <= end, F.sequence(begin, F.greatest(begin, end))).otherwise(F.array().cast("array<int>"))
        offers.append(F.transform(places, part_at(i, size)))
    asked = asked.select("seq", "n", F.explode(F.array_distinct(F.concat(*offers))).alias("o")).select("seq", "n", "o.*")
    pairs = asked.join(refs, ["n", "i", "part"]).select("seq", "ref").distinct()
    return pairs.withColumn("d", F.levenshtein("seq", "ref", most)).where("d >= 0").groupBy("seq").agg(F.min("d").alias("distance"))


BLOCK_SEQUENCES, BLOCK_LETTERS = 2048, 1 << 18
"""A block of sequences has about so many, or fewer if they are long."""
FEW_REFS, FEW_LETTERS = 4096, 1 << 20
"""Library sequences, and letters of them, up to which comparing all costs less than looking for the near ones by segments first."""
MOST_TASKS = 20_000


def _blocks(rows: DataFrame, column: str, block: str) -> tuple[DataFrame, int]:
    """The distinct strings of ``column`` in arrays of bounded size, dealt by hash, and the number of those."""
    n, letters = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(column)), F.lit(0))).first()
    blocks = max(1, math.ceil(n / BLOCK_SEQUENCES), math.ceil(letters / BLOCK_LETTERS))
    dealt = rows.withColumn(block, F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int"))
    return dealt.groupBy(block).agg(F.sort_array(F.collect_list(column)).alias(column)), blocks


def _in_blocks(asked: DataFrame, refs: DataFrame) -> DataFrame:
    """``seq, distance`` to the nearest of ``refs``, every block of sequences against every block of the library.

    A pair of blocks is one row and gives one distance for each of its sequences; the smallest over
    the library's blocks is the answer.  The work is the product of both sizes, some 64 letters of a
    column in each word operation; memory is that of two blocks.
    """
    ours, n_ours = _blocks(asked, "seq", "own")
    theirs, n_theirs = _blocks(refs, "ref", "block")
    pairs = ours.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_theirs - 1)))).join(theirs, "block")
    spread = pairs.repartition(min(MOST_TASKS, n_ours * n_theirs), "own", "block")

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for seqs, refs in zip(batch["seq"], batch["ref"]):
                seqs, refs = sorted(seqs, key=len), sorted(refs, key=len)  # those of a tile end together
                yield pd.DataFrame({"seq": seqs, "distance": nearest_of(seqs, refs, TILE)})

    return spread.select("seq", "ref").mapInPandas(nearest, "seq string, distance int").groupBy("seq").agg(F.min("distance").alias("distance"))


def satmut_delta(satmut: DataFrame, min_total: int = 30) -> DataFrame:
    """PSI of each mutation and its difference from the parent (position 0), by element and condition.

    Replicates are averaged; parents are aggregated first, so that none multiplies rows.
    """
    rows = satmut.where(F.col("included") + F.col("skipped") >= min_total).withColumn("psi", psi_of(F.col("included"), F.col("skipped")))
    rows = written(rows.select("condition", "idx", "position", "nucleotide", "psi"), "rows")
    parents = rows.where("position = 0").groupBy("condition", "idx").agg(F.avg("psi").alias("parent_psi"))
    means = rows.where("position > 0").groupBy("condition", "idx", "position", "nucleotide").agg(F.avg("psi").alias("psi"))
    return means.join(parents, ["condition", "idx"], "left").withColumn("delta", F.col("psi") - F.col("parent_psi"))


def position_effects(deltas: DataFrame) -> DataFrame:
    """Mean effect of each position and its z against the mean of all effects."""
    overall = deltas.agg(F.avg("delta").alias("mu"), F.stddev_samp("delta").alias("sd"))
    each = deltas.groupBy("position").agg(F.avg("delta").alias("mean_delta"), F.count("delta").alias("n"))
    z = F.try_divide(F.col("mean_delta") - F.col("mu"), F.col("sd") / F.sqrt(F.col("n").cast("double")))
    return each.crossJoin(F.broadcast(overall)).select("position", "mean_delta", "n", z.alias("z"))  # one row


def position_tests(deltas: DataFrame) -> DataFrame:
    """:func:`position_effects` with two-sided normal p-values and FDR."""
    from isoflow.operators.stats import bh_adjust, normal_tail

    return bh_adjust(position_effects(deltas).withColumn("p", normal_tail(F.col("z"))))


def effect_means(deltas: DataFrame) -> DataFrame:
    """Mean effect of the three substitutions of each position, with the sign of a loss: -sum / 3."""
    return deltas.groupBy("condition", "idx", "position").agg((-F.sum("delta") / 3).alias("effect"))


def effect_matrix(deltas: DataFrame, lengths: DataFrame, alphabet: str = "ACGT") -> DataFrame:
    """``condition, idx, position``, the effect of each base and ``effect``, minus a third of their sum, for all
    positions from 1 to the element's ``length`` (``lengths (idx, length)``); 0 where nothing was measured."""
    deltas = written(deltas.select("condition", "idx", "position", "nucleotide", "delta"), "deltas")
    seen = deltas.select("condition", "idx").distinct().join(lengths, "idx")
    grid = seen.select("condition", "idx", F.explode(F.expr("sequence(1, length)")).alias("position"))
    bases = deltas.groupBy("condition", "idx", "position").agg(*[F.max(F.when(F.col("nucleotide") == b, F.col("delta"))).alias(b) for b in alphabet])
    filled = grid.join(bases, ["condition", "idx", "position"], "left").na.fill(0.0, list(alphabet))
    return filled.withColumn("effect", -sum((F.col(b) for b in alphabet[1:]), F.col(alphabet[0])) / 3)


def effect_blocks(
    deltas: DataFrame, lengths: DataFrame, sigma: float = 1.1, z: float = 3.0, min_length: int = 3, min_mean: float = 0.25,
) -> DataFrame:
    """``condition, idx, direction, start, stop, len, mean``: runs of positions whose smoothed effect stands out.

    Effects are smoothed along the element; positions more than ``z`` robust deviations from its median
    that follow each other make a block, if it is long and its own mean effect strong enough.
    """
    from isoflow.operators.stats import call_blocks, gaussian_smooth, robust_z

    effects = effect_matrix(deltas, lengths).withColumn("series", F.struct("condition", "idx"))
    scored = robust_z(gaussian_smooth(effects, "series", "position", "effect", sigma), "series", "smooth")
    flagged = scored.withColumn("direction", F.when(F.col("z") > z, 1).when(F.col("z") < -z, -1).otherwise(0))
    return call_blocks(flagged, "direction", "series", "position", "effect", min_length, min_mean).select("series.*", "direction", "start", "stop", "len", "mean")


def global_position(table: DataFrame) -> DataFrame:
    """Dense rank of positions within each location, by element and condition."""
    return table.withColumn("place", F.dense_rank().over(Window.partitionBy("condition", "idx").orderBy("position")))


def observed_vs_predicted(observed: DataFrame, predicted: DataFrame) -> DataFrame:
    """Observed and predicted effects of the same mutation."""
    keys = ["condition", "idx", "position", "nucleotide"]
    return observed.select(*keys, F.col("delta").alias("observed")).join(predicted.select(*keys, F.col("delta").alias("predicted")), keys)


def well_intensity(objects: DataFrame, background: dict[str, float], min_area: float = 0.0) -> DataFrame:
    """Area-weighted intensity of each well and channel, background taken off, 0 at least."""
    level = F.coalesce(*[F.when(F.col("channel") == c, F.lit(float(b))) for c, b in background.items()], F.lit(0.0))
    rows = objects.where(F.col("area") >= min_area).withColumn("clean", F.greatest(F.col("intensity") - level, F.lit(0.0)))
    return rows.groupBy("well", "channel").agg(
        F.sum(F.col("clean") * F.col("area")).alias("total"),
        F.try_divide(F.sum(F.col("clean") * F.col("area")), F.sum("area")).alias("mean"), F.sum("area").alias("area"),
    )


def control_scale(table: DataFrame, low, high, by: str = "plate", value: str = "ratio", condition: str = "condition") -> DataFrame:
    """log2 values scaled so that the means of two controls become 0 and 1, then to the range of the group."""
    w = Window.partitionBy(by)
    logged = table.where(F.col(value) > 0).withColumn("v", F.log2(value))
    a, b = (F.avg(F.when(F.col(condition) == c, F.col("v"))).over(w) for c in (low, high))
    scaled = logged.withColumn("scaled", F.try_divide(F.col("v") - a, b - a))
    lo, hi = F.min("scaled").over(w), F.max("scaled").over(w)
    return scaled.withColumn("unit", F.try_divide(F.col("scaled") - lo, hi - lo)).drop("v")


def two_means_1d(table: DataFrame, by: str = "gene", value: str = "value", item: str = "cell_line") -> DataFrame:
    """Exact split of each group's values into two clusters with least squares; cluster 1 is the lower one.

    In sorted order the best split is found from running sums; equal values stay together.
    """
    order = Window.partitionBy(by).orderBy(value, item)
    whole = Window.partitionBy(by)
    rows = table.where(F.col(value).isNotNull())
    x = rows.withColumns({"k": F.row_number().over(order), "n": F.count(F.lit(1)).over(whole), "s": F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0)), "t": F.sum(value).over(whole), "nxt": F.lead(value).over(order)})
    between = F.when(
        (F.col("k") < F.col("n")) & (F.col("nxt") > F.col(value)),
        F.col("s") * F.col("s") / F.col("k") + (F.col("t") - F.col("s")) * (F.col("t") - F.col("s")) / (F.col("n") - F.col("k")),
    )
    x = x.withColumn("score", F.round(between, 9))
    best = F.max(F.struct("score", (-F.col("k")).alias("k"))).over(whole)
    return x.withColumn("cut", F.when(best["score"].isNotNull(), -best["k"])).select(by, item, value, F.when(F.col("k") <= F.coalesce("cut", F.col("n")), 1).otherwise(2).alias("cluster"))


def partition_groups(clusters: DataFrame, by: str = "gene", item: str = "cell_line") -> DataFrame:
    """Genes that split the items alike, whichever cluster is called 1."""
    sets = clusters.groupBy(by).agg(*[F.array_join(F.array_sort(F.collect_list(F.when(F.col("cluster") == c, F.col(item)))), ",").alias(f"c{c}") for c in (1, 2)])
    key = F.concat_ws("|", F.least("c1", "c2"), F.greatest("c1", "c2"))
    return sets.withColumn("split", key).groupBy("split").agg(F.count(F.lit(1)).alias("n_genes"), F.min(by).alias("first_gene"))


def pls_weights(expression: DataFrame, target: DataFrame) -> DataFrame:
    """First-component weights: covariance of each standardised gene with the target, to unit length."""
    w = Window.partitionBy("gene")
    z = F.try_divide(F.col("value") - F.avg("value").over(w), F.stddev_samp("value").over(w))
    cov = expression.withColumn("z", z).join(target, "cell_line").groupBy("gene").agg(F.covar_samp("z", "y").alias("c"))
    norm = F.sqrt(F.sum(F.col("c") * F.col("c")).over(Window.partitionBy()))
    return cov.select("gene", F.try_divide("c", norm).alias("weight"))


def log_tpm(counts: DataFrame, length: str = "length") -> DataFrame:
    """log2(TPM + 1) of each gene and sample."""
    rate = F.col("cnt") / F.col(length)
    return counts.withColumn("log_tpm", F.log2(1e6 * F.try_divide(rate, F.sum(rate).over(Window.partitionBy("sample"))) + 1))


def model_dataset(psi: DataFrame, sequences: DataFrame, expression: DataFrame) -> DataFrame:
    """One row per event and cell line: sequence, expression vector (one per cell line) and PSI."""
    vectors = expression.groupBy("cell_line").agg(F.array_sort(F.collect_list(F.struct("gene", "value"))).alias("v"))
    vectors = vectors.select(F.col("cell_line").alias("condition"), F.transform("v", lambda x: x["value"]).alias("expression"))
    return psi.where("psi is not null").join(sequences.select("event", "seq"), "event").join(vectors, "condition")
