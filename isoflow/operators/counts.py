"""Counts of splice events: merging files, correcting chimeras, merging near offsets, catalogues.

Tables are long: ``sample, condition, idx, mode, up_off, down_off, cnt`` with mode INCLUDED,
SKIPPED or UNSPLICED.  Counts are long integers.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from isoflow.sources.scratch import written

EVENT = ("sample", "condition", "idx", "mode", "up_off", "down_off")
INCLUDED, SKIPPED, UNSPLICED = "INCLUDED", "SKIPPED", "UNSPLICED"


def merge_replicate_files(counts: DataFrame, keys=EVENT) -> DataFrame:
    """Sum the counts of an event over the files of a sample."""
    return counts.groupBy(*keys).agg(F.sum("cnt").alias("cnt"))


def count_fractions(counts: DataFrame, group=("sample", "idx")) -> DataFrame:
    """Add group totals and each row's share of its group and of its mode; 0/0 is null."""
    total, per_mode = F.sum("cnt").over(Window.partitionBy(*group)), F.sum("cnt").over(Window.partitionBy(*group, "mode"))
    return counts.withColumns({"total": total, "mode_total": per_mode}).withColumns(
        {"frac_of_total": F.try_divide("cnt", "total"), "frac_of_mode": F.try_divide("cnt", "mode_total")}
    )


def chimera_correct_v3(counts: DataFrame, rates: DataFrame, group=("sample", "idx")) -> DataFrame:
    """Scale non-included counts to what remains after chimeric reads of included molecules.

    With I included, N other reads of a group and chimera rate c, a row of n other reads becomes
    trunc((N - cI) / (1 + c) * n / N), 0 at least.  Included rows keep their counts.
    """
    w = Window.partitionBy(*group)
    is_in = F.col("mode") == INCLUDED
    inside, outside = F.sum(F.when(is_in, F.col("cnt"))).over(w), F.sum(F.when(~is_in, F.col("cnt"))).over(w)
    joined = counts.join(rates, "sample")  # one row per sample
    joined = joined.withColumns({"_in": F.coalesce(inside, F.lit(0)), "_out": outside})
    scaled = (F.col("_out") - F.col("rate") * F.col("_in")) / (1 + F.col("rate")) * F.try_divide("cnt", "_out")
    fixed = F.when(is_in, F.col("cnt")).otherwise(F.greatest(F.lit(0), F.coalesce(scaled, F.lit(0)).cast("long")))
    return joined.withColumn("cnt_scaled", fixed.cast("long")).drop("_in", "_out", "rate")


def chimera_correct_v2(counts: DataFrame, rates: DataFrame) -> DataFrame:
    """Non-included counts become trunc(n (1 - c))."""
    fixed = F.when(F.col("mode") == INCLUDED, F.col("cnt")).otherwise((F.col("cnt") * (1 - F.col("rate"))).cast("long"))
    return counts.join(rates, "sample").withColumn("cnt_scaled", fixed).drop("rate")


def geometric_mean(value):
    """Over positive values only."""
    return F.exp(F.avg(F.when(value > 0, F.ln(value))))


def anchor_correct(psi_counts: DataFrame, anchors: DataFrame) -> DataFrame:
    """Scale skipped counts by 1 - rate, the rate of a sample being 1 / geometric mean of its anchors' PSI - 1."""
    psi = F.try_divide("included", F.col("included") + F.col("skipped"))
    rates = psi_counts.join(anchors.select("event").distinct(), "event", "left_semi").groupBy("sample").agg((1 / geometric_mean(psi) - 1).alias("swap_rate"))
    out = psi_counts.join(rates, "sample")
    return out.withColumn("skipped_scaled", (F.col("skipped") * (1 - F.col("swap_rate"))).cast("long"))


def select_anchors(
    psi_counts: DataFrame, n_conditions: int, min_psi: float = 0.95, min_total: int = 100_000, limit: int | None = 100,
    seed: int = 1,
) -> DataFrame:
    """Events seen in all conditions, with a high mean PSI and total; ``limit`` of them drawn by hash."""
    total = F.col("included") + F.col("skipped")
    found = psi_counts.where(total > 0).groupBy("event").agg(F.countDistinct("condition").alias("n"), F.avg(F.try_divide("included", total)).alias("mean_psi"), F.sum(total).alias("total"))
    found = found.where((F.col("n") >= n_conditions) & (F.col("mean_psi") > min_psi) & (F.col("total") > min_total)).select("event", "mean_psi", "total")
    return found if limit is None else found.orderBy(F.xxhash64("event", F.lit(seed)), "event").limit(limit)


FOLDED = 256
"""Offsets of a group up to which its rows are merged one after another in one list."""
TILE = 256
"""Side of a tile, in offsets, in which larger groups are merged."""


def merge_near_offsets(counts: DataFrame, keys=("sample", "condition", "idx"), radius: int = 1, folded: int = FOLDED, tile: int = TILE) -> DataFrame:
    """Merge included events into more frequent ones at most ``radius`` away on both axes.

    Rows of a group are taken by count (largest first, then by offsets); a row joins the first
    earlier kept row near it, else it is kept.  Groups of up to ``folded`` rows are short lists; the others
    are peeled in tiles of the two axes, so no group has to fit into one task.
    """
    rows = written(counts.select(*keys, "up_off", "down_off", "cnt"), "offsets")
    large = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > folded).drop("_n"), "large")
    if large.isEmpty():
        return _merge_lists(rows, keys, radius)
    named = large.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return _merge_lists(rows.join(named, same, "left_anti"), keys, radius).unionByName(_merge_tiles(rows.join(named, same, "left_semi"), keys, radius, tile))


def _merge_lists(counts: DataFrame, keys, radius: int) -> DataFrame:
    row = F.struct((-F.col("cnt")).alias("neg"), "up_off", "down_off", "cnt")
    start = F.expr("cast(array() as array<struct<up_off:int,down_off:int,cnt:bigint>>)")

    def near(a, x):
        return (F.abs(a["up_off"] - x["up_off"]) <= radius) & (F.abs(a["down_off"] - x["down_off"]) <= radius)

    def step(kept, x):
        one = F.struct(x["up_off"].alias("up_off"), x["down_off"].alias("down_off"), x["cnt"].alias("cnt"))
        first = F.array_position(F.transform(kept, lambda a: near(a, x)), True)
        grown = F.transform(
            kept, lambda a,
            i: F.when(i + 1 == first, F.struct(a["up_off"].alias("up_off"), a["down_off"].alias("down_off"), (a["cnt"] + x["cnt"]).alias("cnt"))).otherwise(a),
        )
        return F.when(first > 0, grown).otherwise(F.concat(kept, F.array(one)))

    merged = counts.groupBy(*keys).agg(F.aggregate(F.array_sort(F.collect_list(row)), start, step).alias("kept"))
    return merged.select(*keys, F.explode("kept").alias("k")).select(*keys, "k.*")


_UNDECIDED, _KEPT, _ABSORBED = 0, 1, 2


def _merge_tiles(counts: DataFrame, keys, radius: int, side: int) -> DataFrame:
    """The same merge, peeled in rounds.

    Rows of one cell stand or fall together with the most frequent of them.  A cell is kept when no
    larger neighbour is kept or open, and absorbed as soon as one is kept; a tile settles in one
    round all that does not wait for a cell of another tile, whose border cells it sees as of the
    round before.  What is settled stays so; the largest open cell of a group is settled in every
    round, so the rounds end.  At last each absorbed cell goes to the most frequent kept one near it.
    """
    cells = counts.groupBy(*keys, "up_off", "down_off").agg(F.max("cnt").alias("cnt"), F.sum("cnt").alias("total"))
    cells = written(cells.withColumn("state", F.lit(_UNDECIDED)), "cells")
    schema = cells.schema
    around = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a or b]
    kinds = {f.name: f.dataType for f in schema}
    target = StructType([StructField(k, kinds[k]) for k in keys] + [StructField(n, IntegerType()) for n in ("up_off", "down_off")] + [StructField("cnt", LongType())])

    def tiles(x: DataFrame) -> DataFrame:
        """Each cell in its own tile and in those whose border it is near."""
        at = lambda c, d: F.floor((F.col(c) + d) / side)
        places = F.array_distinct(F.array(*[F.struct(at("up_off", a).alias("tx"), at("down_off", b).alias("ty")) for a in (-radius, 0, radius) for b in (-radius, 0, radius)]))
        own = (F.col("t.tx") == at("up_off", 0)) & (F.col("t.ty") == at("down_off", 0))
        return x.select("*", F.explode(places).alias("t")).select(*x.columns, "t.tx", "t.ty", own.alias("own")).groupBy(*keys, "tx", "ty")

    def ordered(tile: pd.DataFrame) -> tuple[pd.DataFrame, list, dict]:
        tile = tile.sort_values(["cnt", "up_off", "down_off"], ascending=[False, True, True], ignore_index=True)
        places = list(zip(tile["up_off"].tolist(), tile["down_off"].tolist()))
        return tile, places, {p: i for i, p in enumerate(places)}

    def larger(i: int, places: list, index: dict) -> list[int]:
        u, d = places[i]
        near = (index.get((u + a, d + b)) for a, b in around)
        return [j for j in near if j is not None and j < i]

    def peel(tile: pd.DataFrame) -> pd.DataFrame:
        tile, places, index = ordered(tile)
        state, own = tile["state"].tolist(), tile["own"].tolist()
        for i, now in enumerate(state):
            if own[i] and now == _UNDECIDED:
                near = {state[j] for j in larger(i, places, index)}
                state[i] = _ABSORBED if _KEPT in near else _UNDECIDED if _UNDECIDED in near else _KEPT
        tile["state"] = state
        return tile.loc[tile["own"], schema.names]

    def assign(tile: pd.DataFrame) -> pd.DataFrame:
        tile, places, index = ordered(tile)
        state = tile["state"].tolist()
        to = [i if s == _KEPT else min((j for j in larger(i, places, index) if state[j] == _KEPT), default=i) for i, s in enumerate(state)]
        tile["up_off"], tile["down_off"] = [places[j][0] for j in to], [places[j][1] for j in to]
        return tile.loc[tile["own"], [*keys, "up_off", "down_off", "total"]].rename(columns={"total": "cnt"})

    while not cells.where(F.col("state") == _UNDECIDED).isEmpty():
        cells = written(tiles(cells).applyInPandas(peel, schema), "cells")
    return tiles(cells).applyInPandas(assign, target).groupBy(*keys, "up_off", "down_off").agg(F.sum("cnt").alias("cnt"))


def included_event_catalog(
    counts: DataFrame, elements: DataFrame, min_mode_total: int = 30, min_reads: int = 5, min_frac: float = 0.01,
    max_offset: int = 150,
) -> DataFrame:
    """The reference event (0, 0) of every element and the imperfect events with enough support."""
    perfect = elements.select("idx").distinct().select("idx", F.lit(0).alias("up_off"), F.lit(0).alias("down_off"))
    seen = count_fractions(counts).where((F.col("mode") == INCLUDED) & ((F.col("up_off") != 0) | (F.col("down_off") != 0)) & (F.col("mode_total") >= min_mode_total))
    seen = seen.groupBy("idx", "up_off", "down_off").agg(F.max("frac_of_mode").alias("f"), F.max("cnt").alias("r"))
    seen = seen.where((F.col("r") >= min_reads) & (F.col("f") > min_frac) & (F.col("up_off") < max_offset) & (F.col("down_off") < max_offset))
    return perfect.unionByName(seen.select("idx", "up_off", "down_off"))


def unspliced_catalog(counts: DataFrame) -> DataFrame:
    """Support of each unspliced offset."""
    rows = count_fractions(counts).where(F.col("mode") == UNSPLICED)
    return rows.groupBy("mode", "up_off").agg(F.count(F.lit(1)).alias("n"), F.max("frac_of_mode").alias("max_frac"), F.max("cnt").alias("max_reads"))


def apply_alt_ref(counts: DataFrame, alt_ref: DataFrame, keys=EVENT) -> DataFrame:
    """Rename elements ``alt`` to ``ref`` and sum what then coincides."""
    named = counts.join(alt_ref, F.col("idx") == F.col("alt"), "left").withColumn("idx", F.coalesce("ref", "idx"))
    return merge_replicate_files(named, keys)


def depth_normalise(counts: DataFrame, depth: float = 5e7) -> DataFrame:
    """Counts per ``depth`` reads of the sample, truncated."""
    total = F.sum("cnt").over(Window.partitionBy("sample"))
    return counts.withColumn("cnt_scaled", (F.col("cnt") * F.lit(float(depth)) / total).cast("long"))


def events_per_element(counts: DataFrame) -> DataFrame:
    """Distinct events of each element and sample."""
    return counts.groupBy("sample", "idx").agg(F.countDistinct("mode", "up_off", "down_off").alias("n_events"))


def alt_site_counts(counts: DataFrame, min_conditions: int = 21) -> DataFrame:
    """Alternative included sites per element that occur in enough conditions."""
    sites = counts.where((F.col("mode") == INCLUDED) & ((F.col("up_off") != 0) | (F.col("down_off") != 0)))
    wide = sites.groupBy("idx", "up_off", "down_off").agg(F.countDistinct("condition").alias("n")).where(F.col("n") >= min_conditions)
    return wide.groupBy("idx").agg(F.count(F.lit(1)).alias("n_sites"))


def unspliced_profile(counts: DataFrame) -> DataFrame:
    """Share of unspliced reads by sample and offset, averaged over the sample's elements."""
    shares = count_fractions(counts).where(F.col("mode") == UNSPLICED)
    elements = counts.groupBy("sample").agg(F.countDistinct("idx").alias("elements"))
    sums = shares.groupBy("sample", "up_off").agg(F.sum("frac_of_total").alias("s"))
    return sums.join(elements, "sample").select("sample", "up_off", (F.col("s") / F.col("elements")).alias("share"))


def sample_depth(counts: DataFrame) -> DataFrame:
    """Mean and standard deviation of the samples' totals, by condition."""
    totals = counts.groupBy("condition", "sample").agg(F.sum("cnt").alias("total"))
    return totals.groupBy("condition").agg(F.avg("total").alias("mean_total"), F.stddev_samp("total").alias("sd_total"), F.count(F.lit(1)).alias("n_samples"))


def library_coverage(dna: DataFrame, rna: DataFrame) -> DataFrame:
    """Per element, pooled DNA and RNA counts of all runs and barcodes seen in both."""
    pool = lambda df, name: df.groupBy("idx", "cb").agg(F.count(F.lit(1)).alias(name))
    both = pool(dna, "dna").join(pool(rna, "rna"), ["idx", "cb"], "full")
    return both.groupBy("idx").agg(
        F.coalesce(F.sum("dna"), F.lit(0)).alias("dna"), F.coalesce(F.sum("rna"), F.lit(0)).alias("rna"),
        F.count(F.when(F.col("dna").isNotNull() & F.col("rna").isNotNull(), 1)).alias("barcodes_both"),
    )


def histogram(values: DataFrame, group: str, value: str, bins: int = 20) -> DataFrame:
    """Counts of ``bins`` equal intervals over each group's range; the last one holds the maximum."""
    w = Window.partitionBy(group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    place = F.least(F.floor(F.coalesce(F.try_divide((F.col(value) - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0))), F.lit(bins - 1))
    return values.withColumns({"lo": low, "hi": high}).withColumn("bin", place.cast("int")).groupBy(group, "bin").agg(F.count(F.lit(1)).alias("n"))


def umi_dedup(molecules: DataFrame, event=("idx", "mode")) -> DataFrame:
    """Distinct (barcode, UMI) pairs per event."""
    return molecules.groupBy(*event).agg(F.countDistinct("cb", "umi").alias("cnt"))


def molecule_counts(molecules: DataFrame, event=("idx", "mode")) -> DataFrame:
    """Reads of each molecule."""
    return molecules.groupBy(*event, "cb", "umi").agg(F.count(F.lit(1)).alias("reads"))


def mode_counts(table: DataFrame, by, modes=(INCLUDED, SKIPPED)) -> DataFrame:
    """Counts of each mode as columns, absent ones 0."""
    return table.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col("mode") == m, F.col("cnt"))), F.lit(0)).alias(m) for m in modes])


def lineage_counts(lines: DataFrame) -> DataFrame:
    """Distinct cell lines of each lineage."""
    return lines.groupBy("lineage").agg(F.countDistinct("name").alias("n_lines"))
