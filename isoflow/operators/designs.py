"""Designed libraries, event-adjusted regions and comparison with the transcriptome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoflow.operators.counts import INCLUDED, SKIPPED
from isoflow.operators.psi import psi_of


def adjusted_regions(events: DataFrame) -> DataFrame:
    """Introns and exon of ``up_intron, exon, down_intron`` moved by an event's offsets.

    A positive upstream offset moves the exon's start into the exon, a negative one into the
    intron before; a positive downstream offset moves its end into the intron after it.
    """
    whole = F.concat("up_intron", "exon", "down_intron")
    start = F.length("up_intron") + F.col("up_off")
    stop = F.length("up_intron") + F.length("exon") + F.col("down_off")
    fits = (start >= 0) & (stop >= start) & (stop <= F.length(whole))
    cut = lambda a, n: F.when(fits, F.substr(whole, a + 1, n))
    return events.withColumns({"adj_up": cut(F.lit(0), start), "adj_exon": cut(start, stop - start), "adj_down": cut(stop, F.length(whole) - stop)})


def splice_motifs(regions: DataFrame, up: str = "adj_up", exon: str = "adj_exon", down: str = "adj_down") -> DataFrame:
    """The 23 bases around the 3' splice site (20 intron, 3 exon) and the 9 around the 5' one (3 exon, 6 intron); null if shorter."""
    three = F.concat(F.expr(f"right({up}, 20)"), F.expr(f"left({exon}, 3)"))
    five = F.concat(F.expr(f"right({exon}, 3)"), F.expr(f"left({down}, 6)"))
    return regions.withColumns({"motif_3ss": F.when(F.length(three) == 23, three), "motif_5ss": F.when(F.length(five) == 9, five)})


def feature_lengths(events: DataFrame) -> DataFrame:
    """Distinct exon and intron lengths of coordinate tables, long."""
    parts = F.explode(F.array(
        F.struct(F.lit("exon").alias("feature"), (F.col("exonEnd") - F.col("exonStart_0base")).alias("length")),
        F.struct(F.lit("upstream_intron").alias("feature"), (F.col("exonStart_0base") - F.col("upstreamEE")).alias("length")),
        F.struct(F.lit("downstream_intron").alias("feature"), (F.col("downstreamES") - F.col("exonEnd")).alias("length")),
    ))
    return events.select(parts.alias("p")).select("p.*").distinct()


def psi_class(value, low: float = 0.2, high: float = 0.8):
    """``low``, ``mid`` or ``high`` of a PSI; null stays null."""
    return F.when(value < low, "low").when(value > high, "high").when(value.isNotNull(), "mid")


def design_pass(designs: DataFrame, parents: DataFrame, rules: DataFrame) -> DataFrame:
    """Whether parents start and designs end in the class that their category asks for.

    ``designs`` is ``condition, parent, category, psi``; ``parents`` is ``condition, parent, psi``;
    ``rules`` (one row per category) is ``category, start_low, start_high, end_low, end_high``.
    """
    joined = designs.join(parents.select("condition", "parent", F.col("psi").alias("parent_psi")), ["condition", "parent"], "left").join(rules, "category")
    started = F.col("parent_psi").between(F.col("start_low"), F.col("start_high"))
    ended = F.col("psi").between(F.col("end_low"), F.col("end_high"))
    return joined.withColumns({"start_ok": started, "end_ok": ended}).withColumn("correct", F.col("start_ok") & F.col("end_ok")).drop("start_low", "start_high", "end_low", "end_high")


def design_accuracy(passed: DataFrame) -> DataFrame:
    """Share of correct designs among those that started right, by sample and category, then its mean and deviation."""
    each = passed.where("start_ok").groupBy("condition", "category").agg(F.avg(F.col("end_ok").cast("double")).alias("share"))
    return each.groupBy("category").agg(F.avg("share").alias("mean"), F.stddev_samp("share").alias("sd"), F.count("share").alias("n"))


def design_contrast(designs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mean PSI of each design in the two conditions of each named pair (``name, one, two``), difference and fold change."""
    sides = F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("one").alias("condition")), F.struct(F.lit(2).alias("side"), F.col("two").alias("condition"))))
    table = pairs.select("name", sides.alias("s")).select("name", "s.*")
    side = lambda k: F.avg(F.when(F.col("side") == k, F.col("psi")))
    out = designs.join(table, "condition").groupBy("name", "design").agg(side(1).alias("psi1"), side(2).alias("psi2"))
    return out.where("psi1 is not null and psi2 is not null").withColumns({"diff": F.col("psi1") - F.col("psi2"), "fold": F.try_divide("psi1", "psi2")})


def altss_compare(counts: DataFrame, one, two, scale: int = 1000) -> DataFrame:
    """Included events of two conditions: counts scaled to ``scale`` per element, log2 ratio of both plus 1."""
    rows = counts.where((F.col("mode") == INCLUDED) & F.col("condition").isin(one, two))
    sums = rows.groupBy("idx", "up_off", "down_off").agg(*[F.coalesce(F.sum(F.when(F.col("condition") == c, F.col("cnt"))), F.lit(0)).alias(f"n{k}") for k, c in ((1, one), (2, two))])
    totals = sums.groupBy("idx").agg(F.sum("n1").alias("t1"), F.sum("n2").alias("t2"))
    scaled = sums.join(totals, "idx").where("t1 > 0 and t2 > 0").withColumns({f"scaled{k}": (F.col(f"n{k}") * scale / F.col(f"t{k}")).cast("long") for k in (1, 2)})
    return scaled.withColumn("log2_ratio", F.log2((F.col("scaled1") + 1) / (F.col("scaled2") + 1))).drop("t1", "t2")


def transcriptome_compare(assay: DataFrame, transcriptome: DataFrame, high: float = 0.5) -> DataFrame:
    """Events of both tables (``event, condition, psi``) with the quadrant they fall in."""
    both = assay.select("event", "condition", F.col("psi").alias("assay")).join(transcriptome.select("event", "condition", F.col("psi").alias("transcriptome")), ["event", "condition"])
    a, t = F.col("assay") >= high, F.col("transcriptome") >= high
    return both.withColumn("quadrant", F.when(a & t, "both_high").when(a, "assay_high").when(t, "transcriptome_high").otherwise("both_low"))


def transcriptome_correlation(both: DataFrame) -> DataFrame:
    """Correlation of assay and transcriptome (:func:`transcriptome_compare`) in each condition, and the events it rests on."""
    return both.groupBy("condition").agg(F.corr("assay", "transcriptome").alias("r"), F.count(F.lit(1)).alias("n"))


# The coordinate columns of a skipped-exon event, in the order of its id.
COORDINATES = ("exonStart_0base", "exonEnd", "upstreamES", "upstreamEE", "downstreamES", "downstreamEE")


def junction_events(events: DataFrame, min_count: float = 30) -> DataFrame:
    """Skipped-exon events of a transcriptome with id, names, PSI of the replicates and strand-aware lengths.

    ``id`` joins chromosome and coordinates, ``name`` gene and id.  ``psi_list`` has the PSI of each replicate and ``psi`` their
    mean, both to three digits; replicates without reads count as missing.  Events whose mean count
    (``mean_count``) is below ``min_count`` are left out.
    """
    numbers = [F.transform(F.split(c, ","), lambda x: x.try_cast("double")) for c in ("IJC_SAMPLE_1", "SJC_SAMPLE_1")]
    mean = lambda values: F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))
    there = lambda values: F.filter(values, lambda x: x.isNotNull())
    out = events.withColumns({"_i": numbers[0], "_s": numbers[1], "id": F.concat_ws("-", "chr", *COORDINATES)})
    out = out.withColumns({
        "name": F.concat_ws(";", "GeneID", "geneSymbol", "id"), "psi_list": F.zip_with("_i", "_s", lambda i, s: F.round(F.try_divide(i, i + s), 3)),
        "mean_count": F.round(mean(there(F.zip_with("_i", "_s", lambda i, s: i + s))), 0),
    })
    minus = F.col("strand") == "-"
    before, after = F.col("exonStart_0base") - F.col("upstreamEE"), F.col("downstreamES") - F.col("exonEnd")
    out = out.withColumns({
        "psi": F.round(mean(there(F.col("psi_list"))), 3), "exon_length": F.col("exonEnd") - F.col("exonStart_0base"),
        "up_intron_length": F.when(minus, after).otherwise(before), "down_intron_length": F.when(minus, before).otherwise(after),
    })
    return out.where(F.col("mean_count") >= min_count).drop("_i", "_s")


def junction_psi(events: DataFrame) -> DataFrame:
    """PSI of comma lists of inclusion and skipping junction counts, averaged over replicates."""
    lists = [F.transform(F.split(c, ","), lambda x: x.try_cast("double")) for c in ("IJC_SAMPLE_1", "SJC_SAMPLE_1")]
    values = F.zip_with(lists[0], lists[1], lambda i, s: psi_of(i, s))
    kept = F.filter(values, lambda x: x.isNotNull())
    return events.withColumn("psi", F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x), F.size(kept)))


def candidate_genes(expression: DataFrame, *lists: DataFrame) -> DataFrame:
    """Variance, range and tau of the expression of the genes on any of the lists."""
    from isoflow.operators.specificity import tau_of

    listed = lists[0].select("gene")
    for more in lists[1:]:
        listed = listed.union(more.select("gene"))
    a = expression.join(listed.distinct(), "gene", "left_semi").groupBy("gene").agg(
        F.var_samp("value").alias("var"), (F.max("value") - F.min("value")).alias("range"), F.count("value").cast("double").alias("n"),
        F.sum("value").alias("s"), F.max("value").alias("hi"),
    )
    return a.select("gene", "var", "range", tau_of(F.col("n"), F.col("s"), F.col("hi")).alias("tau"))


def condition_shares(counts: DataFrame) -> DataFrame:
    """Skipped share of each element by condition."""
    part = lambda m: F.coalesce(F.sum(F.when(F.col("mode") == m, F.col("cnt"))), F.lit(0))
    return counts.groupBy("condition", "idx").agg(psi_of(part(SKIPPED), part(INCLUDED)).alias("share"))
