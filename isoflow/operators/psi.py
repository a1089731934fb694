"""Percent spliced in: tables, means, transformations, normalisation, major events.

PSI count tables are ``sample, condition, event, included, skipped``; null means not seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoflow.operators.counts import INCLUDED, SKIPPED, UNSPLICED
from isoflow.sources.scratch import written


def psi_of(included, skipped):
    return F.try_divide(included, included + skipped)


FEW_SAMPLES = 100_000
"""Samples up to which their list is broadcast."""


def psi_counts(counts: DataFrame, catalog: DataFrame, min_total: int | None = None) -> DataFrame:
    """Every catalogued event in every sample: its own included count and the element's skipped count.

    The grid joins the catalogue with the samples, which are broadcast up to ``FEW_SAMPLES``.  With ``min_total``
    rows below that coverage are left out.
    """
    samples = written(counts.select("sample", "condition").distinct(), "samples")
    skipped = counts.where(F.col("mode") == SKIPPED).groupBy("sample", "idx").agg(F.sum("cnt").alias("skipped"))
    included = counts.where(F.col("mode") == INCLUDED).groupBy("sample", "idx", "up_off", "down_off").agg(F.sum("cnt").alias("included"))
    grid = catalog.crossJoin(F.broadcast(samples) if samples.count() <= FEW_SAMPLES else samples)
    out = grid.join(included, ["sample", "idx", "up_off", "down_off"], "left").join(skipped, ["sample", "idx"], "left")
    out = out.fillna(0, ["included", "skipped"]).select("sample", "condition", "idx", "up_off", "down_off", "included", "skipped")
    return out if min_total is None else out.where(F.col("included") + F.col("skipped") >= min_total)


def psi(table: DataFrame, min_total: int = 30) -> DataFrame:
    """Add ``psi`` to rows with enough coverage."""
    return table.where(F.col("included") + F.col("skipped") >= min_total).withColumn("psi", psi_of(F.col("included"), F.col("skipped")))


def psi_pooled(table: DataFrame, min_total: int = 30) -> DataFrame:
    """PSI of the counts pooled over a condition's samples."""
    return psi(table.groupBy("condition", "event").agg(F.sum("included").alias("included"), F.sum("skipped").alias("skipped")), min_total)


def psi_by_condition(table: DataFrame, min_total: int = 30, min_replicates: int = 2) -> DataFrame:
    """Mean PSI of a condition from enough covered replicates."""
    means = psi(table, min_total).groupBy("event", "condition").agg(F.avg("psi").alias("psi"), F.count("psi").alias("n"))
    return means.where(F.col("n") >= min_replicates).select("event", "condition", "psi")


def included_fraction(counts: DataFrame) -> DataFrame:
    """Share of each included event in the included reads of its element, averaged by condition."""
    rows = counts.where(F.col("mode") == INCLUDED)
    share = F.try_divide("cnt", F.sum("cnt").over(Window.partitionBy("sample", "idx")))
    return rows.withColumn("share", share).groupBy("condition", "idx", "up_off", "down_off").agg(F.avg("share").alias("share"))


def log_psi(table: DataFrame, scale: int = 1000) -> DataFrame:
    """log2((i + 1) / (s + 1)) of counts scaled to ``scale`` reads; no reads give null."""
    total = F.col("included") + F.col("skipped")
    i, s = (F.try_divide(F.col(c) * scale, total).cast("long") for c in ("included", "skipped"))
    return table.withColumn("log_psi", F.log2((i + 1) / (s + 1)))


def unlog_psi(log_value, scale: int = 1000):
    """The PSI for which :func:`log_psi` would give this value, before rounding: between 0 and 1."""
    ratio = F.pow(F.lit(2.0), log_value)
    included = ((scale + 1) * ratio - 1) / (ratio + 1)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), included / scale))


def own_event_only(satmut: DataFrame, initial: str = "offset_initial", offset: str = "offset") -> DataFrame:
    """Rows at the construct's own event, or skipped ones (offset 0)."""
    return satmut.where((F.col(initial) == F.col(offset)) | (F.col(offset) == "0"))


def major_event_by_vote(table: DataFrame) -> DataFrame:
    """Per element, the offset that is the largest included one in most samples; ties go to smaller offsets."""
    top = Window.partitionBy("sample", "idx").orderBy(F.col("included").desc(), "up_off", "down_off")
    votes = table.withColumn("r", F.row_number().over(top)).where("r = 1").groupBy("idx", "up_off", "down_off").agg(F.count(F.lit(1)).alias("votes"))
    best = Window.partitionBy("idx").orderBy(F.col("votes").desc(), "up_off", "down_off")
    return votes.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def major_event_by_share(counts: DataFrame, min_total: int = 30, min_share: float = 0.01, max_offset: int = 200) -> DataFrame:
    """Per element, the included event with the largest mean share of spliced reads, if it is large and near enough."""
    spliced = counts.where(F.col("mode") != UNSPLICED)
    total = F.sum("cnt").over(Window.partitionBy("sample", "idx"))
    rows = spliced.withColumn("total", total).where((F.col("total") >= min_total) & (F.col("mode") == INCLUDED))
    shares = rows.groupBy("idx", "up_off", "down_off").agg(F.avg(F.col("cnt") / F.col("total")).alias("share"))
    best = Window.partitionBy("idx").orderBy(F.round("share", 9).desc(), "up_off", "down_off")
    top = shares.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")
    return top.where((F.col("share") > min_share) & (F.col("up_off") < max_offset) & (F.col("down_off") < max_offset))


def event_pairs(major: DataFrame, events: DataFrame) -> DataFrame:
    """Each element's major event with each of its other included events."""
    a = major.select("idx", F.col("up_off").alias("major_up"), F.col("down_off").alias("major_down"))
    b = events.select("idx", F.col("up_off").alias("minor_up"), F.col("down_off").alias("minor_down")).distinct()
    return a.join(b, "idx").where("major_up <> minor_up or major_down <> minor_down")


def event_summary(means: DataFrame, n_conditions: int | None = None) -> DataFrame:
    """Per event: extremes and where they are (ties to the smaller condition), mean, median, variance, missing conditions."""
    psi_ = F.col("psi")
    low, high = F.struct(psi_.alias("p"), "condition"), F.struct((-psi_).alias("p"), "condition")
    out = means.where(psi_.isNotNull()).groupBy("event").agg(
        F.min(psi_).alias("row_min"), F.max(psi_).alias("row_max"), F.avg(psi_).alias("row_mean"), F.median(psi_).alias("row_median"),
        F.var_samp(psi_).alias("row_var"), F.min(high)["condition"].alias("max_condition"), F.min(low)["condition"].alias("min_condition"), F.count(psi_).alias("n"),
    )
    return out if n_conditions is None else out.withColumn("n_missing", F.lit(n_conditions) - F.col("n"))


def row_residual(means: DataFrame) -> DataFrame:
    """Mean squared distance of an event's values from their mean."""
    return means.groupBy("event").agg(F.var_pop("psi").alias("residual"))


def completeness(table: DataFrame, thresholds=(0.5, 0.8, 0.9), n_samples: int | None = None, min_total: int = 30) -> DataFrame:
    """How many events are covered in fewer than each share of the samples."""
    covered = table.groupBy("event").agg(F.count_if(F.col("included") + F.col("skipped") >= min_total).alias("seen"))
    if n_samples is None:
        samples = table.select("sample").distinct().agg(F.count(F.lit(1)).alias("n_samples"))
        covered = covered.crossJoin(F.broadcast(samples))  # one row
    else:
        covered = covered.withColumn("n_samples", F.lit(n_samples))
    share = F.col("seen") / F.col("n_samples")
    return covered.agg(F.count(F.lit(1)).alias("n_events"), *[F.count_if(share < t).alias(f"below_{round(t * 100)}") for t in thresholds])


def batch_median_shift(table: DataFrame, batch: str, value: str = "psi", margin: float = 1e-3) -> DataFrame:
    """Shift values between 0 and 1 by the difference of their batch's median from the median of all; 0 and 1 stay."""
    from isoflow.operators.stats import exact_median

    table = written(table, "values")
    medians, overall = exact_median(table, value, (batch,), "_batch"), exact_median(table, value, (), "_all")
    shifted = F.greatest(F.lit(margin), F.least(F.lit(1 - margin), F.col(value) - (F.col("_batch") - F.col("_all"))))
    joined = table.join(medians, batch).crossJoin(F.broadcast(overall))  # one row
    return joined.withColumn("shifted", F.when(F.col(value).isin(0.0, 1.0), F.col(value)).otherwise(shifted)).drop("_batch", "_all")


def impute(table: DataFrame, max_missing: float = 0.5, value: str = "psi", row: str = "event", column: str = "condition") -> DataFrame:
    """Fill nulls of rows that are not too empty with the row's mean, or the column's median where it has none."""
    by_row, by_column = Window.partitionBy(row), Window.partitionBy(column)
    missing = F.avg(F.col(value).isNull().cast("double")).over(by_row)
    filled = F.coalesce(F.col(value), F.avg(value).over(by_row), F.median(value).over(by_column))
    return table.withColumns({"_missing": missing, "filled": filled}).where(F.col("_missing") <= max_missing).drop("_missing")


def min_max(table: DataFrame, group: str, value: str) -> DataFrame:
    """Scale each group to 0..1; a constant group becomes 0."""
    w = Window.partitionBy(group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return table.withColumn("scaled", F.coalesce(F.try_divide(F.col(value) - low, high - low), F.when(F.col(value).isNotNull(), F.lit(0.0))))


def quantile_normalise(table: DataFrame, sample: str = "sample", value: str = "psi") -> DataFrame:
    """Give every sample the mean distribution over the ranks of the largest sample.

    Nulls are ignored and equal values get their average rank.  Samples of another size are
    interpolated linearly between neighbouring ranks, both for the means and for their values.
    """
    rows = written(table.where(F.col(value).isNotNull()), "values")
    sizes = rows.groupBy(sample).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.crossJoin(F.broadcast(sizes.agg(F.max("_n").alias("_top"))))  # one row
    by_value = Window.partitionBy(sample).orderBy(value)
    same, whole = Window.partitionBy(sample, value), Window.partitionBy(sample)
    x = rows.withColumns({
        "_k": F.row_number().over(by_value).cast("long") - 1, "_next": F.lead(value).over(by_value), "_n": F.count(F.lit(1)).over(whole),
        "_r2": 2 * (F.rank().over(by_value).cast("long") - 1) + F.count(F.lit(1)).over(same) - 1,
    })
    x = written(x, "ranked")
    # Ranks from 0.  Target j of the largest sample lies at j * gaps / wide of a sample with n = gaps + 1 values.
    first = F.expr("CASE WHEN _n = 1 THEN 0L ELSE (_k * (_top - 1) + _n - 2) div (_n - 1) END")
    last = F.expr("CASE WHEN _k = _n - 1 THEN _top - 1 ELSE ((_k + 1) * (_top - 1) + _n - 2) div (_n - 1) - 1 END")
    each = x.select(value, "_k", "_next", "_n", "_top", F.explode(F.sequence(first, last)).alias("_j"))
    part = F.coalesce(F.try_divide(F.col("_j") * (F.col("_n") - 1), F.col("_top") - 1) - F.col("_k"), F.lit(0.0))
    means = each.groupBy("_j").agg(F.avg(F.col(value) + F.coalesce(part * (F.col("_next") - F.col(value)), F.lit(0.0))).alias("_mean"))
    # The place of a value is _r2 / 2 of its own sample: whole part and remainder keep it exact.
    x = x.withColumn("_up", F.col("_r2") * (F.col("_top") - 1)).withColumn("_den", F.greatest(2 * (F.col("_n") - 1), F.lit(1)))
    middle = F.col("_n") == 1
    x = x.withColumns({
        "_j": F.when(middle, F.expr("(_top - 1) div 2")).otherwise(F.expr("_up div _den")),
        "_part": F.when(middle, F.expr("(_top - 1) % 2 / 2.0D")).otherwise(F.expr("(_up % _den) / CAST(_den AS DOUBLE)")),
    })
    low, high = means.select("_j", F.col("_mean").alias("_low")), means.select((F.col("_j") - 1).alias("_j"), F.col("_mean").alias("_high"))
    normalised = F.col("_low") + F.coalesce(F.col("_part") * (F.col("_high") - F.col("_low")), F.lit(0.0))
    return x.join(low, "_j").join(high, "_j", "left").select(*table.columns, normalised.alias("normalised"))


def to_matrix(means: DataFrame, conditions: list, row: str = "event", column: str = "condition", value: str = "psi") -> DataFrame:
    """One row per event and one column per listed condition."""
    return means.groupBy(row).pivot(column, conditions).agg(F.first(value))


def to_long(table: DataFrame, ids: list[str], columns: list[str], name: str = "kind", value: str = "n") -> DataFrame:
    """Columns as rows of their name and value."""
    return table.unpivot(ids, columns, name, value)


def logit(p):
    """Log odds; null at 0 and 1."""
    return F.when((p > 0) & (p < 1), F.ln(p / (1 - p)))


def inverse_logit(x):
    return 1 / (1 + F.exp(-x))
