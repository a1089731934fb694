"""Cell-type specificity of event values: tau, upsilon and other metrics, one aggregate each.

Input is long: one row per event and condition with a value; null values do not count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoflow.operators.psi import event_summary


def tau_of(n, total, highest):
    """Sum of 1 - x / max over n - 1, in closed form."""
    return F.try_divide(n - F.try_divide(total, highest), n - 1)


def upsilon_of(n, total, highest):
    """Twice the tau of x + 1, so that small values are not inflated."""
    return 2 * F.try_divide(n - F.try_divide(total + n, highest + 1), n - 1)


def specificity_scores(means: DataFrame, min_n: int = 20, value: str = "psi", by=("event",)) -> DataFrame:
    """tau and upsilon of the values and of 1 - values; null with fewer than ``min_n`` values."""
    v = F.col(value)
    a = means.groupBy(*by).agg(F.count(v).cast("double").alias("n"), F.sum(v).alias("s"), F.max(v).alias("hi"), F.min(v).alias("lo"))
    n, s, hi, lo = (F.col(c) for c in ("n", "s", "hi", "lo"))
    enough = lambda e: F.when(n >= min_n, e)
    return a.select(
        *by,
        enough(tau_of(n, s, hi)).alias("tau"),
        enough(tau_of(n, n - s, 1 - lo)).alias("tau_reverse"),
        enough(upsilon_of(n, s, hi)).alias("upsilon"),
        enough(upsilon_of(n, n - s, 1 - lo)).alias("upsilon_reverse"),
    )


def specificity_table(
    means: DataFrame, n_conditions: int, min_n: int = 20, max_missing: int = 10, high: float = 0.7, min_range: float = 0.3,
) -> DataFrame:
    """Scores and summary of each event, whether it is specific, and the condition it points to."""
    both = specificity_scores(means, min_n).join(event_summary(means, n_conditions), "event").where(F.col("n_missing") < max_missing)
    wide = F.col("row_max") - F.col("row_min") >= min_range
    flag = (F.col("upsilon") >= high) | (F.col("upsilon_reverse") >= high) | ((F.col("tau") >= high) & wide) | ((F.col("tau_reverse") >= high) & wide)
    up = (F.col("upsilon") >= high) | (F.col("tau") >= high)
    target = F.when(F.coalesce(up, F.lit(False)), F.col("max_condition")).otherwise(F.col("min_condition"))
    return both.withColumns({"specific": F.coalesce(flag, F.lit(False)), "target": target})


def specificity_by_group(means: DataFrame, groups: DataFrame, min_n: int = 5) -> DataFrame:
    """Scores of group means; ``groups`` is ``condition, grp``."""
    grouped = means.join(groups, "condition").groupBy("event", "grp").agg(F.avg("psi").alias("psi"))
    return specificity_scores(grouped, min_n)


def specificity_metrics(means: DataFrame, threshold: float = 0.15, value: str = "psi") -> DataFrame:
    """Counts, tau, Gini, Simpson, Shannon, ROKU, SPM and JSS dispersion and the largest TSI, z-score, SPM and JSS per event.

    Values are taken to be positive where a logarithm needs it; zeros add nothing to an entropy.
    """
    rows = means.where(F.col(value).isNotNull()).select("event", F.col(value).cast("double").alias("x"))
    whole = Window.partitionBy("event")
    rank = F.row_number().over(Window.partitionBy("event").orderBy("x"))
    first = rows.withColumns({"r": rank, "n": F.count("x").over(whole), "s": F.sum("x").over(whole), "ss": F.sum(F.col("x") * F.col("x")).over(whole), "m": F.median("x").over(whole), "mean": F.avg("x").over(whole), "sd": F.stddev_samp("x").over(whole)})
    first = first.withColumns({"dev": F.abs(F.col("x") - F.col("m")), "p": F.try_divide("x", "s")})
    second = first.withColumn("mad", F.median("dev").over(whole))
    u = (F.col("x") - F.col("m")) / (5 * F.col("mad") + 1e-4)
    second = second.withColumn("w", F.when(F.abs(u) <= 1, F.pow(1 - u * u, F.lit(2))).otherwise(0.0))
    second = second.withColumn("centre", F.try_divide(F.sum(F.col("x") * F.col("w")).over(whole), F.sum("w").over(whole)))
    second = second.withColumn("far", F.abs(F.col("x") - F.col("centre")))
    second = second.withColumn("pf", F.try_divide("far", F.sum("far").over(whole)))
    plogp = lambda p: F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    spm = F.try_divide("x", F.sqrt("ss"))
    a = second.groupBy("event").agg(
        F.first("n").cast("double").alias("n"), F.first("s").alias("s"), F.max("x").alias("hi"), F.first("mean").alias("mean"), F.first("sd").alias("sd"),
        F.count_if(F.col("x") > threshold).alias("above"), F.sum((2 * F.col("r") - F.col("n") - 1) * F.col("x")).alias("g"), F.sum(F.col("p") * F.col("p")).alias("simpson"),
        F.sum(plogp(F.col("p"))).alias("neg_h"), F.sum(plogp(F.col("pf"))).alias("neg_hf"), F.stddev_samp(spm).alias("spm_sd"), F.max(spm).alias("spm"), F.max("p").alias("tsi"),
        F.sum(plogp((F.col("p") + 1 / F.col("n")) / 2)).alias("neg_hm"),
    )
    n, log_n, root = F.col("n"), F.log2("n"), F.sqrt("n")
    z = F.try_divide(F.col("hi") - F.col("mean"), F.col("sd"))
    jss = 1 - F.sqrt(F.greatest(F.lit(0.0), (F.col("neg_h") - log_n) / 2 - F.col("neg_hm")))
    return a.select(
        "event",
        F.try_divide(n - F.col("above"), n - 1).alias("counts"),
        tau_of(n, F.col("s"), F.col("hi")).alias("tau"),
        F.try_divide(F.col("g"), (n - 1) * F.col("s")).alias("gini"),
        F.try_divide(F.col("simpson") - 1 / n, 1 - 1 / n).alias("simpson"),
        F.try_divide(log_n + F.col("neg_h"), log_n).alias("shannon"),
        F.try_divide(log_n + F.col("neg_hf"), log_n).alias("roku"),
        (F.col("spm_sd") * root).alias("spm_dpm"),
        F.col("tsi").alias("tsi"),
        F.try_divide(z + (n - 1) / root, 2 * (n - 1) / root).alias("z_score"),
        F.col("spm").alias("spm"),
        jss.alias("jss"),
    )
