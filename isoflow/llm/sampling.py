"""Bounded random samples whose draw depends on the rows alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def smallest_draws(rows: DataFrame, groups: DataFrame, group: str, n: int, draw: str = "draw") -> DataFrame:
    """The ``n`` rows of each group with the smallest ``draw`` (a 64-bit hash), ties by all columns.

    ``groups (group, count)`` is collected: the number of groups must be small.  A cut-off by count
    leaves little more than ``n`` rows of a group before any are sorted; where equal draws leave too
    few below it, all rows count.
    """
    counts = {r[group]: r["count"] for r in groups.collect()}
    below = lambda total: int(-(2**63) + min(1.0, (n + 8 * n**0.5 + 50) / max(1, total)) * (2**64 - 1))
    near = F.lit(False)
    for value, total in sorted(counts.items(), key=lambda p: str(p[0])):
        near = near | ((F.col(group) == F.lit(value)) & (F.col(draw) <= F.lit(min(2**63 - 1, below(total)))))
    order = Window.partitionBy(group).orderBy(draw, *[c for c in rows.columns if c not in (group, draw)])
    return rows.where(near).withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n).drop("_place")
