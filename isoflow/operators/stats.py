"""Statistics over long tables: false-discovery control, correlations, rankings, runs, splits."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoflow.sources.scratch import written


BUCKETS = 200
"""Parts into which the distinct values of a table are cut at their quantiles to be ranked."""
FEW = 100_000
"""Rows of a group, or distinct values of a table, up to which they are ranked in one window."""


TASK_ROWS = 500_000
"""Rows that one task should have to sort; larger tables are dealt over more tasks than the session asks for."""


def _tasks(table: DataFrame, rows: int) -> int:
    """Partitions for a shuffle of so many rows: what the session asks for, more for a large table."""
    return max(math.ceil(rows / TASK_ROWS), int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def _shuffled_over(spark, tasks: int) -> Iterator[None]:
    """Tables written inside the block are shuffled over so many partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def ranked_values(table: DataFrame, value: str, by=()) -> DataFrame:
    """``by..., _v, _n, _before, _total, _b``: every distinct value, its rows, the rows of its group below it and all of its group.

    Equal values are counted first, and the counts are written: ``table`` is evaluated once.  Where there are more
    than ``FEW``, distinct values are ordered within buckets between quantiles, and the buckets' sums are
    added up, so that no window holds all rows of a table or of a large group.  Nulls are left out.
    """
    counts = table.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counts = written(counts, "counts")
    if counts.count() <= FEW:
        group = Window.partitionBy(*by)
        before = F.coalesce(F.sum("_n").over(group.orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return counts.select(*by, "_v", "_n", before.alias("_before"), F.sum("_n").over(group).alias("_total"), F.lit(0.0).alias("_b"))
    bounds = sorted({q for q in counts.approxQuantile("_v", [i / BUCKETS for i in range(1, BUCKETS)], 1 / (4 * BUCKETS)) if math.isfinite(q)})
    if bounds:
        counts = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="_v", outputCol="_b", handleInvalid="keep").transform(counts)
    else:
        counts = counts.withColumn("_b", F.lit(0.0))
    key = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    groups = Window.partitionBy(*[f"_k{i}" for i in range(len(by))])
    sums = counts.groupBy(*key, F.col("_b").alias("_kb")).agg(F.sum("_n").alias("_s"))
    earlier = groups.orderBy("_kb").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"_lower": F.coalesce(F.sum("_s").over(earlier), F.lit(0)), "_total": F.sum("_s").over(groups)})  # one row per group and bucket
    inside = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    joined = counts.join(F.broadcast(sums) if not by else sums, _same(by))
    return joined.withColumn("_before", F.col("_lower") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).select(*by, "_v", "_n", "_before", "_total", "_b")


def _same(by, bucket: bool = True):
    """Rows of one group, and of one bucket, on both sides of a join."""
    same = F.col("_b") == F.col("_kb") if bucket else F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return same


def with_values(table: DataFrame, value: str, found: DataFrame, name: str, by=()) -> DataFrame:
    """``table`` with column ``name`` of ``found (by..., _v, name)`` for its value; null for a null value."""
    found = found.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_v").alias("_kv"), F.col(name).alias("_found"))
    same = (F.col(value).cast("double") == F.col("_kv")) & _same(by, False)
    return table.join(found, same, "left").select(*table.columns, F.col("_found").alias(name))


def bh_adjust(table: DataFrame, p: str = "p", by=(), name: str = "fdr") -> DataFrame:
    """Benjamini-Hochberg: p n / rank, made monotone from the largest p down, 1 at most; nulls stay null.

    Tables with a ``by`` list are adjusted within each of its groups.  The table is evaluated once.  Groups of up
    to ``FEW`` rows are adjusted by windows over their rows, larger ones over buckets of their values; either way a
    task sorts about ``TASK_ROWS`` rows.
    """
    table = written(table, "tested")
    size = table.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("largest"), F.sum("n").alias("rows")).first()
    rows = size["rows"] or 0
    tasks = _tasks(table, rows)
    if (size["largest"] or 0) <= FEW:
        spread = table.repartition(tasks, *by) if by and rows > TASK_ROWS else table
        group = Window.partitionBy(*by)
        below = F.count(p).over(group.orderBy(F.col(p).asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        raw = spread.withColumn("_raw", F.col(p) * F.count(p).over(group) / below)
        fdr = F.least(F.lit(1.0), F.min("_raw").over(group.orderBy(F.col(p).desc_nulls_last())))
        return raw.withColumn(name, F.when(F.col(p).isNotNull(), fdr)).drop("_raw")
    with _shuffled_over(table.sparkSession, tasks):
        ranked = ranked_values(table, p, by)
        raw = written(ranked.withColumn("_raw", F.col("_v") * F.col("_total") / (F.col("_before") + F.col("_n"))), "ranked")
        lows = raw.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_b").alias("_kb")).agg(F.min("_raw").alias("_low"))
        later = Window.partitionBy(*[f"_k{i}" for i in range(len(by))]).orderBy(F.col("_kb").desc()).rowsBetween(Window.unboundedPreceding, -1)
        lows = lows.withColumn("_later", F.min("_low").over(later)).drop("_low")  # one row per group and bucket
        upward = Window.partitionBy(*by, "_b").orderBy(F.col("_v").desc())
        fdr = F.least(F.lit(1.0), F.min("_raw").over(upward), F.col("_later"))
        adjusted = with_values(table, p, raw.join(lows, _same(by)).withColumn(name, fdr), name, by)
        return written(adjusted, "adjusted") if rows > TASK_ROWS else adjusted


def with_average_rank(table: DataFrame, column: str, name: str, by=()) -> DataFrame:
    """``table`` with the rank of a column, ties sharing their average; nulls get null."""
    return with_values(table, column, ranked_values(table, column, by).withColumn(name, F.col("_before") + (F.col("_n") + 1) / 2), name, by)


def exact_median(table: DataFrame, value: str, by=(), name: str = "median") -> DataFrame:
    """``by..., name``: the median of each group's values that are not null, from ranks of distinct values instead of a buffer
    that holds them all."""
    ranked = ranked_values(table, value, by)
    at = lambda place: F.max(F.when((F.col("_before") <= place) & (place < F.col("_before") + F.col("_n")), F.col("_v")))
    lower, upper = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    return ranked.groupBy(*by).agg(((at(lower) + at(upper)) / 2).alias(name))


def correlate(table: DataFrame, x: str, y: str, by=()) -> DataFrame:
    """Pearson and Spearman correlation of the complete pairs, and their number."""
    rows = written(table.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y), "pairs")
    ranked = with_average_rank(with_average_rank(rows, x, "_rx", by), y, "_ry", by)
    return ranked.groupBy(*by).agg(F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"), F.count(F.lit(1)).alias("n"))


def correlation_matrix(means: DataFrame, row: str = "event", column: str = "condition", value: str = "psi") -> DataFrame:
    """Pairwise-complete Pearson correlations of the columns, each unordered pair once (a <= b)."""
    a = means.where(F.col(value).isNotNull()).select(row, F.col(column).alias("a"), F.col(value).alias("x"))
    b = a.select(row, F.col("a").alias("b"), F.col("x").alias("y"))
    return a.join(b, row).where("a <= b").groupBy("a", "b").agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))


PAIR_BLOCK = 512
"""Events, and genes, of one block of correlations."""
PAIR_CELLS = 1 << 22
"""Values of one block, absent ones included."""


def _correlations(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairwise-complete correlations of the rows of two tables with NaN gaps, and the numbers of pairs."""
    has_x, has_y = ~np.isnan(x), ~np.isnan(y)
    center = lambda v, has: np.where(has, v - np.nanmean(np.where(has, v, np.nan), axis=1, keepdims=True), 0.0)
    cx, cy, has_x, has_y = center(x, has_x), center(y, has_y), has_x.astype(float), has_y.astype(float)
    n, sx, sy = has_x @ has_y.T, cx @ has_y.T, has_x @ cy.T
    with np.errstate(all="ignore"):
        qx, qy = n * (cx**2 @ has_y.T), n * (has_x @ (cy**2).T)
        vx, vy = qx - sx**2, qy - sy**2
        r = np.where((n > 1) & (vx > 0) & (vy > 0), (n * (cx @ cy.T) - sx * sy) / np.sqrt(vx * vy), np.nan)
    for i, j in np.argwhere((n > 1) & ((vx <= 1e-9 * qx) | (vy <= 1e-9 * qy))).tolist():  # next to no variance: not from differences of sums
        both = ~np.isnan(x[i]) & ~np.isnan(y[j])
        u, v = x[i, both], y[j, both]
        r[i, j] = np.nan if np.ptp(u) == 0 or np.ptp(v) == 0 else np.corrcoef(u, v)[0, 1]
    return r, n.astype(np.int64)


def replicate_r2(table: DataFrame, event: str = "event", condition: str = "condition", sample: str = "sample", value: str = "psi", block: int = PAIR_BLOCK) -> DataFrame:
    """Squared correlation of each pair of samples of one condition, over the events that both have (one row each).

    A sample is one row with its values by event.  Blocks of samples of a condition meet each other once, as matrix
    products inside a task; only the pairs leave it, so nothing is shuffled for each pair and event.
    """
    rows = table.dropna(subset=[event, condition, sample, value]).groupBy(F.col(condition).alias("c"), F.col(sample).alias("s"))
    rows = rows.agg(F.collect_list(F.struct(F.col(event).cast("string").alias("e"), F.col(value).cast("double").alias("v"))).alias("values"))
    rows = written(rows.select("c", "s", F.transform("values", lambda e: e["e"]).alias("at"), F.transform("values", lambda e: e["v"]).alias("values")), "samples")
    events = rows.select(F.explode("at")).distinct().count()
    block = max(1, min(block, PAIR_CELLS // max(1, events)))
    sizes = written(rows.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "blocks")
    tasks = min(20_000, sizes.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2)).first()[0] or 1)
    dealt = rows.join(sizes, "c").withColumn("own", F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int"))
    left = dealt.select("c", F.col("own").alias("i"), F.explode(F.expr("sequence(own, blocks - 1)")).alias("j"), "s", "at", "values")
    right = dealt.select("c", F.explode(F.expr("sequence(0, own)")).alias("i"), F.col("own").alias("j"), "s", "at", "values")
    right = right.toDF(*[f"{c}_" for c in right.columns])
    kinds = dict(rows.dtypes)

    def compare(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        two.columns = one.columns
        if not len(one) or not len(two):
            return pd.DataFrame({k: [] for k in ("c", "a", "b", "r2", "n")})
        names = pd.Index(np.concatenate([*one["at"], *two["at"]])).unique()

        def values(rows):
            out = np.full((len(rows), len(names)), np.nan)
            out[np.repeat(np.arange(len(rows)), [len(v) for v in rows["values"]]), names.get_indexer(np.concatenate(list(rows["at"])))] = np.concatenate(list(rows["values"]))
            return out

        r, n = _correlations(values(one), values(two))
        a, b = one["s"].to_numpy(), two["s"].to_numpy()
        same = one["i"].iloc[0] == one["j"].iloc[0]  # a block and itself: each pair once
        at, to = np.nonzero((n > 0) & (a[:, None] < b[None, :]) if same else n > 0)
        low = a[at] < b[to]
        return pd.DataFrame({"c": one["c"].iloc[0], "a": np.where(low, a[at], b[to]), "b": np.where(low, b[to], a[at]), "r2": r[at, to] ** 2, "n": n[at, to]})

    keys = ["c", "i", "j"]
    found = left.repartition(int(tasks), *keys).groupBy(*keys).cogroup(right.repartition(int(tasks), *[f"{k}_" for k in keys]).groupBy(*[f"{k}_" for k in keys]))
    out = found.applyInPandas(compare, f"c {kinds['c']}, a {kinds['s']}, b {kinds['s']}, r2 double, n long")
    return out.select(F.col("c").alias(condition), "a", "b", F.nanvl("r2", F.lit(None)).alias("r2"), "n")


def gene_event_correlation(means: DataFrame, expression: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """Correlation of each event with each gene over their common conditions (``condition`` = ``cell_line``).

    An event or gene is one row with its values by condition (a few dozen).  Blocks of events meet
    blocks of genes, and their correlations are matrix products inside a task; only results leave it.
    """

    def pack(df, c):
        rows = df.groupBy(c).agg(F.collect_list(F.struct(F.col("condition").cast("string").alias("c"), F.col("v").cast("double").alias("v"))).alias("values"))
        return written(rows.select(c, F.transform("values", lambda e: e["c"]).alias("at"), F.transform("values", lambda e: e["v"]).alias("values")), c)

    events = pack(means.where("psi is not null").select("event", "condition", F.col("psi").alias("v")), "event")
    genes = pack(expression.where("value is not null").select("gene", F.col("cell_line").alias("condition"), F.col("value").alias("v")), "gene")
    parts = lambda df: max(1, -(-df.count() // block))
    n_events, n_genes = parts(events), parts(genes)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = events.select(F.pmod(F.xxhash64("event"), F.lit(n_events)).cast("int").alias("i"), every(n_genes).alias("j"), "event", "at", "values")
    right = genes.select(every(n_events).alias("i"), F.pmod(F.xxhash64("gene"), F.lit(n_genes)).cast("int").alias("j"), "gene", "at", "values")

    def compare(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({"event": [], "gene": [], "r": [], "n": []})
        names, places = np.unique(np.concatenate([*one["at"], *two["at"]]).astype(str), return_inverse=True)
        borders = sum(map(len, one["at"]))

        def table(rows, at):
            out = np.full((len(rows), len(names)), np.nan)
            out[np.repeat(np.arange(len(rows)), [len(v) for v in rows["values"]]), at] = np.concatenate(list(rows["values"]))
            return out

        r, n = _correlations(table(one, places[:borders]), table(two, places[borders:]))
        a, b = np.nonzero(n > 0)
        values = pd.Series(r[a, b]).astype(object)
        return pd.DataFrame({"event": one["event"].to_numpy()[a], "gene": two["gene"].to_numpy()[b], "r": values.where(~np.isnan(r[a, b]), None), "n": n[a, b]})

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(compare, f"event {kind(events, 'event')}, gene {kind(genes, 'gene')}, r double, n long")


def high_correlations(correlations: DataFrame, above: float = 0.5) -> DataFrame:
    """How many events each gene correlates with strongly."""
    return correlations.groupBy("gene").agg(F.count_if(F.abs("r") > above).alias("num_high"))


def _incomplete_beta(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (Lentz), elementwise."""
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    log_front = np.array([math.lgamma(u + v) - math.lgamma(u) - math.lgamma(v) for u, v in zip(p, q)])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(log_front + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c, d = np.ones_like(y), 1 / np.where(np.abs(1 - (p + q) * y / (p + 1)) < tiny, tiny, 1 - (p + q) * y / (p + 1))
    h = d.copy()
    for m in range(1, 200):
        for term in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    out = np.where(y <= 0, 0.0, front * h)
    return np.where(swap, 1 - out, out)


def t_tail(t, df):
    """Two-sided p-value of Student's t, as a vectorised function."""

    def tail(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for values, freedom in batches:
            v, f = values.to_numpy(float), freedom.to_numpy(float)
            out = np.full(len(v), np.nan)
            ok = np.isfinite(v) & (f > 0)
            if ok.any():
                out[ok] = _incomplete_beta(f[ok] / 2, 0.5, f[ok] / (f[ok] + v[ok] ** 2))
            yield pd.Series(out).astype(object).where(ok, None)

    return F.pandas_udf(tail, "double")(t, df)


def _erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function of numbers from 0 up: its series below 2, its continued fraction above."""
    small = np.minimum(x, 2.0)
    term, total = small.copy(), small.copy()
    for k in range(1, 60):
        term = term * -(small**2) / k
        total = total + term / (2 * k + 1)
    large = np.maximum(x, 2.0)
    tail = np.zeros_like(large)
    for k in range(120, 0, -1):
        tail = (k / 2) / (large + tail)
    return np.where(x < 2, 1 - 2 / math.sqrt(math.pi) * total, np.exp(-(large**2)) / math.sqrt(math.pi) / (large + tail))


def _tail(argument):
    def tail(values: pd.Series) -> pd.Series:
        v = values.to_numpy(float, na_value=np.nan)
        return pd.Series(_erfc(argument(v))).astype(object).where(~np.isnan(v), None)

    return F.pandas_udf(tail, "double")


def normal_tail(z):
    """Two-sided p-value of a standard normal."""
    return _tail(lambda v: np.abs(v) / math.sqrt(2))(z)


def chi2_1_tail(x):
    """Upper tail of chi-square with one degree of freedom."""
    return _tail(lambda v: np.sqrt(np.maximum(v, 0.0) / 2))(x)


def correlation_p(r, n):
    """Two-sided p-value of a Pearson correlation of n pairs."""
    return t_tail(r * F.sqrt(F.try_divide((n - 2).cast("double"), 1 - r * r)), (n - 2).cast("double"))


def top_with_ties(table: DataFrame, by: str, value: str, n: int = 1) -> DataFrame:
    """Rows ranked n or better in their group; ties count as one rank."""
    return table.withColumn("rank", F.rank().over(Window.partitionBy(by).orderBy(F.col(value).desc()))).where(F.col("rank") <= n)


def top_n_per_group(table: DataFrame, by: str, value: str, n: int = 5, tie: str | None = None) -> DataFrame:
    """The n largest rows of each group, ties in the order of ``tie``."""
    order = [F.col(value).desc()] + ([F.col(tie)] if tie else [])
    return table.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)


def top_fraction(table: DataFrame, value: str, fraction: float, tie: str) -> DataFrame:
    """The rows with the largest values: this fraction of all, rounded up."""
    n = math.ceil(table.count() * fraction)
    return table.orderBy(F.col(value).desc(), tie).limit(n)


def call_blocks(table: DataFrame, flag: str, by: str, position: str, value: str, min_length: int = 3, min_mean: float = 0.25) -> DataFrame:
    """Runs of neighbouring positions whose nonzero ``flag`` (a direction, 1 or -1) is the same, long and strong enough."""
    rows = table.where(F.col(flag) != 0)
    island = F.col(position) - F.row_number().over(Window.partitionBy(by, flag).orderBy(position))
    runs = rows.withColumn("island", island).groupBy(by, flag, "island").agg(F.min(position).alias("start"), (F.max(position) + 1).alias("stop"), F.count(F.lit(1)).alias("len"), F.avg(value).alias("mean"))
    return runs.where((F.col("len") >= min_length) & (F.col("mean") * F.col(flag) >= min_mean)).drop("island")


def robust_z(table: DataFrame, by: str, value: str) -> DataFrame:
    """Distance from the median in units of IQR / 1.349 (1e-6 if that is 0)."""
    w = Window.partitionBy(by)
    q = [F.percentile(value, F.lit(p)).over(w) for p in (0.25, 0.5, 0.75)]
    spread = (q[2] - q[0]) / 1.349
    return table.withColumn("z", (F.col(value) - q[1]) / F.when(spread > 0, spread).otherwise(1e-6))


def gaussian_smooth(table: DataFrame, by: str, position: str, value: str, sigma: float = 1.1) -> DataFrame:
    """Gaussian filter of each series, mirrored at its ends, cut at four sigma.  One series is one row meanwhile."""
    radius = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weights = F.array(*[F.lit(float(k)) for k in kernel / kernel.sum()])
    series = table.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(value).alias("v")))).alias("s"))
    n = F.size("s")

    def mirrored(i):
        m = F.pmod(i, 2 * n)
        return F.when(m < n, m).otherwise(2 * n - 1 - m)

    smooth = F.transform(
        "s", lambda one,
        i: F.struct(one["p"].alias("p"), one["v"].alias("v"), F.aggregate(F.transform(weights, lambda w, k: w * F.get(F.col("s"), mirrored(i + k - radius).cast("int"))["v"]), F.lit(0.0), lambda a, x: a + x).alias("smooth")),
    )
    return series.select(by, F.explode(smooth).alias("o")).select(by, F.col("o.p").alias(position), F.col("o.v").alias(value), F.col("o.smooth").alias("smooth"))


def smooth_positions(table: DataFrame, by: str, position: str, value: str, weights=(1, 2, 3, 2, 1)) -> DataFrame:
    """Weighted sum over neighbouring rows, the weights' middle on the row; null where the window is cut off."""
    half = len(weights) // 2
    w = Window.partitionBy(by).orderBy(position)
    near = [F.lag(value, half - k).over(w) if k <= half else F.lead(value, k - half).over(w) for k in range(len(weights))]
    total = sum((n * F.lit(float(x)) for n, x in zip(near[1:], weights[1:])), near[0] * F.lit(float(weights[0])))
    return table.withColumn("smooth", total)


def ecdf(table: DataFrame, value: str, grid: list[float]) -> DataFrame:
    """Share of values at most x for each x of a grid, in one pass over the table."""
    counts = table.agg(F.count(value).alias("n"), *[F.count_if(F.col(value) <= x).alias(f"c{i}") for i, x in enumerate(grid)])
    points = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.try_divide(F.col(f"c{i}"), F.col("n")).alias("share")) for i, x in enumerate(grid)])
    return counts.select(F.explode(points).alias("p")).select("p.*")


def threshold_sweep(table: DataFrame, score: str, truth: str, cuts: list[float]) -> DataFrame:
    """Precision, recall and F1 of score >= cut against a boolean, for every cut, in one pass."""
    hit, real = (lambda c: F.col(score) >= c), F.col(truth)
    counts = table.agg(
        F.count_if(real).alias("pos"), *[F.count_if(hit(c) & real).alias(f"tp{i}") for i, c in enumerate(cuts)],
        *[F.count_if(hit(c)).alias(f"pp{i}") for i, c in enumerate(cuts)],
    )
    rows = F.explode(F.array(*[F.struct(F.lit(float(c)).alias("cut"), F.col(f"tp{i}").alias("tp"), F.col(f"pp{i}").alias("pp")) for i, c in enumerate(cuts)]))
    out = counts.select("pos", rows.alias("r")).select("pos", "r.*")
    precision, recall = F.try_divide("tp", "pp"), F.try_divide("tp", "pos")
    return out.select("cut", "tp", precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * F.col("tp"), F.col("pp") + F.col("pos")).alias("f1"))


def group_split(table: DataFrame, key: str, test_share: float = 0.2, seed: int = 0) -> DataFrame:
    """Train and test by a hash of the key, so that no key is on both sides."""
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1000))
    return table.withColumn("is_test", bucket < int(test_share * 1000))


def evaluate_predictions(table: DataFrame, seed: str, real: str, predicted: str) -> DataFrame:
    """Correlations per seed, then their mean and population standard deviation."""
    each = correlate(table, real, predicted, by=(seed,))
    return each.agg(
        F.avg("pearson").alias("pearson_mean"), F.stddev_pop("pearson").alias("pearson_sd"), F.avg("spearman").alias("spearman_mean"),
        F.stddev_pop("spearman").alias("spearman_sd"), F.count(F.lit(1)).alias("n_seeds"),
    )
