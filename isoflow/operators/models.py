"""Models over PSI and expression: principal components, regressions, mixtures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoflow.sources.scratch import written


def psi_pca(means: DataFrame, k: int = 2) -> tuple[DataFrame, list[float], DataFrame]:
    """Components of conditions over standardised events: ``condition, pc``, explained shares, ``event, loading``.

    The conditions are few dozen and the events many: the products of conditions are summed over the
    events in Spark, their eigenvectors are those of the small matrix, and loadings are found event by
    event.  A condition that lacks an event counts with the condition's mean.
    """
    averages = means.groupBy("condition").agg(F.avg("psi").alias("psi")).orderBy("condition").collect()  # one row per condition
    names, fill = [r.condition for r in averages], np.array([0.0 if r.psi is None else r.psi for r in averages])
    place = {c: i for i, c in enumerate(names)}
    rows = means.where("psi is not null").groupBy("event", "condition").agg(F.avg("psi").alias("psi")).groupBy("event").agg(F.collect_list(F.struct("condition", "psi")).alias("values"))

    def standardised(batch: pd.DataFrame) -> np.ndarray:
        z = np.tile(fill, (len(batch), 1))
        for i, values in enumerate(batch["values"]):
            for v in values:
                z[i, place[v["condition"]]] = v["psi"]
        z -= z.mean(axis=1, keepdims=True)
        sd = z.std(axis=1, ddof=1, keepdims=True) if len(names) > 1 else np.zeros((len(z), 1))
        return np.divide(z, sd, out=np.zeros_like(z), where=sd > 0)

    def products(batches):
        total = np.zeros((len(names), len(names)))
        for batch in batches:
            z = standardised(batch)
            total += z.T @ z
        a, b = np.indices(total.shape)
        yield pd.DataFrame({"a": a.ravel(), "b": b.ravel(), "v": total.ravel()})

    gram = np.zeros((len(names), len(names)))
    for r in rows.mapInPandas(products, "a long, b long, v double").groupBy("a", "b").agg(F.sum("v").alias("v")).collect():
        gram[r.a, r.b] = r.v
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(-values)[:k]
    size = np.sqrt(np.maximum(values[order], 0.0))
    directions = np.divide(vectors[:, order], size, out=np.zeros((len(names), len(order))), where=size > 1e-9)

    def loadings(batches):
        for batch in batches:
            yield pd.DataFrame({"event": batch["event"], "loading": list(standardised(batch) @ directions)})

    spark = means.sparkSession
    scores = spark.createDataFrame(
        [(c, [float(x) for x in vectors[i, order] * size]) for i, c in enumerate(names)],
        f"condition {means.schema['condition'].dataType.simpleString()}, pc array<double>",
    )
    total = values.sum()
    return scores, [float(v / total) if total > 0 else 0.0 for v in values[order]], rows.mapInPandas(loadings, f"event {means.schema['event'].dataType.simpleString()}, loading array<double>")


def top_loadings(loadings: DataFrame, component: int = 0, n: int = 10) -> DataFrame:
    """The events that weigh most in a component: ``event, weight``."""
    weight = F.get("loading", F.lit(component))
    return loadings.select("event", weight.alias("weight")).orderBy(F.abs("weight").desc(), "event").limit(n)


MOST_GENES = 2000
"""Genes of a regression: the products of all pairs of them are what its fit needs."""


def fold_products(samples: DataFrame, features: str = "x", targets: str = "y", fold: str = "fold") -> tuple[np.ndarray, list]:
    """For each fold the sums of products of all pairs of ``1, features, targets`` over its samples, from one pass.

    What is collected has the size of the squared number of columns, however many samples there are.
    """

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            if not len(batch):
                continue
            z = np.column_stack([np.ones(len(batch)), np.vstack(list(batch[features])), np.vstack(list(batch[targets]))])
            for f in np.unique(batch[fold]):
                own = z[(batch[fold] == f).to_numpy()]
                sums[f] = sums.get(f, 0) + own.T @ own
        for f, total in sums.items():
            i = np.arange(len(total))
            yield pd.DataFrame({"fold": int(f), "i": i, "row": list(total)})

    added = samples.select(features, targets, fold).mapInPandas(products, "fold int, i int, row array<double>").select("fold", "i", F.posexplode("row").alias("j", "v"))
    rows = added.groupBy("fold", "i", "j").agg(F.sum("v").alias("v")).groupBy("fold", "i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("r"))
    found = rows.select("fold", "i", F.transform("r", lambda e: e["v"]).alias("r")).collect()
    folds = sorted({r["fold"] for r in found})
    out = np.zeros((len(folds), *([1 + max((r["i"] for r in found), default=-1)] * 2)))
    for r in found:
        out[folds.index(r["fold"]), r["i"]] = r["r"]
    return out, folds


class Moments:
    """Centred products of features and targets, from sums of products of ``1, features, targets``."""

    def __init__(self, sums: np.ndarray, n_targets: int):
        n, p = sums[0, 0], len(sums) - 1 - n_targets
        self.n, self.mean = n, sums[0, 1:] / max(n, 1)
        centred = sums[1:, 1:] - n * np.outer(self.mean, self.mean)
        self.xx, self.xy, self.p = centred[:p, :p], centred[:p, p:], p


def ridge_weights(moments: Moments, penalty: float) -> np.ndarray:
    """Weights that minimise the squared error plus ``penalty`` times the squared weights."""
    return np.linalg.solve(moments.xx + (penalty + 1e-12) * np.eye(moments.p), moments.xy)


def lasso_weights(moments: Moments, penalty: float, start: np.ndarray, rounds: int = 2000, close: float = 1e-9) -> np.ndarray:
    """Weights that minimise half the mean squared error plus ``penalty`` times the absolute weights, by coordinate descent from ``start``."""
    w, size = start.copy(), np.diag(moments.xx) / moments.n
    left = moments.xy / moments.n - moments.xx @ w / moments.n  # covariances of features and residuals
    for _ in range(rounds):
        most = 0.0
        for j in np.flatnonzero(size > 1e-12):
            pull = left[j] + size[j] * w[j]
            new = np.sign(pull) * np.maximum(np.abs(pull) - penalty, 0.0) / size[j]
            step = new - w[j]
            if np.any(step):
                left -= np.outer(moments.xx[:, j] / moments.n, step)
                w[j] = new
                most = max(most, float(np.abs(step).max()))
        if most < close:
            break
    return w


def chosen_penalty(sums: np.ndarray, n_targets: int, penalties: list[float], lasso: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (features x targets), the penalty of each target and the held-out errors (penalties x targets).

    A fold's fit uses the sums of the other folds, its error those of the fold; penalties go from large to
    small, each fit starting at the one before.
    """
    order = sorted(penalties, reverse=True)
    total, errors = sums.sum(axis=0), np.zeros((len(order), n_targets))

    def path(moments):
        w = np.zeros((moments.p, n_targets))
        for penalty in order:
            w = lasso_weights(moments, penalty, w) if lasso else ridge_weights(moments, penalty)
            yield w

    for held in sums if len(sums) > 1 else []:
        moments = Moments(total - held, n_targets)
        for k, w in enumerate(path(moments)):
            shift = moments.mean[moments.p :] - moments.mean[: moments.p] @ w
            for t in range(n_targets):
                z = np.concatenate([[-shift[t]], -w[:, t], np.eye(n_targets)[t]])
                errors[k, t] += z @ held @ z
    errors /= max(total[0, 0], 1)
    best = errors.argmin(axis=0)
    fits = list(path(Moments(total, n_targets)))
    weights = np.column_stack([fits[b][:, t] for t, b in enumerate(best)])
    return weights, np.array(order)[best], errors


def expression_regression(
    expression: DataFrame, targets: DataFrame, penalties=(0.01, 0.1, 1.0, 10.0, 100.0), folds: int = 5, lasso: bool = False, most_genes: int = MOST_GENES,
) -> DataFrame:
    """Ridge or lasso of each target on min-max scaled expression: ``target, gene, weight, penalty``.

    ``expression`` is ``cell_line, gene, value`` and ``targets`` ``cell_line, y``, an array such as the first
    principal components of PSI.  The penalty of each target is that of the least error over ``folds`` folds of
    cell lines, dealt by hash.  A missing value counts as the gene's mean; genes without any
    difference get weight 0.
    """
    from isoflow.operators.psi import min_max

    kind = expression.schema["gene"].dataType.simpleString()
    scaled = written(min_max(expression, "gene", "value").select("cell_line", "gene", F.col("scaled").alias("value")), "scaled")
    means = scaled.groupBy("gene").agg(F.avg("value").alias("mean")).orderBy("gene").limit(most_genes + 1).collect()
    if len(means) > most_genes:
        raise ValueError(f"more than {most_genes} genes: select those to regress on")
    spark, schema = expression.sparkSession, f"target int, gene {kind}, weight double, penalty double"
    if not means:
        return spark.createDataFrame([], schema)
    place = F.create_map(*[x for i, r in enumerate(means) for x in (F.lit(r["gene"]), F.lit(i))])
    fill = F.array(*[F.lit(float(r["mean"] or 0.0)) for r in means])
    known = F.map_from_entries(F.collect_list(F.struct(F.col("at"), F.col("value"))))
    lines = scaled.where("value is not null").withColumn("at", place[F.col("gene")]).groupBy("cell_line").agg(known.alias("known"))
    x = F.transform(fill, lambda mean, i: F.coalesce(F.try_element_at("known", i), mean))
    samples = lines.join(targets, "cell_line").select(x.alias("x"), F.col("y").cast("array<double>").alias("y"), F.pmod(F.xxhash64("cell_line"), F.lit(folds)).cast("int").alias("fold"))
    sums, _ = fold_products(samples)
    n_targets = sums.shape[1] - 1 - len(means)
    if not len(sums) or n_targets < 1:
        return spark.createDataFrame([], schema)
    weights, penalty, _ = chosen_penalty(sums, n_targets, list(penalties), lasso)
    rows = [(t + 1, r["gene"], float(weights[i, t]), float(penalty[t])) for t in range(n_targets) for i, r in enumerate(means)]
    return spark.createDataFrame(rows, schema)


def class_border(table: DataFrame, features: list[str], label: str = "label", rounds: int = 50, close: float = 1e-10) -> DataFrame:
    """Logistic regression by Newton steps: one row ``weights, intercept, slope, border, steps, log_likelihood``.

    A step needs one pass that sums gradient and curvature over all rows; a step that lowers the likelihood is
    halved.  With two features the border is the line ``second = border + slope * first`` on which both
    classes are as likely.  Rows with a null are left out.  Where a line parts the classes weights grow
    without end: the steps stop at ``rounds``.
    """
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    rows = table.select(*[v.alias(f"x{i}") for i, v in enumerate(x)], F.col(label).cast("int").alias("label")).na.drop()
    rows = written(rows, "rows")
    d = len(x)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]

    def sums(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        eta = sum((F.col(f"x{i}") * F.lit(float(b[i])) for i in range(1, d)), F.lit(float(b[0])))
        p = 1 / (1 + F.exp(-F.col("eta")))
        likely = F.col("label") * F.col("eta") - F.greatest(F.col("eta"), F.lit(0.0)) - F.log1p(F.exp(-F.abs("eta")))
        one = rows.withColumn("eta", eta).agg(
            F.sum(likely).alias("l"), *[F.sum((F.col("label") - p) * F.col(f"x{i}")).alias(f"g{i}") for i in range(d)],
            *[F.sum(p * (1 - p) * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i, j in pairs],
        ).first()
        curve = np.zeros((d, d))
        for i, j in pairs:
            curve[i, j] = curve[j, i] = one[f"h{i}_{j}"] or 0.0
        return one["l"] or 0.0, np.array([one[f"g{i}"] or 0.0 for i in range(d)]), curve

    b, taken = np.zeros(d), 0
    level, gradient, curve = sums(b)
    while taken < rounds:
        step = np.linalg.lstsq(curve + 1e-12 * np.eye(d), gradient, rcond=None)[0]
        taken += 1
        after = sums(b + step)
        while after[0] < level - 1e-9 * abs(level) and np.abs(step).max() > 1e-12:
            step = step / 2
            after = sums(b + step)
        done = after[0] - level <= close * (1 + abs(level))
        b, (level, gradient, curve) = b + step, after
        if done:
            break
    line = [float(-b[1] / b[2]), float(-b[0] / b[2])] if d == 3 and b[2] else [None, None]
    schema = "weights array<double>, intercept double, slope double, border double, steps int, log_likelihood double"
    return table.sparkSession.createDataFrame([([float(v) for v in b[1:]], float(b[0]), *line, taken, float(level))], schema)


def _splits(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For rows of ascending values, padded after their first ``n``, how many belong to the lower of two clusters of least squares; 0 if all are equal."""
    k = np.arange(1, x.shape[1])
    held = np.where(np.arange(x.shape[1]) < n[:, None], x - x[:, :1], 0.0)
    below = np.cumsum(held, axis=1)[:, :-1]
    above, rest = held.sum(axis=1, keepdims=True) - below, n[:, None] - k
    may = (rest > 0) & (np.diff(x, axis=1) > 0)
    score = np.where(may, below**2 / k + above**2 / np.maximum(rest, 1), -np.inf) if x.shape[1] > 1 else np.full((len(x), 1), -np.inf)
    best = score.argmax(axis=1)
    return np.where(np.isfinite(score[np.arange(len(x)), best]), best + 1, 0)


def _mixtures(x: np.ndarray, n: np.ndarray, rounds: int) -> np.ndarray:
    """Whether each value belongs to the upper of two Gaussians, by EM over all rows at once, from the split of least
    squares on; rows are as for :func:`_splits`."""
    held = np.arange(x.shape[1]) < n[:, None]
    with np.errstate(invalid="ignore"):
        p = (np.arange(x.shape[1]) < _splits(x, n)[:, None]).astype(float)
    x = np.where(held, x, 0.0)
    count = np.maximum(n[:, None], 1)
    mean = x.sum(axis=1, keepdims=True) / count
    floor = 1e-6 * (np.where(held, (x - mean) ** 2, 0).sum(axis=1, keepdims=True) / count) + 1e-12
    open_ = np.ones(len(x), dtype=bool)
    for _ in range(rounds):
        q = np.where(held, 1 - p, 0.0)
        one, two = p.sum(axis=1, keepdims=True), q.sum(axis=1, keepdims=True)
        open_ &= (np.minimum(one, two) / count >= 1e-6)[:, 0]
        if not open_.any():
            break
        one, two = np.maximum(one, 1e-12), np.maximum(two, 1e-12)
        m1, m2 = (p * x).sum(axis=1, keepdims=True) / one, (q * x).sum(axis=1, keepdims=True) / two
        v1 = (p * (x - m1) ** 2).sum(axis=1, keepdims=True) / one + floor
        v2 = (q * (x - m2) ** 2).sum(axis=1, keepdims=True) / two + floor
        odds = np.log(two / one) - 0.5 * np.log(v2 / v1) - 0.5 * ((x - m2) ** 2 / v2 - (x - m1) ** 2 / v1)
        now = np.where(held, 1 / (1 + np.exp(np.clip(odds, -700, 700))), 0.0)
        moved = np.abs(now - p).max(axis=1)
        p = np.where(open_[:, None], now, p)
        open_ &= moved >= 1e-9
    upper = held & (p < 0.5)
    share = lambda part: (np.where(part, x, 0).sum(axis=1) / np.maximum(part.sum(axis=1), 1))
    turned = upper.any(axis=1) & (held & ~upper).any(axis=1) & (share(upper) < share(held & ~upper))
    return np.where(turned[:, None], held & ~upper, upper)


def gmm_1d(table: DataFrame, by: str = "gene", value: str = "value", item: str = "cell_line", rounds: int = 100) -> DataFrame:
    """Two-component Gaussian mixture of each group's values: ``by, item, cluster, method``; cluster 1 has the lower mean.

    Groups (one gene's cell lines) are arrays, and the steps of EM are taken for many of them at once.  A group
    that the mixture leaves in one component is split by least squares instead (``method`` kmeans); one
    whose values are all equal is one cluster.  Nulls are left out.
    """
    kind = table.schema[by].dataType.simpleString(), table.schema[item].dataType.simpleString()
    packed = table.where(F.col(value).isNotNull()).groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(value).cast("double").alias("v"), F.col(item).alias("item")))).alias("s"))
    rows = packed.select(by, F.transform("s", lambda e: e["v"]).alias("v"), F.transform("s", lambda e: e["item"]).alias("item"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            n = np.array([len(v) for v in batch["v"]])
            x = np.full((len(batch), n.max()), np.inf)
            for i, v in enumerate(batch["v"]):
                x[i, : n[i]] = v
            upper, held = _mixtures(x, n, rounds), np.arange(x.shape[1]) < n[:, None]
            single = ~upper.any(axis=1) | ~(held & ~upper).any(axis=1)
            with np.errstate(invalid="ignore"):
                cut = _splits(x, n)
            split = single & (cut > 0)
            upper[split] = (np.arange(x.shape[1]) >= cut[:, None])[split]
            upper[single & (cut == 0)] = False
            method = np.where(split, "kmeans", np.where(single, "one value", "mixture"))
            yield pd.DataFrame({
                by: batch[by].to_numpy().repeat(n), item: np.concatenate([np.asarray(v) for v in batch["item"]]), "cluster": 1 + upper[held].astype(int), "method": method.repeat(n),
            })

    return rows.mapInPandas(fit, f"{by} {kind[0]}, {item} {kind[1]}, cluster int, method string")
