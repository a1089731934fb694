"""Regressions, class borders and mixtures against plain numpy."""

import numpy as np
import pytest

from isoflow.operators import models


def fit(x, y, penalty, lasso):
    """Ridge in closed form, lasso by proximal gradient steps."""
    mx, my = x.mean(axis=0), y.mean(axis=0)
    a, b = x - mx, y - my
    if not lasso:
        w = np.linalg.solve(a.T @ a + penalty * np.eye(a.shape[1]), a.T @ b)
    else:
        w, n = np.zeros((a.shape[1], b.shape[1])), len(a)
        rate = n / np.linalg.norm(a, 2) ** 2
        for _ in range(20_000):
            step = w + rate * a.T @ (b - a @ w) / n
            w = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
    return w, my - mx @ w


@pytest.mark.parametrize("lasso", [False, True])
def test_regression_and_its_penalty(spark, lasso):
    rng = np.random.default_rng(3)
    x = rng.random((40, 6))
    y = np.column_stack([3 * x[:, 0] - 2 * x[:, 3] + rng.normal(0, 0.3, 40), rng.normal(0, 1, 40)])
    folds = rng.integers(0, 4, 40)
    frame = spark.createDataFrame([(a.tolist(), b.tolist(), int(f)) for a, b, f in zip(x, y, folds)], "x array<double>, y array<double>, fold int").repartition(5)
    sums, _ = models.fold_products(frame)
    penalties = [0.3, 0.03, 0.003] if lasso else [0.1, 1.0, 10.0]
    weights, chosen, errors = models.chosen_penalty(sums, 2, penalties, lasso)
    want = np.zeros((3, 2))
    for k, penalty in enumerate(sorted(penalties, reverse=True)):
        for f in range(4):
            w, b = fit(x[folds != f], y[folds != f], penalty, lasso)
            want[k] += ((y[folds == f] - x[folds == f] @ w - b) ** 2).sum(axis=0) / 40
    assert np.allclose(errors, want, rtol=1e-5)
    assert chosen.tolist() == [sorted(penalties, reverse=True)[k] for k in want.argmin(axis=0)]
    for t in range(2):
        assert np.allclose(weights[:, t], fit(x, y, chosen[t], lasso)[0][:, t], atol=1e-5)


def test_regression_from_tables(spark):
    rng = np.random.default_rng(4)
    x = rng.random((30, 3))
    rows = [(f"c{i}", f"g{j}", float(x[i, j])) for i in range(30) for j in range(3) if (i, j) != (4, 1)] + [(f"c{i}", "flat", 2.0) for i in range(30)]
    targets = [(f"c{i}", [float(5 * x[i, 2] + rng.normal(0, 0.01))]) for i in range(29)]
    out = models.expression_regression(spark.createDataFrame(rows, "cell_line string, gene string, value double"), spark.createDataFrame(targets, "cell_line string, y array<double>"), (0.01, 100.0))
    got = {r.gene: (r.weight, r.penalty) for r in out.collect()}
    scale = x[:, 2].max() - x[:, 2].min()
    assert got["g2"] == (pytest.approx(5 * scale, rel=0.02), 0.01) and abs(got["g0"][0]) < 0.1 and got["flat"][0] == 0
    assert models.expression_regression(spark.createDataFrame([], "cell_line string, gene string, value double"), spark.createDataFrame(targets, "cell_line string, y array<double>")).count() == 0
    with pytest.raises(ValueError, match="genes"):
        models.expression_regression(spark.createDataFrame(rows, "cell_line string, gene string, value double"), spark.createDataFrame(targets, "cell_line string, y array<double>"), most_genes=2)


def test_class_border_against_gradient_ascent(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (400, 2))
    label = (rng.random(400) < 1 / (1 + np.exp(-(0.4 + 1.5 * x[:, 0] - 0.8 * x[:, 1])))).astype(int)
    rows = [(float(a), float(b), int(c)) for (a, b), c in zip(x, label)] + [(None, 1.0, 1), (1.0, 1.0, None)]
    got = models.class_border(spark.createDataFrame(rows, "donor double, acceptor double, label int").repartition(4), ["donor", "acceptor"]).first()
    z, b = np.column_stack([np.ones(400), x]), np.zeros(3)
    for _ in range(20_000):
        b += 0.01 * z.T @ (label - 1 / (1 + np.exp(-z @ b))) / 4
    assert [got.intercept, *got.weights] == pytest.approx(b.tolist(), rel=1e-4) and got.steps < 12
    assert got.slope == pytest.approx(-b[1] / b[2], rel=1e-4) and got.border == pytest.approx(-b[0] / b[2], rel=1e-4)
    apart = spark.createDataFrame([(float(v), 0.0, int(v > 0)) for v in (-3, -2, -1, 1, 2, 3)], "donor double, acceptor double, label int")
    assert models.class_border(apart, ["donor", "acceptor"], rounds=15).first().weights[0] > 3
    assert models.class_border(apart.where("false"), ["donor", "acceptor"]).first().intercept == 0


def brute_split(values):
    values = sorted(values)
    cost = lambda part: sum((v - sum(part) / len(part)) ** 2 for v in part)
    cuts = [k for k in range(1, len(values)) if values[k] > values[k - 1]]
    return min(cuts, key=lambda k: cost(values[:k]) + cost(values[k:])) if cuts else 0


def test_mixtures_of_many_genes_and_their_fallback(spark):
    rng = np.random.default_rng(6)
    genes = {f"two{i}": np.concatenate([rng.normal(0, 0.3, 12 + i), rng.normal(6, 0.5, 9)]) for i in range(8)}
    genes |= {f"odd{i}": rng.normal(0, 1, rng.integers(1, 7)) for i in range(40)} | {"flat": np.full(5, 2.0), "one": np.array([1.0]), "pair": np.array([1.0, 2.0])}
    rows = [(g, f"c{i}", float(v)) for g, values in genes.items() for i, v in enumerate(values)] + [("two0", "gap", None)]
    got = models.gmm_1d(spark.createDataFrame(rows, "gene string, cell_line string, value double").repartition(6)).collect()
    assert len(got) == len(rows) - 1
    found = {(r.gene, r.cell_line): (r.cluster, r.method) for r in got}
    for i in range(8):
        assert [found[f"two{i}", f"c{k}"] for k in range(21 + i)] == [(1, "mixture")] * (12 + i) + [(2, "mixture")] * 9
    assert {found["flat", f"c{k}"] for k in range(5)} == {(1, "one value")} and found["one", "c0"] == (1, "one value")
    for g, values in genes.items():
        methods = {found[g, f"c{k}"][1] for k in range(len(values))}
        assert len(methods) == 1
        lower = [values[k] for k in range(len(values)) if found[g, f"c{k}"][0] == 1]
        upper = [values[k] for k in range(len(values)) if found[g, f"c{k}"][0] == 2]
        assert not upper or np.mean(lower) < np.mean(upper)
        if methods == {"kmeans"}:
            assert len(lower) == brute_split(values.tolist()) and max(lower) < min(upper)


def test_split_of_least_squares():
    rng = np.random.default_rng(7)
    values = [np.sort(rng.integers(0, 9, rng.integers(1, 12)).astype(float)) for _ in range(200)]
    n = np.array([len(v) for v in values])
    x = np.full((200, n.max()), np.inf)
    for i, v in enumerate(values):
        x[i, : n[i]] = v
    with np.errstate(invalid="ignore"):
        got = models._splits(x, n)
    cost = lambda v, k: sum(((p - p.mean()) ** 2).sum() for p in (v[:k], v[k:]))
    for v, k in zip(values, got):
        best = brute_split(v.tolist())
        assert (k == 0) == (best == 0) and (k == 0 or (cost(v, k) == pytest.approx(cost(v, best)) and v[k] > v[k - 1]))
