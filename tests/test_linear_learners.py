"""Dual ascent and orthant-wise Poisson regression against closed forms and optimality conditions."""

import time

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from brindle.ml import dual, orthant
from brindle.ml.dual import DualAscent, DualModel


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    x = r.uniform(0, 1, (600, 5))
    x[:, 3] = (x[:, 3] > 0.5) * 1.0
    number = 40 + 30 * x[:, 0] - 20 * x[:, 1] + r.normal(size=600)
    two = (x[:, 0] + 0.3 * r.normal(size=600) > x[:, 1]) * 1.0
    many = np.argmax(np.stack([x[:, 0], x[:, 1], x[:, 2] + 0.2 * r.normal(size=600)]), axis=0) * 1.0
    count = r.poisson(np.exp(0.5 + 1.5 * x[:, 0] - x[:, 3]))
    df = spark.createDataFrame([(*map(lambda v: float(v), (a, b, c, d)), v.tolist()) for a, b, c, d, v in zip(number, two, many, count, x)], "number double, two double, many double, count double, x array<double>")
    df = df.select("*", array_to_vector("x").alias("features")).repartition(3).persist()
    return x, number, two, many, count.astype(float), df


def _read(model):
    bias = np.array(model.getOrDefault("bias"))
    return np.array(model.getOrDefault("weights")).reshape(len(np.atleast_1d(bias)), -1), bias


def test_squares_equal_ridge_regression(rows):
    x, y, *_, df = rows
    model = DualAscent(l1=0.0, l2=0.05, tolerance=1e-9, rounds=60).fit(df.withColumn("label", F.col("number")))
    c = x - x.mean(axis=0)
    wanted = np.linalg.solve(c.T @ c / len(y) + 0.05 * np.eye(5), c.T @ (y - y.mean()) / len(y))
    w, bias = _read(model)
    assert np.allclose(w[0], wanted, atol=1e-3) and np.isclose(bias[0], y.mean() - wanted @ x.mean(axis=0), atol=1e-3)
    assert 0 <= model.getOrDefault("gap") <= 1e-9 * 0.5 * y.var() * 1.01


@pytest.mark.parametrize("l1", [0.02])
@pytest.mark.parametrize("kind", ["squares", "two", "many"])
def test_optimality_holds_and_the_gap_bounds_the_objective(rows, kind, l1):
    x, number, two, many, _, df = rows
    y, l2 = {"squares": (number, 0.02), "two": (two, 0.02), "many": (many, 0.02)}[kind]
    column = {"squares": "number", "two": "two", "many": "many"}[kind]
    model = DualAscent(loss=kind, l1=l1, l2=l2, tolerance=1e-8, rounds=60).fit(df.withColumn("label", F.col(column)))
    w, bias = _read(model)
    z = x @ w.T + bias
    n = len(y)
    if kind == "squares":
        g, loss = z - y[:, None], 0.5 * (z[:, 0] - y) ** 2
    elif kind == "two":
        p = 1 / (1 + np.exp(-z))
        g, loss = p - y[:, None], np.logaddexp(0, np.where(y > 0, -z[:, 0], z[:, 0]))
    else:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        hit = np.arange(3) == y[:, None]
        g, loss = p - hit, -np.log(p[hit])
    grad = g.T @ x / n + l2 * w
    assert np.all(np.where(w != 0, np.abs(grad + l1 * np.sign(w)), np.maximum(np.abs(grad) - l1, 0)) < 5e-4 * max(1, np.abs(g).max()))
    assert np.allclose(g.mean(axis=0) + (0 if kind == "squares" else l2 * bias), 0, atol=5e-4)
    penalty = l2 / 2 * (w**2).sum() + l1 * np.abs(w).sum() + (0 if kind == "squares" else l2 / 2 * (bias**2).sum())
    assert np.isclose(model.getOrDefault("objective"), loss.mean() + penalty, rtol=1e-9)
    if l1 and kind != "many":
        assert (w == 0).any()
    shown = model.transform(df).agg(F.avg(F.col("prediction"))).first()[0]
    wanted = z.mean() if kind == "squares" else (z[:, 0] > 0).mean() if kind == "two" else z.argmax(axis=1).mean()
    assert np.isclose(shown, wanted)


def test_no_rows_and_kept_models(rows, tmp_path):
    *_, df = rows
    assert DualAscent().fit(df.withColumn("label", F.col("number")).limit(0)).transform(df).count() == 600
    model = DualAscent(loss="two", rounds=3).fit(df.withColumn("label", F.col("two")))
    model.write().overwrite().save(str(tmp_path / "m"))
    assert _read(DualModel.load(str(tmp_path / "m")))[0].tolist() == _read(model)[0].tolist()


def _poisson(df, l1, l2=0.0):
    m = orthant.PoissonRegression(l1=l1, l2=l2).fit(df.withColumn("label", F.col("count")))
    return np.array(m.getOrDefault("weights")), m.getOrDefault("bias"), m


@pytest.mark.parametrize(("l1", "l2"), [(0.0, 0.0), (0.01, 0.0), (0.05, 0.01), (0.15, 0.0)])
def test_poisson_optimality_and_exact_zeros(rows, l1, l2):
    x, *_, y, df = rows
    w, b, _ = _poisson(df, l1, l2)
    mu = np.exp(x @ w + b)
    g = x.T @ (mu - y) / len(y) + l2 * w
    assert abs((mu - y).mean()) < 1e-6
    assert np.all(np.where(w != 0, np.abs(g + l1 * np.sign(w)), np.maximum(np.abs(g) - l1, 0)) < 1e-6)
    assert (w == 0).any() == (l1 >= 0.01)


def test_poisson_with_a_large_penalty_is_the_mean(rows):
    *_, y, df = rows
    w, b, model = _poisson(df, 1e6)
    assert (w == 0).all() and np.isclose(np.exp(b), y.mean())
    assert np.isclose(model.transform(df).first()["prediction"], y.mean())
    assert orthant.PoissonRegression().fit(df.withColumn("label", F.col("count")).limit(0)).getOrDefault("weights") == []


def test_poisson_of_large_counts_takes_few_passes(rows, monkeypatch):
    x, *_, y, df = rows
    passes, folded = [], orthant.sums.folded
    monkeypatch.setattr(orthant.sums, "folded", lambda *a: passes.append(1) or folded(*a))
    scaled = df.withColumn("count", F.col("count") * 50_000)
    w, b, _ = _poisson(scaled, 0.01, 0.01)
    mu, y = np.exp(x @ w + b), y * 50_000
    g = x.T @ (mu - y) / len(y) + 0.01 * w
    assert len(passes) <= 12
    assert abs((mu - y).mean()) < 1e-8 * y.mean()
    assert np.all(np.where(w != 0, np.abs(g + 0.01 * np.sign(w)), np.maximum(np.abs(g) - 0.01, 0)) < 1e-8 * y.mean())


def test_poisson_by_either_method_is_the_same(rows, monkeypatch):
    *_, df = rows
    by_newton = _poisson(df, 0.05, 0.01)
    monkeypatch.setattr(orthant, "NEWTON", 0)
    by_quasi_newton = _poisson(df, 0.05, 0.01)
    assert np.allclose(by_newton[0], by_quasi_newton[0], atol=1e-5) and np.isclose(by_newton[1], by_quasi_newton[1], atol=1e-5)


@pytest.mark.parametrize(("loss", "classes"), [(dual.Squares(), 0), (dual.TwoClasses(), 2), (dual.ManyClasses(3), 3)])
def test_a_large_round_goes_by_batches_that_lift_the_bound(loss, classes):
    r, n, l2 = np.random.default_rng(5), 300_000, 0.01
    x = np.hstack([r.normal(size=(n, 4)), np.ones((n, 1))])
    y = r.integers(0, classes, n).astype(float) if classes else x[:, 0] + r.normal(size=n)
    alpha, moved = np.zeros((n, loss.outputs)), np.zeros((loss.outputs, 5))
    bound = lambda a, m: -loss.conjugates(a, y).mean() - l2 / 2 * (dual.primal(m, 0.0, l2, 0) ** 2).sum()
    began = time.monotonic()
    after, own = dual.local_round(x, y, alpha, moved, loss, n, 0.0, l2, 1, 1, r.permutation(n))
    assert time.monotonic() - began < 2.5  # one row at a time took 3.5 s and more
    assert np.allclose(own, after.T @ x / n) and bound(after, own) > bound(alpha, moved)
    batches = dual.batch_norms(x[:10_000], 300)
    assert all(np.linalg.eigvalsh(x[i : min(i + 300, 10_000)].T @ x[i : min(i + 300, 10_000)])[-1] <= b * (1 + 1e-9) for i, b in zip(range(0, 10_000, 300), batches))


def test_a_label_that_features_hardly_explain_is_still_fitted(spark):
    r, n = np.random.default_rng(6), 30_000
    x, y = r.uniform(size=(n, 6)), 30_000 * r.normal(size=n) + 50_000
    df = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y)], "x array<double>, label double").select(array_to_vector("x").alias("features"), "label").repartition(6)
    model = DualAscent(l1=0.01, l2=0.01, standardize=True).fit(df)
    w, bias = _read(model)
    assert ((y - x @ w[0] - bias[0]) ** 2).mean() < y.var()
    deviations = x.std(axis=0, ddof=1)
    g = ((x - x.mean(axis=0)) / deviations).T @ (x @ w[0] + bias[0] - y) / n + 0.01 * w[0] * deviations
    assert np.abs(g + 0.01 * np.sign(w[0])).max() < 1e-4 * y.std()
