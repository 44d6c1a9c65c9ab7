import numpy as np
import pytest
from pyspark.sql import functions as F

from prismatic.functions.boosting import NeuralBoosted
from prismatic.operators import balance, ensemble, instruments, wavelengths


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(2)
    x = r.normal(size=(80, 40))
    return x, 3 * x[:, 10] + 2 * x[:, 25] + 0.05 * r.normal(size=80)


def test_wavelength_selection(spark, data):
    x, y = data
    assert {10, 25} <= set(np.flatnonzero(wavelengths.uve(x, y)))
    best = sorted(wavelengths.ipls(spark, x, y, 8), key=lambda t: -t[2])[:2]
    assert {(a, b) for a, b, _ in best} == {(10, 15), (25, 30)}
    assert {10, 25} <= set(wavelengths.cars(spark, x, y, 12))
    assert {10, 25} <= set(wavelengths.vcpa(spark, x, y, 3, 30))


def test_scored_projections(spark, data):
    x, y = data
    x = np.hstack([x, x[:, [10]] + 0.01 * x[:, [3]], np.ones((80, 1))])  # a copy of the best channel, and a constant one
    got = wavelengths.scored_spa(spark, x, y, 6, starts=4)
    assert len(set(got)) == 6 and {10, 40} - set(got)
    r = np.nan_to_num(np.corrcoef(x.T)) ** 2
    for k in range(1, 6):
        left = [c for c in range(42) if c not in got[:k]]
        assert r[got[:k]].sum(0)[got[k]] == pytest.approx(min(r[got[:k]].sum(0)[left]), abs=1e-12)
    assert sorted(wavelengths.scored_spa(spark, x[:, :3], y, 9)) == [0, 1, 2]


def test_boosting(data):
    x, y = data
    m = NeuralBoosted(n=80, rate=0.2).fit(x[:60, [10, 25]], y[:60])
    assert 1 - ((m.predict(x[60:][:, [10, 25]]) - y[60:]) ** 2).mean() / y[60:].var() > 0.8
    c = NeuralBoosted(n=40, classify=True).fit(x[:60, [10, 25]], (y[:60] > 0).astype(int))
    assert (c.predict(x[60:][:, [10, 25]]) == (y[60:] > 0)).mean() > 0.8 and m.importances().sum() == pytest.approx(1)


def test_instruments(spark):
    axis = [float(k) for k in range(50)]
    peak = np.exp(-0.5 * ((np.arange(50) - 20) / 3) ** 2)
    df = spark.createDataFrame([("fine", (peak + 0.01 * np.sin(np.arange(50) * 2)).tolist()), ("soft", peak.tolist())], "instrument string, values array<double>")
    rows = instruments.characterized(df, "instrument", {"fine": axis, "soft": axis}).collect()
    assert [r["instrument"] for r in rows] == ["fine", "soft"] and rows[1]["mean_fwhm"] == pytest.approx(2.355 * 3, rel=0.03) and rows[1]["interpolated"]
    assert rows[1]["mean_sharpness"] == pytest.approx(1 / rows[1]["mean_fwhm"], rel=0.05)
    both, grid = instruments.equalized({"a": (df, axis), "b": (df.withColumn("values", F.slice("values", 1, 25)), axis[::2])})
    assert grid == [float(k) for k in range(0, 49, 2)] and both.count() == 4
    assert instruments.smoothing_between(peak, axis, peak, axis, [0, 1, 2]) == 0


def test_balance(spark):
    df = spark.createDataFrame([(k, float(k % 10) if k < 99 else 100.0) for k in range(100)], "sample_id long, y double")
    w = balance.rare_boost(df, "y")
    assert w.agg(F.avg("weight")).first()[0] == pytest.approx(1) and w.orderBy(F.desc("weight")).first()["y"] == 100.0
    assert balance.regression_imbalance(df, "y")["severity"] == "severe"
    near = spark.createDataFrame([(0, [0.0], 0), (1, [0.1], 1), (2, [5.0], 1), (3, [5.2], 1)], "sample_id long, values array<double>, label int")
    assert [tuple(r) for r in balance.tomek_links(near, "label").collect()] == [(0, 1)]


def test_ensembles(spark):
    rows = [(i, m, float(i), float(i) * (1.5 if (m == "a") == (i < 50) else 1.0)) for i in range(100) for m in ("a", "b")]
    p = spark.createDataFrame(rows, "id long, model string, y double, pred double")
    errors = ensemble.regional_errors(p, [25.0, 50.0, 75.0])
    assert {r["region"]: r["model"] for r in ensemble.best_experts(errors).collect()} == {0: "b", 1: "b", 2: "a", 3: "a"}
    assert ensemble.mixture(p, errors, [25.0, 50.0, 75.0]).count() == 100
    names, w = ensemble.stacked(p)
    assert names == ["a", "b"] and len(w) == 3
    t = np.random.default_rng(0).normal(size=(50, 2))
    assert [x[1] for x in ensemble.applicability(t, np.array([[0.0, 0.0], [50.0, 50.0]]))] == ["good", "extrapolation"]
