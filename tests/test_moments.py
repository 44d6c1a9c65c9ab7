"""What was refused beyond 20,000 samples, on more of them, against NumPy on the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismatic.functions.linalg import Pls, Ridge, spa
from prismatic.operators import moments, multivariate, transfer, wavelengths

N = 20_500


def test_folds_and_fits(spark, many):
    df, x, y, fold = many
    assert np.ptp(np.bincount(fold)) <= 1
    hashed = df.select("sample_id", F.xxhash64(F.lit(42), "sample_id").alias("h")).orderBy("h").toPandas()["sample_id"].to_numpy()
    assert (fold[hashed] == np.arange(N) % 5).all()
    m = moments.whole(df, "y")
    for k in (1, 4, 10):
        a, b = moments.fitted_pls(m, k), Pls(k).fit(x, y)
        assert np.allclose(a.coef, b.coef) and np.allclose(a.vip(), b.vip()) and m.errors(a) == pytest.approx(((y - b.predict(x)) ** 2).sum())
    assert np.allclose(moments.fitted_ridge(m, 2.0).coef, Ridge(2.0).fit(x, y).coef)
    assert moments.cv_rmse(moments.by_fold(df, "y"), 3) == pytest.approx(rmse(x, y, fold, 3))
    assert moments.PASS_BYTES > 0


def test_passes_over_few_blocks_at_once(many, monkeypatch):
    df, x, y, fold = many
    want = moments.by_fold(df, "y")
    monkeypatch.setattr(moments, "PASS_BYTES", 2 * 8 * 144)
    assert all(np.allclose(a.a, b.a) for a, b in zip(want, moments.by_fold(df, "y")))


def test_cars(spark, many):
    assert {2, 7} <= set(wavelengths.cars_of_rows(many[0], "y", 8))


def test_dosc(many):
    df, x, y, fold = many
    fitted = Pls(3).fit(x, y)
    left = x - fitted.x_mean - fitted.t @ fitted.p.T
    v = np.linalg.svd(left, full_matrices=False)[2][:2].T
    e = x - fitted.x_mean
    got = np.stack(multivariate.dosc(df, "y", 2, 3).orderBy("sample_id").toPandas()["values"])
    assert np.allclose(got, e - (e @ v) @ v.T, atol=1e-6)


def test_ipls(spark, many):
    df, x, y, fold = many
    for a, b, r2 in wavelengths.ipls_of(spark, moments.by_fold(df, "y"), 3, 2):
        assert r2 == pytest.approx(max(0, 1 - rmse(x[:, a:b], y, fold, 2) ** 2 / y.var()))


def plain_jypls(m, s, t, folds, most):
    """As it was on the driver."""
    x, target = np.concatenate([m, s]), np.concatenate([t, t])
    errors = []
    for k in range(1, most + 1):
        each = []
        for test in np.array_split(np.arange(len(x)), folds):
            train = np.setdiff1d(np.arange(len(x)), test)
            each.append(np.sqrt(((target[test] - Pls(k).fit(x[train], target[train]).predict(x[test])) ** 2).mean()))
        errors.append(np.mean(each))
    fitted = Pls(1 + int(np.argmin(errors))).fit(x, target)
    scores = (x - fitted.x_mean) @ fitted.w @ np.linalg.pinv(fitted.p.T @ fitted.w)
    tm, ts = scores[: len(t)], scores[len(t) :]
    return fitted.w @ np.linalg.solve(ts.T @ ts + 1e-6 * np.eye(ts.shape[1]), ts.T @ tm) @ fitted.p.T


def test_jypls(many):
    df, x, y, fold = many
    slave = df.withColumn("values", F.transform("values", lambda v, k: v * (1 + 0.01 * k) + F.sin(v)))
    s = np.stack(slave.orderBy("sample_id").toPandas()["values"])
    for folds in (5, 7):
        assert np.allclose(transfer.fit_jypls(df, slave, df, "y", folds=folds, most=4)["matrix"], plain_jypls(x, s, y, folds, 4), atol=1e-8)


def test_scored_spa(spark, many):
    df, x, y, fold = many
    got = wavelengths.scored_spa_of(spark, moments.by_fold(df, "y"), 4, 3, 3)
    r = np.corrcoef(x.T) ** 2
    for k in range(1, 4):
        left = [c for c in range(10) if c not in got[:k]]
        assert r[got[:k]].sum(0)[got[k]] == pytest.approx(r[got[:k]].sum(0)[left].min())


def test_uve(spark, many):
    df, x, y, fold = many
    noise = moments.noise(df.select(F.xxhash64(F.lit(43), "sample_id").alias("k")).toPandas()["k"].to_numpy(), 10)
    assert abs(noise.mean()) < 0.01 and abs(noise.std() - 1) < 0.01 and np.abs(np.corrcoef(noise.T) - np.eye(10)).max() < 0.05
    assert {2, 7} <= set(np.flatnonzero(wavelengths.uve_of_rows(df, "y")))


def test_uve_spa(spark, many):
    df, x, y, fold = many
    assert wavelengths.projected(moments.whole(df, "y").scatter[:-1, :-1], 6, N) == spa(x, 6)
    assert len(wavelengths.uve_spa_of_rows(df, "y", 8, cutoff=0.0)) == 8


def test_vcpa(spark, many):
    assert {2, 7} <= set(wavelengths.vcpa_of(spark, moments.by_fold(many[0], "y"), 2, 20))
