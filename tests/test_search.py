import json

import numpy as np
import pytest

from prismatic.functions import registry, steps
from prismatic.functions.learners import classifier
from prismatic.functions.linalg import Pls, Ridge, farthest_pair, find_peaks, kennard_stone, model
from prismatic.operators import report, scoring, screening, search, wavelengths
from prismatic.sources import facade


@pytest.fixture(scope="module")
def data(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(60, 30)).cumsum(1) * 0.1
    y = 3 * x[:, 8] - 2 * x[:, 20] + 0.05 * g.normal(size=60)
    df = spark.createDataFrame([(i, v.tolist(), float(t), i % 5, "ab"[int(t > 0)]) for i, (v, t) in enumerate(zip(x, y))], "sample_id long, values array<double>, y double, fold int, kind string")
    return df, x, y


def brute(x, y, make, chain, channels=None, folds=5):
    fold, rmse, r2 = np.arange(len(y)) % folds, [], []
    for f in range(folds):
        test = fold == f
        c = chain()
        c.axis(list(range(x.shape[1])))
        z, t = c.fit_apply(x[~test], y[~test]), None
        t = c.apply(x[test])
        if channels is not None:
            z, t = z[:, channels], t[:, channels]
        e = y[test] - make().fit(z, y[~test]).predict(t)
        rmse.append(np.sqrt((e**2).mean()))
        r2.append(1 - (e**2).sum() / ((y[test] - y[test].mean()) ** 2).sum())
    return np.mean(rmse), np.mean(r2)


def test_subsets_regions_and_derivatives(spark, data):
    """Every configuration against plain loops: full spectra, subsets by importance, regions, first and second derivatives."""
    df, x, y = data
    axis = [1000.0 + 2 * k for k in range(30)]
    got = search.searched(df, "y", ("Ridge", "PLS"), ("raw", "deriv_snv"), (7,), orders=(1, 2), counts=(5, 10, 100), regions=2, axis=axis, fold="fold", max_components=3, region_size=20, region_step=10).collect()
    assert {(r["preprocess"], r["deriv"]) for r in got} == {("raw", 0), ("deriv_snv", 1), ("deriv_snv", 2)}
    assert {"full", "top5", "top10", "top2regions"} <= {r["subset"] for r in got} and "top100" not in {r["subset"] for r in got}
    for r in got:
        make, chain = lambda: model(r["model"], json.loads(r["params"])), lambda: steps.Chain(r["preprocess"], r["deriv"] or 1, r["window"])
        z = chain().fit_apply(x, y)
        channels = None
        if r["subset"] != "full":
            channels = [axis.index(float(w)) for w in r["all_vars"].split(",")]
            assert r["n_vars"] == len(channels)
        if r["subset"].startswith("top") and "regions" not in r["subset"]:
            order = np.argsort(-registry.importances(make().fit(z, y)), kind="stable")
            assert channels == sorted(order[: int(r["subset"][3:])].tolist())
        if r["subset"] == "top2regions":
            corr = np.abs([np.corrcoef(z[:, k], y)[0, 1] for k in range(30)])
            starts = sorted(np.arange(1000.0, 1058.0, 10.0), key=lambda s: -np.mean([c for w, c in zip(axis, corr) if s <= w < s + 20]))[:2]
            assert channels == sorted({k for s in starts for k, w in enumerate(axis) if s <= w < s + 20})
        rmse, r2 = brute(x, y, make, chain, channels)
        assert (r["rmse"], r["r2"]) == (pytest.approx(rmse), pytest.approx(r2))
        assert r["full_vars"] == 30 and len(r["top_vars"].split(",")) == min(30, r["n_vars"]) and len(r["regional_rmse"]) == 4


def test_interference_is_fitted_inside_folds(spark, data):
    df, x, y = data
    library = np.outer(np.random.default_rng(3).normal(size=10), np.ones(30)).tolist()
    plans = [[{"step": "msc", "reference": "median"}], [{"step": "osc"}, {"step": "msc"}], [{"step": "glsw", "method": "residual", "components": 3}], [{"step": "dosc", "components": 2}], [{"step": "epo", "library": library, "k": 1}], [{"step": "exclude", "ranges": [[3, 9]]}, {"step": "glsw"}], [{"step": "als", "lam": 100.0, "rounds": 3}, {"step": "polynomial", "degree": 2}]]
    for plan in plans:
        got = search.searched(df, "y", ("Ridge",), ("snv",), fold="fold", interference=plan).collect()
        for r in got:
            rmse, r2 = brute(x, y, lambda: Ridge(json.loads(r["params"])["alpha"]), lambda: steps.Chain("snv", interference=plan))
            assert (r["rmse"], r["r2"]) == (pytest.approx(rmse), pytest.approx(r2)), plan
            assert r["n_vars"] == (23 if plan[0]["step"] == "exclude" else 30)
    with pytest.raises(ValueError):
        steps.Chain("raw", interference=[{"step": "other"}])


def test_classes_with_resampling(spark, data):
    df, x, y = data
    few = df.where("kind = 'a' or sample_id % 3 = 0")
    for balance in (None, "smote"):
        got = search.searched_classes(few, "kind", ("PLS-DA",), ("raw",), max_components=3, counts=(5,), balance=balance).collect()
        assert {r["subset"] for r in got} == {"full", "top5"} and all(r["auc"] > 0.7 for r in got if r["subset"] == "full")


def test_steps_keep_to_their_definitions():
    g = np.random.default_rng(7)
    x, y = 1 + g.random((20, 12)), g.normal(size=20)
    ref = np.median(x, axis=0)
    got = steps.Msc("median").fit(x, y).apply(x)
    for row, z in zip(x, got):
        b, a = np.polyfit(ref, row, 1)
        assert np.allclose(z, (row - a) / b)
    assert np.allclose(steps.Msc().fit(x, y).apply(np.full((1, 12), 2.0)), 2.0)  # a row without variation stays
    w = steps.Glsw().fit(x, y).root ** 2
    assert w.mean() == pytest.approx(1) and np.argmax(w) == np.argmin(x.var(0))
    p = Pls(1).fit(x, y).p[:, 0]
    p /= np.linalg.norm(p)
    e = x - x.mean(0)
    assert np.allclose(steps.LoadingOsc().fit(x, y).apply(x), e - np.outer(e @ p, p))
    # a row held out is treated alike whatever other rows are held out with it
    for step in (steps.Msc(), steps.LoadingOsc(), steps.Dosc(), steps.Glsw("residual")):
        step.fit(x[:15], y[:15])
        assert np.allclose(step.apply(x[15:])[:1], step.apply(x[15:16]))


def test_ranking(spark):
    rows = [{"model": m, "lvs": lv, "rmse": e, "r2": 1 - e, "n_vars": n, "full_vars": 100} for m, lv, e, n in (("PLS", 5, 0.5, 100), ("PLS", 25, 0.5, 100), ("Ridge", None, 0.5, 100), ("MLP", None, 0.5, 100), ("PLS", 50, 0.5, 100), ("Other", None, 0.5, 10))]
    table = scoring.results_table(spark, "regression", rows)
    assert table.columns[:3] == ["model", "params", "preprocess"] and scoring.results_table(spark, "classification").count() == 0
    both = {(r["model"], r["lvs"]): (r["score"], r["rank"]) for r in scoring.composite(table, "regression", 10.0, 10.0).collect()}
    assert {k: round(v[0], 6) for k, v in both.items()} == {("PLS", 5): 1.2, ("PLS", 25): 2.0, ("Ridge", None): 1.25, ("MLP", None): 1.8, ("PLS", 50): 2.0, ("Other", None): 0.6}
    assert both["PLS", 25][1] == both["PLS", 50][1] == 5 and both["Other", None][1] == 1
    plain = scoring.composite(table, "regression", 0.0, 0.0)
    assert {r["rank"] for r in plain.collect()} == {1}
    two, ten = (dict((r["n_vars"], r["score"]) for r in scoring.composite(table, "regression", p, 0.0).collect()) for p in (2.0, 10.0))
    assert ten[100] / two[100] == pytest.approx(25)
    assert table.unionByName(scoring.results_table(spark, "regression", [{"model": "new", "all_vars": "1.0"}])).count() == 7


def test_tiers_and_models():
    assert registry.tier_models("quick") == ["PLS", "Ridge", "ElasticNet"] and "PLS-DA" in registry.tier_models("experimental", "classification")
    assert registry.is_valid("SVM", "classification") and not registry.is_valid("SVM", "regression") and not registry.is_valid("x")
    assert registry.has_importances("SVR") and not registry.takes_subsets("KNN")
    assert registry.grid("XGBoost") == registry.grid("BoostedTrees") and registry.grid("PLS", 4) == {"n_components": [2, 3, 4]}
    for call in (lambda: registry.tier_models("huge"), lambda: registry.supported("ranking")):
        with pytest.raises(ValueError):
            call()
    g = np.random.default_rng(2)
    x = g.normal(size=(80, 6))
    y = 4 * x[:, 2] + 0.1 * g.normal(size=80)
    for task, names in (("regression", registry.supported()), ("classification", registry.supported("classification"))):
        for name in names:
            params = {k: v[0] for k, v in registry.grid(name).items()} | ({"n": 10} if name not in ("PLS", "PLS-DA", "Ridge", "Lasso", "ElasticNet", "SVR", "SVM", "MLP") else {})
            fitted = (model if task == "regression" else classifier)(registry.own_name(name), params).fit(x, y if task == "regression" else (y > 0).astype(int))
            w = registry.importances(fitted)
            assert w.shape == (6,) and (w >= 0).all()
            assert np.argmax(w) == 2 or name in ("MLP", "SVR", "SVM", "NeuralBoosted"), name


def test_kennard_stone_has_no_switch():
    """The same rule whatever the number of rows: the farthest pair comes first."""
    g = np.random.default_rng(3)
    for n in (5, 1999, 2001):
        x = g.normal(size=(n, 3))
        d = np.sqrt(((x[:, None, :2] - x[None, :, :2]) ** 2).sum(2)) if n < 10 else None
        a, b = farthest_pair(x)
        size = (x**2).sum(1)
        every = size[:, None] + size[None] - 2 * x @ x.T
        assert every[a, b] == pytest.approx(every.max()) and kennard_stone(x, 4)[:2] == [a, b]
        assert farthest_pair(x, block=7) == (a, b)
        assert d is None or d.shape == (n, n)


def test_peaks():
    v = np.array([0, 1, 0, 0.9, 0, 0, 0, 0.5, 1.5, 0.5, 0.0])
    assert find_peaks(v, 0.1) == [1, 3, 8] and find_peaks(v, 0.1, distance=3) == [1, 8] and find_peaks(v, 0.1, 1, 1.2) == [8]


def test_wavelength_methods(spark, data):
    _, x, y = data
    steady, limit = wavelengths.steadiness(x, y)
    assert np.array_equal(wavelengths.uve(x, y), steady > limit) or not (steady > limit).any()
    assert len(wavelengths.uve_spa(x, y, 8, cutoff=0.0)) == 8
    assert [r["method"] for r in wavelengths.compared(spark, x, y, 6, 3)] == ["spa", "cars", "vcpa"]
    assert "1. 0-50: mean |r| 0.500" in screening.region_report([{"start": 0.0, "end": 50.0, "mean_corr": 0.5, "max_corr": 0.9, "n": 4}])


def test_signal_kind(spark):
    kind = lambda rows, names=(): facade.signal_kind(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "sample_id long, values array<double>"), names)
    dip, bump = [float(0.6 - 0.3 * np.exp(-((k - 20) ** 2) / 9)) for k in range(40)], [float(0.2 + 2 * np.exp(-((k - 20) ** 2) / 9)) for k in range(40)]
    assert kind([dip])[0] == "reflectance" and kind([bump])[0] == "absorbance"
    assert kind([dip])[1] == 100 and kind([dip], ["abs_400"])[1] == pytest.approx(100 * 95 / 110)
    assert kind([[]]) == kind([[None, float("nan")]]) == ("reflectance", 50.0)


def test_domains(spark):
    from prismatic.operators import ensemble

    d = spark.createDataFrame([(1, 0.5, "good"), (1, 2.0, "caution"), (2, 0.1, "good"), (2, 9.0, "extrapolation")], "id long, distance double, trust string")
    assert {r["id"]: (r["distance"], r["trust"]) for r in ensemble.farthest_domain(d).collect()} == {1: (2.0, "caution"), 2: (9.0, "extrapolation")}
    assert report.SMALL < report.DESCRIBED
