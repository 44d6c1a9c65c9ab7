import numpy as np
import pytest

from prismatic import __main__ as command
from prismatic.functions import linalg, registry
from prismatic.functions.learners import Forest, classifier
from prismatic.functions.linalg import Ridge
from prismatic.operators import ensemble, report, search
from prismatic.sources import facade, models, saved


def test_command(spark, tmp_path):
    g = np.random.default_rng(3)
    axis = [400.0 + k for k in range(100)]
    x = 0.5 + 0.1 * g.normal(size=(40, 100))
    facade.write_spectra(spark.createDataFrame([(f"Spectrum {i:03d}", v.tolist()) for i, v in enumerate(x)], "sample_id string, values array<double>"), axis, str(tmp_path / "x.csv"), "csv")
    (tmp_path / "y.csv").write_text("File,%N,kind\n" + "".join(f"spectrum{i:03d}.asd,{10 * v[20]},{'ab'[int(v[20] > 0.5)]}\n" for i, v in enumerate(x)))
    common = ["--spectra", str(tmp_path / "x.csv"), "--format", "csv", "--reference", str(tmp_path / "y.csv"), "--id", "File", "--folds", "4", "--preprocessing", "raw", "--variable-counts", "--regions", "0"]
    rows = command.main([*common, "--target", "%N", "--models", "Ridge", "--results", str(tmp_path / "r"), "--report", str(tmp_path / "r.md")])
    assert len(rows) == 5 and [r["rank"] for r in rows] == sorted(r["rank"] for r in rows)
    assert "%N" in (tmp_path / "r.md").read_text() and spark.read.parquet(str(tmp_path / "r")).count() == 5
    rows = command.main([*common, "--target", "kind", "--task", "classification", "--models", "PLS-DA", "--max-components", "3"])
    assert len(rows) == 2 and all(0 <= r["auc"] <= 1 for r in rows)
    rows = command.main([*common[:-3], "--variable-counts", "10", "--regions", "2", "--target", "%N", "--models", "Ridge"])
    assert {r["subset"] for r in rows} >= {"full", "top10", "top2regions"} and all(r["n_vars"] == (100 if r["subset"] == "full" else len(r["all_vars"].split(","))) for r in rows)
    with pytest.raises(SystemExit):
        command.main(["--target", "y"])


@pytest.mark.parametrize("kind", ensemble.KINDS)
def test_saved_ensembles(spark, tmp_path, kind):
    g = np.random.default_rng(4)
    x = g.normal(size=(60, 5))
    y = x[:, 0] * 2 + x[:, 1]
    df = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "sample_id long, values array<double>, y double")
    models = {"strong": Ridge(0.1).fit(x, y), "weak": Ridge(500.0).fit(x, y), "trees": Forest(8, 4).fit(x, y)}
    rows = [(i, n, float(t), float(p)) for n, m in models.items() for i, (t, p) in enumerate(zip(y, m.predict(x)))]
    preds = spark.createDataFrame(rows, "id long, model string, y double, pred double")
    made = ensemble.created(preds, kind, 4)
    saved.save_ensemble(spark, models, str(tmp_path / "e"), [400.0 + k for k in range(5)], made, note="n")
    again = saved.load_ensemble(spark, str(tmp_path / "e"))
    got = {r["id"]: r["pred"] for r in saved.predicted(df, again).collect()}
    want = {r["id"]: r["pred"] for r in ensemble.combined(preds, made).collect()}
    assert again["note"] == "n" and len(got) == 60 and all(abs(got[i] - p) < 1e-8 for i, p in want.items())
    p = np.stack([models[n].predict(x) for n in sorted(models)], axis=1)
    if kind == "simple_average":
        assert np.allclose([want[i] for i in range(60)], p.mean(1))
    if "stacking" in kind:
        edges = np.quantile(y, [0.25, 0.5, 0.75])
        at = np.searchsorted(edges, p.mean(1), side="right")
        f = np.column_stack([p, np.eye(4)[at], p.mean(1)]) if kind == "region_stacking" else p
        e, t = f - f.mean(0), y - y.mean()
        w = np.linalg.solve(e.T @ e + np.eye(f.shape[1]), e.T @ t)
        assert np.allclose([want[i] for i in range(60)], e @ w + y.mean(), atol=1e-6)
    with pytest.raises(ValueError):
        ensemble.created(preds, "other")


@pytest.mark.parametrize("name", ["PLS", "Ridge", "Lasso", "ElasticNet", "RandomForest", "BoostedTrees", "SVR", "MLP", "NeuralBoosted"])
def test_saved_models(spark, tmp_path, name):
    g = np.random.default_rng(5)
    x, axis = g.normal(size=(50, 6)), [400.0 + k for k in range(6)]
    y = x[:, 1] - 2 * x[:, 4]
    params = {k: v[0] for k, v in registry.grid(name).items()} | ({"n": 5} if name in ("RandomForest", "BoostedTrees", "NeuralBoosted") else {})
    fitted = linalg.model(name, params).fit(x, y)
    models.save_model(spark, fitted, str(tmp_path / "m"), axis, preprocess="raw", residuals=y - fitted.predict(x), domain=report.domain(x))
    again, a, about = models.load_model(spark, str(tmp_path / "m"))
    assert a == axis and about["preprocess"] == "raw" and np.array_equal(about["residuals"], y - fitted.predict(x)) and np.array_equal(about["domain"]["mean"], x.mean(0))
    assert np.array_equal(again.predict(x), fitted.predict(x)) and type(again) is type(fitted)
    assert models.model_info(spark, str(tmp_path / "m"))["kind"] == type(fitted).__name__


@pytest.mark.parametrize("name", ["PLS-DA", "RandomForest", "SVM", "NeuralBoosted"])
def test_saved_classifiers(spark, tmp_path, name):
    g = np.random.default_rng(6)
    x = g.normal(size=(60, 4))
    y = np.where(x[:, 0] > 0.4, "high", np.where(x[:, 0] < -0.4, "low", "middle"))
    fitted = classifier(name, {"n_components": 2} if name == "PLS-DA" else {"n": 5} if name != "SVM" else {}).fit(x, y)
    models.save_model(spark, fitted, str(tmp_path / "m"), [1.0, 2.0, 3.0, 4.0])
    again = models.load_model(spark, str(tmp_path / "m"))[0]
    assert list(again.classes) == ["high", "low", "middle"] and np.array_equal(again.proba(x), fitted.proba(x)) and list(again.predict(x)) == list(fitted.predict(x))


def test_matched_channels():
    assert models.matched_channels([400.0, 410.004, 420.0], [410.0, 400.0]) == [1, 0]
    with pytest.raises(ValueError, match="410.1"):
        models.matched_channels([400.0, 410.0], [410.1])


def test_saved_profiles(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", 0.5)], "instrument string, detail double")
    saved.save_profiles(df, str(tmp_path / "p"))
    assert sorted(map(tuple, saved.load_profiles(spark, str(tmp_path / "p")).select("instrument", "detail").collect())) == [("a", 1.5), ("b", 0.5)]
