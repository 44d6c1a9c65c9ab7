"""Searches of classes whose rows stay with the tasks, against models that hold all rows."""

import json

import numpy as np
import pytest

from prismatic.functions import registry
from prismatic.functions.learners import ShareForest, ShareTree, Tree, auc, classifier
from prismatic.functions.steps import Chain
from prismatic.operators import classes, search


def test_trees_by_level():
    """As trees grown a node at a time, where both see all columns."""
    g = np.random.default_rng(0)
    x = g.normal(size=(700, 5)).round(1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + g.normal(size=700) > 0).astype(int)
    codes = ShareForest(1).fit(x, y).packed(x)
    rows = g.integers(0, 700, 700)
    for depth in (0, 1, 4, 30):
        got, want = ShareTree(depth).fit(codes, y, rows, g), Tree(depth).fit(codes.T[rows], -y[rows].astype(float), np.ones(700))
        assert np.allclose(got.predict(codes), want.predict(codes.T), rtol=0, atol=1e-11) and np.allclose(got.gain, want.gain)
    assert ShareTree().fit(codes, np.ones(700, dtype=int), rows, g).predict(codes).tolist() == [1.0] * 700


@pytest.fixture(scope="module")
def few(spark):
    """Classes of uneven sizes, one with fewer rows than folds, one row without a class."""
    g = np.random.default_rng(3)
    x = 2 + g.normal(size=(203, 9)).cumsum(1)
    kinds = np.where(x[:, 2] + g.normal(size=203) > 3, "b", np.where(x[:, 7] - x[:, 3] + g.normal(size=203) > 0, "a", "c")).astype(object)
    kinds[:3], kinds[3] = "rare", None
    return spark.createDataFrame([(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, kinds))], "sample_id long, values array<double>, kind string").repartition(3)


def plain(df, r, folds=5):
    """Accuracy and area of a configuration, by models of rows in one place."""
    held = df.where("kind is not null").selectExpr("*", "xxhash64(42, sample_id) as h").orderBy("kind", "h", "sample_id").toPandas()
    z, y, fold = Chain(r["preprocess"], 1, 7).apply(np.stack(held["values"])), held["kind"].to_numpy(dtype=str), np.arange(len(held)) % folds
    out = []
    for f in range(folds):
        fitted = classifier(r["model"], json.loads(r["params"])).fit(z[fold != f], y[fold != f])
        p, truth = fitted.proba(z[fold == f]), y[fold == f]
        areas = [a for k, c in enumerate(fitted.classes) if not np.isnan(a := auc((truth == c).astype(int), p[:, k]))]
        out.append(((fitted.classes[p.argmax(1)] == truth).mean(), np.mean(areas)))
    whole = classifier(r["model"], json.loads(r["params"])).fit(z, y)
    return *np.mean(out, axis=0), np.argsort(-registry.importances(whole), kind="stable").tolist()


@pytest.mark.parametrize("copies", [True, False])
def test_grid(spark, few, monkeypatch, copies):
    """PLS-DA and forests, with the work of a forest in several tasks and in one; edges in one pass and in several. No rows come to the driver."""
    monkeypatch.setitem(registry.GRIDS, "RandomForest", {"n": [7], "depth": [30]})
    if not copies:
        monkeypatch.setattr(classes, "COPY_BYTES", 0)
        monkeypatch.setattr(classes, "EDGE_BYTES", 8 * 202 * 4)
    monkeypatch.setattr(search, "Data", None)
    got = search.searched_classes(few, "kind", max_components=4 if copies else 2).collect()
    assert len(got) == (8 if copies else 4)
    for r in got:
        accuracy, area, order = plain(few, r)
        assert (r["accuracy"], r["auc"]) == (pytest.approx(accuracy, abs=1e-12), pytest.approx(area, abs=1e-9)), r
        assert [int(float(w)) for w in r["top_vars"].split(",")] == order and r["n_vars"] == r["full_vars"] == 9 and r["all_vars"] == "N/A"
    bare = search.searched_classes(few, "kind", ("RandomForest",), ("raw",), top=False).collect()
    assert len(bare) == 1 and bare[0]["top_vars"] is None and bare[0]["accuracy"] == pytest.approx(next(r["accuracy"] for r in got if r["model"] == "RandomForest" and r["preprocess"] == "raw"))


def test_other_models_beside(few):
    """A model that needs all rows in one place goes beside those that don't."""
    got = search.searched_classes(few, "kind", ("PLS-DA", "SVM"), ("raw",), max_components=2).collect()
    assert {r["model"] for r in got} == {"PLS-DA", "SVM"} and all(0 < r["accuracy"] <= 1 for r in got)
