"""Searches over more than 20,000 samples, against NumPy on the same rows."""

import json

import numpy as np
import pandas as pd
import pytest

from prismatic.functions import registry, steps
from prismatic.functions.linalg import model
from prismatic.operators import moments, search

N = 20_100


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    g = np.random.default_rng(8)
    x = 5 + g.normal(size=(N, 12)).cumsum(1) * 0.3
    y = 3 * x[:, 4] - 2 * x[:, 9] + 0.5 * g.normal(size=N)
    path = str(tmp_path_factory.mktemp("many") / "t.parquet")
    pd.DataFrame({"sample_id": np.arange(N), "values": list(x), "y": y, "own": np.arange(N) % 3 - 1}).to_parquet(path)
    df = spark.read.parquet(path).repartition(5)
    return df, x, y, moments.dealt(df, 5).select("sample_id", "fold").orderBy("sample_id").toPandas()["fold"].to_numpy()


def plain(x, y, fold, r, channels):
    chain = steps.Chain(r["preprocess"], r["deriv"] or 1, r["window"])
    z = chain.fit_apply(x, y)[:, channels]
    e, at = np.empty(len(y)), np.searchsorted(np.quantile(y, [0.25, 0.5, 0.75]), y, side="right")
    made = lambda: model(r["model"], json.loads(r["params"]))
    used = [f for f in range(5) if (fold == f).any()]
    for f in used:
        test = fold == f
        e[test] = y[test] - made().fit(z[~test], y[~test]).predict(z[test])
    in_folds = np.isin(fold, used)
    return {
        "rmse": np.mean([np.sqrt((e[fold == f] ** 2).mean()) for f in used]),
        "r2": np.mean([1 - (e[fold == f] ** 2).mean() / y[fold == f].var() for f in used]),
        "pooled_r2": 1 - (e[in_folds] ** 2).sum() / ((y - y.mean()) ** 2).sum(),
        "regional_rmse": [np.sqrt((e[in_folds & (at == q)] ** 2).mean()) for q in range(4)],
    }


def checked(got, x, y, fold):
    for r in got:
        channels = list(range(12)) if r["all_vars"] == "N/A" else [int(float(w)) for w in r["all_vars"].split(",")]
        want = plain(x, y, fold, r, channels)
        assert all(r[k] == pytest.approx(v) for k, v in want.items()), r


def test_grid(many):
    df, x, y, fold = many
    checked(search.searched(df, "y", ("PLS", "Ridge"), ("raw", "snv", "deriv"), (7,), max_components=3).collect(), x, y, fold)


def test_subsets_and_regions(many):
    df, x, y, fold = many
    got = search.searched(df, "y", ("PLS",), ("raw", "snv_deriv"), (7,), orders=(1, 2), counts=(3,), regions=2, region_size=4, region_step=2, max_components=2).collect()
    assert {"full", "top3", "top2regions"} <= {r["subset"] for r in got}
    checked(got, x, y, fold)
    one = next(r for r in got if r["subset"] == "top3" and r["preprocess"] == "raw")
    order = np.argsort(-registry.importances(model("PLS", json.loads(one["params"])).fit(x, y)), kind="stable")
    assert one["all_vars"] == ",".join(f"{k:.1f}" for k in sorted(order[:3]))


def test_given_folds(many):
    """Rows outside the folds are learned from alone."""
    df, x, y, _ = many
    checked(search.searched(df, "y", ("Ridge",), ("raw",), folds=2, fold="own").collect(), x, y, np.arange(N) % 3 - 1)


def test_classes(spark, many):
    df = many[0].selectExpr("sample_id", "slice(values, 1, 3) as values", "y > 0 as kind")
    got = search.searched_classes(df, "kind", ("PLS-DA",), ("raw",), folds=2, max_components=2).collect()
    assert len(got) == 1 and 0.5 < got[0]["accuracy"] <= 1
