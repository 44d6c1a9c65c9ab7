import json
import statistics

import numpy as np
import pytest

from prismatic.functions import steps
from prismatic.functions.linalg import Ridge
from prismatic.operators import diagnostics, multivariate
from prismatic.operators.registry import Registry, load_configuration


def test_registry(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 2.0])], "sample_id long, values array<double>")
    b = spark.createDataFrame([(2, [0.0, 4.0])], "sample_id long, values array<double>")
    r = Registry()
    first, second = r.add(a, [1.0, 2.0, 3.0], "A"), r.add(b, [1.0, 3.0], "B")
    with pytest.raises(ValueError):
        r.merge()
    both, axis = r.merge(duplicates="rename")
    assert axis == [1.0, 3.0] and sorted(x["sample_id"] for x in both.collect()) == ["A_1", "A_2", "B_2"]
    kept, axis = r.merge(how="interpolation", duplicates="keep_first")
    assert axis == [1.0, 2.0, 3.0] and {x["sample_id"]: x["values"] for x in kept.collect()} == {1: [1.0, 2.0, 3.0], 2: [2.0, 2.0, 2.0]}
    only, _ = r.merge([second], how="interpolation", target=[1.0, 2.0, 4.0])
    assert only.first()["values"] == [0.0, 2.0, 6.0]
    assert json.loads(r.to_json())[first]["n_samples"] == 2
    r.remove(first)
    assert list(r.sources) == [second]
    rows, axis = r.merge()
    assert r.merged_summary(rows, axis, "single") == {"strategy": "single", "n_samples": 1, "n_channels": 2, "range": [1.0, 3.0], "sources": {"B": 1}}
    assert list(load_configuration(r.to_json())) == [second]
    r.clear()
    assert not r.sources


def test_orthogonal_corrections(spark):
    g = np.random.default_rng(3)
    y, noise = g.normal(size=50), g.normal(size=50)
    signal, drift = np.eye(12)[2], np.ones(12) / np.sqrt(12)
    x = np.outer(y, signal) + 10 * np.outer(noise, drift) + 0.01 * g.normal(size=(50, 12))
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(50)], "sample_id long, values array<double>, y double")
    library = spark.createDataFrame([(i, (n * drift + 0.001 * g.normal(size=12)).tolist()) for i, n in enumerate(noise)], "sample_id long, values array<double>")
    fitted = steps.LoadingOsc(2).fit(x, y)
    got = np.array([r["values"] for r in multivariate.osc(df, "y", 2).orderBy("sample_id").collect()])
    assert np.allclose(got, fitted.apply(x), atol=1e-8)
    for cleaned in (multivariate.osc_by_scores(df, "y"), multivariate.orthogonalized(df, library, 1)):
        z = np.array([r["values"] for r in cleaned.orderBy("sample_id").collect()])
        assert z.var(0).sum() < 0.2 * x.var(0).sum()
        assert abs(np.corrcoef(z[:, 2], y)[0, 1]) > 0.98 > abs(np.corrcoef(x[:, 2], y)[0, 1])
    assert multivariate.dosc(df, "y", 1, 2).count() == 50


def test_quantiles_and_jackknife(spark):
    g = np.random.default_rng(5)
    df = spark.createDataFrame([(float(v),) for v in g.normal(size=300)], "r double")
    rows = diagnostics.quantile_pairs(df, "r").orderBy("place").collect()
    values = sorted(r["r"] for r in df.collect())
    assert [(r["place"], r["observed"]) for r in rows] == list(enumerate(values, 1))
    assert all(r["expected"] == pytest.approx(statistics.NormalDist().inv_cdf(r["place"] / 301)) for r in rows)
    tied = spark.createDataFrame([(1.0,)] * 7 + [(None,), (2.0,), (0.0,)], "r double")
    assert [r["observed"] for r in diagnostics.quantile_pairs(tied, "r").orderBy("place").collect()] == [0.0, *[1.0] * 7, 2.0]
    assert diagnostics.quantile_pairs(tied.limit(0), "r").count() == 0
    x = g.normal(size=(30, 2))
    y = x @ [1.0, 2.0] + 0.1 * g.normal(size=30)
    for (p, lo, hi), t in zip(diagnostics.jackknife(spark, lambda: Ridge(1e-3), x, y, x[:3]), y[:3]):
        assert lo < p < hi and abs(p - t) < 0.5
