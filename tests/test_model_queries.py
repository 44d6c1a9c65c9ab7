import numpy as np
import pytest

from prismatic.functions.learners import Forest
from prismatic.functions.linalg import Ridge
from prismatic.operators import report, scoring, screening
from prismatic.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    got = catalog.QUERIES[name](spark, DIR)
    assert got.columns and got.count() > 0


def test_outliers_against_numpy(spark):
    g = np.random.default_rng(1)
    x, y = g.normal(size=(80, 6)) * [9, 5, 1, 1, 1, 1], g.normal(size=80)
    x[7], y[7] = x[7] + 60, 40
    df = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "sample_id long, values array<double>, y double")
    got = report.outliers(df, "y", 3).orderBy("sample_id").toPandas()
    e = x - x.mean(0)
    s = e @ np.linalg.svd(e)[2][:3].T
    t2 = (s @ np.linalg.inv(np.cov(s.T)) * s).sum(1)
    assert np.allclose(got["t2"], t2) and np.allclose(got["distance"], np.sqrt(t2))
    assert np.allclose(got["q"], (e**2).sum(1) - (s**2).sum(1)) and np.allclose(got["z"], (y - y.mean()) / y.std())
    assert got["confidence"][7] in ("moderate", "high") and got["total_flags"].max() == got["total_flags"][7]
    assert report.outliers(df, "y", 3, upper=-100.0).where("not y_outlier").count() == 0


def test_trust(spark):
    g = np.random.default_rng(2)
    x = g.normal(size=(130, 4))
    y = x[:, 0]
    df = spark.createDataFrame([(0, x[0].tolist()), (1, [50.0, 50.0, 50.0, 50.0])], "sample_id long, values array<double>")
    for model in (Ridge(1e-6).fit(x, y), Forest(20).fit(x, y)):
        a, b = report.predicted(df, model, report.domain(x), 0.25).orderBy("sample_id").collect()
        assert a["trust"] == "good" and b["trust"] == "extrapolation" and b["distance"] > 80
        assert (a["spread"] == 0.25) == isinstance(model, Ridge)


def test_complexity_and_subsets(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("PLS", 100, 25, "raw", 0), ("SVR", 10_000, None, "deriv_snv", 2)], "m string, n int, lv int, p string, d int")
    got = [r[0] for r in df.select(scoring.complexity(*map(F.col, ("m", "n", "lv", "p", "d")))).collect()]
    assert got == [43.5, 71.0]
    ranked = [{"start": 10 * k, "end": 10 * k + 15, "channels": [k, k + 1]} for k in range(6)]
    made = screening.subsets(ranked, 5)
    assert list(made) == ["region_0-15", "region_10-25", "region_20-35", "top2regions", "top5regions"] and made["top2regions"] == [0, 1, 2]
