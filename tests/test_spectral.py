import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismatic.functions import arrays, linalg
from prismatic.operators import balance, multivariate, search, spectra, transfer
from prismatic.plans import specs
from prismatic.sources import models, spectral_files
from prismatic.streaming import spectra as streams


@pytest.fixture(scope="module")
def made(spark):
    r = np.random.default_rng(1)
    x = 1 + 0.05 * r.normal(size=(60, 30))
    y = 2 * x[:, 5] + 1.5 * x[:, 12] + 0.001 * r.normal(size=60)
    return x, y, spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(60)], "sample_id long, values array<double>, y double")


def test_savgol_matches_polynomials():
    x = np.arange(20.0)
    for deriv, want in ((1, 2 * x - 3), (2, np.full(20, 2.0))):
        assert arrays.savgol_matrix(20, 7, deriv=deriv) @ (x**2 - 3 * x + 1) == pytest.approx(want)
    with pytest.raises(ValueError):
        arrays.savgol_matrix(5, 7)


def test_flat_spectrum(spark):
    df = spark.createDataFrame([([2.0, 2.0, 2.0],)], "v array<double>")
    assert df.select(arrays.snv(F.col("v")).alias("v")).first()["v"] == [0.0, 0.0, 0.0]


def test_pls_is_exact_with_all_components(made):
    x, y, _ = made
    full = linalg.Pls(30).fit(x, y)
    a = np.column_stack([np.ones(60), x])
    assert full.predict(x) == pytest.approx(a @ np.linalg.lstsq(a, y, rcond=None)[0], abs=1e-6)
    top = linalg.Pls(4).fit(x, y).vip()
    assert set(np.argsort(-top)[:2]) == {5, 12}


def test_models_shrink(made):
    x, y, _ = made
    lasso = linalg.ElasticNet(1e-4, 1.0).fit(x, y).coef
    assert set(np.flatnonzero(np.abs(lasso) > 0.5)) == {5, 12}
    assert np.abs(linalg.Ridge(1e6).fit(x, y).coef).max() < 1e-3


def test_distributions():
    assert linalg.f_quantile(0.95, 5, 30) == pytest.approx(2.5336, abs=1e-3)
    assert linalg.t_quantile(0.975, 10) == pytest.approx(2.2281, abs=1e-3)


def test_selection_kernels(made):
    x, _, _ = made
    order = linalg.kennard_stone(x, 10)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert set(order[:2]) == set(map(int, np.unravel_index(d.argmax(), d.shape))) and len(set(order)) == 10
    assert len(set(linalg.spa(x, 8))) == 8
    assert linalg.find_peaks(np.array([0, 1, 0, 3, 2, 2.5, 0]), 0.6) == [1, 3]
    flat = linalg.baseline_als(np.linspace(0, 5, 50) + np.exp(-((np.arange(50) - 25) ** 2) / 4) * 10, 1e4)
    assert flat.argmax() == 25 and abs(flat[:10]).max() < 0.5


def test_search_finds_the_signal(made):
    _, _, df = made
    best = search.searched(df, "y", models=("PLS",), preprocessing=("raw",), max_components=8).orderBy(F.desc("r2")).first()
    assert best["r2"] > 0.95 and best["pooled_r2"] > 0.95


def test_pca_and_leverage(made):
    x, _, df = made
    e = x - x.mean(0)
    u, s, vt = np.linalg.svd(e, full_matrices=False)
    got = {r["sample_id"]: r for r in multivariate.pca_outliers(df, 3).collect()}
    t2 = (u[:, :3] ** 2).sum(1) * 59
    q = ((e - u[:, :3] * s[:3] @ vt[:3]) ** 2).sum(1)
    assert [got[i]["t2"] for i in range(60)] == pytest.approx(t2) and [got[i]["q"] for i in range(60)] == pytest.approx(q)
    a = np.column_stack([np.ones(60), x])
    hat = np.diag(a @ np.linalg.pinv(a))
    assert [r["leverage"] for r in multivariate.leverage(df).orderBy("sample_id").collect()] == pytest.approx(hat, abs=1e-5)


def test_transfer_recovers_an_affine_slave(spark, made):
    x, _, df = made
    slave = df.select("sample_id", F.transform("values", lambda v: 0.9 * v + 0.1).alias("values"))
    tsr = transfer.fit_tsr(spectra.long(df), spectra.long(slave))
    back = transfer.apply_tsr(slave, tsr).orderBy("sample_id").collect()
    assert np.array([r["values"] for r in back]) == pytest.approx(x, abs=1e-6)
    m, t = transfer.fit_ctai(df, slave, 30, 1.0)
    assert np.array([r["values"] for r in slave.orderBy("sample_id").collect()]) @ m + t == pytest.approx(x, abs=1e-4)
    pds = transfer.fit_pds(df, slave, 30, 5)
    assert np.abs(np.array([r["values"] for r in transfer.apply_matrix(slave, pds).orderBy("sample_id").collect()]) - x).mean() < 0.02


def test_smote_evens_classes(made):
    _, _, df = made
    both = df.withColumn("label", (F.col("sample_id") % 4 == 0).cast("int"))
    n = {r["label"]: r["count"] for r in multivariate.smote(both, "label").groupBy("label").count().collect()}
    assert n == {0: 45, 1: 45}
    assert balance.class_imbalance(both, "label").first()["severity"] == "moderate"


def test_files(spark, tmp_path, made):
    axis = [400.0 + k for k in range(120)]
    v = [math.sin(k) for k in range(120)]
    (tmp_path / "wide.csv").write_text("id," + ",".join(map(str, axis)) + ",y\n" + "".join(f"s{i}," + ",".join(str(x + i) for x in v) + f",{i}\n" for i in range(3)) + "s9," + ",".join(["x"] * 120) + ",1\n")
    wide, found = spectral_files.read_wide_csv(spark, f"{tmp_path}/wide.csv")
    assert found == axis and wide.count() == 4
    both, _ = spectral_files.read_combined_csv(spark, f"{tmp_path}/wide.csv", "y")
    assert sorted(r["sample_id"] for r in both.collect()) == ["s0", "s1", "s2"]
    (tmp_path / "a.asc").write_text("# head\n" + "".join(f"{w}\t{x}\n" for w, x in zip(axis, v)))
    (tmp_path / "b.jdx").write_text(spectral_files.jcamp_text("b", axis, v))
    for name, kind in (("a.asc", "ascii"), ("b.jdx", "jcamp")):
        df, found = spectral_files.on_common_axis(spectral_files.read_text_spectra(spark, f"{tmp_path}/{name}", kind))
        row = df.first()
        assert row["sample_id"] == name[0] and found == axis and row["values"] == pytest.approx(v)
    title = "##TITLE=t\n##FIRSTX=1\n##LASTX=4\n##YFACTOR=2\n##XYDATA=(X++(Y..Y))\n1 5 6\n3 7 8\n##END=\n"
    assert spectral_files.jcamp_of(title) == ([1, 2, 3, 4], [10, 12, 14, 16], "t")
    assert [spectral_files.detect_format(p) for p in ("a.CSV", "b.0", "c.jdx", "d.zzz")] == ["csv", "opus", "jcamp", "unknown"]
    with pytest.raises(ValueError):
        spectral_files.strictly_rising([1.0, 1.0], 2)


def test_model_round_trip(spark, tmp_path, made):
    x, y, _ = made
    fitted = linalg.Pls(3).fit(x, y)
    models.save_linear(spark, fitted, f"{tmp_path}/m", list(range(30)), target="y")
    back, axis, meta = models.load_linear(spark, f"{tmp_path}/m")
    assert back.predict(x) == pytest.approx(fitted.predict(x), abs=1e-12) and len(axis) == 30 and meta["target"] == "y"


def test_stream_equals_batch(spark, tmp_path, made):
    _, _, df = made
    df.select("sample_id", "values").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("sample_id long, values array<double>").parquet(f"{tmp_path}/in")
    got = streams.run_available(streams.transformed(stream, arrays.snv), f"{tmp_path}/out", f"{tmp_path}/ck")
    want = streams.transformed(df.select("sample_id", "values"), arrays.snv)
    assert sorted(map(tuple, ((r["sample_id"], tuple(r["values"])) for r in got.collect()))) == sorted((r["sample_id"], tuple(r["values"])) for r in want.collect())


def test_specs():
    assert specs.parse_range("5, 1-9 step 4, 5", "n", int) == [1, 5, 9]
    assert specs.parse_range("None, 9-1 step 4", "n", int, allow_none=True) == [None, 1, 5, 9]
    assert specs.parse_range("-1--0.5 step 0.25", "a") == [-1.0, -0.75, -0.5]
    assert specs.parse_range("b, a, b", "s", str) == ["b", "a"] and specs.parse_range(" ", "n") == []
    for bad in ("1-5 step 0", "1-5", "1-5 step x", "1.5"):
        with pytest.raises(ValueError, match="n:"):
            specs.parse_range(bad, "n", int)
    assert specs.parse_wavelengths("2-3, 5", [1.0, 2.0, 2.5, 3.0, 5.0]) == [2.0, 2.5, 3.0, 5.0]
    assert specs.is_regression([1, 2, 3.5]) and not specs.is_regression([1, 2, 3]) and not specs.is_regression(["a"])
