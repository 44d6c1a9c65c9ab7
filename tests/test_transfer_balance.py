import numpy as np
import pytest

from prismatic.functions.linalg import Pls
from prismatic.operators import balance, resampling, search, transfer


def frames(spark, n=60, p=8):
    g = np.random.default_rng(1)
    m = g.normal(size=(n, 3)) @ g.normal(size=(3, p)) + 0.01 * g.normal(size=(n, p))
    s = 0.8 * m + 0.3
    make = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample_id long, values array<double>")
    y = spark.createDataFrame([(i, float(v[0] + v[1])) for i, v in enumerate(m)], "sample_id long, y double")
    return m, s, make(m), make(s), y


def values(df):
    return np.array([r["values"] for r in df.orderBy("sample_id").collect()])


def test_matrix_transfers(spark, tmp_path):
    m, s, master, slave, y = frames(spark)
    assert np.allclose(transfer.fit_ds(master, slave, 8, 1e-3), np.linalg.solve(s.T @ s + 1e-3 * np.eye(8), s.T @ m), atol=1e-6)
    fitted = transfer.fit_nspfce(master, slave, 8, normalize=False)
    assert fitted["rounds"] < 100
    assert np.abs(values(transfer.apply_transfer(slave, fitted)) - m).max() < 0.05
    some = transfer.fit_nspfce(master, slave, 8, [1, 4], normalize=False)
    moved = values(transfer.apply_transfer(slave, some))
    assert np.allclose(moved[:, [0, 2, 3, 5, 6, 7]], s[:, [0, 2, 3, 5, 6, 7]])
    transfer.save_transfer(spark, some, str(tmp_path / "t"))
    again = transfer.load_transfer(spark, str(tmp_path / "t"))
    assert again["method"] == "ns-pfce" and np.allclose(values(transfer.apply_transfer(slave, again)), moved)


def test_jypls(spark):
    m, s, master, slave, y = frames(spark)
    fitted = transfer.fit_jypls(master, slave, y, "y", folds=4, most=4)
    assert fitted["matrix"].shape == (8, 8) and 1 <= fitted["n_components"] <= 4
    # with one instrument twice, scores map to themselves: weights times loadings are left
    same = transfer.fit_jypls(master, master, y, "y", components=3)
    pls = Pls(3).fit(np.concatenate([m, m]), np.tile(m[:, 0] + m[:, 1], 2))
    assert np.allclose(same["matrix"], pls.w @ pls.p.T, atol=1e-5)
    with pytest.raises(ValueError):
        transfer.fit_jypls(master.limit(1), slave, y, "y")


def classes(spark, sizes=(40, 12)):
    g = np.random.default_rng(2)
    x = [(g.normal(size=3) + 1.5 * c, c) for c, n in enumerate(sizes) for _ in range(n)]
    return spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(x)], "sample_id long, values array<double>, label int")


@pytest.mark.parametrize("method", resampling.METHODS)
def test_resampling(spark, method):
    df = classes(spark)
    out = resampling.resampled(df, "label", method).toPandas()
    n = out.groupby("label").size().to_dict()
    assert not out["sample_id"].duplicated().any()
    if method in ("smote", "borderline_smote"):
        assert n == {0: 40, 1: 40}
    elif method == "adasyn":
        assert n[0] == 40 and abs(n[1] - 40) <= 6
    elif method == "random_undersampler":
        assert n == {0: 12, 1: 12}
    elif method == "tomek_links":
        assert n[1] == 12 and n[0] == 40 - balance.tomek_links(df, "label").count()
    else:
        assert set(n) == {0, 1} and (out["sample_id"] < 0).any()
    new = np.stack(out.loc[out["sample_id"] < 0, "values"]) if (out["sample_id"] < 0).any() else np.zeros((0, 3))
    own = np.stack(df.where("label = 1").toPandas()["values"])
    assert (new >= own.min(0) - 1e-12).all() and (new <= own.max(0) + 1e-12).all()


def test_resampling_edges(spark):
    small = classes(spark, (10, 3))
    assert resampling.resampled(small, "label", "smote").count() == 13
    assert resampling.resampled(small.limit(0), "label", "smote").count() == 0
    with pytest.raises(ValueError):
        resampling.resampled(small, "label", "other")
    assert resampling.recommended(classes(spark), "label") == ("class_weight", "smote")
    assert resampling.recommended(classes(spark, (30, 25)), "label") == (None, None)
    assert resampling.recommended(classes(spark, (300, 60)), "label") == ("smote", "adasyn")


def test_tomek_by_hand():
    x = np.array([[0.0], [1.0], [1.1], [5.0], [5.3], [9.0]])
    assert resampling.tomek(x, np.array([0, 0, 1, 1, 1, 0])).tolist() == [[1, 2]]


def test_search_of_classes_and_further_models(spark):
    df = classes(spark, (30, 30))
    found = {r["model"]: r for r in search.searched_classes(df, "label", ("PLS-DA", "RandomForest", "SVM"), ("raw",), folds=3, max_components=2).collect()}
    assert set(found) == {"PLS-DA", "RandomForest", "SVM"} and all(r["auc"] > 0.85 and r["accuracy"] > 0.75 for r in found.values())
    g = np.random.default_rng(4)
    x = g.normal(size=(60, 6))
    reg = spark.createDataFrame([(i, v.tolist(), float(2 * v[0] - v[3])) for i, v in enumerate(x)], "sample_id long, values array<double>, y double")
    best = search.searched(reg, "y", ("RandomForest", "BoostedTrees", "SVR", "MLP"), ("raw",), folds=3).groupBy("model").agg({"pooled_r2": "max"}).collect()
    assert {r[0] for r in best} == {"RandomForest", "BoostedTrees", "SVR", "MLP"} and all(r[1] > 0.5 for r in best)
