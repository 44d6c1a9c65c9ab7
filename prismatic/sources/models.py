"""Saved models: JSON for what describes them and Parquet for their numbers; no pickles.

A fitted model of any kind here is a tree of numbers, texts, arrays, lists and further models. Arrays go to Parquet by name; the rest, with the arrays' names in their places,
to JSON. Loading makes the known classes alone.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession

from prismatic.functions import boosting, learners, linalg
from prismatic.functions.linalg import Ridge

KNOWN = {c.__name__: c for c in (linalg.Pls, linalg.Ridge, linalg.ElasticNet, boosting.Net, boosting.NeuralBoosted, learners.Tree, learners.ShareTree, learners.Forest, learners.ShareForest, learners.GradientBoosted, learners.KernelRegression, learners.Perceptron, learners.Logistic, learners.PlsDa, learners.OneVsRest, learners.BoostedNetworks)}
#: What a fitted model doesn't need.
LEFT_OUT = {"rng", "make"}


def taken_apart(value, arrays: list[np.ndarray]):
    """value in terms of JSON; arrays take the numbers."""
    if isinstance(value, np.ndarray):
        if value.dtype.kind in "US":
            return {"texts": value.tolist()}
        arrays.append(value)
        return {"array": len(arrays) - 1}
    if type(value).__name__ in KNOWN:
        return {"class": type(value).__name__, "state": {k: taken_apart(v, arrays) for k, v in vars(value).items() if k not in LEFT_OUT}}
    if isinstance(value, dict):
        return {"dict": [[taken_apart(k, arrays), taken_apart(v, arrays)] for k, v in value.items()]}
    if isinstance(value, (list, tuple)):
        return {"list" if isinstance(value, list) else "tuple": [taken_apart(v, arrays) for v in value]}
    if isinstance(value, np.generic):
        return value.item()
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    raise TypeError(f"can't save a {type(value).__name__}")


def put_together(value, arrays: dict[int, np.ndarray]):
    if not isinstance(value, dict):
        return value
    kind, inner = next(iter(value.items()))
    if kind == "array":
        return arrays[inner]
    if kind == "texts":
        return np.array(inner)
    if kind == "class":
        out = KNOWN[inner].__new__(KNOWN[inner])
        vars(out).update({k: put_together(v, arrays) for k, v in value["state"].items()})
        return out
    if kind == "dict":
        return {put_together(k, arrays): put_together(v, arrays) for k, v in inner}
    made = [put_together(v, arrays) for v in inner]
    return made if kind == "list" else tuple(made)


def save_model(spark: SparkSession, model, path: str, axis: list[float], **about) -> None:
    """model, the wavelengths it takes, and about: any of preprocess, window, deriv, label order, residuals of cross-validation, domain (as report.domain() gives it)."""
    arrays: list[np.ndarray] = []
    meta = {"model": taken_apart(model, arrays), "axis": list(map(float, axis)), "about": taken_apart(about, arrays), "kind": type(model).__name__}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    rows = [(k, a.dtype.str, list(a.shape), a.astype(float).ravel().tolist()) for k, a in enumerate(arrays)]
    spark.createDataFrame(rows, "id int, dtype string, shape array<int>, numbers array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/arrays")


def load_model(spark: SparkSession, path: str) -> tuple[object, list[float], dict]:
    """The model, its axis and what else was said of it."""
    meta = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    arrays = {r["id"]: np.array(r["numbers"], dtype=float).reshape(r["shape"]).astype(np.dtype(r["dtype"])) for r in spark.read.parquet(f"{path}/arrays").collect()}
    return put_together(meta["model"], arrays), meta["axis"], put_together(meta["about"], arrays)


def matched_channels(axis: list[float], wanted: list[float], tolerance: float = 0.01) -> list[int]:
    """The place on axis of each wanted wavelength: the nearest, within tolerance."""
    a = np.asarray(axis, dtype=float)
    at = [int(np.argmin(np.abs(a - w))) if len(a) else -1 for w in wanted]
    if missing := [w for w, k in zip(wanted, at) if k < 0 or abs(a[k] - w) > tolerance]:
        raise ValueError(f"{len(missing)} wavelengths are missing, the first {missing[0]}")
    return at


def save_linear(spark: SparkSession, model, path: str, axis: list[float], **about) -> None:
    meta = about | {"kind": "linear", "y_mean": float(model.y_mean)}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    rows = [(k, float(w), float(m), float(c)) for k, (w, m, c) in enumerate(zip(axis, model.x_mean, model.coef))]
    spark.createDataFrame(rows, "ch int, wl double, x_mean double, coef double").coalesce(1).write.mode("overwrite").parquet(f"{path}/coefficients")


def model_info(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/metadata").first()["value"])


def load_linear(spark: SparkSession, path: str) -> tuple[Ridge, list[float], dict]:
    rows = spark.read.parquet(f"{path}/coefficients").orderBy("ch").collect()
    out, meta = Ridge(0.0), model_info(spark, path)
    out.x_mean, out.coef, out.y_mean = np.array([r["x_mean"] for r in rows]), np.array([r["coef"] for r in rows]), meta["y_mean"]
    return out, [r["wl"] for r in rows], meta
