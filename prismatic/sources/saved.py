"""Saved ensembles and instrument profiles: JSON for what describes them, Parquet for their numbers; no pickles."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismatic.operators.ensemble import KINDS, combined
from prismatic.sources.models import load_model, model_info, save_model


def save_ensemble(spark: SparkSession, models: dict, path: str, axis: list[float], ensemble: dict, **about) -> None:
    """Models of any kind by name, and what ensemble.created() made of their predictions."""
    if ensemble["kind"] not in KINDS:
        raise ValueError(f"unknown ensemble {ensemble['kind']}")
    for name, model in models.items():
        save_model(spark, model, f"{path}/models/{name}", axis, name=name)
    meta = {k: v for k, v in ensemble.items() if k != "errors"} | {"models": sorted(models)} | about
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    if "errors" in ensemble:
        ensemble["errors"].select("model", "region", "rmse").coalesce(1).write.mode("overwrite").parquet(f"{path}/errors")


def load_ensemble(spark: SparkSession, path: str) -> dict:
    meta = model_info(spark, path)
    loaded = meta | {"models": {n: load_model(spark, f"{path}/models/{n}")[0] for n in meta["models"]}}
    return loaded if "stacking" in meta["kind"] else loaded | {"errors": spark.read.parquet(f"{path}/errors")}


def predicted(spectra: DataFrame, ensemble: dict) -> DataFrame:
    """id (sample_id) and pred of a loaded ensemble."""
    from prismatic.operators import search

    preds = None
    for name, model in sorted(ensemble["models"].items()):
        part = search.predicted(spectra, model).select(F.col("sample_id").alias("id"), F.lit(name).alias("model"), "pred")
        preds = part if preds is None else preds.unionByName(part)
    return combined(preds, ensemble)


def save_profiles(profiles: DataFrame, path: str) -> None:
    """One row for each instrument."""
    profiles.coalesce(1).write.mode("overwrite").json(path)


def load_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
