"""Searches whose executors have no copy of the package: what they need travels with the job."""

import json
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pandas as pd

REPO = str(Path(__file__).resolve().parents[1])
RUN = """
import json, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
sys.path.insert(0, sys.argv[1])
import __spark_entry__
print(json.dumps([r.asDict() for r in __spark_entry__.queries()[sys.argv[2]](spark, sys.argv[3]).collect()]))
"""


def rows_of(query, folder):
    """Of a driver of its own, which alone has the repository on its path."""
    g = np.random.default_rng(4)
    x = g.normal(size=(150, 64)).astype(np.float32)
    pd.DataFrame({"vec_id": np.arange(150), "embedding": list(x), "label": (3 * x[:, 10] + 5).round().astype(np.int32)}).to_parquet(folder / "embeddings.parquet")
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")} | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", RUN, REPO, query, str(folder)], cwd=folder, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return json.loads(done.stdout.splitlines()[-1])


def test_subsets(tmp_path):
    found = {r["subset"] for r in rows_of("search_subsets", tmp_path)}
    assert {"full", "top10", "top5regions"} <= found and any(s.startswith("region_") for s in found)


def test_variable_subsets(tmp_path):
    """Against the SQL."""
    import duckdb

    from prismatic.plans.catalog import SQL

    got = rows_of("search_variable_subsets", tmp_path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet'")
    want = db.execute(SQL["search_variable_subsets"]).fetchall()
    assert len(want) == 10 and sorted(tuple(r.values()) for r in got) == sorted(want)


def test_class_search(tmp_path):
    got = rows_of("class_search", tmp_path)
    assert len(got) == 16 and {r["model"] for r in got} == {"PLS-DA", "RandomForest"} and all(0 <= r["accuracy"] <= 1 for r in got)
