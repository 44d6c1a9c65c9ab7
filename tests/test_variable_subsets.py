"""search_variable_subsets over odd tables, against its SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from prismatic.plans.catalog import QUERIES, SQL

N = 150


def rows():
    x = np.random.default_rng(4).normal(size=(N, 64)).round(3)
    return [[k - 40, v.tolist(), int((3 * v[10] - v[40]).round())] for k, v in enumerate(x)]


def results(spark, folder, table, where="true"):
    """The query's over the table, and the SQL's over those of its rows."""
    columns = [pa.array(c, t) for c, t in zip(zip(*table) if table else ([], [], []), (pa.int64(), pa.list_(pa.float32()), pa.int32()))]
    pq.write_table(pa.table(columns, ["vec_id", "embedding", "label"]), folder / "embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS FROM '{folder}/embeddings.parquet' WHERE {where}")
    want = db.execute(SQL["search_variable_subsets"]).fetchall()
    return sorted(map(tuple, QUERIES["search_variable_subsets"](spark, str(folder)).collect())), sorted(want)


def test_negative_and_null_ids(spark, tmp_path):
    table = rows()
    table[7][0] = None
    got, want = results(spark, tmp_path, table)
    assert len(got) == 10 and got == want


def test_vectors_without_the_channels(spark, tmp_path):
    """Short, empty and null vectors, null channels and labels: as if the rows weren't there."""
    table = rows()
    table[3][1], table[20][1], table[21][1] = table[3][1][:30], [], None
    table[50][1][40], table[51][1][10], table[52][1][0], table[60][2] = None, None, None, None
    got, want = results(spark, tmp_path, table, "embedding[11] IS NOT NULL AND embedding[41] IS NOT NULL AND label IS NOT NULL")
    assert len(got) == 10 and got == want


def test_nan(spark, tmp_path):
    """No figures, rather than errors of 0."""
    table = rows()
    table[3][1][10] = float("nan")
    got, want = results(spark, tmp_path, table)
    assert len(got) == 10 and [r[:4] for r in got] == [r[:4] for r in want]
    assert np.array([r[4:] for r in got]) == pytest.approx(np.array([r[4:] for r in want]), nan_ok=True) and np.isnan(got[0][4])


def test_no_rows(spark, tmp_path):
    assert results(spark, tmp_path, []) == ([], [])
