"""Calibration transfer between instruments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismatic.operators.spectra import channels


def fit_tsr(master: DataFrame, slave: DataFrame) -> DataFrame:
    """ch, slope, intercept and r2 of master on slave, over long rows of samples that both measured."""
    both = slave.select("sample_id", "ch", F.col("value").alias("s")).join(master.select("sample_id", "ch", F.col("value").alias("m")), ["sample_id", "ch"])
    g = both.groupBy("ch").agg(F.covar_pop("m", "s").alias("c"), F.var_pop("s").alias("vs"), F.var_pop("m").alias("vm"), F.avg("m").alias("mm"), F.avg("s").alias("ms"))
    slope = F.when(F.col("vs") > 1e-10, F.try_divide("c", "vs")).otherwise(1.0)
    return g.select("ch", slope.alias("slope"), (F.col("mm") - slope * F.col("ms")).alias("intercept"), F.coalesce(F.try_divide(F.col("c") * F.col("c"), F.col("vs") * F.col("vm")), F.lit(0.0)).alias("r2"))


def apply_tsr(spectra: DataFrame, fitted: DataFrame) -> DataFrame:
    """Each channel by its own line: as many rows as channels come to the driver."""
    rows = sorted(fitted.collect(), key=lambda r: r["ch"])
    lines = F.array(*[F.struct(F.lit(r["slope"]).alias("a"), F.lit(r["intercept"]).alias("b")) for r in rows])
    return spectra.withColumn("values", F.zip_with("values", lines, lambda x, k: x * k["a"] + k["b"]))


#: Cores for each task of the second level of a sum.
FAN_IN = 64


def added_up(rows: DataFrame, size: int, add) -> np.ndarray:
    """The sum of blocks of `size` doubles: each task adds its rows to one by add(block, rows as pandas), and the tasks of a second level add blocks up, so that blocks,
    not cells, are shuffled and few reach the driver."""

    def part(batches):
        g, found = np.zeros(size), False
        for b in batches:
            if len(b):
                found = True
                add(g, b)
        if found:
            yield pd.DataFrame({"g": [g.tobytes()]})

    def added(batches):
        g, found = np.zeros(size), False
        for b in batches:
            for one in b["g"]:
                g, found = g + np.frombuffer(one), True
        if found:
            yield pd.DataFrame({"g": [g.tobytes()]})

    n = max(1, rows.sparkSession.sparkContext.defaultParallelism // FAN_IN)
    blocks = rows.mapInPandas(part, "g binary").repartition(n).mapInPandas(added, "g binary").collect()  # n blocks at most
    return sum((np.frombuffer(bytes(r["g"])) for r in blocks), np.zeros(size))


def summed(pairs: DataFrame, size: int, wide: int) -> np.ndarray:
    """The sum of a' b over rows (a of size, b of wide)."""

    def add(g, b):
        g += (np.stack(b["a"]).T @ np.stack(b["b"])).ravel()

    return added_up(pairs.select("a", "b"), size * wide, add).reshape(size, wide)


def own_gram(spectra: DataFrame, size: int) -> np.ndarray:
    """values' values over all rows, without a join."""
    return summed(spectra.select(F.col("values").alias("a"), F.col("values").alias("b")), size, size)


def shared_samples(master: DataFrame, slave: DataFrame) -> DataFrame:
    """sample_id, a (the slave's values) and b (the master's) of the samples that both measured."""
    return slave.select("sample_id", F.col("values").alias("a")).join(master.select("sample_id", F.col("values").alias("b")), "sample_id")


def moments(master: DataFrame, slave: DataFrame, size: int, wide: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """S'S and S'M over the shared samples, in one pass over one join. The slave's values have `size` numbers, the master's `wide`."""
    wide = wide or size
    both = shared_samples(master, slave)
    g = summed(both.select("a", F.concat("a", "b").alias("b")), size, size + wide)
    return g[:, :size], g[:, size:]


def fit_ds(master: DataFrame, slave: DataFrame, size: int, ridge: float = 0.0) -> np.ndarray:
    """Direct standardization: (S'S + ridge I)^-1 S'M."""
    ss, sm = moments(master, slave, size)
    return np.linalg.pinv(ss + ridge * np.eye(size)) @ sm


def apply_matrix(spectra: DataFrame, matrix: np.ndarray) -> DataFrame:
    m = spectra.sparkSession.sparkContext.broadcast(matrix)

    @F.pandas_udf("array<double>")
    def times(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(v) @ m.value)) if len(v) else v

    return spectra.withColumn("values", times("values"))


def fit_pds(master: DataFrame, slave: DataFrame, size: int, window: int = 11) -> np.ndarray:
    """Piecewise direct standardization as a banded matrix: each master channel from the slave's channels around it, without intercept."""
    (ss, sm), half = moments(master, slave, size), window // 2
    out = np.zeros((size, size))
    for j in range(size):
        near = slice(max(0, j - half), min(size, j + half + 1))
        out[near, j] = np.linalg.pinv(ss[near, near]) @ sm[near, j]
    return out


def fit_ctai(master: DataFrame, slave: DataFrame, size: int, share: float = 0.99) -> tuple[np.ndarray, np.ndarray]:
    """Matrix and offset of an affine map in the slave's principal directions that hold `share` of its variance."""
    one = lambda d: d.select("sample_id", F.concat(F.array(F.lit(1.0)), "values").alias("values"))
    ss, sm = moments(one(master), one(slave), size + 1)
    n, ms, mm = ss[0, 0], ss[0, 1:] / ss[0, 0], sm[0, 1:] / ss[0, 0]
    c, x = ss[1:, 1:] - n * np.outer(ms, ms), sm[1:, 1:] - n * np.outer(ms, mm)
    values, v = np.linalg.eigh(c)
    values, v = values[::-1], v[:, ::-1]
    k = int(np.searchsorted(np.cumsum(values) / values.sum(), share)) + 1
    v = v[:, :k]
    m = v @ np.linalg.pinv(v.T @ c @ v) @ (v.T @ x)
    return m, mm - ms @ m


def fit_nspfce(master: DataFrame, slave: DataFrame, size: int, chosen: list[int] | None = None, rounds: int = 100, tol: float = 1e-6, ridge: float = 1e-6, normalize: bool = True) -> dict:
    """matrix and offset of the damped iteration from scaled channels towards the ridge solution, on the chosen channels (all if None); rounds used.

    All it needs are moments, so rows are read once: the mean squared error that stops it is taken over all shared samples.
    """
    one = lambda d: d.select("sample_id", F.concat(F.array(F.lit(1.0)), "values").alias("values"))
    squares = master.select("sample_id", F.concat(F.array(F.lit(1.0)), "values", F.transform("values", lambda v: v * v)).alias("values"))
    ss, sm = moments(squares, one(slave), size + 1, 2 * size + 1)
    n, at = ss[0, 0], np.arange(size) if chosen is None else np.array(chosen, dtype=int)
    ms, m_mean, m2 = ss[0, 1:][at] / n, sm[0, 1:][at] / n, sm[0, size + 1 :][at]
    ss, sm = ss[1:, 1:][np.ix_(at, at)], sm[1:, 1:][np.ix_(at, at)]
    sd = lambda second, mean: np.sqrt(np.maximum(second / n - mean**2, 0)) + 1e-10
    scale = sd(m2, m_mean) / sd(np.diag(ss), ms)
    t, offset, used = np.diag(scale), m_mean - ms * scale, rounds
    goal, before = np.linalg.solve(ss + ridge * np.eye(len(at)), sm), None
    for k in range(rounds):
        # mean over cells of (m - s t - o)^2, from moments
        error = (m2 - 2 * (t * sm).sum(0) + ((ss @ t) * t).sum(0)).sum() + n * (offset @ offset - 2 * offset @ (m_mean - ms @ t))
        error /= n * len(at)
        if before is not None and abs(error - before) < tol:
            used = k
            break
        before, t = error, 0.5 * goal + 0.5 * t
        offset = m_mean - ms @ t
        if normalize and k % 10 == 0 and (mean := np.diag(t).mean()) > 0:
            t, offset = t / mean, offset * mean
    return {"method": "ns-pfce", "matrix": t, "offset": offset, "channels": at, "rounds": used}


def fit_jypls(master: DataFrame, slave: DataFrame, reference: DataFrame, y: str, components: int | None = None, folds: int = 5, most: int = 20) -> dict:
    """Joint-Y PLS: both instruments' spectra of the transfer samples against the same y; the slave's scores are mapped to the master's and back to channels."""
    from prismatic.operators.diagnostics import ranked
    from prismatic.operators.moments import fitted_pls, of_rows, total

    both = shared_samples(master, slave).join(reference.select("sample_id", F.col(y).cast("double").alias("y")), "sample_id")
    n, size = both.count(), channels(master)
    if n < 2:
        raise ValueError("takes 2 transfer samples at least")
    # folds are runs of the master's rows and then the slave's, in order of sample_id: each begins at some place of one instrument
    begins = np.cumsum([0, *map(len, np.array_split(np.empty(2 * n, dtype=bool), min(folds, n)))])[:-1].tolist() if components is None else [0]
    at = {r["place"] - 1: r["sample_id"] for r in ranked(both.select("sample_id"), "sample_id").where(F.col("place").isin([b % n + 1 for b in begins])).collect()}
    fold = lambda slave: sum((((F.col("sample_id") >= F.lit(at[b % n])) if (b >= n) == slave else F.lit(slave)).cast("int") for b in begins[1:]), F.lit(0))
    stacked = both.select(F.col("b").alias("values"), "y", fold(False).alias("cell")).unionByName(both.select(F.col("a").alias("values"), "y", fold(True).alias("cell")))
    parts = of_rows(stacked, len(begins), size)
    every, limit = total(parts), min(most, n - 1, size)
    if components is None:
        rmse = [np.mean([np.sqrt(one.errors(fitted_pls(every - one, k)) / one.n) for one in parts]) for k in range(1, limit + 1)]
        components = 1 + int(np.argmin(rmse))
    fitted = fitted_pls(every, min(components, n - 1, size))
    rotation = fitted.w @ np.linalg.pinv(fitted.p.T @ fitted.w)
    ss, sm = summed_scores(both, fitted.x_mean, rotation)
    turn = np.linalg.solve(ss + 1e-6 * np.eye(len(ss)), sm)
    return {"method": "jypls-inv", "matrix": fitted.w @ turn @ fitted.p.T, "n_components": len(ss)}


def summed_scores(both: DataFrame, mean: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """T'T and T'M of the slave's (a) and the master's (b) scores."""
    k = rotation.shape[1]

    def add(g, b):
        s, m = (np.stack(b["a"]) - mean) @ rotation, (np.stack(b["b"]) - mean) @ rotation
        g += (s.T @ np.hstack([s, m])).ravel()

    g = added_up(both.select("a", "b"), 2 * k * k, add).reshape(k, 2 * k)
    return g[:, :k], g[:, k:]


def apply_transfer(spectra: DataFrame, fitted: dict) -> DataFrame:
    """By method: ds, pds, ctai, jypls-inv and ns-pfce are a matrix, with an offset where there is one; channels that weren't chosen stay as they are."""
    model = spectra.sparkSession.sparkContext.broadcast((np.asarray(fitted["matrix"]), np.asarray(fitted.get("offset", 0.0)), fitted.get("channels")))

    @F.pandas_udf("array<double>")
    def moved(v: pd.Series) -> pd.Series:
        if not len(v):
            return v
        x, (matrix, offset, at) = np.stack(v), model.value
        at = slice(None) if at is None else at
        x[:, at] = x[:, at] @ matrix + offset
        return pd.Series(list(x))

    return spectra.withColumn("values", moved("values"))


def save_transfer(spark, fitted: dict, path: str) -> None:
    """Arrays as Parquet rows (name, place, values), the rest as JSON."""
    import json

    arrays = {k: np.atleast_2d(np.asarray(v, dtype=float)) for k, v in fitted.items() if isinstance(v, (np.ndarray, list))}
    meta = {k: v for k, v in fitted.items() if k not in arrays} | {"vectors": [k for k in arrays if np.ndim(fitted[k]) == 1]}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    rows = [(k, i, row.tolist()) for k, a in arrays.items() for i, row in enumerate(a)]
    spark.createDataFrame(rows, "name string, place int, row array<double>").write.mode("overwrite").parquet(f"{path}/arrays")


def load_transfer(spark, path: str) -> dict:
    import json

    out = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    vectors = out.pop("vectors")
    rows = spark.read.parquet(f"{path}/arrays").orderBy("name", "place").collect()
    for name in sorted({r["name"] for r in rows}):
        a = np.array([r["row"] for r in rows if r["name"] == name])
        out[name] = a[0] if name in vectors else a
    if "channels" in out:
        out["channels"] = out["channels"].astype(int)
    return out
