"""Search over preprocessing x model x parameters x channels, scored by cross-validation: one task for each configuration, subset of channels and fold. Tasks hold sums over
the samples where these fit the model (PLS and ridge, without steps that learn), and else all samples."""

from __future__ import annotations

import itertools
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from prismatic import ByValue
from prismatic.functions.learners import auc, classifier
from prismatic.functions.linalg import model
from prismatic.functions.registry import grid, has_importances, importances, own_name, takes_subsets
from prismatic.functions.steps import Chain
from prismatic.operators import classes, moments
from prismatic.operators.resampling import grown
from prismatic.operators.screening import REGION_SIZE, REGION_STEP, subsets
from prismatic.operators.spectra import channels

# Numbers of channels that subsets by importance have, and channels named for a configuration.
COUNTS, NAMED = (10, 20, 50, 100, 250, 500, 1000), 30
#: channels: null for full spectra.
RESULTS = "config int, model string, params string, preprocess string, deriv int, window int, subset string, channels array<int>"


def prepared(x: np.ndarray, how: str, window: int, order: int = 1) -> np.ndarray:
    """raw, snv, deriv, snv_deriv or deriv_snv, along each row."""
    return Chain(how, order, window).apply(x)


def treatments(preprocessing, windows, orders) -> list[tuple[str, int, int]]:
    """(name, order of the derivative, window); those without a derivative have 0 and 0."""
    return [t for how in preprocessing for t in ([(how, d, w) for d in orders for w in windows] if "deriv" in how else [(how, 0, 0)])]


def configurations(models, preprocessing, windows, max_components: int, orders=(1,)) -> list[dict]:
    out = []
    for name in models:
        values = grid(name, max_components)
        for one in itertools.product(*values.values()):
            params = json.dumps(dict(zip(values, one)))
            out += [{"model": name, "params": params, "preprocess": how, "deriv": d, "window": w} for how, d, w in treatments(preprocessing, windows, orders)]
    return out


def region_channels(x: np.ndarray, y: np.ndarray, axis: np.ndarray, n: int, size: float, step: float) -> dict[str, list[int]]:
    """Channels of subsets() for the n windows [start, start + size) of the axis with the largest mean |r|."""
    e, t = x - x.mean(0), y - y.mean()
    norm = np.sqrt((e**2).sum(0) * (t @ t))
    return best_regions(np.abs(np.divide(e.T @ t, norm, out=np.full(len(axis), np.nan), where=norm > 0)), axis, n, size, step)


def best_regions(r: np.ndarray, axis: np.ndarray, n: int, size: float, step: float) -> dict[str, list[int]]:
    """The same from |r| of each channel."""
    found = []
    for start in np.arange(axis.min(), axis.max(), step):
        inside = np.flatnonzero((axis >= start) & (axis < start + size) & ~np.isnan(r))
        if len(inside):
            found.append({"start": float(start), "end": float(start + size), "channels": inside.tolist(), "mean": float(r[inside].mean())})
    return subsets(sorted(found, key=lambda f: -f["mean"])[:n], n)


def named(r, fitted, axis: np.ndarray) -> dict:
    """n_vars, top_vars and all_vars of a model of all samples."""
    top = most_important(importances(fitted), axis) if has_importances(r.model) else []
    return {"n_vars": len(axis), "top_vars": ",".join(f"{w:.1f}" for w in top) or "N/A", "all_vars": ",".join(f"{w:.1f}" for w in axis) if r.channels is not None else "N/A"}


def most_important(weights: np.ndarray, axis: np.ndarray) -> np.ndarray:
    return axis[np.argsort(-weights, kind="stable")[:NAMED]]


class Data:
    """What each task holds: spectra, target, axis, folds; and what all configurations share."""

    def __init__(self, x, y, axis, folds: int, classes: bool, interference, balance):
        self.x, self.y, self.axis, self.folds, self.classes, self.interference, self.balance = x, y, axis, folds, classes, list(interference), balance
        self.fold = np.arange(len(y)) % folds
        self.codes = np.unique(y, return_inverse=True)[1].astype(float) if classes else y

    def chain(self, r) -> Chain:
        made = Chain(r.preprocess, r.deriv or 1, r.window, self.interference)
        self.after = np.asarray(made.axis(list(self.axis)))
        return made

    def fitted(self, r, z: np.ndarray, rows: np.ndarray):
        params, y = json.loads(r.params), self.y[rows]
        if self.balance:  # on the rows learned from alone
            more, of = grown(z, self.codes[rows].astype(np.int64), self.balance, 5, 42) if np.bincount(self.codes[rows].astype(np.int64)).min() > 5 else (z[:0], np.zeros(0, dtype=np.int64))
            z, y = np.concatenate([z, more]), np.concatenate([y, np.unique(self.y)[of]])
        return (classifier if self.classes else model)(own_name(r.model), params).fit(z, y)

    def subsets(self, r, counts, regions: int, size: float, step: float):
        """(name, channels after preprocessing) to try beside the full spectra. Importances and correlations are those of all samples."""
        every = np.ones(len(self.y), dtype=bool)
        z = self.chain(r).fit_apply(self.x, self.codes)
        out = []
        if counts and takes_subsets(r.model):
            order = np.argsort(-importances(self.fitted(r, z, every)), kind="stable")
            out += [(f"top{n}", np.sort(order[:n]).tolist()) for n in counts if n < z.shape[1]]
        if regions:
            out += list(region_channels(z, self.codes, self.after, regions, size, step).items())
        return out

    def score(self, r) -> dict:
        """Of one fold: its errors; of fold -1: the channels of a model of all samples."""
        test = self.fold == r.fold
        chain = self.chain(r)
        z = chain.fit_apply(self.x[~test], self.codes[~test])
        channels = np.asarray(r.channels, dtype=int) if r.channels is not None else np.arange(z.shape[1])
        axis = self.after[channels]
        fitted = self.fitted(r, z[:, channels], ~test)
        if r.fold < 0:
            return named(r, fitted, axis)
        if not test.any():
            return {}
        z, y = chain.apply(self.x[test])[:, channels], self.y[test]
        if self.classes:
            p = fitted.proba(z)
            areas = [a for k, c in enumerate(fitted.classes) if not np.isnan(a := auc((y == c).astype(int), p[:, k]))]
            return {"a": float((fitted.classes[p.argmax(1)] == y).mean()), "b": float(np.mean(areas)) if areas else None}
        e = y - fitted.predict(z)
        at = np.searchsorted(np.quantile(self.y, [0.25, 0.5, 0.75]), y, side="right")
        spread = ((y - y.mean()) ** 2).sum()
        return {"a": float(np.sqrt((e**2).mean())), "b": float(1 - (e**2).sum() / spread) if spread else None, "sse": float((e**2).sum()), "q_sse": np.bincount(at, e**2, 4).tolist(), "q_n": np.bincount(at, minlength=4).tolist()}


#: Models that moments fit, and quarters of y.
BY_MOMENTS, QUARTERS = ("PLS", "Ridge"), 4


class Sums:
    """What each task holds of any number of samples, for models that moments fit: by treatment, the moments of each fold and quarter of y. Rows whose fold is none of
    0 to folds - 1 are learned from alone."""

    def __init__(self, folds: int, parts: dict, axes: dict):
        self.folds, self.parts, self.axes = folds, parts, axes

    @classmethod
    def of(cls, rows: DataFrame, axis: np.ndarray, folds: int, treated: list[tuple[str, int, int]], interference) -> Sums:
        """rows: values, y, fold."""
        edges = rows.agg(F.percentile("y", F.array(*[F.lit(k / QUARTERS) for k in range(1, QUARTERS)])).alias("q")).first()["q"]
        quarter = sum(((F.col("y") >= F.lit(q)).cast("int") for q in edges), F.lit(0))
        cell = F.when(F.col("fold").between(0, folds - 1), F.col("fold")).otherwise(folds) * QUARTERS + quarter
        celled, parts, axes = rows.select("values", "y", cell.alias("cell")), {}, {}
        for how, deriv, window in treated:
            chain = Chain(how, deriv or 1, window, interference)
            axes[how, deriv, window] = np.asarray(chain.axis(list(axis)))
            width = len(axes[how, deriv, window])
            parts[how, deriv, window] = moments.of_rows(celled, (folds + 1) * QUARTERS, width, made=lambda b, chain=chain: chain.apply(np.stack(b["values"])))
        return cls(folds, parts, axes)

    def of_row(self, r):
        return self.parts[r.preprocess, r.deriv, r.window], self.axes[r.preprocess, r.deriv, r.window]

    def fitted(self, r, m: moments.Moments):
        params = json.loads(r.params)
        return moments.fitted_pls(m, int(params["n_components"])) if own_name(r.model) == "PLS" else moments.fitted_ridge(m, params["alpha"])

    def subsets(self, r, counts, regions: int, size: float, step: float):
        """As those of Data."""
        parts, axis = self.of_row(r)
        m, out = moments.total(parts), []
        if counts:
            order = np.argsort(-importances(self.fitted(r, m)), kind="stable")
            out += [(f"top{n}", np.sort(order[:n]).tolist()) for n in counts if n < len(axis)]
        if regions:
            s = m.scatter
            norm = np.sqrt(np.maximum(0, np.diag(s)[:-1] * s[-1, -1]))
            out += list(best_regions(np.abs(np.divide(s[:-1, -1], norm, out=np.full(len(axis), np.nan), where=norm > 0)), axis, regions, size, step).items())
        return out

    def score(self, r) -> dict:
        """As that of Data."""
        parts, axis = self.of_row(r)
        channels = np.asarray(r.channels, dtype=int) if r.channels is not None else np.arange(len(axis))
        parts = [m.take(channels) for m in parts]
        every, own = moments.total(parts), parts[r.fold * QUARTERS : (r.fold + 1) * QUARTERS] if r.fold >= 0 else []
        fitted = self.fitted(r, every - moments.total(own) if own else every)
        if r.fold < 0:
            return named(r, fitted, axis[channels])
        test, errors = moments.total(own), [m.errors(fitted) for m in own]
        if not test.n:
            return {}
        spread, e = test.scatter[-1, -1], sum(errors)
        return {"a": float(np.sqrt(e / test.n)), "b": float(1 - e / spread) if spread > 1e-12 * every.a[-1, -1] else None, "sse": e, "q_sse": errors, "q_n": [m.n for m in own]}


SCORES = "n_vars int, top_vars string, all_vars string, a double, b double, sse double, q_sse array<double>, q_n array<long>"


def spread_over(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(max(1, min(n, 4 * df.sparkSession.sparkContext.defaultParallelism)))


def ran(spark, data: Data | Sums, configs: list[tuple[int, dict]], counts, regions, region_size, region_step) -> DataFrame:
    """RESULTS with SCORES for each fold, and fold -1 for a model of all samples. configs: with their numbers."""
    held = spark.sparkContext.broadcast(ByValue(data))
    rows = [(k, *c.values(), "full", None) for k, c in configs]
    full = spark.createDataFrame(rows, RESULTS)

    def propose(batches):
        for batch in batches:
            out = [(*r, name, channels) for r in batch.itertuples(index=False) for name, channels in held.value.subsets(r, counts, regions, region_size, region_step)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULTS.split(", ")])

    def fit(batches):
        for batch in batches:
            out = [held.value.score(r) for r in batch.itertuples(index=False)]
            yield batch.assign(**{c: pd.Series([o.get(c) for o in out], dtype=object) for c in (s.split()[0] for s in SCORES.split(", "))})

    every = full
    if counts or regions:
        every = full.unionByName(spread_over(full.drop("subset", "channels"), len(rows)).mapInPandas(propose, RESULTS))
    # the number of configurations times folds is known but for the subsets' part
    grid_rows = every.withColumn("fold", F.explode(F.sequence(F.lit(-1), F.lit(data.folds - 1))))
    return spread_over(grid_rows, len(rows) * (data.folds + 1)).mapInPandas(fit, f"{RESULTS}, fold int, {SCORES}")


KEYS = ["config", "model", "params", "preprocess", "deriv", "window", "subset"]


def searched(samples: DataFrame, y: str, models=("PLS", "Ridge"), preprocessing=("raw", "snv", "deriv"), windows=(7, 19), folds: int = 5, max_components: int = 8, seed: int = 42, orders=(1,), counts=(), regions: int = 0, axis: list[float] | None = None, interference=(), region_size: float = REGION_SIZE, region_step: float = REGION_STEP, fold: str | None = None) -> DataFrame:
    """model, params, preprocess, deriv, window, subset, rmse and r2 (means over folds), pooled_r2, n_vars, full_vars, lvs, regional_rmse (by quarter of y), all_vars, top_vars.

    samples: sample_id, values, y. Fold of a sample: its place in an order by a hash of seed and id, modulo folds, or the column fold (0 to folds - 1). orders: of derivatives. counts: sizes of subsets by
    importance (COUNTS are the usual ones); regions: how many of the best regions to try. As importances and correlations are those of all samples, subsets
    look somewhat better than they are. interference: steps (functions/steps.py) fitted inside each fold.
    """
    own = [F.col(fold).cast("int").alias("fold")] if fold else []
    rows, n, width = moments.targeted(samples, y, *own), samples.count(), channels(samples)
    axis = np.arange(width, dtype=float) if axis is None else np.asarray(axis, dtype=float)
    configs = list(enumerate(configurations(models, preprocessing, windows, min(max_components, n // folds - 1, width), orders))) if n else []
    # what learns a step inside the folds, or is no linear model of all channels, takes the rows themselves
    summed = [(k, c) for k, c in configs if own_name(c["model"]) in BY_MOMENTS and not Chain("raw", interference=interference).learns]
    others = [c for c in configs if c not in summed]
    spark, some, total = samples.sparkSession, (counts, regions, region_size, region_step), 1.0
    each = None
    if summed:
        dealt = (rows if fold else moments.dealt(rows, folds, seed)).select("values", "y", "fold").persist(StorageLevel.DISK_ONLY)
        sums = Sums.of(dealt, axis, folds, treatments(preprocessing, windows, orders), interference)
        dealt.unpersist()
        total = float(moments.total(next(iter(sums.parts.values()))).scatter[-1, -1])
        each = ran(spark, sums, summed, *some)
    if others or not n:
        held = rows.orderBy(F.xxhash64(F.lit(seed), "sample_id"), "sample_id").toPandas()
        x, t = np.stack(held["values"]) if len(held) else np.zeros((0, 0)), held["y"].to_numpy(dtype=float)
        data = Data(x, t, axis, folds, False, interference, None)
        if fold:
            data.fold = held["fold"].to_numpy(dtype=int)
        total = float(((t - t.mean()) ** 2).sum()) if len(t) else 1.0
        more = ran(spark, data, others, *some)
        each = more if each is None else each.unionByName(more)
    quarter = [F.sqrt(F.try_divide(F.sum(F.col("q_sse")[k]), F.sum(F.col("q_n")[k]))) for k in range(4)]
    out = each.groupBy(*KEYS).agg(F.avg("a").alias("rmse"), F.avg("b").alias("r2"), (1 - F.sum("sse") / total).alias("pooled_r2"), F.max("n_vars").alias("n_vars"), F.array(*quarter).alias("regional_rmse"), F.max("all_vars").alias("all_vars"), F.max("top_vars").alias("top_vars"))
    return out.withColumns({"full_vars": F.lit(width), "lvs": F.get_json_object("params", "$.n_components").cast("int")})


#: Classifiers that need no samples in one place.
SPREAD = ("PLS-DA", "PLS", "RandomForest")


def of_any_number(samples: DataFrame, axis: np.ndarray, folds: int, seed: int, configs: list[tuple[int, dict]], interference, top: bool) -> DataFrame:
    """What ran() gives for full spectra, of SPREAD."""
    dealt, treated, found = classes.Dealt(samples, folds, seed), list(dict.fromkeys((c["preprocess"], c["deriv"], c["window"]) for _, c in configs)), []
    chains = [Chain(how, deriv or 1, window, interference) for how, deriv, window in treated]
    axes = [np.asarray(c.axis(list(axis))) for c in chains]
    place = {(c["model"], c["params"], treated.index((c["preprocess"], c["deriv"], c["window"]))): (k, c) for k, c in configs}

    def add(model, params, t, fold, weights, a=None, b=None):
        k, c = place[model, params, t]
        names = ",".join(f"{w:.1f}" for w in most_important(weights, axes[t])) if weights is not None else None
        found.append((k, *c.values(), "full", None, fold, len(axes[t]), names, "N/A", a, b, None, None, None))

    for model, params in dict.fromkeys((c["model"], c["params"]) for _, c in configs if c["model"] == "RandomForest"):
        scores, weights = classes.searched_forest(dealt, chains, [len(a) for a in axes], **json.loads(params), whole=top)
        for t, fold, a, b in scores:
            add(model, params, t, fold, weights.get(t), a, b)
    linear = {(c["model"], c["params"]): int(json.loads(c["params"])["n_components"]) for _, c in configs if c["model"] != "RandomForest"}
    if linear:
        scores, weights = classes.searched_pls(dealt, chains, [len(a) for a in axes], sorted(set(linear.values())))
        for (model, params), n in linear.items():
            for t, k, fold, a, b in scores:
                if k == n:
                    add(model, params, t, fold, weights[t, k], a, b)
    dealt.rows.unpersist()
    return samples.sparkSession.createDataFrame(found, f"{RESULTS}, fold int, {SCORES}")


def searched_classes(samples: DataFrame, y: str, models=("PLS-DA", "RandomForest"), preprocessing=("raw", "snv"), windows=(7,), folds: int = 5, max_components: int = 8, seed: int = 42, orders=(1,), counts=(), regions: int = 0, axis: list[float] | None = None, interference=(), balance: str | None = None, region_size: float = REGION_SIZE, region_step: float = REGION_STEP, top: bool = True) -> DataFrame:
    """As searched(), with accuracy and auc (one against the rest, mean over classes, then over folds). Folds go by places within a class. balance: smote, borderline_smote or
    adasyn, on the rows learned from alone. Without top, top_vars of forests stay null, as they take forests of all samples. Where neither rows nor steps nor channels are learned
    (balance, interference, counts, regions), PLS-DA and forests take any number of samples."""
    rows, width = samples.select("sample_id", "values", F.col(y).cast("string").alias("y")).where("y is not null"), channels(samples)
    axis = np.arange(width, dtype=float) if axis is None else np.asarray(axis, dtype=float)
    configs = list(enumerate(configurations(models, preprocessing, windows, min(max_components, width), orders)))
    plain = not (counts or regions or balance or Chain("raw", interference=interference).learns)
    spread = [(k, c) for k, c in configs if plain and c["model"] in SPREAD]
    others = [c for c in configs if c not in spread]
    each = of_any_number(rows, axis, folds, seed, spread, interference, top) if spread else None
    if others:
        held = rows.orderBy("y", F.xxhash64(F.lit(seed), "sample_id"), "sample_id").toPandas()
        data = Data(np.stack(held["values"]), held["y"].to_numpy(dtype=str), axis, folds, True, interference, balance)
        more = ran(samples.sparkSession, data, others, counts, regions, region_size, region_step)
        each = more if each is None else each.unionByName(more)
    out = each.groupBy(*KEYS).agg(F.avg("a").alias("accuracy"), F.avg("b").alias("auc"), F.max("n_vars").alias("n_vars"), F.max("all_vars").alias("all_vars"), F.max("top_vars").alias("top_vars"))
    return out.withColumns({"full_vars": F.lit(width), "lvs": F.get_json_object("params", "$.n_components").cast("int")})


def predicted(spectra: DataFrame, fitted, preprocess: str = "raw", window: int = 7, order: int = 1, channels: list[int] | None = None) -> DataFrame:
    """spectra with `pred` of a fitted model, in Arrow batches; channels after preprocessing, where the model takes some of them."""
    m = spectra.sparkSession.sparkContext.broadcast(fitted)

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=float)
        z = prepared(np.stack(v), preprocess, window, order)
        return pd.Series(m.value.predict(z if channels is None else z[:, channels]))

    return spectra.withColumn("pred", score("values"))
