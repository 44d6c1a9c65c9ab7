"""Regions of the target, and ensembles weighted by how models do there. Rows: id, model, y, pred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quartile_edges(df: DataFrame, y: str) -> list[float]:
    return list(df.agg(F.expr(f"percentile({y}, array(0.25, 0.5, 0.75))").alias("q")).first()["q"])


def region(y: Column, edges: list[float]) -> Column:
    """0 .. len(edges), closed on the left."""
    return sum((F.when(y >= e, 1).otherwise(0) for e in edges[1:]), F.when(y >= edges[0], 1).otherwise(0))


def regional_errors(preds: DataFrame, edges: list[float]) -> DataFrame:
    """model, region, n, rmse and mae."""
    e = F.col("y") - F.col("pred")
    return preds.groupBy("model", region(F.col("y"), edges).alias("region")).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def regional_weights(errors: DataFrame) -> DataFrame:
    """model, region, weight: 1 / (rmse + 1e-6), summing to 1 in each region."""
    w = errors.select("model", "region", (1 / (F.col("rmse") + 1e-6)).alias("w"))
    return w.join(w.groupBy("region").agg(F.sum("w").alias("s")), "region").select("model", "region", (F.col("w") / F.col("s")).alias("weight"))


def region_weighted(preds: DataFrame, weights: DataFrame, edges: list[float]) -> DataFrame:
    """id and pred: the region follows the mean prediction. weights has a row for each model and region."""
    mean = preds.groupBy("id").agg(F.avg("pred").alias("m")).select("id", region(F.col("m"), edges).alias("region"))
    return preds.join(mean, "id").join(F.broadcast(weights), ["model", "region"]).groupBy("id").agg((F.sum(F.col("pred") * F.col("weight")) / F.sum("weight")).alias("pred"))


def quality_consensus(preds: DataFrame, quality: DataFrame) -> DataFrame:
    """id and pred: the mean of predictions weighted by each model's R2 (columns model, r2)."""
    return preds.join(F.broadcast(quality), "model").groupBy("id").agg((F.sum(F.col("pred") * F.col("r2")) / F.sum("r2")).alias("pred"))


def best_experts(errors: DataFrame) -> DataFrame:
    """region and the model of least rmse there; ties to the first by name."""
    return errors.groupBy("region").agg(F.min_by("model", F.struct("rmse", "model")).alias("model"))


def mixture(preds: DataFrame, errors: DataFrame, edges: list[float]) -> DataFrame:
    """id and pred of the best expert for the region of the mean prediction."""
    mean = preds.groupBy("id").agg(F.avg("pred").alias("m")).select("id", region(F.col("m"), edges).alias("region"))
    return preds.join(mean.join(F.broadcast(best_experts(errors)), "region"), ["id", "model"]).select("id", "pred")


def wide_predictions(preds: DataFrame, names: list[str], edges: list[float] | None = None) -> tuple[DataFrame, list[str]]:
    """id, y (where preds have it) and a column for each feature of a stack: the models' predictions and, with edges, the region of their mean as 0 and 1, and the mean."""
    more = [F.first("y").alias("y")] if "y" in preds.columns else []
    wide = preds.groupBy("id").pivot("model", names).agg(F.first("pred")).select("id", *[F.col(f"`{n}`").alias(f"f{k}") for k, n in enumerate(names)])
    wide = wide.join(preds.groupBy("id").agg(F.avg("pred").alias("mean"), *more), "id")
    features = [f"f{k}" for k in range(len(names))]
    if edges is not None:
        at = region(F.col("mean"), edges)
        wide = wide.withColumns({f"r{k}": F.when(at == k, 1.0).otherwise(0.0) for k in range(len(edges) + 1)})
        features += [*(f"r{k}" for k in range(len(edges) + 1)), "mean"]
    return wide, features


def stacked(preds: DataFrame, alpha: float = 1.0, edges: list[float] | None = None) -> tuple[list[str], list[float]]:
    """Models and the ridge weights of wide_predictions()'s features, the intercept last, fitted on predictions (out of fold) from sums over all rows."""
    import numpy as np

    names = sorted(r["model"] for r in preds.select("model").distinct().collect())
    wide, features = wide_predictions(preds, names, edges)
    cols = [*features, "y"]
    middle = wide.agg(*[F.avg(c).alias(c) for c in cols]).first()
    mean = np.array([middle[c] for c in cols])
    e = [F.col(c) - float(m) for c, m in zip(cols, mean)]
    sums = wide.agg(*[F.sum(e[a] * e[b]).alias(f"c{a}_{b}") for a in range(len(cols)) for b in range(a, len(cols))]).first()
    c = np.array([[sums[f"c{min(a, b)}_{max(a, b)}"] for b in range(len(cols))] for a in range(len(cols))])
    w = np.linalg.solve(c[:-1, :-1] + alpha * np.eye(len(features)), c[:-1, -1])
    return names, [*w.tolist(), float(mean[-1] - mean[:-1] @ w)]


def stack(preds: DataFrame, names: list[str], weights: list[float], edges: list[float] | None = None) -> DataFrame:
    """id and pred by the weights of stacked()."""
    wide, features = wide_predictions(preds, names, edges)
    return wide.select("id", sum((F.col(f) * w for f, w in zip(features, weights)), F.lit(weights[-1])).alias("pred"))


# The kinds of ensembles.
KINDS = ["simple_average", "region_weighted", "mixture", "soft_mixture", "stacking", "region_stacking"]


def created(preds: DataFrame, kind: str = "region_weighted", n_regions: int = 5) -> dict:
    """An ensemble of models from their predictions out of fold (id, model, y, pred): kind, edges of n_regions regions with equal parts of y, and errors or weights."""
    if kind not in KINDS:
        raise ValueError(f"unknown ensemble {kind}: one of {KINDS}")
    cuts = ", ".join(str(k / n_regions) for k in range(1, n_regions))
    one = preds.groupBy("id").agg(F.first("y").alias("y"))
    edges = list(one.agg(F.expr(f"percentile(y, array({cuts}))").alias("q")).first()["q"]) if n_regions > 1 else []
    made = {"kind": kind, "edges": edges}
    if "stacking" in kind:
        made["names"], made["weights"] = stacked(preds, edges=edges if kind == "region_stacking" else None)
    else:
        made["errors"] = regional_errors(preds, edges)
    return made


def combined(preds: DataFrame, ensemble: dict) -> DataFrame:
    """id and pred of an ensemble of created() for the models' predictions (id, model, pred)."""
    kind, edges = ensemble["kind"], ensemble["edges"]
    if kind == "simple_average":
        return simple_average(preds)
    if "stacking" in kind:
        return stack(preds, ensemble["names"], ensemble["weights"], edges if kind == "region_stacking" else None)
    if kind == "mixture":
        return mixture(preds, ensemble["errors"], edges)
    return region_weighted(preds, regional_weights(ensemble["errors"]), edges)


def applicability(train_scores, new_scores, block: int = 1024) -> list[tuple[float, str]]:
    """Distance of each new score vector to its nearest training one, and good, caution or extrapolation by the training set's own 75th and 95th percentiles.
    Distances are made by blocks of rows; only the training set's own are held, half of their square."""
    import numpy as np

    size = (train_scores**2).sum(1)
    far = lambda part: np.sqrt(np.maximum(0, (part**2).sum(1)[:, None] + size[None] - 2 * part @ train_scores.T))
    own = [far(train_scores[lo : lo + block])[np.arange(len(train_scores))[None] > np.arange(lo, min(lo + block, len(train_scores)))[:, None]].astype(np.float32) for lo in range(0, len(train_scores), block)]
    p75, p95 = np.percentile(np.concatenate(own), [75, 95])
    out = np.concatenate([far(new_scores[lo : lo + block]).min(1) for lo in range(0, len(new_scores), block)]) if len(new_scores) else np.zeros(0)
    return [(float(x), "good" if x <= p75 else "caution" if x <= p95 else "extrapolation") for x in out]


def farthest_domain(domains: DataFrame) -> DataFrame:
    """id, distance and trust over an ensemble's models (id, distance, trust): the largest distance and the least trust."""
    rank = F.when(F.col("trust") == "extrapolation", 2).when(F.col("trust") == "caution", 1).otherwise(0)
    worst = domains.groupBy("id").agg(F.max("distance").alias("distance"), F.max(rank).alias("r"))
    return worst.select("id", "distance", F.element_at(F.array(*map(F.lit, ("good", "caution", "extrapolation"))), F.col("r") + 1).alias("trust"))


def simple_average(preds: DataFrame) -> DataFrame:
    return preds.groupBy("id").agg(F.avg("pred").alias("pred"))


def soft_mixture(preds: DataFrame, errors: DataFrame, edges: list[float]) -> DataFrame:
    """id and pred: every expert, weighted by 1 / (rmse + 1e-6) in the region of the mean prediction."""
    return region_weighted(preds, regional_weights(errors), edges)


def regional_consensus(preds: DataFrame, errors: DataFrame, edges: list[float]) -> DataFrame:
    """id and pred: models weighted by 1 / (rmse^2 + 1e-10) in the region of the median prediction; without any weight there, the median."""
    middle = preds.groupBy("id").agg(F.expr("percentile(pred, 0.5)").alias("m")).withColumn("region", region(F.col("m"), edges))
    w = errors.select("model", "region", (1 / (F.col("rmse") * F.col("rmse") + 1e-10)).alias("w"))
    both = preds.join(middle, "id").join(F.broadcast(w), ["model", "region"], "left")
    return both.groupBy("id").agg(F.coalesce(F.try_divide(F.sum(F.col("pred") * F.col("w")), F.sum("w")), F.first("m")).alias("pred"))


def specialization(errors: DataFrame) -> DataFrame:
    """model and the deviation of its regional rmse over their mean: 0 for a model equally good everywhere."""
    return errors.groupBy("model").agg(F.try_divide(F.stddev_pop("rmse"), F.avg("rmse")).alias("specialization"))
