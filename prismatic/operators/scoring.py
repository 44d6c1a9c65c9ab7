"""Ranking of configurations: performance with penalties for variables and complexity; class metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# A model's complexity where it has no latent variables, 0.5 for others; and the latent variables that count as 1.
COMPLEXITY = {"Ridge": 0.25, "ElasticNet": 0.28, "Lasso": 0.3, "KNN": 0.45, "SVM": 0.55, "RandomForest": 0.6, "LightGBM": 0.63, "CatBoost": 0.64, "XGBoost": 0.65, "MLP": 0.8, "NeuralBoosted": 0.85}
MANY_LATENT = 25
# Columns of a table of results, in order.
COMMON = "model string, params string, preprocess string, deriv int, window int, lvs int, n_vars int, full_vars int, subset string"
METRICS = {"regression": "rmse double, r2 double", "classification": "accuracy double, auc double"}


def relative_complexity(model: Column, components: Column) -> Column:
    """0 to 1: by latent variables where there are any, else by the kind of model."""
    named = F.create_map(*[F.lit(x) for pair in COMPLEXITY.items() for x in pair])
    return F.when(F.coalesce(components, F.lit(0)) > 0, F.least(components / MANY_LATENT, F.lit(1.0))).otherwise(F.coalesce(named[model], F.lit(0.5)))


def composite(results: DataFrame, task: str = "regression", variable_penalty: float = 2.0, complexity_penalty: float = 2.0) -> DataFrame:
    """results (rmse, r2 or auc, accuracy; n_vars, full_vars, model, lvs) with score and rank (equal scores share the least rank). Results are one row a
    configuration, so one window over all is small. Penalties go from 0 to 10; without variation or a value a metric counts as average."""
    every = Window.partitionBy()

    def z(c: str):
        sd = F.stddev_samp(c).over(every)
        return F.coalesce(F.when(sd > 0, (F.col(c) - F.avg(c).over(every)) / sd), F.lit(0.0))

    fit = 0.5 * z("rmse") - 0.5 * z("r2") if task == "regression" else -z("auc") - 0.3 * z("accuracy")
    penalty = (variable_penalty / 10) ** 2 * F.col("n_vars") / F.col("full_vars") + (complexity_penalty / 10) ** 2 * relative_complexity(F.col("model"), F.col("lvs"))
    return results.withColumn("score", fit + penalty).withColumn("rank", F.rank().over(Window.orderBy("score")))


def results_table(spark, task: str, rows: list[dict] = ()) -> DataFrame:
    """A table of results, empty or of rows; what a row lacks is null, and n_vars of full_vars 1 of 1. Tables go together with unionByName."""
    schema = f"{COMMON}, {METRICS[task]}, top_vars string, all_vars string"
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def confusion(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """class, t (rows of it), p (rows predicted as it) and h (both): counts alone, so a row for each class is all that is left of any number of rows."""
    cells = df.groupBy(y, predicted).agg(F.count(F.lit(1)).alias("n"))
    hit = F.sum(F.when(F.col(y) == F.col(predicted), F.col("n")).otherwise(0))
    true = cells.groupBy(F.col(y).alias("class")).agg(F.sum("n").alias("t"), hit.alias("h"))
    said = cells.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("p"))
    return true.join(said, "class", "full").na.fill(0, ["t", "h", "p"])


def by_class(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """class, support, precision, recall and f1; 0 where nothing is there to divide by."""
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    h, t, p = F.col("h"), F.col("t"), F.col("p")
    return confusion(df, y, predicted).select("class", t.alias("support"), share(h, p).alias("precision"), share(h, t).alias("recall"), share(2.0 * h, t + p).alias("f1"))


def class_metrics(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """One row: accuracy, balanced accuracy, macro and weighted F1, weighted precision and recall, from the confusion counts."""
    per, t = by_class(df, y, predicted), F.col("support")
    weighted = lambda c: F.sum(F.col(c) * t) / F.sum(t)
    return per.agg(weighted("recall").alias("accuracy"), F.avg(F.when(t > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("f1").alias("f1_macro"), weighted("f1").alias("f1_weighted"), weighted("precision").alias("precision_weighted"), weighted("recall").alias("recall_weighted"))


def auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row: area under the curve of score for y of 0 and 1, ties counted half. Counts by distinct score come first; their running sum sorts those alone."""
    by = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return by.withColumn("below", below).agg(F.try_divide(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))


def regression_metrics(df: DataFrame, y: str, predicted: str, *by: str) -> DataFrame:
    """n, rmse, mae, bias, r2 and rpd (deviation of y over rmse), for each group or for all rows."""
    e, t = F.col(predicted) - F.col(y), F.col(y)
    rmse = F.sqrt(F.avg(e * e))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), rmse.alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.try_subtract(F.lit(1.0), F.try_divide(F.avg(e * e), F.var_pop(t))).alias("r2"), F.try_divide(F.stddev_samp(t), rmse).alias("rpd"))


# Points of models, 50 for others; of preprocessing without a derivative, then by order of the derivative with the points of an unknown order.
MODEL_POINTS = {"PLS": 20, "Ridge": 25, "Lasso": 30, "RandomForest": 60, "MLP": 80, "NeuralBoosted": 85}
PLAIN_POINTS = {"raw": 0, "snv": 20}
DERIVATIVE_POINTS = {"deriv": {1: 50, 2: 70, None: 40}, "deriv_snv": {1: 60, 2: 80, None: 50}}


def complexity_points(model: Column, n_vars: Column, components: Column, preprocess: Column, order: Column) -> Column:
    """0 to 100: a quarter each for the model and its latent variables, 0.3 for channels, 0.2 for preprocessing."""

    def points(of: Column, table: dict, other: int) -> Column:
        out = F.lit(other)
        for k, v in table.items():
            out = F.when(of == k, v).otherwise(out)
        return out

    latent = F.when(components.isNull() | (components == 0), 50.0).otherwise(F.least(F.lit(100.0), (components - 2) * 100 / 23))
    prep = points(preprocess, PLAIN_POINTS, 30)
    for name, by_order in DERIVATIVE_POINTS.items():
        prep = F.when(preprocess == name, points(order, {k: v for k, v in by_order.items() if k}, by_order[None])).otherwise(prep)
    return 0.25 * points(model, MODEL_POINTS, 50) + 0.3 * F.least(F.lit(100.0), 4.5 * F.sqrt(n_vars)) + 0.25 * latent + 0.2 * prep


def complexity(model: Column, n_vars: Column, components: Column, preprocess: Column, order: Column) -> Column:
    """complexity_points() to one decimal."""
    return F.round(complexity_points(model, n_vars, components, preprocess, order), 1)
