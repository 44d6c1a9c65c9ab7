"""Alignment of spectra with reference tables, merging of sources, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalized_id(c: Column) -> Column:
    """One of the file endings .asd .sig .csv .txt .spc off, blanks out, lower case."""
    return F.lower(F.replace(F.regexp_replace(c, r"(?i)\.(asd|sig|csv|txt|spc)$", ""), F.lit(" "), F.lit("")))


def first_of_each(df: DataFrame, key: str, order: list) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def aligned(x: DataFrame, ref: DataFrame, key: str, target: str) -> DataFrame:
    """Inner join on key, or, if no key matches exactly, on normalised keys; rows without a target go."""
    known = ref.where(F.col(target).isNotNull())
    if x.select(key).join(ref.select(key), key, "left_semi").isEmpty():
        left, right = x.withColumn("__k", normalized_id(F.col(key))), known.withColumn("__k", normalized_id(F.col(key))).drop(key)
        return left.join(right, "__k").drop("__k")
    return x.join(known, key)


def unmatched(x: DataFrame, ref: DataFrame, key: str) -> DataFrame:
    """key and side of the ids without a partner."""
    return x.join(ref, key, "left_anti").select(key, F.lit("spectra").alias("side")).unionByName(ref.join(x, key, "left_anti").select(key, F.lit("reference").alias("side")))


def merged(sources: dict[str, tuple[DataFrame, list[float]]], how: str) -> tuple[DataFrame, list[float]]:
    """Rows of all sources on one axis, with the source's name in `datasource`: how is intersection (common channels) or union (missing ones null)."""
    axes = [set(a) for _, a in sources.values()]
    axis = sorted(set.intersection(*axes) if how == "intersection" else set.union(*axes))
    out = None
    for name, (df, own) in sources.items():
        place = {w: i for i, w in enumerate(own)}
        values = F.array(*[F.col("values")[place[w]] if w in place else F.lit(None).cast("double") for w in axis])
        part = df.withColumn("values", values).withColumn("datasource", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out, axis


def filtered(df: DataFrame, kind: str, value, column: str) -> DataFrame:
    """kind regex (search), range (inclusive) or list; any other leaves df as it is."""
    c = F.col(column)
    if kind == "regex":
        return df.where(c.cast("string").rlike(value))
    if kind == "range":
        return df.where(c.between(*value))
    return df.where(c.isin(list(value))) if kind == "list" else df
