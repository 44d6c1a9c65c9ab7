"""python -m prismatic: spectra and reference values in, a ranked search and a report out."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from prismatic.functions import registry
from prismatic.operators import relational, scoring, search
from prismatic.plans.specs import markdown_report
from prismatic.sources import facade


def options(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="prismatic", description=__doc__)
    p.add_argument("--spectra", required=True, help="file or folder of spectra")
    p.add_argument("--reference", required=True, help="CSV with ids and the target")
    p.add_argument("--id", required=True, dest="key", help="the reference's id column")
    p.add_argument("--target", required=True)
    p.add_argument("--format", default="auto")
    p.add_argument("--task", choices=["regression", "classification"], default="regression")
    p.add_argument("--models", nargs="+", default=None)
    p.add_argument("--tier", default="quick", help="models to try where none are named: quick, standard, comprehensive or experimental")
    p.add_argument("--derivatives", nargs="+", type=int, choices=[1, 2], default=[1, 2])
    p.add_argument("--variable-counts", nargs="*", type=int, default=list(search.COUNTS), help="sizes of subsets by importance; none for full spectra alone")
    p.add_argument("--regions", type=int, default=5, help="best regions to try; 0 for none")
    p.add_argument("--preprocessing", nargs="+", default=["raw", "snv", "deriv", "snv_deriv", "deriv_snv"])
    p.add_argument("--windows", nargs="+", type=int, default=[7, 19])
    p.add_argument("--folds", type=int, default=5)
    p.add_argument("--max-components", type=int, default=8)
    p.add_argument("--variable-penalty", type=float, default=2.0)
    p.add_argument("--complexity-penalty", type=float, default=2.0)
    p.add_argument("--results", help="folder for the ranked configurations, as Parquet")
    p.add_argument("--report", help="file for the report, as Markdown")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> list[dict]:
    o = options(argv)
    spark = SparkSession.builder.getOrCreate()
    x, axis = facade.read_spectra(spark, o.spectra, o.format)
    found = spark.read.option("header", True).csv(o.reference)
    target = F.col(f"`{o.target}`")
    reference = found.select(F.col(f"`{o.key}`").alias("sample_id"), (target.try_cast("double") if o.task == "regression" else target).alias("y"))
    samples = relational.aligned(x, reference.dropDuplicates(["sample_id"]), "sample_id", "y")
    models = tuple(o.models or registry.tier_models(o.tier, o.task))
    run = search.searched if o.task == "regression" else search.searched_classes
    ran = run(samples, "y", models, tuple(o.preprocessing), tuple(o.windows), o.folds, o.max_components, orders=tuple(o.derivatives), counts=tuple(o.variable_counts), regions=o.regions, axis=axis)
    points = scoring.complexity(F.col("model"), F.col("n_vars"), F.col("lvs"), F.col("preprocess"), F.col("deriv"))
    ranked = scoring.composite(ran.withColumn("complexity", points), o.task, o.variable_penalty, o.complexity_penalty).orderBy("rank", "config", "subset")
    if o.results:
        ranked.write.mode("overwrite").parquet(o.results)
        ranked = spark.read.parquet(o.results).orderBy("rank", "config", "subset")
    rows = [r.asDict() for r in ranked.collect()]  # one row a configuration
    if o.report:
        facade.write_bytes(spark, o.report, markdown_report(o.target, rows).encode())
    return rows


if __name__ == "__main__":
    for row in main()[:10]:
        print(*(f"{k}={v}" for k, v in row.items()))
