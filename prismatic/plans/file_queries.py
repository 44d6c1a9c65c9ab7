"""Queries that go through files: spectra written and read again in each format, models, transfers and ensembles saved and loaded before use; and small ones about
specifications, models and importances. Spectra keep what they held, so SQL answers from the tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismatic.functions import registry
from prismatic.operators import moments, multivariate, spectra, transfer
from prismatic.operators.registry import Registry
from prismatic.plans.catalog import LONG, query, rounded, two_sources
from prismatic.plans.model_queries import PAIR, first_channels, pairs
from prismatic.plans.specs import parse_range, parse_wavelengths
from prismatic.sources import binary_files, excel, facade, models, scratch, spectral_files

HELD = f"WITH {LONG} SELECT sample_id, ch, round(value, 6) + 0.0 AS value FROM lng"


def written(spark, sf_dir) -> tuple[DataFrame, list[float]]:
    s = spectra.from_embeddings(spark, sf_dir)
    return s, [400.0 + k for k in range(spectra.channels(s))]


def read_again(read: DataFrame) -> DataFrame:
    rows = read.withColumn("sample_id", F.col("sample_id").cast("long"))
    return rounded(spectra.long(rows).select("sample_id", "ch", "value"), "value")


@query(HELD)
def csv_round_trip(spark, sf_dir):
    s, axis = written(spark, sf_dir)
    path = scratch.folder(spark, "csv")
    facade.write_spectra(s, axis, path, "csv")
    return read_again(facade.read_spectra(spark, path, "csv", least=len(axis))[0])


@query(HELD)
def jcamp_round_trip(spark, sf_dir):
    s, axis = written(spark, sf_dir)
    path = scratch.folder(spark, "jcamp")
    facade.write_spectra(s, axis, path, "jcamp")
    return read_again(facade.read_spectra(spark, f"{path}/*.txt", "jcamp", least=len(axis))[0])


@query(HELD)
def excel_round_trip(spark, sf_dir):
    s, axis = written(spark, sf_dir)
    path = scratch.folder(spark, "excel") + ".xlsx"
    facade.write_spectra(s, axis, path, "excel")
    scratch.GIVEN.append(path)
    return read_again(excel.read_excel(spark, path, least=len(axis))[0])


@query(HELD)
def spc_round_trip(spark, sf_dir):
    s, axis = written(spark, sf_dir)
    return read_again(spectral_files.on_common_axis(binary_files.spectra_of(binary_files.spc_contents(s, axis), "spc"), len(axis))[0])


@query(f"WITH {LONG} SELECT sample_id, label::DOUBLE AS y, ch, round(value, 6) + 0.0 AS value FROM lng")
def combined_table_round_trip(spark, sf_dir):
    """Separator, sample and target are found by the reader."""
    s, axis = written(spark, sf_dir)
    path = scratch.folder(spark, "combined")
    columns = [F.col("values")[k].alias(str(w)) for k, w in enumerate(axis)]
    s.select(F.col("sample_id").alias("Specimen ID"), *columns, F.col("label").alias("protein")).write.option("header", True).option("sep", ";").csv(path)
    read, _ = spectral_files.read_combined_csv(spark, path, least=len(axis))
    return rounded(spectra.long(read.withColumn("sample_id", F.col("sample_id").cast("long")), "y").select("sample_id", "y", "ch", "value"), "value")


@query("""SELECT unnest(['a.csv', 'b.XLSX', 'c.spc', 'd.jdx', 'e.asd', 'f.0', 'g.12', 'h.sp', 'i.seq', 'j.dat', 'k.zip']) AS name,
                 unnest(['csv', 'excel', 'spc', 'jcamp', 'asd', 'opus', 'opus', 'perkinelmer', 'agilent', 'ascii', 'unknown']) AS format""")
def detected_formats(spark, sf_dir):
    names = ["a.csv", "b.XLSX", "c.spc", "d.jdx", "e.asd", "f.0", "g.12", "h.sp", "i.seq", "j.dat", "k.zip"]
    return spark.createDataFrame([(n, spectral_files.detect_format(n)) for n in names], "name string, format string")


@query(f"""WITH {LONG}, b AS (SELECT a.sample_id, a.ch, a.value AS m, s.value AS s FROM lng a JOIN lng s ON s.ch = a.ch AND s.sample_id = a.sample_id + 1 AND a.sample_id % 2 = 0),
           f AS (SELECT ch, sum(m * s) / sum(s * s) AS f FROM b GROUP BY ch) SELECT l.sample_id - 1 AS sample_id, l.ch, round(l.value * f, 6) + 0.0 AS value FROM lng l JOIN f USING (ch) WHERE l.sample_id % 2 = 1""")
def saved_transfer(spark, sf_dir):
    master, slave = pairs(spark, sf_dir)
    path = scratch.folder(spark, "transfer")
    transfer.save_transfer(spark, {"method": "pds", "matrix": transfer.fit_pds(master, slave, spectra.channels(master), 1)}, path)
    return rounded(spectra.long(transfer.apply_transfer(slave, transfer.load_transfer(spark, path))).select("sample_id", "ch", "value"), "value")


@query(f"""WITH {PAIR}, y AS (SELECT vec_id AS sample_id, label::DOUBLE AS y FROM embeddings),
           s AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, count(*) * var_pop(a) + 1 AS aa, count(*) * var_pop(b) + 1 AS bb, count(*) * covar_pop(a, b) AS ab, count(*) * covar_pop(a, y) AS ay, count(*) * covar_pop(b, y) AS cy FROM t JOIN y USING (sample_id))
           SELECT sample_id, round(my + ((bb * ay - ab * cy) * (a - ma) + (aa * cy - ab * ay) * (b - mb)) / (aa * bb - ab * ab), 6) AS pred FROM t, s""")
def saved_model_predictions(spark, sf_dir):
    """Ridge on two channels, saved and loaded; it finds its channels among all by wavelength."""
    s, axis = written(spark, sf_dir)
    path = scratch.folder(spark, "model")
    models.save_model(spark, moments.fitted_ridge(moments.whole(first_channels(s), "label"), 1.0), path, [axis[10] + 0.004, axis[40]])
    model, wanted, _ = models.load_model(spark, path)
    from prismatic.operators.search import predicted

    own = s.withColumn("values", F.array(*[F.col("values")[k] for k in models.matched_channels(axis, wanted)]))
    return rounded(predicted(own, model).select("sample_id", "pred"), "pred")


@query(f"""WITH {LONG}, w AS (SELECT ch, covar_pop(value, label) AS w FROM lng GROUP BY ch)
           SELECT ch, round(sqrt(count(*) OVER () * w * w / sum(w * w) OVER ()), 6) AS vip FROM w""")
def vip_of_one_component(spark, sf_dir):
    fitted = moments.fitted_pls(moments.whole(spectra.from_embeddings(spark, sf_dir), "label"), 1)
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in enumerate(registry.importances(fitted))], "ch int, vip double"), "vip")


@query(f"""WITH {PAIR}, k AS (SELECT avg(a) AS ma, avg(b) AS mb, var_samp(a) AS aa, var_samp(b) AS bb, covar_samp(a, b) AS ab FROM t),
           r AS (SELECT *, 0.5 * atan2(2 * ab, aa - bb) AS r FROM k), l AS (SELECT *, cos(r) ** 2 * aa + 2 * sin(r) * cos(r) * ab + sin(r) ** 2 * bb AS l FROM r),
           s AS (SELECT sample_id, ((a - ma) * cos(r) + (b - mb) * sin(r)) ** 2 / l AS t2, ((b - mb) * cos(r) - (a - ma) * sin(r)) ** 2 AS q FROM t, l)
           SELECT sample_id, round(t2, 6) AS t2, round(q, 8) AS q, q > (SELECT quantile_cont(q, 0.95) FROM s) AS q_outlier FROM s""")
def residuals_of_one_component(spark, sf_dir):
    found = multivariate.pca_outliers(first_channels(spectra.from_embeddings(spark, sf_dir)), 1)
    return rounded(rounded(found.select("sample_id", "t2", "q", "q_outlier"), "t2"), "q", to=8)


@query(f"""WITH {LONG}, m AS (SELECT ch, avg(value) AS m, avg(value) FILTER (sample_id % 2 = 0) - avg(value) FILTER (sample_id % 2 = 1) AS d FROM lng GROUP BY ch),
           s AS (SELECT sample_id, sum((value - m) * d) AS s FROM lng JOIN m USING (ch) GROUP BY sample_id), n AS (SELECT sum(d * d) AS n FROM m)
           SELECT sample_id, ch, round(value - m - s * d / n, 6) + 0.0 AS value FROM lng JOIN m USING (ch) JOIN s USING (sample_id), n""")
def epo_of_one_difference(spark, sf_dir):
    """What differs between the mean spectra of two instruments (even and odd samples) goes."""
    s = spectra.from_embeddings(spark, sf_dir).drop("label")
    means = spectra.long(s).groupBy((F.col("sample_id") % 2).alias("sample_id"), "ch").agg(F.avg("value").alias("value"))
    two = means.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("ch", "value"))).alias("p")).select("sample_id", F.col("p.value").alias("values"))
    return rounded(spectra.long(multivariate.orthogonalized(s, two, 1)).select("sample_id", "ch", "value"), "value")


@query("""WITH s AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 'A' ELSE 'B' END AS source FROM embeddings)
          SELECT source, count(*) AS n_samples, 40::BIGINT AS n_channels, CASE source WHEN 'A' THEN 0.0::DOUBLE ELSE 24.0 END AS lo, CASE source WHEN 'A' THEN 39.0::DOUBLE ELSE 63.0 END AS hi FROM s GROUP BY source
          UNION ALL SELECT 'merged', count(*), 16, 24.0, 39.0 FROM s""")
def source_summaries(spark, sf_dir):
    r = Registry()
    for name, (df, axis) in two_sources(spark, sf_dir).items():
        r.add(df, axis, name)
    merged = r.merged_summary(*r.merge(), "intersection")
    found = [*(s.summary() for s in r.sources.values()), merged | {"name": "merged"}]
    return spark.createDataFrame([(x["name"], x["n_samples"], x["n_channels"], float(x["range"][0]), float(x["range"][1])) for x in found], "source string, n_samples long, n_channels long, lo double, hi double")


@query("""SELECT 'steps' AS spec, unnest([1.0, 5.0, 7.0, 9.0]::DOUBLE[]) AS value UNION ALL SELECT 'wavelengths', unnest([410.0, 411.0, 412.0, 450.0]::DOUBLE[])""")
def range_specs(spark, sf_dir):
    axis = [400.0 + k for k in range(64)]
    found = [("steps", v) for v in parse_range("9, 1, 5-9 step 2", "windows")] + [("wavelengths", w) for w in parse_wavelengths("410-412, 450, 900", axis)]
    return spark.createDataFrame([(n, float(v)) for n, v in found], "spec string, value double")


@query("""SELECT unnest(['PLS', 'Ridge', 'Lasso', 'RandomForest', 'LightGBM', 'SVM', 'PLS-DA', 'nothing']) AS model,
                 unnest([true, true, true, true, true, false, false, false]) AS regression, unnest([true, false, false, true, true, true, true, false]) AS classification""")
def supported_models(spark, sf_dir):
    names = ["PLS", "Ridge", "Lasso", "RandomForest", "LightGBM", "SVM", "PLS-DA", "nothing"]
    return spark.createDataFrame([(m, registry.is_valid(m, "regression"), registry.is_valid(m, "classification")) for m in names], "model string, regression boolean, classification boolean")
