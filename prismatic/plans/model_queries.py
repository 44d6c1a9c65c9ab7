"""Further queries of the catalogue: transfers, choices of channels and samples, models, instruments, ensembles; with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismatic.functions import arrays, registry
from prismatic.operators import diagnostics, ensemble, instruments, moments, multivariate, report, resampling, scoring, search, spectra, transfer, wavelengths
from prismatic.operators.registry import Registry
from prismatic.plans.catalog import ERRORS, LONG, MODELS, REGION, mapped, query, rounded, table, two_models, two_sources
from prismatic.streaming import spectra as streaming


@query(f"""WITH {LONG}, t AS (SELECT i::INTEGER AS ch FROM generate_series(0, 63) g(i)),
           s AS (SELECT DISTINCT sample_id FROM lng), b AS (SELECT sample_id, ch, CASE WHEN sample_id % 2 = 0 THEN least(ch, 38) ELSE greatest(24, least(ch, 62)) END AS lo FROM s, t)
           SELECT b.sample_id, CASE WHEN b.sample_id % 2 = 0 THEN 'A' ELSE 'B' END AS datasource, b.ch::DOUBLE AS wl, round(a.value + (b.ch - lo) * (z.value - a.value), 6) + 0.0 AS value
           FROM b JOIN lng a ON a.sample_id = b.sample_id AND a.ch = lo JOIN lng z ON z.sample_id = b.sample_id AND z.ch = lo + 1""")
def merge_interpolation(spark, sf_dir):
    r = Registry()
    for name, (df, axis) in two_sources(spark, sf_dir).items():
        r.add(df, axis, name)
    df, axis = r.merge(how="interpolation")
    at = F.array(*map(F.lit, axis))
    return rounded(df.select("sample_id", "datasource", F.posexplode("values").alias("p", "value")).select("sample_id", "datasource", at[F.col("p")].alias("wl"), "value"), "value")


@query(f"WITH {LONG} SELECT sample_id, label, ch, round(value, 6) + 0.0 AS value FROM lng WHERE ch < 10 QUALIFY dense_rank() OVER (ORDER BY sample_id) <= 5")
def data_preview(spark, sf_dir):
    first = spectra.from_embeddings(spark, sf_dir).orderBy("sample_id").limit(5).withColumn("values", F.slice("values", 1, 10))
    return rounded(spectra.long(first, "label").select("sample_id", "label", "ch", "value"), "value")


@query("SELECT p_partkey, round(1e7 / p_retailprice, 6) AS wavenumber FROM part")
def wavelength_to_wavenumber(spark, sf_dir):
    return rounded(table(spark, sf_dir, "part").select("p_partkey", arrays.reciprocal(F.col("p_retailprice")).alias("wavenumber")), "wavenumber")


@query("""WITH s AS (SELECT DISTINCT p_retailprice AS w FROM part), d AS (SELECT w - lag(w) OVER (ORDER BY w) AS s FROM s)
          SELECT round(quantile_cont(s, 0.5), 6) AS median_step, round(min(s), 6) AS min_step, round(max(s), 6) AS max_step, stddev_pop(s) / avg(s) < 1e-6 AS interpolated FROM d WHERE s IS NOT NULL""")
def axis_spacing(spark, sf_dir):
    return rounded(diagnostics.spacing(table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("wl")).distinct(), "wl"), "median_step", "min_step", "max_step")


@query("""WITH s AS (SELECT quantile_cont(value, 0.5) AS m, stddev_pop(value) AS sd FROM events), d AS (SELECT event_id, abs(value - m) / sd AS d FROM events, s),
          w AS (SELECT event_id, 1 + d / (SELECT max(d) FROM d) AS w FROM d) SELECT event_id, round(w / avg(w) OVER (), 6) AS weight FROM w""")
def rare_boost_weights(spark, sf_dir):
    from prismatic.operators import balance

    return rounded(balance.rare_boost(table(spark, sf_dir, "events").select("event_id", "value"), "value").select("event_id", "weight"), "weight")


@query("""WITH e AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 1500.0 - l_extendedprice AS e FROM lineitem)
          SELECT l_returnflag, count(*) AS n, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(avg(e), 4) + 0.0 AS bias, round(1 - avg(e * e) / var_pop(y), 6) AS r2, round(stddev_samp(y) / sqrt(avg(e * e)), 6) AS rpd FROM e GROUP BY 1""")
def regression_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("pred"))
    return rounded(rounded(scoring.regression_metrics(rows, "y", "pred", "l_returnflag"), "rmse", "mae", "bias", to=4), "r2", "rpd")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'PLS' WHEN 1 THEN 'MLP' ELSE 'SVR' END AS model, l_partkey % 900 AS n_vars,
                     CASE WHEN l_linenumber % 3 = 0 THEN l_suppkey % 12 END AS lv, CASE l_suppkey % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'snv' ELSE 'deriv' END AS prep, l_partkey % 4 AS d FROM lineitem)
          SELECT l_orderkey, l_linenumber, round(0.25 * CASE model WHEN 'PLS' THEN 20 WHEN 'MLP' THEN 80 ELSE 50 END + 0.3 * least(100.0::DOUBLE, 4.5::DOUBLE * sqrt(n_vars))
                 + 0.25 * CASE WHEN lv IS NULL OR lv = 0 THEN 50.0::DOUBLE ELSE least(100.0::DOUBLE, (lv - 2) * 100 / 23) END
                 + 0.2 * CASE prep WHEN 'raw' THEN 0 WHEN 'snv' THEN 20 ELSE CASE d WHEN 1 THEN 50 WHEN 2 THEN 70 ELSE 40 END END, 4) AS complexity FROM c""")
def complexity_scores(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem")
    third, prep = F.col("l_linenumber") % 3, F.col("l_suppkey") % 3
    model = F.when(third == 0, "PLS").when(third == 1, "MLP").otherwise("SVR")
    score = scoring.complexity_points(model, F.col("l_partkey") % 900, F.when(third == 0, F.col("l_suppkey") % 12), F.when(prep == 0, "raw").when(prep == 1, "snv").otherwise("deriv"), F.col("l_partkey") % 4)
    return rounded(c.select("l_orderkey", "l_linenumber", score.alias("complexity")), "complexity", to=4)


@query(f"WITH {MODELS} SELECT id, round(avg(pred), 6) AS pred FROM p GROUP BY id")
def simple_average(spark, sf_dir):
    return rounded(ensemble.simple_average(two_models(spark, sf_dir)), "pred")


@query(f"""WITH {MODELS}, {ERRORS}, b AS (SELECT region, arg_min(model, rmse) AS model FROM e GROUP BY region), m AS (SELECT id, avg(pred) AS m FROM p GROUP BY id), g AS (SELECT id, {REGION.format('m')} AS region FROM m, q)
           SELECT p.id, round(pred, 6) AS pred FROM p JOIN g USING (id) JOIN b ON b.region = g.region AND b.model = p.model""")
def mixture_of_experts(spark, sf_dir):
    p = two_models(spark, sf_dir)
    edges = ensemble.quartile_edges(p.where("model = 'a'"), "y")
    return rounded(ensemble.mixture(p, ensemble.regional_errors(p, edges), edges), "pred")


@query(f"""WITH {MODELS}, {ERRORS}, w AS (SELECT model, region, 1 / (rmse * rmse + 1e-10) AS w FROM e), m AS (SELECT id, quantile_cont(pred, 0.5) AS m FROM p GROUP BY id), g AS (SELECT id, {REGION.format('m')} AS region FROM m, q)
           SELECT p.id, round(sum(pred * w) / sum(w), 3) AS pred FROM p JOIN g USING (id) JOIN w USING (model, region) GROUP BY p.id""")
def regional_consensus(spark, sf_dir):
    p = two_models(spark, sf_dir)
    edges = ensemble.quartile_edges(p.where("model = 'a'"), "y")
    return rounded(ensemble.regional_consensus(p, ensemble.regional_errors(p, edges), edges), "pred", to=3)


@query(f"WITH {MODELS}, {ERRORS} SELECT model, round(stddev_pop(rmse) / avg(rmse), 6) AS specialization FROM e GROUP BY model")
def model_specialization(spark, sf_dir):
    p = two_models(spark, sf_dir)
    return rounded(ensemble.specialization(ensemble.regional_errors(p, ensemble.quartile_edges(p.where("model = 'a'"), "y"))), "specialization")


@query("SELECT to_timestamp(floor(epoch(ts) / 300) * 300)::TIMESTAMP AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def windowed_readings(spark, sf_dir):
    return rounded(streaming.readings(table(spark, sf_dir, "events")), "mean")


def pairs(spark, sf_dir):
    """Even samples as the master's, each with its odd neighbour as the slave's."""
    s = spectra.from_embeddings(spark, sf_dir)
    return s.where("sample_id % 2 = 0"), s.where("sample_id % 2 = 1").withColumn("sample_id", F.col("sample_id") - 1)


def matrix_transfer(spark, sf_dir, fit):
    master, slave = pairs(spark, sf_dir)
    return spectra.long(transfer.apply_transfer(slave, fit(master, slave, spectra.channels(master))).drop("label"))


# Kennard-Stone in SQL: a step of the recursion adds the sample farthest from those chosen
CHOICE = """{dist},
    seed AS (SELECT a, b FROM d WHERE a < b ORDER BY dist DESC, a, b LIMIT 1),
    k AS (SELECT 2 AS n, [a, b] AS ids FROM seed
          UNION ALL SELECT any_value(n) + 1, list_append(any_value(ids), arg_max(a, m)) FROM (
              SELECT n, ids, d.a, min(d.dist) AS m FROM k JOIN d ON list_contains(k.ids, d.b) AND NOT list_contains(k.ids, d.a) WHERE n < {n} GROUP BY n, ids, d.a) HAVING count(*) > 0),
    o AS (SELECT unnest(generate_series(0, len(ids) - 1))::INTEGER AS place, unnest(ids) AS sample_id FROM k WHERE n = {n})"""
PLAIN = "d AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b, list_distance(p.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS dist FROM embeddings p, embeddings q)"
SCALED = f"""{LONG}, r AS (SELECT ch, min(value) AS lo, max(value) - min(value) + 1e-10 AS w FROM lng GROUP BY ch), yr AS (SELECT min(label) AS lo, max(label) - min(label) + 1e-10 AS w FROM embeddings),
    s AS (SELECT sample_id, any_value((label - yr.lo) / yr.w) AS y, list((value - r.lo) / r.w ORDER BY ch) AS v FROM lng JOIN r USING (ch), yr GROUP BY sample_id),
    d AS MATERIALIZED (SELECT p.sample_id AS a, q.sample_id AS b, list_distance(p.v, q.v) + abs(p.y - q.y) AS dist FROM s p, s q)"""


@query("WITH RECURSIVE " + CHOICE.format(dist=PLAIN, n=40) + " SELECT sample_id, place FROM o")
def kennard_stone_selection(spark, sf_dir):
    return multivariate.selected_samples(spectra.from_embeddings(spark, sf_dir), 40)


@query("WITH RECURSIVE " + CHOICE.format(dist=PLAIN, n=80) + " SELECT sample_id, CASE WHEN place < 40 AND place % 2 = 1 THEN 'validation' ELSE 'calibration' END AS part FROM o")
def duplex_split(spark, sf_dir):
    return multivariate.duplex(spectra.from_embeddings(spark, sf_dir), 60, 20)


@query("WITH RECURSIVE " + CHOICE.format(dist=SCALED, n=40) + " SELECT sample_id, place FROM o")
def spxy_selection(spark, sf_dir):
    return multivariate.selected_samples(spectra.from_embeddings(spark, sf_dir), 40, "label")


@query(f"""WITH {LONG}, m AS (SELECT ch, avg(value) AS m FROM lng GROUP BY ch), c AS (SELECT ch, covar_pop(value, label) AS c FROM lng GROUP BY ch),
           t AS (SELECT sample_id, sum((value - m) * c) AS t FROM lng JOIN m USING (ch) JOIN c USING (ch) GROUP BY sample_id),
           p AS (SELECT ch, sum((value - m) * t) AS p FROM lng JOIN m USING (ch) JOIN t USING (sample_id) GROUP BY ch), n AS (SELECT sqrt(sum(p * p)) AS n FROM p),
           s AS (SELECT sample_id, sum((value - m) * p / n) AS s FROM lng JOIN m USING (ch) JOIN p USING (ch), n GROUP BY sample_id)
           SELECT sample_id, ch, round(value - m - s * p / n, 6) + 0.0 AS value FROM lng JOIN m USING (ch) JOIN p USING (ch) JOIN s USING (sample_id), n""")
def osc(spark, sf_dir):
    return rounded(spectra.long(multivariate.osc(spectra.from_embeddings(spark, sf_dir), "label")).select("sample_id", "ch", "value"), "value")


# polynomials up to the third degree that are orthogonal over 64 places about their middle
@query(f"""WITH {LONG}, t AS (SELECT i AS ch, i - 31.5::DOUBLE AS t FROM generate_series(0, 63) g(i)), k AS (SELECT sum(t * t) / 64 AS a, sum(t ** 4) / sum(t * t) AS b FROM t),
           p AS (SELECT ch, unnest([1, t, t * t - a, t * t * t - b * t]) AS p, unnest([0, 1, 2, 3]) AS d FROM t, k), q AS (SELECT d, sum(p * p) AS q FROM p GROUP BY d),
           f AS (SELECT sample_id, d, sum(value * p) AS f FROM lng JOIN p USING (ch) GROUP BY 1, 2)
           SELECT l.sample_id, l.ch, round(any_value(l.value) - sum(f.f * p.p / q.q), 6) + 0.0 AS value FROM lng l JOIN p USING (ch) JOIN f ON f.sample_id = l.sample_id AND f.d = p.d JOIN q ON q.d = p.d GROUP BY 1, 2""")
def cubic_baseline(spark, sf_dir):
    return mapped(spark, sf_dir, lambda v, n: arrays.detrended(v, n, 3))


@query("""WITH r AS (SELECT l_extendedprice - l_quantity * 1500.0 AS r FROM lineitem), o AS (SELECT r, row_number() OVER (ORDER BY r) AS place, count(*) OVER () AS n FROM r)
          SELECT place, round(place / (n + 1), 9) AS probability, round(r, 6) + 0.0 AS observed FROM o""")
def residual_quantiles(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") - F.col("l_quantity") * 1500.0).alias("r"))
    return rounded(rounded(diagnostics.quantile_pairs(rows, "r").select("place", "probability", "observed"), "probability", to=9), "observed")


@query(f"""WITH {MODELS}, w AS (SELECT id, any_value(y) AS y, max(pred) FILTER (model = 'a') AS a, max(pred) FILTER (model = 'b') AS b FROM p GROUP BY id),
           s AS (SELECT count(*) * var_pop(a) + 1 AS aa, count(*) * var_pop(b) + 1 AS bb, count(*) * covar_pop(a, b) AS ab, count(*) * covar_pop(a, y) AS ay, count(*) * covar_pop(b, y) AS cy, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM w),
           c AS (SELECT (bb * ay - ab * cy) / (aa * bb - ab * ab) AS ca, (aa * cy - ab * ay) / (aa * bb - ab * ab) AS cb, ma, mb, my FROM s)
           SELECT 'a' AS term, round(ca, 5) + 0.0 AS weight FROM c UNION ALL SELECT 'b', round(cb, 5) + 0.0 FROM c UNION ALL SELECT 'intercept', round(my - ca * ma - cb * mb, 2) + 0.0 FROM c""")
def stacked_weights(spark, sf_dir):
    names, w = ensemble.stacked(two_models(spark, sf_dir))
    return spark.createDataFrame([(n, round(v, 5) + 0.0) for n, v in zip(names, w)] + [("intercept", round(w[-1], 2) + 0.0)], "term string, weight double")


@query("""WITH o AS (SELECT vec_id AS sample_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR), vec_id) AS n FROM embeddings)
          SELECT sample_id, label FROM o WHERE n <= (SELECT min(c) FROM (SELECT count(*) AS c FROM embeddings GROUP BY label))""")
def undersampled_classes(spark, sf_dir):
    rows = spectra.from_embeddings(spark, sf_dir).select("sample_id", "label")
    return resampling.undersampled_classes(rows, "label", order=F.md5(F.col("sample_id").cast("string").cast("binary")))


@query(f"""WITH {LONG}, b AS (SELECT a.sample_id, a.ch, a.value AS m, s.value AS s FROM lng a JOIN lng s ON s.ch = a.ch AND s.sample_id = a.sample_id + 1 AND a.sample_id % 2 = 0),
           f AS (SELECT ch, sum(m * s) / sum(s * s) AS f FROM b GROUP BY ch) SELECT l.sample_id - 1 AS sample_id, l.ch, round(l.value * f, 6) + 0.0 AS value FROM lng l JOIN f USING (ch) WHERE l.sample_id % 2 = 1""")
def pds_of_single_channels(spark, sf_dir):
    got = matrix_transfer(spark, sf_dir, lambda m, s, n: {"matrix": transfer.fit_pds(m, s, n, 1)})
    return rounded(got.select("sample_id", "ch", "value"), "value")


def first_channels(df):
    return df.withColumn("values", F.array(F.col("values")[10], F.col("values")[40]))


PAIR = "t AS (SELECT vec_id AS sample_id, embedding[11]::DOUBLE AS a, embedding[41]::DOUBLE AS b FROM embeddings)"


@query(f"""WITH {PAIR}, k AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, count(*) * var_pop(a) AS aa, count(*) * var_pop(b) AS bb, count(*) * covar_pop(a, b) AS ab FROM t)
           SELECT sample_id, round(1 / n + (bb * (a - ma) ** 2 - 2 * ab * (a - ma) * (b - mb) + aa * (b - mb) ** 2) / (aa * bb - ab * ab), 8) AS leverage,
                  1 / n + (bb * (a - ma) ** 2 - 2 * ab * (a - ma) * (b - mb) + aa * (b - mb) ** 2) / (aa * bb - ab * ab) > 6 / n AS is_high FROM t, k""")
def leverage_of_two_channels(spark, sf_dir):
    return rounded(multivariate.leverage(first_channels(spectra.from_embeddings(spark, sf_dir))), "leverage", to=8)


@query(f"""WITH {PAIR}, k AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS aa, var_samp(b) AS bb, covar_samp(a, b) AS ab FROM t)
           SELECT sample_id, round((bb * (a - ma) ** 2 - 2 * ab * (a - ma) * (b - mb) + aa * (b - mb) ** 2) / (aa * bb - ab * ab), 6) AS t2 FROM t, k""")
def hotelling_of_two_channels(spark, sf_dir):
    return rounded(multivariate.pca_outliers(first_channels(spectra.from_embeddings(spark, sf_dir)), 2).select("sample_id", "t2"), "t2")


@query(f"""WITH {PAIR}, m AS (SELECT p.sample_id, p.a AS ma, p.b AS mb, s.a AS sa, s.b AS sb FROM t p JOIN t s ON s.sample_id = p.sample_id + 1 AND p.sample_id % 2 = 0),
           g AS (SELECT sum(sa * sa) + 1e-3 AS aa, sum(sb * sb) + 1e-3 AS bb, sum(sa * sb) AS ab, sum(sa * ma) AS xa, sum(sb * ma) AS ya, sum(sa * mb) AS xb, sum(sb * mb) AS yb FROM m)
           SELECT sample_id, round((sa * (bb * xa - ab * ya) + sb * (aa * ya - ab * xa)) / (aa * bb - ab * ab), 6) + 0.0 AS a, round((sa * (bb * xb - ab * yb) + sb * (aa * yb - ab * xb)) / (aa * bb - ab * ab), 6) + 0.0 AS b FROM m, g""")
def direct_standardization_of_two_channels(spark, sf_dir):
    master, slave = (first_channels(d.drop("label")) for d in pairs(spark, sf_dir))
    both = transfer.apply_matrix(slave.join(master.select("sample_id"), "sample_id", "left_semi"), transfer.fit_ds(master, slave, 2, 1e-3))
    return rounded(both.select("sample_id", F.col("values")[0].alias("a"), F.col("values")[1].alias("b")), "a", "b")


@query(f"""WITH {LONG} SELECT sample_id, CASE WHEN sample_id % 2 = 0 THEN 'A' ELSE 'B' END AS instrument, (ch - 24)::INTEGER AS ch, round(value, 6) + 0.0 AS value FROM lng WHERE ch BETWEEN 24 AND 39""")
def equalized_instruments(spark, sf_dir):
    df, _ = instruments.equalized(two_sources(spark, sf_dir))
    return rounded(df.select("sample_id", "instrument", F.posexplode("values").alias("ch", "value")), "value")


# What follows has no SQL: iterations, random streams of NumPy and fitted models. Tests compare with plain NumPy.


@query()
def pds_transfer(spark, sf_dir):
    return matrix_transfer(spark, sf_dir, lambda m, s, n: {"matrix": transfer.fit_pds(m, s, n)})


@query()
def ctai_transfer(spark, sf_dir):
    return matrix_transfer(spark, sf_dir, lambda m, s, n: dict(zip(("matrix", "offset"), transfer.fit_ctai(m, s, n))))


@query()
def nspfce_transfer(spark, sf_dir):
    return matrix_transfer(spark, sf_dir, lambda m, s, n: transfer.fit_nspfce(m, s, n))


@query()
def jypls_transfer(spark, sf_dir):
    return matrix_transfer(spark, sf_dir, lambda m, s, n: transfer.fit_jypls(m, s, m, "label", most=6))


@query()
def dosc(spark, sf_dir):
    return spectra.long(multivariate.dosc(spectra.from_embeddings(spark, sf_dir), "label"))


def listed(spark, channels) -> object:
    return spark.createDataFrame([(int(c),) for c in channels], "ch int")


def by_fold(spark, sf_dir):
    return moments.by_fold(spectra.from_embeddings(spark, sf_dir), "label")


@query()
def uve_channels(spark, sf_dir):
    import numpy as np

    return listed(spark, np.flatnonzero(wavelengths.uve_of_rows(spectra.from_embeddings(spark, sf_dir), "label")))


@query()
def ipls_intervals(spark, sf_dir):
    return spark.createDataFrame(wavelengths.ipls_of(spark, by_fold(spark, sf_dir), intervals=8), "first int, past int, r2 double")


@query()
def cars_channels(spark, sf_dir):
    return listed(spark, wavelengths.cars_of_rows(spectra.from_embeddings(spark, sf_dir), "label"))


@query()
def vcpa_channels(spark, sf_dir):
    return listed(spark, wavelengths.vcpa_of(spark, by_fold(spark, sf_dir)))


@query()
def uve_spa_channels(spark, sf_dir):
    return listed(spark, wavelengths.uve_spa_of_rows(spectra.from_embeddings(spark, sf_dir), "label", 8))


@query()
def spa_channels(spark, sf_dir):
    return listed(spark, sorted(wavelengths.scored_spa_of(spark, by_fold(spark, sf_dir), 8)))


@query()
def compare_sample_selections(spark, sf_dir):
    return spark.createDataFrame(report.compared_selections(spectra.from_embeddings(spark, sf_dir), 30, "label"), "method string, mean_distance double, min_distance double, coverage double")


@query()
def outlier_report(spark, sf_dir):
    return report.outliers(spectra.from_embeddings(spark, sf_dir), "label")


@query()
def adasyn_balance(spark, sf_dir):
    return spectra.long(resampling.resampled(spectra.from_embeddings(spark, sf_dir), "label", "adasyn"), "label")


@query()
def smote_tomek_balance(spark, sf_dir):
    return spectra.long(resampling.resampled(spectra.from_embeddings(spark, sf_dir), "label", "smote_tomek"), "label")


@query()
def class_search(spark, sf_dir):
    found = search.searched_classes(spectra.from_embeddings(spark, sf_dir), "label", top=False)
    return scoring.composite(found, "classification").select("model", "params", "preprocess", "accuracy", "auc", "score", "rank")


@query()
def search_subsets(spark, sf_dir):
    """Second derivatives, subsets by importance and regions beside full spectra."""
    found = search.searched(spectra.from_embeddings(spark, sf_dir), "label", ("PLS", "Ridge"), ("raw", "snv_deriv"), (7,), orders=(1, 2), counts=search.COUNTS, regions=5, region_size=16, region_step=8)
    return scoring.composite(found).select("model", "params", "preprocess", "deriv", "window", "subset", "n_vars", "rmse", "r2", "regional_rmse", "all_vars", "top_vars", "score", "rank")


# two channels, so that ridge is a pair of equations; folds by id
TWO = "two AS (SELECT vec_id AS id, vec_id % 5 AS fold, embedding[11]::DOUBLE AS a, embedding[41]::DOUBLE AS b, label::DOUBLE AS y FROM embeddings)"
SUMS = "avg(a) AS ma, avg(b) AS mb, avg(y) AS my, count(*) * var_pop(a) AS aa, count(*) * var_pop(b) AS bb, count(*) * covar_pop(a, b) AS ab, count(*) * covar_pop(a, y) AS ay, count(*) * covar_pop(b, y) AS \"by\""


@query(f"""WITH {TWO}, al AS (SELECT unnest([0.001, 0.01, 0.1, 1.0, 10.0]::DOUBLE[]) AS alpha),
           f AS (SELECT k.fold, {SUMS} FROM (SELECT DISTINCT fold FROM two) k JOIN two t ON t.fold <> k.fold GROUP BY k.fold),
           w AS (SELECT {SUMS} FROM two),
           best AS (SELECT alpha, abs(((bb + alpha) * ay - ab * "by")) >= abs(((aa + alpha) * "by" - ab * ay)) AS first FROM w, al),
           c AS (SELECT fold, alpha, 'full' AS subset, ma, mb, my, ((bb + alpha) * ay - ab * "by") / ((aa + alpha) * (bb + alpha) - ab * ab) AS ca, ((aa + alpha) * "by" - ab * ay) / ((aa + alpha) * (bb + alpha) - ab * ab) AS cb FROM f, al
                 UNION ALL SELECT fold, alpha, 'top1', ma, mb, my, CASE WHEN first THEN ay / (aa + alpha) ELSE 0 END, CASE WHEN first THEN 0 ELSE "by" / (bb + alpha) END FROM f JOIN best USING (true) WHERE true),
           e AS (SELECT alpha, subset, c.fold, y, y - (my + ca * (a - ma) + cb * (b - mb)) AS e FROM c JOIN two USING (fold)),
           s AS (SELECT alpha, subset, fold, sqrt(avg(e * e)) AS rmse, 1 - avg(e * e) / var_pop(y) AS r2 FROM e GROUP BY 1, 2, 3)
           SELECT alpha, subset, CASE subset WHEN 'full' THEN 2 ELSE 1 END AS n_vars, CASE WHEN subset = 'full' THEN 'N/A' WHEN first THEN '10.0' ELSE '40.0' END AS all_vars, round(avg(rmse), 6) AS rmse, round(avg(r2), 6) AS r2
           FROM s JOIN best USING (alpha) GROUP BY 1, 2, first""".replace("JOIN best USING (true) WHERE true", "JOIN (SELECT alpha AS best_alpha, first FROM best) ON true JOIN al ON alpha = best_alpha"))
def search_variable_subsets(spark, sf_dir):
    """Remainders of ids are -4 to 4. Rows without an id, a label or one of the channels can be neither learned from nor scored."""
    values = F.array(*[F.get("values", F.lit(k)) for k in (10, 40)])
    two = spectra.from_embeddings(spark, sf_dir).select("sample_id", "label", values.alias("values"), (F.col("sample_id") % 5 + 4).alias("fold"))
    two = two.where("fold IS NOT NULL AND label IS NOT NULL AND values[0] IS NOT NULL AND values[1] IS NOT NULL")
    found = search.searched(two, "label", ("Ridge",), ("raw",), folds=9, counts=(1,), axis=[10.0, 40.0], fold="fold")
    found = found.withColumns({c: F.coalesce(c, F.lit(float("nan"))) for c in ("rmse", "r2")})  # Arrow takes NaN for null
    return rounded(found.select(F.get_json_object("params", "$.alpha").cast("double").alias("alpha"), "subset", "n_vars", "all_vars", "rmse", "r2"), "rmse", "r2")


@query("SELECT unnest(['quick', 'quick', 'quick', 'standard', 'standard', 'standard', 'standard', 'standard', 'standard']) AS tier, unnest(['PLS', 'Ridge', 'ElasticNet', 'PLS', 'Ridge', 'Lasso', 'ElasticNet', 'RandomForest', 'LightGBM']) AS model, unnest([1, 2, 3, 1, 2, 3, 4, 5, 6]) AS place")
def tier_models(spark, sf_dir):
    return spark.createDataFrame([(t, m, k + 1) for t in ("quick", "standard") for k, m in enumerate(registry.tier_models(t))], "tier string, model string, place int")


@query("""WITH c AS (SELECT o_orderpriority AS y, CASE WHEN o_orderkey % 3 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS p FROM orders), k AS (SELECT DISTINCT y AS class FROM c),
          n AS (SELECT class, count(*) FILTER (y = class) AS t, count(*) FILTER (p = class) AS p, count(*) FILTER (y = class AND p = class) AS h FROM c, k GROUP BY class)
          SELECT class, t AS support, round(coalesce(h / nullif(p, 0), 0), 6) AS precision, round(coalesce(h / nullif(t, 0), 0), 6) AS recall, round(coalesce(2.0::DOUBLE * h / nullif(t + p, 0), 0), 6) AS f1 FROM n""")
def class_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("y"), F.when(F.col("o_orderkey") % 3 == 0, "1-URGENT").otherwise(F.col("o_orderpriority")).alias("p"))
    return rounded(scoring.by_class(o, "y", "p"), "precision", "recall", "f1")


@query("""WITH s AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_quantity AS s FROM lineitem), g AS (SELECT s, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY s)
          SELECT round((sum(a.pos * b.neg) FILTER (a.s > b.s) + 0.5 * sum(a.pos * b.neg) FILTER (a.s = b.s)) / ((SELECT sum(pos) FROM g)::DOUBLE * (SELECT sum(neg) FROM g)), 6) AS auc FROM g a, g b""")
def roc_auc(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"), F.col("l_quantity").alias("s"))
    return rounded(scoring.auc(rows, "y", "s"), "auc")


@query()
def predictions_with_trust(spark, sf_dir):
    """Ridge fitted on even samples, for all."""
    s = spectra.from_embeddings(spark, sf_dir)
    even = s.where("sample_id % 2 = 0")
    fitted, rmsecv = moments.fitted_ridge(moments.whole(even, "label"), 1.0), moments.cv_rmse(moments.by_fold(even, "label"), 5)
    return report.predicted(s, fitted, report.domain_of_rows(even), rmsecv).select("sample_id", "pred", "spread", "distance", "trust")


@query()
def instrument_profiles(spark, sf_dir):
    s = spectra.from_embeddings(spark, sf_dir).withColumn("instrument", F.when(F.col("sample_id") % 2 == 0, "even").otherwise("odd"))
    axis = [400.0 + k for k in range(spectra.channels(s))]
    return instruments.characterized(s, "instrument", {"even": axis, "odd": [400 + 2 * (w - 400) for w in axis]})


from prismatic.plans import file_queries  # noqa: E402, F401  registers further queries
