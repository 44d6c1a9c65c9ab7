"""Queries over the given tables, each by the library's operators, with the same question in SQL. Spectra are the rows of `embeddings`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismatic.functions import arrays
from prismatic.operators import balance, diagnostics, ensemble, relational, scoring, screening, spectra, transfer

LONG = "lng AS (SELECT vec_id AS sample_id, label, unnest(generate_series(0, len(embedding) - 1))::INTEGER AS ch, unnest(embedding)::DOUBLE AS value FROM embeddings)"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *cols: str, to: int = 6) -> DataFrame:
    """cols to so many decimals, without a negative zero."""
    return df.withColumns({c: F.round(F.col(c), to) + 0.0 for c in cols})


def mapped(spark: SparkSession, sf_dir: str, f) -> DataFrame:
    """Long rows of spectra whose values are f of the column and the number of channels."""
    s = spectra.from_embeddings(spark, sf_dir)
    out = spectra.long(s.withColumn("values", f(F.col("values"), spectra.channels(s))))
    return rounded(out.select(F.col("sample_id"), "ch", "value"), "value")


@query(f"""WITH {LONG} SELECT sample_id, ch, round((value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w = 0 THEN 1 ELSE stddev_pop(value) OVER w END, 6) + 0.0 AS value
           FROM lng WINDOW w AS (PARTITION BY sample_id)""")
def snv_long(spark, sf_dir):
    return mapped(spark, sf_dir, lambda v, n: arrays.snv(v))


@query(f"WITH {LONG} SELECT sample_id, ch, round(log10(1.0 / greatest(value, 1e-6)), 6) + 0.0 AS value FROM lng")
def absorbance(spark, sf_dir):
    return mapped(spark, sf_dir, lambda v, n: arrays.absorbance(v))


# weights of a seven-point fit about its centre: first derivative k/28, half the second (k^2-4)/84, a sixth of the third (k^3-7k)/216
SAVGOL = """WITH {long}, n AS (SELECT max(ch) AS last FROM lng),
    c AS (SELECT sample_id, ch, least(greatest(ch, 3), last - 3) AS centre FROM lng, n)
    SELECT c.sample_id, c.ch, round({what}, 6) + 0.0 AS value
    FROM c JOIN lng ON lng.sample_id = c.sample_id AND lng.ch BETWEEN centre - 3 AND centre + 3 GROUP BY c.sample_id, c.ch, centre"""
K = "(lng.ch - centre)"


@query(SAVGOL.format(long=LONG, what=f"sum({K} * value) / 28 + 2 * (c.ch - centre) * sum(({K} * {K} - 4) * value) / 84"))
def savgol_first(spark, sf_dir):
    return mapped(spark, sf_dir, lambda v, n: arrays.savgol(v, n, 7, deriv=1))


@query(SAVGOL.format(long=LONG, what=f"2 * sum(({K} * {K} - 4) * value) / 84 + 6 * (c.ch - centre) * sum(({K} * {K} * {K} - 7 * {K}) * value) / 216"))
def savgol_second(spark, sf_dir):
    return mapped(spark, sf_dir, lambda v, n: arrays.savgol(v, n, 7, deriv=2))


@query(f"""WITH {LONG}, s AS (SELECT sample_id, regr_slope(value, ch) AS b, regr_intercept(value, ch) AS a FROM lng GROUP BY sample_id)
           SELECT sample_id, ch, round(value - a - b * ch, 6) + 0.0 AS value FROM lng JOIN s USING (sample_id)""")
def detrend_linear(spark, sf_dir):
    return mapped(spark, sf_dir, lambda v, n: arrays.detrended(v, n, 1))


@query(f"""WITH {LONG}, m AS (SELECT ch, avg(value) AS ref FROM lng GROUP BY ch), j AS (SELECT * FROM lng JOIN m USING (ch)),
           s AS (SELECT sample_id, regr_slope(value, ref) AS b, regr_intercept(value, ref) AS a FROM j GROUP BY sample_id)
           SELECT sample_id, ch, round((value - a) / b, 4) + 0.0 AS value FROM j JOIN s USING (sample_id)""")
def msc(spark, sf_dir):
    return rounded(spectra.long(spectra.msc(spectra.from_embeddings(spark, sf_dir))), "value", to=4)


@query(f"""WITH {LONG}, v AS (SELECT ch, 1 / (var_pop(value) + 1e-6) AS w FROM lng GROUP BY ch)
           SELECT sample_id, ch, round(value * sqrt(w / (SELECT avg(w) FROM v)), 6) + 0.0 AS value FROM lng JOIN v USING (ch)""")
def glsw(spark, sf_dir):
    return rounded(spectra.long(spectra.glsw(spectra.from_embeddings(spark, sf_dir))), "value")


@query(f"WITH {LONG} SELECT sample_id, (row_number() OVER (PARTITION BY sample_id ORDER BY ch) - 1)::INTEGER AS ch, round(value, 6) + 0.0 AS value FROM lng WHERE ch NOT BETWEEN 14 AND 19 AND ch NOT BETWEEN 40 AND 44")
def wavelength_exclude(spark, sf_dir):
    return mapped(spark, sf_dir, lambda v, n: arrays.chosen(v, arrays.kept_channels(list(range(n)), [(14, 19), (40, 44)])))


@query(f"WITH {LONG} SELECT sample_id, ch - 8 AS ch, round(value, 6) + 0.0 AS value FROM lng WHERE ch BETWEEN 8 AND 31")
def wavelength_trim(spark, sf_dir):
    return mapped(spark, sf_dir, lambda v, n: arrays.chosen(v, arrays.kept_channels(list(range(n)), [(8, 31)], invert=True)))


@query(f"""WITH {LONG}, t AS (SELECT i::INTEGER AS i, i * 0.75 AS x FROM generate_series(0, 79) g(i)),
           b AS (SELECT i, x, least(floor(x), 62)::INTEGER AS lo FROM t)
           SELECT a.sample_id, b.i AS ch, round(a.value + (x - lo) * (z.value - a.value), 6) + 0.0 AS value
           FROM b JOIN lng a ON a.ch = b.lo JOIN lng z ON z.ch = b.lo + 1 AND z.sample_id = a.sample_id""")
def resample_linear(spark, sf_dir):
    return mapped(spark, sf_dir, lambda v, n: arrays.resampled(v, [float(i) for i in range(n)], [i * 0.75 for i in range(80)]))


@query(f"WITH {LONG}, r AS (SELECT ch, corr(value, label) AS r FROM lng GROUP BY ch ORDER BY abs(r) DESC, ch LIMIT 20) SELECT ch, round(r, 6) + 0.0 AS r FROM r")
def predictor_screening(spark, sf_dir):
    return rounded(screening.screened(spectra.long(spectra.from_embeddings(spark, sf_dir), "label"), "label", 20), "r")


REGIONS = f"""WITH {LONG}, r AS (SELECT ch, abs(corr(value, label)) AS a FROM lng GROUP BY ch),
    w AS (SELECT s.start::INTEGER AS start, avg(a) AS mean_corr, max(a) AS max_corr, count(*) AS n FROM generate_series(0, 56, 8) s(start) JOIN r ON ch >= s.start AND ch < s.start + 16 GROUP BY 1)"""


def found_regions(spark, sf_dir) -> DataFrame:
    rows = spectra.long(spectra.from_embeddings(spark, sf_dir), "label")
    return screening.regions(screening.channel_correlations(rows, "label"), 56)


@query(REGIONS + " SELECT start, round(mean_corr, 6) AS mean_corr, round(max_corr, 6) AS max_corr, n FROM w")
def region_correlations(spark, sf_dir):
    return rounded(found_regions(spark, sf_dir), "mean_corr", "max_corr")


@query(REGIONS + " SELECT start, round(mean_corr, 6) AS mean_corr FROM w ORDER BY w.mean_corr DESC, start LIMIT 3")
def top_regions(spark, sf_dir):
    return rounded(found_regions(spark, sf_dir).orderBy(F.desc("mean_corr"), "start").limit(3).select("start", "mean_corr"), "mean_corr")


@query("SELECT p_partkey, lower(replace(regexp_replace(p_name || ' X.ASD', '\\.(asd|sig|csv|txt|spc)$', '', 'i'), ' ', '')) AS id FROM part")
def normalise_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", relational.normalized_id(F.concat("p_name", F.lit(" X.ASD"))).alias("id"))


@query("SELECT c_custkey AS k, c_name, o_orderkey, o_totalprice FROM (SELECT *, 'Cust ' || c_custkey || '.asd' AS id FROM customer) c JOIN orders o ON lower(replace(replace(id, '.asd', ''), ' ', '')) = 'cust' || o_custkey WHERE o_totalprice IS NOT NULL")
def align_normalised(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name", F.concat(F.lit("Cust "), F.col("c_custkey").cast("string"), F.lit(".asd")).alias("id"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.concat(F.lit("CUST"), F.col("o_custkey").cast("string")).alias("id"))
    return relational.aligned(c, o, "id", "o_totalprice").drop("id")


@query("SELECT c_custkey AS id, 'spectra' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_custkey, 'reference' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def align_unmatched(spark, sf_dir):
    return relational.unmatched(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), "id")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def dedup_keep_first(spark, sf_dir):
    return relational.first_of_each(table(spark, sf_dir, "events"), "user_id", ["event_id"]).select("user_id", "event_id", "event_type")


def two_sources(spark, sf_dir) -> dict:
    s = spectra.from_embeddings(spark, sf_dir).drop("label")
    part = lambda lo, hi: F.slice("values", lo + 1, hi - lo)
    return {"A": (s.where("sample_id % 2 = 0").withColumn("values", part(0, 40)), [float(i) for i in range(40)]), "B": (s.where("sample_id % 2 = 1").withColumn("values", part(24, 64)), [float(i) for i in range(24, 64)])}


def merged(spark, sf_dir, how) -> DataFrame:
    df, axis = relational.merged(two_sources(spark, sf_dir), how)
    at = F.array(*map(F.lit, axis))
    return rounded(df.select("sample_id", "datasource", F.posexplode("values").alias("p", "value")).select("sample_id", "datasource", at[F.col("p")].alias("wl"), "value"), "value")


@query(f"WITH {LONG} SELECT sample_id, CASE WHEN sample_id % 2 = 0 THEN 'A' ELSE 'B' END AS datasource, ch::DOUBLE AS wl, round(value, 6) + 0.0 AS value FROM lng WHERE ch BETWEEN 24 AND 39")
def merge_intersection(spark, sf_dir):
    return merged(spark, sf_dir, "intersection")


@query(f"WITH {LONG} SELECT sample_id, CASE WHEN sample_id % 2 = 0 THEN 'A' ELSE 'B' END AS datasource, ch::DOUBLE AS wl, CASE WHEN (sample_id % 2 = 0 AND ch < 40) OR (sample_id % 2 = 1 AND ch >= 24) THEN round(value, 6) + 0.0 END AS value FROM lng")
def merge_union(spark, sf_dir):
    return merged(spark, sf_dir, "union")


@query("SELECT doc_id, source FROM documents WHERE regexp_matches(source, '[37]$')")
def filter_regex(spark, sf_dir):
    return relational.filtered(table(spark, sf_dir, "documents").select("doc_id", "source"), "regex", "[37]$", "source")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
def filter_range(spark, sf_dir):
    return relational.filtered(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "range", (10, 12), "l_quantity")


@query("SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'view')")
def filter_list(spark, sf_dir):
    return relational.filtered(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "list", ["click", "view"], "event_type")


@query("""WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), r AS (SELECT count(*) AS n_classes, max(n) AS largest, min(n) AS smallest, max(n) / min(n) AS ratio FROM n)
          SELECT n_classes, largest, smallest, round(ratio, 6) AS ratio, CASE WHEN ratio < 3 THEN 'none' WHEN ratio < 5 THEN 'moderate' WHEN ratio < 10 THEN 'severe' ELSE 'extreme' END AS severity FROM r""")
def class_imbalance(spark, sf_dir):
    return rounded(balance.class_imbalance(table(spark, sf_dir, "embeddings"), "label"), "ratio")


BINS = "m AS (SELECT min(value) AS lo, max(value) AS hi FROM events)"


@query(f"WITH {BINS}, b AS (SELECT least(9, floor((value - lo) / ((hi - lo) / 10)))::INTEGER AS bin, count(*) AS n FROM events, m GROUP BY 1) SELECT g.i::INTEGER AS bin, coalesce(n, 0) AS n FROM generate_series(0, 9) g(i) LEFT JOIN b ON bin = i")
def regression_bins(spark, sf_dir):
    return balance.bin_counts(table(spark, sf_dir, "events"), "value", 10)


@query(f"""WITH {BINS}, r AS (SELECT event_id, floor((value - lo) / ((hi - lo) / 5))::INTEGER AS bin FROM events, m), n AS (SELECT bin, count(*) AS n FROM r GROUP BY bin),
           w AS (SELECT event_id, bin, (SELECT sum(n) FROM n) / ((SELECT count(*) FROM n) * n) AS w FROM r JOIN n USING (bin)) SELECT event_id, bin, round(w / avg(w) OVER (), 6) AS weight FROM w""")
def bin_weights(spark, sf_dir):
    return rounded(balance.bin_weights(table(spark, sf_dir, "events").select("event_id", "value"), "value", 5).select("event_id", "bin", "weight"), "weight")


@query(f"""WITH {BINS}, r AS (SELECT event_id, value, least(9, floor((value - lo) / ((hi - lo) / 10)))::INTEGER AS bin FROM events, m), n AS (SELECT bin, count(*) AS n FROM r GROUP BY bin),
           k AS (SELECT floor(quantile_cont(n, 0.5)) AS k FROM n) SELECT event_id, bin FROM r, k QUALIFY row_number() OVER (PARTITION BY bin ORDER BY event_id) <= any_value(k) OVER ()""")
def undersample_bins(spark, sf_dir):
    return balance.undersampled(table(spark, sf_dir, "events").select("event_id", "value"), "value", ["event_id"]).select("event_id", "bin")


PREDICTED = "l_extendedprice AS y, l_quantity * 1500.0 AS pred"


@query(f"WITH r AS (SELECT l_orderkey, l_linenumber, y - pred AS residual FROM (SELECT *, {PREDICTED} FROM lineitem)) SELECT l_orderkey, l_linenumber, round(residual, 4) + 0.0 AS residual, round(residual / stddev_pop(residual) OVER (), 6) + 0.0 AS standardized FROM r")
def residual_diagnostics(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("pred"))
    return rounded(rounded(diagnostics.residuals(rows, "y", "pred").select("l_orderkey", "l_linenumber", "residual", "standardized"), "residual", to=4), "standardized")


@query("WITH z AS (SELECT event_id, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS z, value FROM events) SELECT event_id, round(z, 6) + 0.0 AS z, abs(z) > 3 OR value > 100 AS is_outlier FROM z")
def zscore_outliers(spark, sf_dir):
    return rounded(diagnostics.z_outliers(table(spark, sf_dir, "events").select("event_id", "value"), "value", 3.0, upper=100.0).select("event_id", "z", "is_outlier"), "z")


@query("WITH m AS (SELECT quantile_cont(value, 0.5) AS m FROM events), d AS (SELECT quantile_cont(abs(value - m), 0.5) AS d FROM events, m) SELECT event_id, value > m + 3 * d AS is_outlier FROM events, m, d")
def mad_outliers(spark, sf_dir):
    return diagnostics.mad_outliers(table(spark, sf_dir, "events").select("event_id", "value"), "value").select("event_id", "is_outlier")


@query(f"WITH {LONG}, d AS (SELECT sample_id, value - 2 * lag(value) OVER w + lag(value, 2) OVER w AS d FROM lng WINDOW w AS (PARTITION BY sample_id ORDER BY ch)) SELECT sample_id, round(avg(d * d), 8) AS roughness FROM d GROUP BY sample_id")
def spectrum_roughness(spark, sf_dir):
    return rounded(spectra.from_embeddings(spark, sf_dir).select("sample_id", arrays.roughness(F.col("values")).alias("roughness")), "roughness", to=8)


CONFIGS = """r AS (SELECT l_suppkey AS config, sqrt(avg(power(l_extendedprice - l_quantity * 1500.0, 2))) AS rmse, 1 - sum(power(l_extendedprice - l_quantity * 1500.0, 2)) / sum(power(l_extendedprice - 38000.0, 2)) AS r2,
             l_suppkey % 40 + 1 AS n_vars, 64 AS full_vars, CASE l_suppkey % 4 WHEN 0 THEN l_suppkey % 30 + 1 END AS lvs,
             CASE l_suppkey % 4 WHEN 1 THEN 0.25 WHEN 2 THEN 0.8 ELSE 0.5 END AS kind FROM lineitem GROUP BY l_suppkey)"""


@query(f"""WITH {CONFIGS}, z AS (SELECT config, 0.5 * (rmse - avg(rmse) OVER ()) / stddev_samp(rmse) OVER () - 0.5 * (r2 - avg(r2) OVER ()) / stddev_samp(r2) OVER () + 0.09 * n_vars / full_vars + 0.25 * coalesce(CASE WHEN lvs IS NOT NULL THEN least(lvs / 25.0, 1) END, kind) AS score FROM r)
           SELECT config, round(score, 5) + 0.0 AS score, rank() OVER (ORDER BY z.score)::INTEGER AS rank FROM z""")
def composite_score_rank(spark, sf_dir):
    e = F.col("l_extendedprice") - F.col("l_quantity") * 1500.0
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("config")).agg(F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / F.sum(F.pow(F.col("l_extendedprice") - 38000.0, 2))).alias("r2"))
    g = g.withColumn("n_vars", F.col("config") % 40 + 1).withColumn("full_vars", F.lit(64))
    kind, lvs = F.col("config") % 4, (F.col("config") % 30 + 1).cast("int")
    g = g.withColumn("model", F.when(kind == 0, "PLS").when(kind == 1, "Ridge").when(kind == 2, "MLP").otherwise("Other")).withColumn("lvs", F.when(kind == 0, lvs))
    return rounded(scoring.composite(g, variable_penalty=3.0, complexity_penalty=5.0).select("config", "score", "rank"), "score", to=5)


@query("""WITH p AS (SELECT toxic AS y, CASE WHEN length(text) > 1500 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)),
          c AS (SELECT k.c, count(*) FILTER (y = c) AS t, count(*) FILTER (p = c) AS s, count(*) FILTER (y = c AND p = c) AS h FROM p, (VALUES (0), (1)) k(c) GROUP BY k.c)
          SELECT round(sum(h) / sum(t), 6) AS accuracy, round(avg(h / t), 6) AS balanced_accuracy, round(avg(2.0 * h / (t + s)), 6) AS f1_macro, round(sum(2.0 * h / (t + s) * t) / sum(t), 6) AS f1_weighted FROM c""")
def class_metrics(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.char_length("text") > 1500, 1).otherwise(0).alias("p"))
    m = scoring.class_metrics(table(spark, sf_dir, "labels").join(d, "doc_id"), "toxic", "p")
    return rounded(m.select("accuracy", "balanced_accuracy", "f1_macro", "f1_weighted"), "accuracy", "balanced_accuracy", "f1_macro", "f1_weighted")


TSR = f"""WITH {LONG}, b AS (SELECT a.ch, a.value AS m, s.value AS s FROM lng a JOIN lng s ON s.ch = a.ch AND s.sample_id = a.sample_id + 1 AND a.sample_id % 2 = 0),
    f AS (SELECT ch, regr_slope(m, s) AS slope, regr_intercept(m, s) AS intercept, regr_r2(m, s) AS r2 FROM b GROUP BY ch)"""


def tsr(spark, sf_dir):
    """Even samples as a master's, each with its odd neighbour as the slave's."""
    s = spectra.from_embeddings(spark, sf_dir).drop("label")
    slave = s.where("sample_id % 2 = 1").withColumn("sample_id", F.col("sample_id") - 1)
    return transfer.fit_tsr(spectra.long(s.where("sample_id % 2 = 0")), spectra.long(slave)), s


@query(TSR + " SELECT ch, round(slope, 6) + 0.0 AS slope, round(intercept, 6) + 0.0 AS intercept, round(r2, 6) + 0.0 AS r2 FROM f")
def tsr_fit(spark, sf_dir):
    return rounded(tsr(spark, sf_dir)[0], "slope", "intercept", "r2")


@query(TSR + " SELECT sample_id, ch, round(value * slope + intercept, 6) + 0.0 AS value FROM lng JOIN f USING (ch)")
def tsr_apply(spark, sf_dir):
    fitted, s = tsr(spark, sf_dir)
    return rounded(spectra.long(transfer.apply_tsr(s, fitted)), "value")


MODELS = "p AS (SELECT o_orderkey AS id, 'a' AS model, o_totalprice AS y, o_totalprice * 0.9 + (o_orderkey % 13) * 100 AS pred FROM orders UNION ALL SELECT o_orderkey, 'b', o_totalprice, o_totalprice * 1.05 - (o_orderkey % 7) * 300 FROM orders), q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS q2, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)"
REGION = "(CASE WHEN {0} >= q1 THEN 1 ELSE 0 END + CASE WHEN {0} >= q2 THEN 1 ELSE 0 END + CASE WHEN {0} >= q3 THEN 1 ELSE 0 END)"
ERRORS = f"e AS (SELECT model, {REGION.format('y')} AS region, count(*) AS n, sqrt(avg((y - pred) * (y - pred))) AS rmse, avg(abs(y - pred)) AS mae FROM p, q GROUP BY 1, 2)"


def two_models(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("y"))
    a = o.select("id", F.lit("a").alias("model"), "y", (F.col("y") * 0.9 + F.col("id") % 13 * 100).alias("pred"))
    return a.unionByName(o.select("id", F.lit("b").alias("model"), "y", (F.col("y") * 1.05 - F.col("id") % 7 * 300).alias("pred")))


@query(f"WITH {MODELS}, {ERRORS} SELECT model, region, n, round(rmse, 3) AS rmse, round(mae, 3) AS mae FROM e")
def regional_errors(spark, sf_dir):
    p = two_models(spark, sf_dir)
    return rounded(ensemble.regional_errors(p, ensemble.quartile_edges(p.where("model = 'a'"), "y")), "rmse", "mae", to=3)


@query(f"""WITH {MODELS}, {ERRORS}, w AS (SELECT model, region, 1 / (rmse + 1e-6) AS w FROM e), m AS (SELECT id, avg(pred) AS m FROM p GROUP BY id), g AS (SELECT id, {REGION.format('m')} AS region FROM m, q)
           SELECT p.id, round(sum(pred * w) / sum(w), 3) AS pred FROM p JOIN g USING (id) JOIN w USING (model, region) GROUP BY p.id""")
def region_weighted_ensemble(spark, sf_dir):
    p = two_models(spark, sf_dir)
    edges = ensemble.quartile_edges(p.where("model = 'a'"), "y")
    return rounded(ensemble.region_weighted(p, ensemble.regional_weights(ensemble.regional_errors(p, edges)), edges), "pred", to=3)


@query(f"WITH {MODELS} SELECT id, round(sum(pred * CASE model WHEN 'a' THEN 0.8::DOUBLE ELSE 0.95::DOUBLE END) / sum(CASE model WHEN 'a' THEN 0.8::DOUBLE ELSE 0.95::DOUBLE END), 6) AS pred FROM p GROUP BY id")
def quality_consensus(spark, sf_dir):
    r2 = spark.createDataFrame([("a", 0.8), ("b", 0.95)], "model string, r2 double")
    return rounded(ensemble.quality_consensus(two_models(spark, sf_dir), r2), "pred", to=6)


@query()
def pls_search(spark, sf_dir):
    from prismatic.operators import search

    found = search.searched(spectra.from_embeddings(spark, sf_dir), "label")
    return scoring.composite(found).select("model", "params", "preprocess", "deriv", "window", "rmse", "r2", "pooled_r2", "score", "rank")


@query()
def pca_outliers(spark, sf_dir):
    from prismatic.operators import multivariate

    return multivariate.pca_outliers(spectra.from_embeddings(spark, sf_dir))


@query()
def leverage(spark, sf_dir):
    from prismatic.operators import multivariate

    return multivariate.leverage(spectra.from_embeddings(spark, sf_dir))


@query()
def als_baseline(spark, sf_dir):
    from prismatic.operators import multivariate

    return spectra.long(multivariate.als_corrected(spectra.from_embeddings(spark, sf_dir)))


@query()
def epo(spark, sf_dir):
    from prismatic.operators import multivariate

    s = spectra.from_embeddings(spark, sf_dir)
    return spectra.long(multivariate.orthogonalized(s, s.where("label = 0")))


@query()
def direct_standardization(spark, sf_dir):
    s = spectra.from_embeddings(spark, sf_dir).drop("label")
    slave = s.where("sample_id % 2 = 1").withColumn("sample_id", F.col("sample_id") - 1)
    return spectra.long(transfer.apply_matrix(slave, transfer.fit_ds(s.where("sample_id % 2 = 0"), slave, spectra.channels(s), 1e-3)))


@query()
def smote_balance(spark, sf_dir):
    from prismatic.operators import multivariate

    return spectra.long(multivariate.smote(spectra.from_embeddings(spark, sf_dir), "label"), "label")


from prismatic.plans import model_queries  # noqa: E402, F401  registers further queries
