"""Queries of ranking metrics, calibration, sampling and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.functions import scalars as fx
from meridia.operators import diagnostics as dg
from meridia.operators import evaluation as el
from meridia.operators import features as fe
from meridia.operators import metrics as me
from meridia.operators import models as mo
from meridia.plans import frames as fr
from meridia.plans.registry import query


def _scored(spark, sf_dir):
    """Labelled documents: length as the score, toxic as the label, language as the group."""
    d = fr.table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score"))
    lab = fr.table(spark, sf_dir, "labels")
    return lab.join(d, "doc_id").select(F.col("doc_id").alias("row_id"), "lang", "score", F.col("toxic").alias("label"), "quality", (F.least("score", F.lit(5000.0)) / 5000.0).alias("p"))


SCORED = "sc AS (SELECT l.doc_id AS row_id, lang, CAST(n_chars AS DOUBLE) AS score, toxic AS label, quality, least(CAST(n_chars AS DOUBLE), 5000.0) / 5000.0 AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
_AUC = "(SELECT sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) FROM {0} a, {0} b WHERE a.label = 1 AND b.label = 0)"


@query(f"WITH {SCORED} SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS n_events, round({_AUC.format('sc')}, 9) AS auc FROM sc")
def roc_auc(spark, sf_dir):
    return me.roc_auc(_scored(spark, sf_dir)).withColumn("auc", F.round("auc", 9))


@query(f"""WITH {SCORED}, w AS (SELECT a.lang, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) AS auc FROM sc a JOIN sc b ON a.lang = b.lang WHERE a.label = 1 AND b.label = 0 GROUP BY a.lang)
SELECT lang, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_events, CASE WHEN sum(label) >= 15 THEN round(any_value(auc), 9) END AS auc FROM sc LEFT JOIN w USING (lang) GROUP BY lang""")
def subgroup_auc(spark, sf_dir):
    return me.roc_auc(_scored(spark, sf_dir), ("lang",), 15).withColumn("auc", F.round("auc", 9))


@query(f"""WITH {SCORED}, g AS (SELECT score, sum(label) AS pos, count(*) AS n FROM sc GROUP BY score), c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS seen FROM g)
SELECT round(sum(tp / seen * pos) / sum(pos), 9) AS average_precision FROM c""")
def average_precision(spark, sf_dir):
    return me.average_precision(_scored(spark, sf_dir)).select(F.round("average_precision", 9).alias("average_precision"))


@query(f"""WITH {SCORED}, q AS (SELECT label AS y, p, least(greatest(p, 1e-15), 1 - 1e-15) AS c FROM sc)
SELECT round(avg(pow(p - y, 2)), 9) AS brier, round(avg(-(y * ln(c) + (1 - y) * ln(1 - c))), 9) AS log_loss FROM q""")
def brier_log_loss(spark, sf_dir):
    rows = _scored(spark, sf_dir).select(F.col("p").alias("score"), "label")
    return me.brier_log_loss(rows).select(F.round("brier", 9).alias("brier"), F.round("log_loss", 9).alias("log_loss"))


@query(f"""WITH {SCORED}, e AS (SELECT quantile_cont(score, 0.2) AS a, quantile_cont(score, 0.4) AS b, quantile_cont(score, 0.6) AS c, quantile_cont(score, 0.8) AS d FROM sc)
SELECT CAST(score >= a AS BIGINT) + CAST(score >= b AS BIGINT) + CAST(score >= c AS BIGINT) + CAST(score >= d AS BIGINT) AS bin, round(avg(score), 6) AS mean_score, round(avg(label), 9) AS event_rate, count(*) AS n FROM sc, e GROUP BY ALL""")
def calibration_bins(spark, sf_dir):
    return me.calibration(_scored(spark, sf_dir)).select("bin", F.round("mean_score", 6).alias("mean_score"), F.round("event_rate", 9).alias("event_rate"), "n")


@query(f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, row_id) AS rn, count(*) OVER () AS n, sum(label) OVER () AS ev FROM sc), k AS (SELECT * FROM (VALUES (0.01), (0.05), (0.1)) t(rate)),
j AS (SELECT CAST(rate AS DOUBLE) AS rate, greatest(1, CAST(round_even(rate * n, 0) AS BIGINT)) AS k, rn, label, ev FROM r, k)
SELECT rate, k, CAST(sum(label) FILTER (WHERE rn <= k) AS BIGINT) AS true_positives, round(sum(label) FILTER (WHERE rn <= k) / k, 9) AS "precision", round(sum(label) FILTER (WHERE rn <= k) / any_value(ev), 9) AS recall FROM j GROUP BY rate, k""")
def alert_rate_topk(spark, sf_dir):
    out = me.alerts(_scored(spark, sf_dir))
    return out.select("rate", "k", "true_positives", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(f"""WITH {SCORED} SELECT row_id, round(100.0 * (rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0) / count(*) OVER (PARTITION BY lang), 9) AS pct_rank FROM sc""")
def pct_rank_average(spark, sf_dir):
    return me.pct_rank(_scored(spark, sf_dir), ("lang",)).select("row_id", F.round("pct_rank", 9).alias("pct_rank"))


@query(f"""WITH {SCORED}, f AS (SELECT *, quality = 0 AS flag, row_number() OVER (ORDER BY score DESC, row_id) AS rn FROM sc), b AS (SELECT count(*) FILTER (WHERE flag) AS budget FROM f)
SELECT budget, CAST(sum(label) FILTER (WHERE flag) AS BIGINT) AS flag_events, CAST(sum(label) FILTER (WHERE rn <= budget) AS BIGINT) AS score_events, count(*) FILTER (WHERE rn <= budget AND flag) AS overlap,
round(count(*) FILTER (WHERE rn <= budget AND flag) / budget, 9) AS overlap_share FROM f, b GROUP BY budget""")
def matched_budget(spark, sf_dir):
    out = me.matched_budget(_scored(spark, sf_dir).withColumn("flag", F.col("quality") == 0), "flag")
    return out.withColumn("overlap_share", F.round("overlap_share", 9))


_FLAGS = ("has_the", "has_digit", "long_text")


@query("""WITH x AS (SELECT toxic AS label, contains(text, 'the') AS has_the, regexp_matches(text, '[0-9]') AS has_digit, n_chars > 2000 AS long_text FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
u AS (SELECT 'has_the' AS flag, has_the AS f, label FROM x UNION ALL SELECT 'has_digit', has_digit, label FROM x UNION ALL SELECT 'long_text', long_text, label FROM x),
r AS (SELECT flag, avg(CAST(f AS INT)) FILTER (WHERE label = 1) AS a, avg(CAST(f AS INT)) FILTER (WHERE label = 0) AS b FROM u GROUP BY flag)
SELECT flag, round(a, 9) AS event_rate, round(b, 9) AS comparison_rate, round(CASE WHEN b <> 0 THEN a / b END, 9) AS lift FROM r""")
def lift_by_code(spark, sf_dir):
    d = fr.table(spark, sf_dir, "documents").select("doc_id", F.contains("text", F.lit("the")).alias("has_the"), F.col("text").rlike("[0-9]").alias("has_digit"), (F.col("n_chars") > 2000).alias("long_text"))
    rows = fr.table(spark, sf_dir, "labels").join(d, "doc_id").withColumnRenamed("toxic", "label")
    return me.lift(rows, _FLAGS).select("flag", *[F.round(c, 9).alias(c) for c in ("event_rate", "comparison_rate", "lift")])


@query("""WITH x AS (SELECT lang, quality, toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
SELECT lang, quality, toxic, count(*) AS n FROM x GROUP BY GROUPING SETS ((lang, quality, toxic), (quality, toxic))""")
def confusion_counts(spark, sf_dir):
    rows = fr.table(spark, sf_dir, "labels").join(fr.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return me.confusion(rows, "quality", "toxic", "lang")


_Z = 1.959963984540054


@query(f"""WITH g AS (SELECT lang, count(*) FILTER (WHERE toxic = 1) AS k, count(*) AS n FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY lang), p AS (SELECT *, k / n AS p, {_Z} AS z FROM g)
SELECT lang, k, n, round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)), 9) AS low,
round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)), 9) AS high FROM p""")
def wilson_interval(spark, sf_dir):
    rows = fr.table(spark, sf_dir, "labels").join(fr.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    out = me.wilson_rows(rows, ("lang",), F.col("toxic") == 1)
    return out.select("lang", "k", "n", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


def clustered_bootstrap_ci(spark, sf_dir):
    """The whole number of resamples, over clusters of documents."""
    rows = _scored(spark, sf_dir).withColumn("cluster", F.col("row_id") % 50)
    return el.auc_interval(rows, "cluster")


query()(clustered_bootstrap_ci)


@query(f"WITH {fr.YEARLY} SELECT entity, fy, CASE WHEN v IS NULL THEN CASE WHEN lo IS NULL THEN 0.0 ELSE round(lo - 1, 6) END ELSE round(v, 6) END AS score FROM (SELECT entity, fy, -price AS v, min(-price) OVER () AS lo FROM yearly)")
def heuristic_scores(spark, sf_dir):
    return mo.heuristic(fr.yearly(spark, sf_dir), "price", -1).select("entity", "fy", F.round("score", 6).alias("score"))


@query(f"WITH {fr.YEARLY} SELECT fy, feature, round(avg(CAST(v IS NULL AS INT)), 9) AS null_rate FROM (SELECT fy, 'price' AS feature, price AS v FROM yearly UNION ALL SELECT fy, 'duty', duty FROM yearly UNION ALL SELECT fy, 'balance', balance FROM yearly) GROUP BY ALL")
def missingness_profile(spark, sf_dir):
    out = dg.missingness(fr.yearly(spark, sf_dir), ("price", "duty", "balance"), ("fy",))
    return out.withColumn("null_rate", F.round("null_rate", 9))


@query("""WITH r AS (SELECT l_orderkey, l_suppkey, l_discount > 0.09 AS a, l_tax > 0.07 AS b, l_quantity > 45 AS c FROM lineitem)
SELECT rule, n_rows, n_entities FROM (SELECT 'high_discount' AS rule, count(*) FILTER (WHERE a) AS n_rows, count(DISTINCT CASE WHEN a THEN l_suppkey END) AS n_entities FROM r
UNION ALL SELECT 'high_tax', count(*) FILTER (WHERE b), count(DISTINCT CASE WHEN b THEN l_suppkey END) FROM r UNION ALL SELECT 'high_quantity', count(*) FILTER (WHERE c), count(DISTINCT CASE WHEN c THEN l_suppkey END) FROM r
UNION ALL SELECT 'any', count(*) FILTER (WHERE a OR b OR c), count(DISTINCT CASE WHEN a OR b OR c THEN l_suppkey END) FROM r)""")
def impossible_values(spark, sf_dir):
    rules = {"high_discount": F.col("l_discount") > 0.09, "high_tax": F.col("l_tax") > 0.07, "high_quantity": F.col("l_quantity") > 45}
    return dg.impossible_values(fr.table(spark, sf_dir, "lineitem"), rules, "l_suppkey")


@query(f"""WITH {SCORED}, r AS (SELECT *, rank() OVER (ORDER BY score) / count(*) OVER () AS q FROM sc)
SELECT category, count(*) AS n FROM (SELECT CASE WHEN label = 1 AND q < 0.9 AND quality = 0 THEN 'missed_low_quality' WHEN label = 1 AND q < 0.9 THEN 'missed' WHEN label = 0 AND q >= 0.9 THEN 'false_alert' ELSE 'right' END AS category FROM r) GROUP BY category""")
def error_taxonomy(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    s = me.running(rows.groupBy("score").agg(F.count(F.lit(1)).alias("k")), "score", "k")
    # One row.
    s = s.join(F.broadcast(s.agg(F.sum("k").alias("n")))).select("score", ((F.col("upto") - F.col("k") + 1) / F.col("n")).alias("q"))
    cases = [("missed_low_quality", (F.col("label") == 1) & (F.col("q") < 0.9) & (F.col("quality") == 0)), ("missed", (F.col("label") == 1) & (F.col("q") < 0.9)), ("false_alert", (F.col("label") == 0) & (F.col("q") >= 0.9))]
    return dg.taxonomy(rows.join(s, "score"), cases, "right")


@query("""WITH o AS (SELECT o_orderkey AS row_id, o_totalprice AS size, o_orderstatus = 'F' AS event FROM orders), b AS (SELECT quantile_cont(size, 0.1) AS lo, quantile_cont(size, 0.9) AS hi FROM o WHERE event)
SELECT count(*) AS n, count(*) FILTER (WHERE event) AS n_events, round(min(size), 2) AS least, round(max(size), 2) AS most FROM o, b WHERE event OR size BETWEEN lo AND hi""")
def size_band_match(spark, sf_dir):
    o = fr.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("size"), (F.col("o_orderstatus") == "F").alias("event"))
    out = dg.size_band(o, "size", "event")
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if("event").alias("n_events"), F.round(F.min("size"), 2).alias("least"), F.round(F.max("size"), 2).alias("most"))


@query("""WITH e AS (SELECT quantile_cont(o_totalprice, 1.0/3) AS a, quantile_cont(o_totalprice, 2.0/3) AS b FROM orders)
SELECT CASE WHEN o_totalprice <= a THEN 1 WHEN o_totalprice <= b THEN 2 ELSE 3 END AS tercile, count(*) AS n FROM orders, e GROUP BY ALL""")
def size_tercile(spark, sf_dir):
    o = fr.table(spark, sf_dir, "orders")
    return dg.quantile_bucket(o, "o_totalprice", 3, "tercile").groupBy("tercile").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {fr.YEARLY} SELECT entity, count(price) AS n, round(regr_slope(price, fy), 4) AS slope FROM yearly WHERE price IS NOT NULL GROUP BY entity HAVING count(*) >= 3")
def ols_slope_shape(spark, sf_dir):
    return dg.ols_slope(fr.yearly(spark, sf_dir), ("entity",), "price", "fy").withColumn("slope", F.round("slope", 4))


@query("""WITH y AS (SELECT year(o_orderdate) AS fy, count(*) FILTER (WHERE o_orderstatus = 'F') AS quota FROM orders GROUP BY ALL), c AS (SELECT year(o_orderdate) AS fy, o_orderkey, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey % 97, o_orderkey) AS rn FROM orders WHERE o_orderstatus <> 'F')
SELECT CAST(c.fy AS BIGINT) AS fy, o_orderkey AS row_id FROM c JOIN y ON c.fy = y.fy WHERE rn <= quota""")
def year_matched_sample(spark, sf_dir):
    o = fr.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.year("o_orderdate").cast("long").alias("fy"), (F.col("o_orderstatus") == "F").alias("event"))
    return dg.matched_sample(o, "fy", "event", [F.col("row_id") % 97, F.col("row_id")]).select("fy", "row_id")


def logistic_hazard(spark, sf_dir):
    rows = _features(spark, sf_dir)
    model = mo.logistic(FEATURES, n=rows.count()).fit(rows)
    return mo.score(model, rows).select("row_id", F.round("score", 6).alias("score"))


def linear_attribution(spark, sf_dir):
    rows = _features(spark, sf_dir)
    model = mo.logistic(FEATURES, n=rows.count()).fit(rows)
    parts = mo.contributions(model, rows, FEATURES, ("row_id",))
    return parts.withColumn("contribution", F.round("contribution", 6))


FEATURES = ("log_chars", "n_lines", "digit_share")


def _features(spark, sf_dir):
    text = F.col("text")
    d = fr.table(spark, sf_dir, "documents").select(F.col("doc_id"), fx.log_positive(F.col("n_chars")).alias("log_chars"), F.size(F.split(text, "\n")).cast("double").alias("n_lines"), fx.safe_ratio(F.length(F.regexp_replace(text, "[^0-9]", "")), F.length(text)).alias("digit_share"))
    return fr.table(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("doc_id").alias("row_id"), F.col("toxic").alias("label"), *FEATURES)


query()(logistic_hazard)
query()(linear_attribution)


@query(f"WITH {SCORED} SELECT round(({_AUC.format('sc').replace('a.score', 'a.quality').replace('b.score', 'b.quality')}) - ({_AUC.format('sc')}), 9) AS delta, CAST(NULL AS DOUBLE) AS low, 2 AS n_clusters")
def paired_delta_few_clusters(spark, sf_dir):
    """A difference without an interval: two clusters are too few."""
    rows = _scored(spark, sf_dir).select(F.col("score").alias("score_a"), F.col("quality").cast("double").alias("score_b"), "label", (F.col("row_id") % 2).alias("cluster"))
    out = el.delta_auc(rows, "cluster", samples=50)
    return out.select(F.round("delta", 9).alias("delta"), "low", "n_clusters")


@query()
def paired_delta_interval(spark, sf_dir):
    rows = _scored(spark, sf_dir).select(F.col("score").alias("score_a"), F.col("quality").cast("double").alias("score_b"), "label", (F.col("row_id") % 50).alias("cluster"))
    return el.delta_auc(rows, "cluster")


@query(f"""WITH {SCORED}, x AS (SELECT score, label, unnest(['all', CASE WHEN lang = 'en' THEN 'english' END, CASE WHEN lang <> 'en' THEN 'but_english' END, CASE WHEN row_id % 10 < 3 THEN 'held_out' END]) AS slice FROM sc),
w AS (SELECT a.slice, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) AS auc FROM x a JOIN x b USING (slice) WHERE a.label = 1 AND b.label = 0 GROUP BY a.slice)
SELECT slice, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_events, round(any_value(auc), 9) AS auc FROM x LEFT JOIN w USING (slice) WHERE slice IS NOT NULL GROUP BY slice""")
def robustness_slices(spark, sf_dir):
    slices = {"all": F.lit(True), "english": F.col("lang") == "en", "but_english": F.col("lang") != "en", "held_out": F.col("row_id") % 10 < 3}
    return el.by_slices(_scored(spark, sf_dir), slices).withColumn("auc", F.round("auc", 9))


@query(f"WITH {SCORED}, y AS (SELECT score, CAST(quality = 0 AS INT) AS label FROM sc) SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS n_events, round({_AUC.format('y')}, 9) AS auc FROM y")
def cohort_separability(spark, sf_dir):
    """The score under another question."""
    rows = el.relabelled(_scored(spark, sf_dir), F.col("quality") == 0)
    return me.roc_auc(rows).withColumn("auc", F.round("auc", 9))


@query("SELECT name, family, n FROM (VALUES " + ", ".join(f"('{s.name}', '{s.family}', {len(s.features)})" for s in el.specs()) + ") t(name, family, n)")
def model_specs(spark, sf_dir):
    del sf_dir
    return spark.createDataFrame([(s.name, s.family, len(s.features)) for s in el.specs()], "name string, family string, n int")


@query("SELECT family, count(*) AS n FROM (VALUES " + ", ".join(f"('{f.family}')" for f in fe.FEATURES) + ") t(family) GROUP BY family")
def feature_catalog(spark, sf_dir):
    del sf_dir
    return fe.catalog_frame(spark).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


def _dated(spark, sf_dir):
    """Documents as observations: three features under catalog names, years by id."""
    rows = _features(spark, sf_dir)
    years = (F.lit(2000) + F.col("row_id") % 6).cast("int")
    return rows.select("row_id", years.alias("year"), "label", F.col("log_chars").alias("log_total_assets"), F.col("n_lines").cast("double").alias("log_revenue"), F.when(F.col("row_id") % 4 != 0, F.col("digit_share")).alias("cash_to_assets"))


_SMALL = ("log_total_assets", "log_revenue", "cash_to_assets")


@query()
def walk_forward_scores(spark, sf_dir):
    """Out-of-fold scores of a heuristic and of a logistic regression, pooled."""
    rows = _dated(spark, sf_dir)
    out = None
    for spec in (el.Spec("by_size", "heuristic", _SMALL[:1]), el.Spec("logistic", "logistic", _SMALL)):
        part = el.walk_forward(spec, rows, (2003, 2004, 2005), ("row_id", "label")).withColumn("model", F.lit(spec.name))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("score", F.round("score", 6))


@query()
def gradient_boosting(spark, sf_dir):
    """All rounds of boosting on one fold."""
    rows = _dated(spark, sf_dir)
    spec = el.Spec("boosting", "gradient_boosting", _SMALL)
    return el.walk_forward(spec, rows, (2005,), ("row_id", "label")).withColumn("score", F.round("score", 6))


@query()
def calibration_fit(spark, sf_dir):
    rows = _scored(spark, sf_dir).select(F.col("p").alias("score"), "label")
    slope, intercept = el.calibration_fit(rows)
    return spark.createDataFrame([(slope, intercept)], "slope double, intercept double").select(F.round("slope", 5).alias("slope"), F.round("intercept", 5).alias("intercept"))


@query()
def permutation_importance(spark, sf_dir):
    rows = _dated(spark, sf_dir).where("label is not null")
    spec = el.Spec("logistic", "logistic", _SMALL)
    model = el.fit(spec, rows)
    found = el.permutation_importance(rows, _SMALL, lambda r: el.score(spec, model, r), "row_id", repeats=2)
    return spark.createDataFrame(found, "feature string, auc_drop double, share_positive double")


@query()
def attribution_shares(spark, sf_dir):
    """Out-of-fold contributions: sizes, shares of missing marks, and how exactly they add up."""
    rows = _dated(spark, sf_dir)
    parts = el.out_of_fold_parts(el.Spec("logistic", "logistic", _SMALL), rows, (2004, 2005), ("row_id",))
    bucket = F.when(F.col("feature").endswith("__missing"), F.lit("missingness")).otherwise(F.lit("size"))
    shares = el.artefact_shares(parts.withColumn("bucket", bucket), ("fold",))
    return shares.select("fold", F.round("missingness_share", 5).alias("missingness_share"), F.round("artefact_share", 5).alias("artefact_share"))
