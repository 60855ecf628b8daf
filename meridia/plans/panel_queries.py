"""Queries of event labels, folds, leakage, the store and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.operators import evidence as ev
from meridia.operators import folds as fd
from meridia.operators import labels as lb
from meridia.operators import store as st
from meridia.plans import frames as fr
from meridia.plans.registry import query

HORIZON, COMPLETE = 3, "2024-01-28"


def _cases(spark, sf_dir):
    """error events with the user's next signup as their resolution."""
    from pyspark.sql import Window

    e = fr.table(spark, sf_dir, "events").where("event_type in ('error', 'signup')")
    after = F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).over(Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.currentRow, Window.unboundedFollowing))
    return e.select(F.col("user_id").alias("entity"), "event_type", F.col("ts").alias("filed"), after.alias("resolved")).where("event_type = 'error'").drop("event_type")


def _labelled(spark, sf_dir):
    obs = fr.table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", F.col("user_id").alias("entity"), F.col("ts").alias("moment"))
    rows = lb.with_cases(obs, _cases(spark, sf_dir), "entity", ("event_id", "entity", "moment"))
    return lb.outcome(rows, HORIZON, F.to_date(F.lit(COMPLETE)))


LABELLED = f"""cases AS (SELECT user_id AS entity, ts AS filed, (SELECT min(s.ts) FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'signup' AND s.ts >= e.ts) AS resolved FROM events e WHERE event_type = 'error'),
obs AS (SELECT event_id, user_id AS entity, ts AS moment FROM events WHERE event_type = 'purchase'),
joined AS (SELECT event_id, o.entity, moment, min(CASE WHEN filed > moment THEN filed END) AS first_event, coalesce(bool_or(filed <= moment AND (resolved IS NULL OR moment <= resolved)), false) AS in_case
  FROM obs o LEFT JOIN cases c ON o.entity = c.entity GROUP BY ALL),
reasons AS (SELECT *, CASE WHEN in_case THEN 'active_proceeding' WHEN CAST(moment AS DATE) + {HORIZON} > DATE '{COMPLETE}' THEN 'window_not_observable' END AS censoring_reason FROM joined),
labelled AS (SELECT *, CASE WHEN censoring_reason IS NULL THEN CASE WHEN first_event IS NOT NULL AND CAST(first_event AS DATE) <= CAST(moment AS DATE) + {HORIZON} THEN 1 ELSE 0 END END AS label FROM reasons)"""


@query(f"WITH {LABELLED} SELECT event_id, label, censoring_reason, CASE WHEN label = 1 THEN date_diff('day', CAST(moment AS DATE), CAST(first_event AS DATE)) END AS days_to_event FROM labelled")
def hazard_label(spark, sf_dir):
    return _labelled(spark, sf_dir).select("event_id", "label", "censoring_reason", F.col("days_to_event").cast("long").alias("days_to_event"))


@query(f"WITH {LABELLED} SELECT censoring_reason, count(*) AS n FROM labelled WHERE censoring_reason IS NOT NULL GROUP BY ALL")
def censoring_reasons(spark, sf_dir):
    return _labelled(spark, sf_dir).where("censoring_reason is not null").groupBy("censoring_reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LABELLED} SELECT count(*) FILTER (WHERE label = 1) AS positive, count(*) FILTER (WHERE label = 0) AS negative, count(*) FILTER (WHERE label IS NULL) AS censored FROM labelled")
def outcome_counts(spark, sf_dir):
    return lb.outcome_counts(_labelled(spark, sf_dir))


@query("""WITH c AS (SELECT CAST(day(ts) AS BIGINT) AS period, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL),
f AS (SELECT p AS period, coalesce(n, 0) AS n FROM range(2, greatest((SELECT max(period) FROM c), 20) + 1) t(p) LEFT JOIN c ON period = p),
m AS (SELECT quantile_cont(n, 0.5) AS reference_median FROM f WHERE period BETWEEN 2 AND 20), l AS (SELECT max(period) AS z FROM f, m WHERE n >= 0.9 * reference_median OR period <= 20)
SELECT CAST(period AS BIGINT) AS period, n, reference_median, period <= z AS complete FROM f, m, l""")
def label_completeness(spark, sf_dir):
    e = fr.table(spark, sf_dir, "events").where("event_type = 'error'")
    return lb.completeness(e, F.day("ts"), (2, 20), 0.9)


@query("""WITH g AS (SELECT date_diff('day', CAST(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DATE), CAST(ts AS DATE)) AS g FROM events),
s AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM g WHERE g IS NOT NULL)
SELECT max(n) AS n, min(g) AS min, max(CASE WHEN i = least(floor(n * 0.25), n - 1) THEN g END) AS p25, max(CASE WHEN i = least(floor(n * 0.5), n - 1) THEN g END) AS median,
max(CASE WHEN i = least(floor(n * 0.75), n - 1) THEN g END) AS p75, max(CASE WHEN i = least(floor(n * 0.9), n - 1) THEN g END) AS p90, max(g) AS max,
round(count(*) FILTER (WHERE g <= 1) / count(*), 9) AS within_1, round(count(*) FILTER (WHERE g <= 3) / count(*), 9) AS within_3 FROM s""")
def gap_quantiles_by_index(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    g = fr.table(spark, sf_dir, "events").select(F.datediff("ts", F.lag("ts").over(w)).cast("long").alias("g"))
    return lb.gap_quantiles(g, "g", (1, 3))


def _observations(spark, sf_dir):
    o = fr.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("date"), F.year("o_orderdate").cast("long").alias("year"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))


OBSERVED = "obs AS (SELECT o_orderkey AS row_id, o_custkey AS entity, CAST(o_orderdate AS DATE) AS date, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(o_orderstatus = 'F' AS INTEGER) AS label FROM orders)"
FOLDS = (
    OBSERVED
    + """, y AS (SELECT year, count(*) AS n, sum(label) AS e FROM obs GROUP BY year),
folds AS (SELECT a.year AS test_year, CAST(sum(b.n) AS BIGINT) AS train_rows, CAST(sum(b.e) AS BIGINT) AS train_events, a.n AS test_rows, CAST(a.e AS BIGINT) AS test_events
  FROM y a JOIN y b ON b.year < a.year GROUP BY a.year, a.n, a.e HAVING sum(b.e) >= 20 AND a.e >= 1)"""
)


@query(f"WITH {FOLDS} SELECT * FROM folds")
def walk_forward_folds(spark, sf_dir):
    return fd.walk_forward(_observations(spark, sf_dir))


@query(f"WITH {OBSERVED} SELECT year, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_events, count(DISTINCT entity) AS n_entities FROM obs GROUP BY year")
def fold_event_counts(spark, sf_dir):
    return fd.year_counts(_observations(spark, sf_dir))


@query(f"""WITH {FOLDS} SELECT test_year, CAST(count(*) FILTER (WHERE entity % 10 >= 3 AND year < test_year) AS BIGINT) AS train_rows, CAST(coalesce(sum(label) FILTER (WHERE entity % 10 >= 3 AND year < test_year), 0) AS BIGINT) AS train_events,
CAST(count(*) FILTER (WHERE entity % 10 < 3 AND year = test_year) AS BIGINT) AS test_rows, CAST(coalesce(sum(label) FILTER (WHERE entity % 10 < 3 AND year = test_year), 0) AS BIGINT) AS test_events
FROM (SELECT f.test_year, o.* FROM folds f JOIN obs o ON o.year <= f.test_year) GROUP BY test_year HAVING train_rows > 0 AND test_rows > 0""")
def held_out_folds(spark, sf_dir):
    obs = _observations(spark, sf_dir)
    return fd.held_out_folds(obs, fd.walk_forward(obs), held=F.col("entity") % 10 < 3)


@query(f"""WITH {FOLDS}, b AS (SELECT test_year, max(date) FILTER (WHERE year < test_year) AS a, min(date) FILTER (WHERE year = test_year) AS z FROM folds JOIN obs ON year <= test_year GROUP BY test_year)
SELECT count(*) FILTER (WHERE a >= z) AS n_violations FROM b""")
def temporal_ordering_violations(spark, sf_dir):
    obs = _observations(spark, sf_dir)
    return fd.temporal_violations(obs, fd.walk_forward(obs)).agg(F.count(F.lit(1)).alias("n_violations"))


@query("""WITH o AS (SELECT o_custkey AS entity, o_orderkey AS accession, CAST(o_orderdate AS DATE) AS filed FROM orders),
c AS (SELECT entity, max(filed) AS cutoff FROM o WHERE year(filed) <= 1998 GROUP BY entity)
SELECT count(*) AS n_violations FROM c JOIN o USING (entity) WHERE year(o.filed) <= 1999 AND o.filed > cutoff""")
def leakage_violations(spark, sf_dir):
    o = fr.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("accession"), F.to_date("o_orderdate").alias("filed"))
    obs = o.where("year(filed) <= 1999").groupBy("entity").agg(F.max(F.when(F.year("filed") <= 1998, F.col("filed"))).alias("cutoff"), F.collect_list("accession").alias("accessions")).where("cutoff is not null")
    return fd.leakage(obs, o, "entity").agg(F.count(F.lit(1)).alias("n_violations"))


# Versions of conversations as a store's history.

VERSIONS = """a AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS assessment_id, conv_id AS cik, DATE '2024-01-01' + CAST(turn AS INTEGER) AS as_of, turn, role, text FROM conversations)"""


def _versions(spark, sf_dir):
    c = fr.table(spark, sf_dir, "conversations")
    day = F.date_add(F.to_date(F.lit("2024-01-01")), F.col("turn").cast("int"))
    return c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("assessment_id"), F.col("conv_id").alias("cik"), day.alias("as_of"), "turn", "role", F.col("text").alias("payload"), day.cast("timestamp").alias("recorded_at"))


def _reviews(spark, sf_dir):
    v = _versions(spark, sf_dir).where("role = 'assistant'")
    one = v.select(F.concat(F.lit("a"), "assessment_id").alias("review_id"), "assessment_id", F.lit("approved").alias("status"), F.lit(None).cast("string").alias("supersedes"), "recorded_at")
    two = v.where("turn % 2 = 1").select(F.concat(F.lit("b"), "assessment_id").alias("review_id"), "assessment_id", F.lit("rejected").alias("status"), F.concat(F.lit("a"), "assessment_id").alias("supersedes"), F.expr("recorded_at + interval 1 hour").alias("recorded_at"))
    return one.unionByName(two)


@query(f"""WITH {VERSIONS} SELECT cik, assessment_id, rank() OVER (PARTITION BY cik ORDER BY as_of DESC, assessment_id) AS rank,
CASE WHEN rank() OVER (PARTITION BY cik ORDER BY as_of DESC, assessment_id) > 1 THEN 'superseded' WHEN role <> 'assistant' THEN 'draft' WHEN turn % 2 = 1 THEN 'rejected' ELSE 'approved' END AS state FROM a""")
def append_only_history(spark, sf_dir):
    drafts = _versions(spark, sf_dir).select(F.concat(F.lit("d"), "assessment_id").alias("draft_id"), "assessment_id", "recorded_at")
    out = st.history(_versions(spark, sf_dir), drafts, _reviews(spark, sf_dir))
    return out.select("cik", "assessment_id", F.col("rank").cast("long").alias("rank"), "state")


@query(f"WITH {VERSIONS} SELECT assessment_id, CASE WHEN turn % 2 = 1 THEN 'rejected' ELSE 'approved' END AS status FROM a WHERE role = 'assistant'")
def effective_review(spark, sf_dir):
    return st.effective_review(_reviews(spark, sf_dir)).select("assessment_id", "status")


@query("SELECT conv_id AS cik, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def latest_per_key(spark, sf_dir):
    return st.latest_per_key(_versions(spark, sf_dir), "cik", [F.desc("as_of")]).select("cik", "turn", "role")


# Evidence from orders: three layers, dimensions by priority.

REGISTER = """reg AS (SELECT o_custkey AS entity, CAST(o_orderkey AS VARCHAR) AS evidence_id,
 CASE o_orderkey % 4 WHEN 0 THEN 'model' WHEN 1 THEN 'health' WHEN 2 THEN 'narrative' ELSE 'model' END AS layer,
 CASE o_orderkey % 4 WHEN 0 THEN 'model_score' WHEN 1 THEN 'dimension_status' WHEN 2 THEN CASE WHEN o_orderkey % 44 = 2 THEN 'coverage_gap' ELSE 'narrative_signal' END ELSE 'model_driver' END AS kind,
 CASE WHEN o_orderkey % 4 IN (1, 3) THEN o_orderpriority END AS dimension,
 CASE WHEN o_orderstatus = 'F' THEN 'elevated' WHEN o_orderstatus = 'O' THEN 'quiet' ELSE 'unknown' END AS concern,
 CASE WHEN o_orderkey % 4 = 2 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'negated' ELSE 'asserted' END END AS assertion,
 CASE WHEN o_orderkey % 4 = 2 THEN CASE o_orderkey % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'moderate' ELSE 'high' END END AS specificity,
 CASE WHEN o_orderkey % 4 = 2 THEN 'code' || CAST(o_orderkey % 6 AS VARCHAR) END AS code,
 CASE WHEN o_orderkey % 4 = 3 THEN 0.125 END AS share, CASE WHEN o_orderkey % 4 = 3 THEN CASE WHEN o_orderkey % 8 = 3 THEN 'missingness' ELSE 'size' END END AS grp FROM orders),
votes AS (SELECT * FROM reg WHERE layer <> 'narrative' OR assertion = 'negated' OR (assertion = 'asserted' AND specificity IN ('high', 'moderate')))"""


def _register(spark, sf_dir):
    k = F.col("o_orderkey")
    r = k % 4
    narrative, driver = r == 2, r == 3
    return fr.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("entity"), k.cast("string").alias("evidence_id"),
        F.when(r == 1, F.lit("health")).when(narrative, F.lit("narrative")).otherwise(F.lit("model")).alias("layer"),
        F.when(r == 0, F.lit("model_score")).when(r == 1, F.lit("dimension_status")).when(narrative, F.when(k % 44 == 2, F.lit("coverage_gap")).otherwise(F.lit("narrative_signal"))).otherwise(F.lit("model_driver")).alias("kind"),
        F.when(r.isin(1, 3), F.col("o_orderpriority")).alias("dimension"),
        F.when(F.col("o_orderstatus") == "F", F.lit("elevated")).when(F.col("o_orderstatus") == "O", F.lit("quiet")).otherwise(F.lit("unknown")).alias("concern"),
        F.when(narrative, F.when(k % 3 == 0, F.lit("negated")).otherwise(F.lit("asserted"))).alias("assertion"),
        F.when(narrative, F.when(k % 5 == 0, F.lit("low")).when(k % 5 == 1, F.lit("moderate")).otherwise(F.lit("high"))).alias("specificity"),
        F.when(narrative, F.concat(F.lit("code"), (k % 6).cast("string"))).alias("code"),
        F.when(driver, F.lit(0.125)).alias("share"), F.when(driver, F.when(k % 8 == 3, F.lit("missingness")).otherwise(F.lit("size"))).alias("grp"),
    )


_RESOLVE = "CASE WHEN bool_or(concern = 'elevated') THEN 'elevated' WHEN bool_or(concern = 'quiet') THEN 'quiet' ELSE 'unknown' END"


@query(f"WITH {REGISTER} SELECT entity, layer, {_RESOLVE} AS concern FROM votes GROUP BY ALL")
def reads_any_elevated_wins(spark, sf_dir):
    return ev.reads(_register(spark, sf_dir))


FINDINGS = f"""{REGISTER}, rd AS (SELECT entity, layer, {_RESOLVE} AS concern FROM votes GROUP BY ALL),
l AS (SELECT e.entity, coalesce(m.concern, 'unknown') AS m, coalesce(h.concern, 'unknown') AS h, coalesce(n.concern, 'unknown') AS n FROM (SELECT DISTINCT entity FROM reg) e
  LEFT JOIN rd m ON m.entity = e.entity AND m.layer = 'model' LEFT JOIN rd h ON h.entity = e.entity AND h.layer = 'health' LEFT JOIN rd n ON n.entity = e.entity AND n.layer = 'narrative'),
sev AS (SELECT DISTINCT entity FROM reg WHERE kind = 'narrative_signal' AND assertion = 'asserted' AND specificity = 'high'),
dr AS (SELECT entity, dimension, sum(share) AS share, {_RESOLVE} AS driver FROM reg WHERE kind = 'model_driver' GROUP BY ALL),
hs AS (SELECT entity, dimension, {_RESOLVE} AS state FROM reg WHERE layer = 'health' GROUP BY ALL),
tp AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY share DESC, dimension DESC) AS rn FROM dr),
found AS (
  SELECT entity, 'contradiction' AS family, 'model_elevated_health_quiet' AS rule, '' AS subject FROM l WHERE m = 'elevated' AND h = 'quiet'
  UNION ALL SELECT entity, 'contradiction', 'severe_disclosure_model_quiet', '' FROM l JOIN sev USING (entity) WHERE m = 'quiet'
  UNION ALL SELECT entity, 'contradiction', 'severe_disclosure_health_quiet', '' FROM l JOIN sev USING (entity) WHERE h = 'quiet'
  UNION ALL SELECT entity, 'contradiction', 'asserted_and_negated', code FROM reg WHERE code IS NOT NULL GROUP BY entity, code HAVING bool_or(assertion = 'asserted') AND bool_or(assertion = 'negated')
  UNION ALL SELECT entity, 'contradiction', 'driver_against_dimension', dimension FROM dr JOIN hs USING (entity, dimension) WHERE share >= 0.1 AND driver <> state AND driver <> 'unknown' AND state <> 'unknown'
  UNION ALL SELECT entity, 'contradiction', 'score_from_artefacts', '' FROM reg GROUP BY entity HAVING bool_or(kind = 'model_score' AND concern = 'elevated') AND coalesce(sum(share) FILTER (WHERE grp IN ('missingness', 'data_quality')), 0) >= 0.35
  UNION ALL SELECT entity, 'contradiction', 'coverage_gap', '' FROM l WHERE n <> 'elevated' AND entity IN (SELECT entity FROM reg WHERE kind = 'coverage_gap')
  UNION ALL SELECT entity, 'corroboration', 'three_layers_elevated', '' FROM l WHERE m = 'elevated' AND h = 'elevated' AND n = 'elevated'
  UNION ALL SELECT entity, 'corroboration', 'dimension_agrees', dimension FROM dr JOIN hs USING (entity, dimension) WHERE driver = 'elevated' AND state = 'elevated'
  UNION ALL SELECT entity, 'corroboration', 'top_driver_confirmed', tp.dimension FROM tp JOIN hs USING (entity, dimension) WHERE rn = 1 AND state = 'elevated'
  UNION ALL SELECT entity, 'corroboration', 'model_and_severe_disclosure', '' FROM l JOIN sev USING (entity) WHERE m = 'elevated')"""


@query(f"WITH {FINDINGS} SELECT * FROM found WHERE family = 'contradiction'")
def contradictions(spark, sf_dir):
    return ev.findings(_register(spark, sf_dir)).where("family = 'contradiction'")


@query(f"WITH {FINDINGS} SELECT * FROM found WHERE family = 'corroboration'")
def corroborations(spark, sf_dir):
    return ev.findings(_register(spark, sf_dir)).where("family = 'corroboration'")


@query("""WITH p AS (SELECT o_custkey AS entity, o_orderpriority AS dimension, CAST(count(*) AS VARCHAR) AS before FROM orders WHERE year(o_orderdate) <= 1997 GROUP BY ALL),
c AS (SELECT o_custkey AS entity, o_orderpriority AS dimension, CAST(count(*) AS VARCHAR) AS after FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY ALL)
SELECT entity, dimension, before, after, CASE WHEN before IS NULL THEN 'appeared' WHEN after IS NULL THEN 'resolved' ELSE 'changed' END AS change
FROM p FULL OUTER JOIN c USING (entity, dimension) WHERE before IS DISTINCT FROM after""")
def evidence_diff_full_outer(spark, sf_dir):
    o = fr.table(spark, sf_dir, "orders")
    keys = (F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("dimension"))
    p = o.where("year(o_orderdate) <= 1997").groupBy(*keys).agg(F.count(F.lit(1)).cast("string").alias("content"))
    c = o.where("year(o_orderdate) between 1996 and 1998").groupBy(*keys).agg(F.count(F.lit(1)).cast("string").alias("content"))
    return ev.diff(p, c, ("entity", "dimension"), "content")
