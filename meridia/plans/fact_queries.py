"""Queries of facts, validations and ratios."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.operators import facts as fo
from meridia.operators import ratios as ro
from meridia.plans import frames as fr
from meridia.plans.registry import query

#: Line numbers repeat within an order, so part and supplier break ties.
ORDER = ("filed", "accession", "line", "part", "supplier")
CUTOFF = "1998-12-31"


@query(f"""WITH {fr.FACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY entity, concept, fy ORDER BY filed, accession, line, part, supplier) AS rn
FROM facts WHERE filed <= DATE '{CUTOFF}')
SELECT entity, concept, fy, filed, accession, value FROM r WHERE rn = 1""")
def asof_earliest_wins(spark, sf_dir):
    return fo.as_of(fr.facts(spark, sf_dir), F.to_date(F.lit(CUTOFF)), ("entity", "concept", "fy"), ORDER, ("value",)).select("entity", "concept", "fy", "filed", "accession", "value")


@query(f"""WITH {fr.FACTS}, f AS (SELECT *, first_value(value) OVER (PARTITION BY entity, concept, fy ORDER BY filed, accession, line, part, supplier) AS v0 FROM facts),
d AS (SELECT *, row_number() OVER (PARTITION BY entity, concept, fy ORDER BY filed, accession, line, part, supplier) AS rn,
 count(*) OVER (PARTITION BY entity, concept, fy) AS n FROM f WHERE value <> v0)
SELECT entity, concept, fy, v0 AS first_value, value AS restated_value, n AS n_changes,
 CASE WHEN abs(value - v0) / greatest(abs(v0), abs(value), 1.0) <= 0.001 THEN 'immaterial' ELSE 'same_tag' END AS kind FROM d WHERE rn = 1""")
def restatements(spark, sf_dir):
    return fo.restatements(fr.facts(spark, sf_dir), ("entity", "concept", "fy"), ORDER)


@query("""SELECT t.o_orderkey AS accession, count(*) AS n_visible, min(CAST(f.o_orderdate AS DATE)) AS first_filed, round(sum(f.o_totalprice), 2) AS visible_total
FROM orders t JOIN orders f ON f.o_custkey = t.o_custkey
AND (CAST(f.o_orderdate AS DATE) < CAST(t.o_orderdate AS DATE) OR (CAST(f.o_orderdate AS DATE) = CAST(t.o_orderdate AS DATE) AND f.o_orderkey <= t.o_orderkey))
GROUP BY t.o_orderkey""")
def visible_history_range_join(spark, sf_dir):
    o = fr.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("accession"), F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("filed"), F.col("o_totalprice").alias("price"))
    out = fo.visible_history(o, "entity", ("filed", "accession"), {"n_visible": F.count(F.lit(1)), "first_filed": F.min("filed"), "visible_total": F.sum("price")})
    return out.select("accession", "n_visible", "first_filed", F.round("visible_total", 2).alias("visible_total"))


@query("""SELECT l_orderkey AS accession, l_partkey AS part, 'quantity' AS tag, CAST(NULL AS DOUBLE) AS value, 'conflicting' AS status
FROM lineitem GROUP BY l_orderkey, l_partkey HAVING min(l_quantity) <> max(l_quantity)""")
def tag_policy_conflict(spark, sf_dir):
    rows = fr.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("accession"), F.col("l_partkey").alias("part"), F.lit("quantity").alias("tag"), F.col("l_quantity").alias("value"))
    return fo.direct_tags(rows, ("accession", "part")).where("status = 'conflicting'")


def _tags(spark, sf_dir):
    rows = fr.lines(spark, sf_dir).groupBy("supplier", "fy", F.col("flag").alias("tag")).agg(F.round(F.max("quantity"), 2).alias("value"))
    priority = F.when(F.col("tag") == "R", 1).when(F.col("tag") == "A", 2).otherwise(3)
    return rows.withColumn("priority", priority).withColumn("status", F.lit("found"))


_TAGS = f"""WITH {fr.LINES}, t AS (SELECT supplier, fy, flag, round(max(quantity), 2) AS value, CASE flag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS p FROM lines GROUP BY ALL),
g AS (SELECT supplier, fy, arg_min(value, p) AS v, min(value) AS lo, max(value) AS hi, count(*) AS n_tags FROM t GROUP BY supplier, fy),
h AS (SELECT *, abs(lo - hi) <= greatest(1.0, 0.001 * greatest(abs(lo), abs(hi))) AS agree FROM g)"""


@query(_TAGS + """ SELECT supplier, fy, CASE WHEN agree THEN v END AS value, CASE WHEN agree THEN 'found' ELSE 'conflicting' END AS status,
CASE WHEN n_tags > 1 AND NOT agree THEN 'low' ELSE 'high' END AS confidence, n_tags FROM h""")
def tag_policy_alternates(spark, sf_dir):
    return fo.combine_alternates(_tags(spark, sf_dir), ("supplier", "fy"))


@query(_TAGS + """ SELECT supplier, fy, v AS value, 'found' AS status, CASE WHEN n_tags > 1 AND NOT agree THEN 'low' ELSE 'high' END AS confidence, n_tags FROM h""")
def tag_policy_preferred_scope(spark, sf_dir):
    return fo.combine_alternates(_tags(spark, sf_dir), ("supplier", "fy"), scope=True)


@query(f"""WITH {fr.LINES}, t AS (SELECT supplier, fy, state AS grp, CASE flag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS alt, line = 7 AS tot, quantity FROM lines),
a AS (SELECT supplier, fy, grp, alt, sum(quantity) AS v FROM t WHERE NOT tot GROUP BY ALL), b AS (SELECT supplier, fy, grp, arg_min(v, alt) AS v FROM a GROUP BY ALL),
c AS (SELECT supplier, fy, sum(v) AS parts, count(*) AS n_parts FROM b GROUP BY ALL), w AS (SELECT supplier, fy, min(quantity) AS whole FROM t WHERE tot GROUP BY ALL)
SELECT supplier, fy, round(coalesce(whole, parts), 4) AS value, CASE WHEN whole IS NOT NULL THEN 'total' ELSE 'components' END AS source, coalesce(n_parts, 0) AS n_parts
FROM c FULL OUTER JOIN w USING (supplier, fy)""")
def tag_policy_components(spark, sf_dir):
    alt = F.when(F.col("flag") == "R", 1).when(F.col("flag") == "A", 2).otherwise(3)
    rows = fr.lines(spark, sf_dir).select("supplier", "fy", F.col("state").alias("grp"), alt.alias("alt"), (F.col("line") == 7).alias("is_total"), F.col("quantity").alias("value"))
    return fo.combine_components(rows, ("supplier", "fy")).withColumn("value", F.round("value", 4))


@query("""WITH w AS (SELECT c_custkey AS entity, (SELECT round(sum(o_totalprice), 2) FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1995) AS a,
 CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS s, CASE WHEN c_custkey % 3 = 0 THEN 10.0 END AS m FROM customer)
SELECT entity, a AS total_assets, s + m AS total_equity, round(a - (s + m), 2) AS total_liabilities,
 CASE WHEN s + m IS NULL THEN 'missing' ELSE 'derived' END AS total_equity_status,
 CASE WHEN a - (s + m) IS NULL THEN 'missing' ELSE 'derived' END AS total_liabilities_status FROM w""")
def staged_derivation(spark, sf_dir):
    paid = fr.table(spark, sf_dir, "orders").where("year(o_orderdate) = 1995").groupBy(F.col("o_custkey").alias("entity")).agg(F.round(F.sum("o_totalprice"), 2).alias("total_assets"))
    c = fr.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("shareholders_equity"), F.when(F.col("c_custkey") % 3 == 0, F.lit(10.0)).alias("noncontrolling_interest"))
    w = c.join(paid, "entity", "left").withColumns({k: F.lit(None).cast("double") for k in ("total_equity", "total_liabilities")})
    names = ("total_assets", "shareholders_equity", "noncontrolling_interest", "total_equity", "total_liabilities")
    w = w.withColumns({f"{k}_status": F.when(F.col(k).isNull(), F.lit("missing")).otherwise(F.lit("found")) for k in names})
    # Liabilities come first in the catalog, so they need the second pass.
    rules = [("total_liabilities", ("total_assets", "total_equity"), F.col("total_assets") - F.col("total_equity")), ("total_equity", ("shareholders_equity", "noncontrolling_interest"), F.col("shareholders_equity") + F.col("noncontrolling_interest"))]
    out = fo.derive(w, rules)
    return out.select("entity", "total_assets", "total_equity", F.round("total_liabilities", 2).alias("total_liabilities"), "total_equity_status", "total_liabilities_status")


@query(f"""WITH {fr.LINES}, f AS (SELECT DISTINCT supplier, fy, flag AS concept FROM lines), c AS (SELECT * FROM (VALUES ('R', 's1'), ('A', 's1'), ('N', 's2'), ('X', 's2')) t(concept, statement)),
p AS (SELECT DISTINCT supplier, fy, statement FROM f JOIN c USING (concept))
SELECT supplier, fy, c.concept, 'missing' AS status FROM p JOIN c USING (statement) LEFT JOIN f USING (supplier, fy, concept) WHERE f.concept IS NULL""")
def missing_placeholders(spark, sf_dir):
    catalog = spark.createDataFrame([("R", "s1"), ("A", "s1"), ("N", "s2"), ("X", "s2")], "concept string, statement string")
    facts = fr.lines(spark, sf_dir).select("supplier", "fy", F.col("flag").alias("concept")).distinct()
    return fo.missing_placeholders(facts, ("supplier", "fy"), catalog)


@query("""WITH s AS (SELECT l_orderkey, sum(l_extendedprice) AS a, sum(l_extendedprice * l_tax) AS b FROM lineitem GROUP BY l_orderkey),
g AS (SELECT o_orderkey AS accession, abs(o_totalprice - (a + b)) AS gap, o_totalprice AS w FROM orders LEFT JOIN s ON o_orderkey = l_orderkey)
SELECT accession, CASE WHEN gap IS NULL THEN 'skipped' WHEN gap <= greatest(1.0, 0.01 * abs(w)) THEN 'passed' ELSE 'failed' END AS "check" FROM g""")
def identity_check(spark, sf_dir):
    s = fr.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("accession")).agg(F.sum("l_extendedprice").alias("a"), F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("b"))
    o = fr.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("accession"), F.col("o_totalprice").alias("w"))
    return fo.identity_check(o.join(s, "accession", "left"), "w", ("a", "b")).select("accession", "check")


@query(f"""WITH {fr.YEARLY}, p AS (SELECT *, CASE WHEN lag(fy) OVER w = fy - 1 THEN lag(price) OVER w END + reduction + duty AS e FROM yearly WINDOW w AS (PARTITION BY entity ORDER BY fy))
SELECT entity, fy, round(e, 6) AS expected, CASE WHEN e IS NULL OR price IS NULL THEN 'skipped' WHEN abs(e - price) <= greatest(10.0, 0.05 * abs(price)) THEN 'passed' ELSE 'failed' END AS "check" FROM p""")
def prior_year_tie_out(spark, sf_dir):
    out = fo.prior_year_tie_out(fr.yearly(spark, sf_dir), "entity", "price", ("reduction", "duty"))
    return out.select("entity", "fy", F.round("expected", 6).alias("expected"), "check")


@query(f"""WITH {fr.YEARLY} SELECT entity, fy, 'negative' AS rule, 'balance' AS concept, balance AS value FROM yearly WHERE balance < 0
UNION ALL SELECT entity, fy, 'part_exceeds_whole', 'duty', duty FROM yearly WHERE duty > 1.001 * reduction""")
def sign_sanity(spark, sf_dir):
    return fo.sign_sanity(fr.yearly(spark, sf_dir), ("entity", "fy"), ("balance", "price"), (("duty", "reduction"),))


@query(f"""WITH {fr.YEARLY} SELECT concept, count(*) FILTER (WHERE v IS NOT NULL) AS n_found, count(*) FILTER (WHERE v IS NULL) AS n_missing, count(*) AS n,
count(*) FILTER (WHERE v IS NOT NULL) / count(*) AS coverage FROM (SELECT 'price' AS concept, price AS v FROM yearly UNION ALL SELECT 'quantity', quantity FROM yearly) GROUP BY concept""")
def completeness_by_concept(spark, sf_dir):
    rows = fr.yearly(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(c).alias("concept"), F.when(F.col(c).isNull(), F.lit("missing")).otherwise(F.lit("found")).alias("status")) for c in ("price", "quantity")])).alias("x")).select("x.*")
    return fo.status_histogram(rows, "concept", ("found", "missing"))


RATIOS = (
    ro.Ratio("reduction_rate", "margin", ("reduction",), "price", "%", higher_is_stronger=False),
    ro.Ratio("duty_rate", "margin", ("duty",), "price", "%"),
    ro.Ratio("unit_price", "size", ("price",), "quantity"),
    ro.Ratio("price_to_balance", "leverage", ("price", "duty"), "balance", higher_is_stronger=False, near_zero=True),
    ro.Ratio("balance_signed", "leverage", ("price",), "balance", negative_allowed=True, higher_is_stronger=False),
)
_LONG = [(r.name, r.category, " + ".join(r.numerator), r.denominator, r.negative_allowed) for r in RATIOS]
RATIO_SQL = (
    fr.YEARLY
    + ", ratio_long AS ("
    + " UNION ALL ".join(
        f"""SELECT entity, fy, '{n}' AS ratio, '{c}' AS category, {num} AS n, {den} AS d,
 CASE WHEN {num} IS NULL OR {den} IS NULL THEN 'missing_input' WHEN abs({den}) < 1.0 {'' if neg else f'OR {den} < 0'} THEN 'invalid_denominator' ELSE 'calculated' END AS status, {str(neg).lower()} AS neg FROM yearly"""
        for n, c, num, den, neg in _LONG
    )
    + "), ratios AS (SELECT entity, fy, ratio, category, status, CASE WHEN status = 'calculated' THEN n / d END AS value, status = 'calculated' AND d < 0 AND ratio = 'balance_signed' AS negative_equity, status = 'calculated' AND abs(d) < 0.02 * abs(n) AND ratio = 'price_to_balance' AS near_zero FROM ratio_long)"
)


def ratio_series(spark, sf_dir):
    return ro.calculate(fr.yearly(spark, sf_dir), ("entity", "fy"), RATIOS)


@query(f"WITH {RATIO_SQL} SELECT entity, fy, ratio, category, round(value, 8) AS value, status FROM ratios")
def ratio_status_precedence(spark, sf_dir):
    return ratio_series(spark, sf_dir).select("entity", "fy", "ratio", "category", F.round("value", 8).alias("value"), "status")


@query(f"""WITH {RATIO_SQL} SELECT ratio, warning, count(*) AS n FROM (SELECT ratio, 'NEGATIVE_EQUITY' AS warning FROM ratios WHERE negative_equity
UNION ALL SELECT ratio, 'NEAR_ZERO_DENOMINATOR' FROM ratios WHERE near_zero) GROUP BY ALL""")
def ratio_warnings(spark, sf_dir):
    return ratio_series(spark, sf_dir).select("ratio", F.explode("warnings").alias("warning")).groupBy("ratio", "warning").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {RATIO_SQL}, c AS (SELECT *, lag(value) OVER w AS prior, lag(status) OVER w AS ps FROM ratios WINDOW w AS (PARTITION BY entity, ratio ORDER BY fy))
SELECT entity, ratio, fy, round(value - prior, 8) + 0.0 AS absolute, CASE WHEN abs(prior) >= 1e-9 THEN round((value - prior) / prior, 6) + 0.0 END AS percent
FROM c WHERE status = 'calculated' AND ps = 'calculated' AND ratio IN ('reduction_rate', 'duty_rate')""")
def ratio_history_changes(spark, sf_dir):
    out = ro.changes(ratio_series(spark, sf_dir).where("ratio in ('reduction_rate', 'duty_rate')"), ("entity", "ratio"))
    return out.select("entity", "ratio", "fy", (F.round("absolute", 8) + 0.0).alias("absolute"), (F.round("percent", 6) + 0.0).alias("percent"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_flatten(spark, sf_dir):
    e = fr.table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k bigint").alias("p")).select("event_id", "p.k")
