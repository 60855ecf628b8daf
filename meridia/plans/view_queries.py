"""Queries of serving views, set operations and stability."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.functions import scalars as fx
from meridia.operators import labels as lb
from meridia.operators import metrics as me
from meridia.operators import ratios as ro
from meridia.operators import views as vw
from meridia.plans import fact_queries as fq
from meridia.plans import frames as fr
from meridia.plans import panel_queries as pq
from meridia.plans.registry import query


@query(f"""WITH {pq.REGISTER}, e AS (SELECT DISTINCT entity FROM reg), l AS (SELECT unnest(['model', 'health', 'narrative']) AS layer), r AS (SELECT entity, layer, {pq._RESOLVE} AS concern FROM votes GROUP BY ALL)
SELECT entity, layer, coalesce(concern, 'unknown') AS concern FROM e CROSS JOIN l LEFT JOIN r USING (entity, layer)""")
def layer_reads(spark, sf_dir):
    r = pq._register(spark, sf_dir)
    return vw.layer_reads(r, r)


@query(f"""WITH {pq.FINDINGS}, f AS (SELECT entity, bool_or(kind = 'narrative_signal' AND coalesce(assertion, '') = 'asserted' AND coalesce(specificity, '') = 'high') AS s, bool_or(kind = 'model_score' AND concern = 'elevated') AS m, bool_or(kind = 'coverage_gap') AS g FROM reg GROUP BY entity)
SELECT entity, CASE WHEN entity IN (SELECT entity FROM found WHERE family = 'contradiction') THEN 'contradiction' WHEN s THEN 'severe_disclosure' WHEN m THEN 'score_elevated' WHEN g THEN 'coverage_gap' ELSE 'other' END AS reason FROM f""")
def desk_reasons(spark, sf_dir):
    return vw.reason_buckets(pq._register(spark, sf_dir))


@query(f"""WITH {fq.RATIO_SQL} SELECT entity, ratio, round(arg_max(value, fy), 7) + 0.0 AS latest, CASE WHEN count(value) >= 2 THEN round(arg_max(value, fy) - arg_min(value, fy), 7) + 0.0 END AS change, count(value) AS n_observed FROM ratios GROUP BY ALL""")
def ratio_series_summary(spark, sf_dir):
    out = vw.series_summary(fq.ratio_series(spark, sf_dir), ("entity", "ratio"))
    return out.select("entity", "ratio", (F.round("latest", 7) + 0.0).alias("latest"), (F.round("change", 7) + 0.0).alias("change"), "n_observed")


@query(f"""WITH {fq.RATIO_SQL}, l AS (SELECT entity, ratio, arg_max(value, fy) AS v FROM ratios WHERE value IS NOT NULL AND entity IN (1, 2, 3, 4, 5) GROUP BY ALL)
SELECT entity, round(max(CASE WHEN ratio = 'reduction_rate' THEN v END), 8) AS reduction_rate, round(max(CASE WHEN ratio = 'duty_rate' THEN v END), 8) AS duty_rate FROM l GROUP BY entity""")
def company_comparison(spark, sf_dir):
    out = vw.comparison(fq.ratio_series(spark, sf_dir), (1, 2, 3, 4, 5), ("reduction_rate", "duty_rate"))
    return out.select("entity", F.round("reduction_rate", 8).alias("reduction_rate"), F.round("duty_rate", 8).alias("duty_rate"))


@query("""WITH p AS (SELECT year(l_shipdate) AS era, l_returnflag AS grp, l_discount * l_extendedprice AS c FROM lineitem), k AS (SELECT era FROM p GROUP BY era HAVING count(*) >= 50),
s AS (SELECT era, grp, sum(abs(c)) AS z FROM p JOIN k USING (era) GROUP BY ALL), t AS (SELECT era, grp, z / sum(z) OVER (PARTITION BY era) AS share FROM s)
SELECT grp, round(coalesce(max(CASE WHEN era = 1996 THEN share END), 0), 8) AS y1996, round(coalesce(max(CASE WHEN era = 1998 THEN share END), 0), 8) AS y1998 FROM t GROUP BY grp""")
def era_stability(spark, sf_dir):
    p = fr.table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("era"), F.col("l_returnflag").alias("grp"), (F.col("l_discount") * F.col("l_extendedprice")).alias("contribution"))
    out = vw.group_shares_by_era(p, (1996, 1998))
    return out.select("grp", F.round("1996", 8).alias("y1996"), F.round("1998", 8).alias("y1998"))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS a, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS b FROM orders)
SELECT round(corr(a, b), 9) AS rho, count(*) AS n FROM r""")
def spearman_rank(spark, sf_dir):
    return vw.spearman(fr.table(spark, sf_dir, "orders").select("o_totalprice", "o_custkey"), "o_totalprice", "o_custkey").select(F.round("rho", 9).alias("rho"), "n")


@query("""WITH e AS (SELECT o_orderkey, o_custkey, year(o_orderdate) AS y FROM orders WHERE o_orderstatus = 'F'), f AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS y FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT o_orderkey AS row_id FROM e WHERE EXISTS (SELECT 1 FROM f WHERE f.o_custkey = e.o_custkey AND f.y BETWEEN e.y - 3 AND e.y)""")
def recently_filed_events(spark, sf_dir):
    o = fr.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("year"), "o_orderstatus", "o_orderpriority")
    return vw.recently_filed(o.where("o_orderstatus = 'F'"), o.where("o_orderpriority = '1-URGENT'")).select("row_id")


@query(f"""WITH {fr.YEARLY}, r AS (SELECT entity, fy AS year, 100.0 * (rank() OVER (PARTITION BY fy ORDER BY price) + (count(*) OVER (PARTITION BY fy, price) - 1) / 2.0) / count(*) OVER (PARTITION BY fy) AS p FROM yearly WHERE price IS NOT NULL)
SELECT a.entity, a.year, round(b.p - a.p, 6) + 0.0 AS move FROM r a JOIN r b ON a.entity = b.entity AND b.year = a.year + 1""")
def year_over_year_moves(spark, sf_dir):
    rows = fr.yearly(spark, sf_dir).where("price is not null").select("entity", F.col("fy").alias("year"), F.col("price").alias("score"))
    return vw.year_moves(me.pct_rank(rows, ("year",)).select("entity", "year", "pct_rank")).withColumn("move", F.round("move", 6) + 0.0)


@query(("WITH " + pq.LABELLED).replace(f"+ {pq.HORIZON}", "+ 7") + " SELECT event_id, label, censoring_reason FROM labelled")
def relabel_longer_horizon(spark, sf_dir):
    obs = fr.table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", F.col("user_id").alias("entity"), F.col("ts").alias("moment"))
    rows = lb.with_cases(obs, pq._cases(spark, sf_dir), "entity", ("event_id", "entity", "moment"))
    return lb.outcome(rows, 7, F.to_date(F.lit(pq.COMPLETE))).select("event_id", "label", "censoring_reason")


@query("""SELECT c_custkey AS entity FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def codes_intersect(spark, sf_dir):
    o = fr.table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("entity")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("a"), F.bool_or(F.col("o_orderstatus") == "P").alias("b")).where("a and b").select("entity")


@query("""SELECT DISTINCT o_custkey AS entity FROM orders EXCEPT SELECT user_id FROM events WHERE event_type = 'error'""")
def keys_except(spark, sf_dir):
    o = fr.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity")).distinct()
    return o.join(fr.table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("entity")), "entity", "left_anti")


@query("""SELECT l_orderkey AS accession, CAST(count(*) AS BIGINT) AS n_annual FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE least(abs(date_diff('day', make_date(year(l_shipdate) - 1, 6, 30), CAST(l_shipdate AS DATE))), abs(date_diff('day', make_date(year(l_shipdate), 6, 30), CAST(l_shipdate AS DATE))), abs(date_diff('day', make_date(year(l_shipdate) + 1, 6, 30), CAST(l_shipdate AS DATE)))) <= 10
AND date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) BETWEEN 350 AND 380 GROUP BY l_orderkey""")
def annual_period_filter(spark, sf_dir):
    li = fr.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("accession"), F.to_date("l_shipdate").alias("end"))
    o = fr.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("accession"), F.to_date("o_orderdate").alias("start"))
    return li.join(o, "accession").where(fx.is_annual_period("start", "end", 6, 30)).groupBy("accession").agg(F.count(F.lit(1)).alias("n_annual"))


@query(f"""WITH {fq.RATIO_SQL} SELECT category, ratio, count(*) FILTER (WHERE status = 'calculated') AS n_calculated, count(*) FILTER (WHERE status = 'missing_input') AS n_missing_input, count(*) FILTER (WHERE status = 'invalid_denominator') AS n_invalid_denominator, count(*) AS n,
count(*) FILTER (WHERE status = 'calculated') / count(*) AS coverage FROM ratios GROUP BY ALL""")
def ratio_coverage(spark, sf_dir):
    from meridia.operators import facts as fo

    rows = fq.ratio_series(spark, sf_dir)
    out = fo.status_histogram(rows, "ratio", (ro.CALCULATED, ro.MISSING_INPUT, ro.INVALID_DENOMINATOR))
    names = spark.createDataFrame([(r.name, r.category) for r in fq.RATIOS], "ratio string, category string")
    return out.join(F.broadcast(names), "ratio").select("category", *out.columns)


@query("""SELECT o_custkey AS entity, CAST(count(DISTINCT CASE WHEN l_shipdate < '1998-01-01' THEN year(l_shipdate) END) AS BIGINT) AS n_years, CASE WHEN count(DISTINCT CASE WHEN l_shipdate < '1998-01-01' THEN year(l_shipdate) END) >= 2 THEN 'usable' WHEN count(*) > 0 THEN 'too_few_periods' END AS reason
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey""")
def pre_event_periods(spark, sf_dir):
    li = fr.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    rows = li.join(fr.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("entity")), "o_orderkey")
    years = rows.groupBy("entity").agg(F.countDistinct(F.when(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp"), F.year("l_shipdate"))).alias("n_years"))
    return years.withColumn("reason", F.when(F.col("n_years") >= 2, F.lit("usable")).otherwise(F.lit("too_few_periods")))
