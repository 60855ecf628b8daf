"""Queries of trends, outliers, dimensions and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.operators import health as ho
from meridia.plans import fact_queries as fq
from meridia.plans import frames as fr
from meridia.plans.registry import query

#: Positions, deltas, runs and medians of each series, spelled out with windows.
TREND_SQL = (
    fq.RATIO_SQL
    + """, s AS (SELECT entity, ratio, category, fy, CASE WHEN status = 'calculated' THEN value END AS v, negative_equity FROM ratios),
calc AS (SELECT *, row_number() OVER (PARTITION BY entity, ratio ORDER BY fy) AS k, row_number() OVER (PARTITION BY entity, ratio ORDER BY fy DESC) AS kd,
  v - lag(v) OVER (PARTITION BY entity, ratio ORDER BY fy) AS cd FROM s WHERE v IS NOT NULL),
ends AS (SELECT entity, ratio, count(*) AS n, min(fy) AS lo, max(fy) AS hi, arg_min(v, fy) AS first, arg_max(v, fy) AS last,
  quantile_cont(v, 0.5) FILTER (WHERE kd > 1) AS prior_median FROM calc GROUP BY ALL),
base AS (SELECT s.entity, s.ratio, any_value(s.category) AS category, coalesce(any_value(e.n), 0) AS n, any_value(e.first) AS first, any_value(e.last) AS last, any_value(e.prior_median) AS prior_median,
  bool_or(s.negative_equity) AS negative_equity, count(*) FILTER (WHERE s.v IS NULL AND s.fy > e.lo AND s.fy < e.hi) AS n_gaps
  FROM s LEFT JOIN ends e USING (entity, ratio) GROUP BY s.entity, s.ratio),
dir AS (SELECT *, last - first AS absolute0, CASE WHEN abs(first) >= 1e-9 THEN (last - first) / first END AS percent0 FROM base),
dir2 AS (SELECT *, CASE WHEN negative_equity THEN 'not_meaningful' WHEN n = 0 THEN 'insufficient' WHEN n_gaps > 0 THEN 'discontinuous' WHEN n < 3 THEN 'insufficient'
  WHEN NOT CASE WHEN percent0 IS NOT NULL THEN abs(percent0) >= 0.05 ELSE abs(absolute0) >= 1e-6 END THEN 'stable' WHEN absolute0 > 0 THEN 'increasing' ELSE 'decreasing' END AS direction FROM dir),
run AS (SELECT c.entity, c.ratio, c.kd, CASE WHEN d.direction = 'increasing' THEN c.cd > 1e-9 ELSE -c.cd > 1e-9 END AS good FROM calc c JOIN dir2 d USING (entity, ratio)
  WHERE d.direction IN ('increasing', 'decreasing') AND c.k > 1),
persist AS (SELECT entity, ratio, count(*) FILTER (WHERE kd < coalesce(stop, 1000)) AS persistence FROM (SELECT *, min(CASE WHEN NOT good THEN kd END) OVER (PARTITION BY entity, ratio) AS stop FROM run) GROUP BY ALL),
del AS (SELECT entity, ratio, fy, v - lag(v) OVER (PARTITION BY entity, ratio ORDER BY fy) AS d, row_number() OVER (PARTITION BY entity, ratio ORDER BY fy DESC) AS back FROM s),
mid AS (SELECT entity, ratio, count(d) AS m, quantile_cont(d, 0.5) AS mid FROM del WHERE back > 1 GROUP BY ALL),
dev AS (SELECT x.entity, x.ratio, quantile_cont(abs(x.d - y.mid), 0.5) AS mad FROM del x JOIN mid y USING (entity, ratio) WHERE x.back > 1 AND x.d IS NOT NULL GROUP BY ALL),
odd AS (SELECT l.entity, l.ratio, coalesce(m.m >= 3 AND CASE WHEN mad > 0 THEN 0.6745 * abs(l.d - mid) / mad > 3.0 ELSE abs(l.d - mid) > 1e-6 END, false) AS unusual
  FROM del l LEFT JOIN mid m USING (entity, ratio) LEFT JOIN dev USING (entity, ratio) WHERE l.back = 1),
trends AS (SELECT d.*, coalesce(p.persistence, 0) AS persistence, CASE WHEN n - 1 >= 2 THEN prior_median END AS baseline, o.unusual,
  CASE WHEN direction IN ('increasing', 'decreasing') THEN CASE WHEN (direction = 'increasing') = (ratio NOT IN ('reduction_rate', 'price_to_balance', 'balance_signed')) THEN 'improving' ELSE 'deteriorating' END ELSE direction END AS health
  FROM dir2 d LEFT JOIN persist p USING (entity, ratio) LEFT JOIN odd o USING (entity, ratio)),
dims AS (SELECT entity, category, count(*) FILTER (WHERE health = 'deteriorating') AS n_deteriorating, count(*) FILTER (WHERE health = 'improving') AS n_improving, count(*) FILTER (WHERE health = 'stable') AS n_stable FROM trends GROUP BY ALL),
dim_status AS (SELECT *, CASE WHEN n_deteriorating > 0 AND n_improving > 0 THEN 'mixed' WHEN n_deteriorating > 0 THEN 'deteriorating' WHEN n_improving > 0 THEN 'improving' WHEN n_stable > 0 THEN 'stable' ELSE 'insufficient' END AS dimension_status FROM dims)"""
)
SIGNALS_SQL = """signal_rows AS (SELECT entity, ratio, category || '_deterioration' AS signal FROM trends WHERE health = 'deteriorating'
UNION ALL SELECT entity, ratio, 'negative_equity' FROM trends WHERE negative_equity UNION ALL SELECT entity, ratio, 'unusual_movement' FROM trends WHERE unusual)"""


def trend_frame(spark, sf_dir):
    higher = ~F.col("ratio").isin("reduction_rate", "price_to_balance", "balance_signed")
    return ho.trends(fq.ratio_series(spark, sf_dir), ("entity", "ratio", "category"), higher)


@query(f"WITH {TREND_SQL} SELECT entity, ratio, direction, health, CASE WHEN direction IN ('stable', 'increasing', 'decreasing') THEN round(absolute0, 8) + 0.0 END AS absolute, n AS n_calculated FROM trends")
def trend_direction(spark, sf_dir):
    return trend_frame(spark, sf_dir).select("entity", "ratio", "direction", "health", (F.round("absolute", 8) + 0.0).alias("absolute"), "n_calculated")


@query(f"WITH {TREND_SQL} SELECT entity, ratio, persistence FROM trends WHERE direction IN ('increasing', 'decreasing')")
def trend_persistence(spark, sf_dir):
    return trend_frame(spark, sf_dir).where("direction in ('increasing', 'decreasing')").select("entity", "ratio", "persistence")


@query(f"WITH {TREND_SQL} SELECT entity, ratio, n_gaps FROM trends WHERE n_gaps > 0")
def trend_gap(spark, sf_dir):
    return trend_frame(spark, sf_dir).where("n_gaps > 0").select("entity", "ratio", "n_gaps")


@query(f"WITH {TREND_SQL} SELECT entity, ratio, round(baseline, 7) AS baseline, round(last - baseline, 7) AS deviation FROM trends WHERE baseline IS NOT NULL")
def baseline_deviation(spark, sf_dir):
    return trend_frame(spark, sf_dir).where("baseline is not null").select("entity", "ratio", F.round("baseline", 7).alias("baseline"), F.round("deviation", 7).alias("deviation"))


@query(f"WITH {TREND_SQL} SELECT entity, ratio FROM trends WHERE unusual")
def robust_z_outlier(spark, sf_dir):
    return trend_frame(spark, sf_dir).where("unusual").select("entity", "ratio")


@query(f"""WITH {fr.LINES}, s AS (SELECT entity, flag, fy, count(*) AS n FROM lines GROUP BY ALL), r AS (SELECT *, dense_rank() OVER (PARTITION BY entity ORDER BY fy DESC) AS k FROM s)
SELECT entity, flag, fy, n FROM r WHERE k <= 5""")
def last_n_periods_union(spark, sf_dir):
    s = fr.lines(spark, sf_dir).groupBy("entity", "flag", "fy").agg(F.count(F.lit(1)).alias("n"))
    return ho.last_periods(s, "entity")


@query(f"WITH {TREND_SQL} SELECT entity, category, n_deteriorating, n_improving, n_stable, dimension_status FROM dim_status")
def dimension_status(spark, sf_dir):
    return ho.dimension_status(trend_frame(spark, sf_dir), ("entity", "category"))


@query(f"WITH {TREND_SQL}, {SIGNALS_SQL} SELECT entity, ratio, signal FROM signal_rows")
def signals(spark, sf_dir):
    return ho.signals(trend_frame(spark, sf_dir), "entity", codes=F.concat("category", F.lit("_deterioration")))


@query(f"WITH {TREND_SQL} SELECT entity, count(*) AS n_deteriorating FROM dim_status WHERE dimension_status = 'deteriorating' GROUP BY entity HAVING count(*) >= 2")
def multi_dimension(spark, sf_dir):
    return ho.multi_dimension(ho.dimension_status(trend_frame(spark, sf_dir), ("entity", "category")), "entity", 2)
