"""Trends, robust outliers, dimension status and warning signals of ratio series.

A series is rows (entity, ratio, category, fy, value, status), one for each period whether or not
it is calculated. A trend is one aggregation into a sorted array and higher-order functions, so
one exchange serves all its parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
ANALYSIS_WINDOW = 5
MIN_PERIODS = 3
STABLE_MAGNITUDE = 0.05
NEAR_ZERO_BASELINE, CHANGE_NOISE, PERSISTENCE_NOISE = 1e-9, 1e-6, 1e-9
UNUSUAL_Z, UNUSUAL_MIN_PRIOR, Z_FACTOR = 3.0, 3, 0.6745
MIN_PRIOR_FOR_BASELINE = 2
MULTI_DIMENSIONS = 3
DETERIORATION_SIGNAL = {
    "current_ratio": "liquidity_deterioration", "quick_ratio": "liquidity_deterioration", "debt_to_equity": "leverage_deterioration", "debt_to_assets": "leverage_deterioration",
    "liabilities_to_assets": "leverage_deterioration", "gross_margin": "margin_compression", "operating_margin": "margin_compression", "net_profit_margin": "profitability_deterioration",
    "roa": "profitability_deterioration", "roe": "profitability_deterioration", "interest_coverage": "interest_coverage_decline", "ocf_to_debt": "cash_flow_weakening", "ocf_to_revenue": "cash_flow_weakening",
}


def last_periods(series: DataFrame, entity: str, n: int = ANALYSIS_WINDOW, year: str = "fy") -> DataFrame:
    """Rows of the entity's last n distinct periods over all its ratios, calculated or not."""
    rank = F.dense_rank().over(Window.partitionBy(entity).orderBy(F.desc(year)))
    return series.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def median_of(a: Column) -> Column:
    """The median of an array of numbers, null of none."""

    def of_sorted(s: Column) -> Column:
        n = F.size(s)
        odd = F.get(s, F.floor(n / 2).cast("int"))
        return F.when(n % 2 == 1, odd).otherwise((F.get(s, F.floor(n / 2).cast("int") - 1) + odd) / 2)

    # A lambda over one element binds the sorted array, so it's sorted once.
    return F.get(F.transform(F.array(F.array_sort(a)), of_sorted), F.lit(0))


def settled(rows: DataFrame) -> DataFrame:
    """The same rows with every column computed: later lambdas read values instead of expressions."""
    return rows.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))))


def trends(series: DataFrame, key: Sequence[str], higher_is_stronger: Column | None = None, year: str = "fy") -> DataFrame:
    """One row for each key: direction, changes, persistence, baseline, unusual movement and gaps."""
    negative = F.exists("warnings", lambda w: w == "NEGATIVE_EQUITY") if "warnings" in series.columns else F.lit(False)
    rows = series.select(*key, F.col(year).alias("fy"), F.when(F.col("status") == "calculated", F.col("value")).alias("v"), negative.alias("neg"))
    rows = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("fy", "v"))).alias("s"), F.bool_or("neg").alias("negative_equity"))
    rows = settled(rows.withColumn("x", F.transform("s", lambda e: e["v"])).withColumn("c", F.filter("x", lambda v: v.isNotNull())))
    n, total = F.size("c"), F.size("x")
    known = F.filter(F.transform("s", lambda e: F.when(e["v"].isNotNull(), e["fy"])), lambda y: y.isNotNull())
    rows = settled(rows.withColumns({"lo": F.array_min(known), "hi": F.array_max(known)}))
    rows = rows.withColumn("gaps", F.transform(F.filter("s", lambda e: e["v"].isNull() & (e["fy"] > F.col("lo")) & (e["fy"] < F.col("hi"))), lambda e: e["fy"]))
    # Deltas of neighbouring positions; null where one isn't calculated.
    rows = rows.withColumn("d", F.transform(F.sequence(F.lit(1), F.greatest(total - 1, F.lit(1))), lambda i: F.get("x", i) - F.get("x", i - 1)))
    rows = rows.withColumn("cd", F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.get("c", i) - F.get("c", i - 1)))
    rows = settled(rows)
    first, last = F.get("c", F.lit(0)), F.get("c", n - 1)
    absolute = last - first
    pct = F.when(F.abs(first) >= NEAR_ZERO_BASELINE, absolute / first)
    moving = F.when(pct.isNotNull(), F.abs(pct) >= STABLE_MAGNITUDE).otherwise(F.abs(absolute) >= CHANGE_NOISE)
    direction = F.when(F.col("negative_equity"), F.lit("not_meaningful")).when(n == 0, F.lit("insufficient")).when(F.size("gaps") > 0, F.lit("discontinuous")).when(n < MIN_PERIODS, F.lit("insufficient"))
    direction = direction.when(~moving, F.lit("stable")).when(absolute > 0, F.lit("increasing")).otherwise(F.lit("decreasing"))
    rows = rows.withColumns({"direction": direction, "absolute": F.when(direction.isin("stable", "increasing", "decreasing"), absolute), "percent": F.when(direction.isin("stable", "increasing", "decreasing"), pct)})
    rows = settled(rows.withColumn("sign", F.when(F.col("direction") == "increasing", 1).when(F.col("direction") == "decreasing", -1)))
    sign = F.col("sign")
    run = F.aggregate(
        F.reverse("cd"),
        F.struct(F.lit(0).alias("k"), F.lit(True).alias("on")),
        lambda acc, d: F.struct((acc["k"] + F.when(acc["on"] & (d * sign > PERSISTENCE_NOISE), 1).otherwise(0)).alias("k"), (acc["on"] & F.coalesce(d * sign > PERSISTENCE_NOISE, F.lit(False))).alias("on")),
        lambda acc: acc["k"],
    )
    prior = F.slice("c", F.lit(1), F.greatest(n - 1, F.lit(0)))
    baseline = F.when(n - 1 >= MIN_PRIOR_FOR_BASELINE, median_of(prior))
    newest = F.get("d", F.greatest(total - 2, F.lit(0)))
    before = F.filter(F.slice("d", F.lit(1), F.greatest(total - 2, F.lit(0))), lambda d: d.isNotNull())
    rows = rows.withColumns({"persistence": F.when(sign.isNotNull(), run).otherwise(F.lit(0)).cast("long"), "baseline": baseline, "deviation": last - baseline, "newest": F.when(total >= 2, newest), "before": before})
    rows = settled(settled(rows).withColumn("mid", median_of(F.col("before"))))
    rows = rows.withColumn("mad", median_of(F.transform("before", lambda d: F.abs(d - F.col("mid")))))
    far = F.abs(F.col("newest") - F.col("mid"))
    unusual = (F.size("before") >= UNUSUAL_MIN_PRIOR) & F.when(F.col("mad") > 0, Z_FACTOR * far / F.col("mad") > UNUSUAL_Z).otherwise(far > CHANGE_NOISE)
    rows = rows.withColumn("unusual", F.coalesce(unusual, F.lit(False)))
    health = F.col("direction")
    if higher_is_stronger is not None:
        up = F.col("direction") == "increasing"
        health = F.when(F.col("direction").isin("increasing", "decreasing"), F.when(up == higher_is_stronger, F.lit("improving")).otherwise(F.lit("deteriorating"))).otherwise(F.col("direction"))
    return rows.select(*key, "direction", health.alias("health"), "absolute", "percent", "persistence", "baseline", "deviation", "unusual", "negative_equity", F.size("gaps").cast("long").alias("n_gaps"), n.cast("long").alias("n_calculated"), "gaps")


def dimension_status(trend_rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """mixed, deteriorating, improving, stable or insufficient for each key (entity and category)."""
    rows = trend_rows.groupBy(*key).agg(*[F.count_if(F.col("health") == h).alias(f"n_{h}") for h in ("deteriorating", "improving", "stable")])
    status = F.when((F.col("n_deteriorating") > 0) & (F.col("n_improving") > 0), F.lit("mixed")).when(F.col("n_deteriorating") > 0, F.lit("deteriorating")).when(F.col("n_improving") > 0, F.lit("improving"))
    return rows.withColumn("dimension_status", status.when(F.col("n_stable") > 0, F.lit("stable")).otherwise(F.lit("insufficient")))


def signals(trend_rows: DataFrame, entity: str, ratio: str = "ratio", codes: Column | None = None) -> DataFrame:
    """Entity, ratio and signal: up to three for each trend."""
    if codes is None:
        table = F.create_map(*[F.lit(x) for kv in DETERIORATION_SIGNAL.items() for x in kv])
        codes = F.coalesce(F.try_element_at(table, F.col(ratio)), F.lit("deterioration"))
    found = F.array_compact(F.array(F.when(F.col("health") == "deteriorating", codes), F.when(F.col("negative_equity"), F.lit("negative_equity")), F.when(F.col("unusual"), F.lit("unusual_movement"))))
    return trend_rows.select(entity, ratio, F.explode(found).alias("signal"))


def multi_dimension(dimensions: DataFrame, entity: str, least: int = MULTI_DIMENSIONS) -> DataFrame:
    """Entities with that many deteriorating dimensions."""
    rows = dimensions.groupBy(entity).agg(F.count_if(F.col("dimension_status") == "deteriorating").alias("n_deteriorating"))
    return rows.where(F.col("n_deteriorating") >= least)


def explanation(ratio: Column, direction: Column, first: Column, last: Column, percent: Column, n: Column) -> Column:
    """A trend in words; the percentage is told only where its sign agrees with the change's."""
    agrees = percent.isNotNull() & (F.signum(percent) == F.signum(last - first))
    told = F.when(agrees, F.format_string(" (%+.1f%%)", 100 * percent)).otherwise(F.lit(""))
    moved = F.format_string("%s %s from %.4g to %.4g over %d periods", ratio, direction, first, last, n)
    return F.when(direction.isin("increasing", "decreasing", "stable"), F.concat(moved, told, F.lit("."))).otherwise(F.format_string("%s: %s.", ratio, direction))


def by_dimension(trend_rows: DataFrame, entity: str, order: Sequence[str]) -> DataFrame:
    """Each entity's trends of every dimension as one sorted array, dimensions in catalog order."""
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("category"))
    rows = trend_rows.groupBy(entity, "category").agg(F.array_sort(F.collect_list(F.struct("ratio", "direction", "health"))).alias("trends"))
    return rows.withColumn("place", place)


def trend_counts(trend_rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All trends, those with a direction, and those with too little history."""
    known = F.col("direction").isin("increasing", "decreasing", "stable")
    rows = trend_rows.groupBy(*by) if by else trend_rows.groupBy()
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(known).alias("n_conclusive"), F.count_if(F.col("direction") == "insufficient").alias("n_insufficient"))


def limited_history(trend_rows: DataFrame, entity: str) -> DataFrame:
    """Whether no trend of an entity has a direction."""
    return trend_rows.groupBy(entity).agg(F.every(F.col("direction") == "insufficient").alias("limited"))


def report(series: DataFrame, entity: str, higher_is_stronger: Column, n: int = ANALYSIS_WINDOW, keep: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trends, dimensions, signals) of the last n periods of a series (entity, ratio, category, fy, value, status).

    keep persists the trends, which the other two are made of.
    """
    found = trends(last_periods(series, entity, n), (entity, "ratio", "category"), higher_is_stronger)
    found = found.persist() if keep else found
    dimensions = dimension_status(found, (entity, "category"))
    wide = multi_dimension(dimensions, entity).select(entity, F.lit(None).cast("string").alias("ratio"), F.lit("multi_dimension_deterioration").alias("signal"))
    return found, dimensions, signals(found, entity).unionByName(wide)
