"""The feature panel: 57 point-in-time features of every trigger filing, and the catalog that names them.

A panel is made of the as-of view of each trigger (trigger, fy, concept, value, status): one pivot to
filing years, ratios as rows, trends by one aggregation, then two aggregations by trigger that meet on
the same partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions import scalars as fx
from meridia.operators import health as ho
from meridia.operators import ratios as ro

FAMILIES = ("scale", "levels", "ratios", "trends", "signals", "quality")
RATIO_NAMES = tuple(r.name for r in ro.RATIOS)
DIMENSIONS = tuple(dict.fromkeys(r.category for r in ro.RATIOS))
INPUTS = tuple(sorted({c for r in ro.RATIOS for c in r.inputs}))
CONCEPTS = tuple(dict.fromkeys([*INPUTS, "total_assets", "revenue", "capital_expenditures"]))
SIGNALS = (*dict.fromkeys(ho.DETERIORATION_SIGNAL.values()), "negative_equity", "unusual_movement", "multi_dimension_deterioration")
MIN_DENOMINATOR = 1.0


@dataclass(frozen=True)
class Feature:
    """A feature's family and the concepts, ratio, signal or dimension behind it."""

    name: str
    family: str
    kind: str
    source: str | None = None
    concepts: tuple[str, ...] = ()


def _catalog() -> tuple[Feature, ...]:
    levels = {
        "working_capital_to_assets": ("current_assets", "current_liabilities", "total_assets"), "cash_to_assets": ("cash", "total_assets"), "ebit_to_assets": ("ebit", "total_assets"),
        "revenue_to_assets": ("revenue", "total_assets"), "fcf_to_assets": ("operating_cash_flow", "capital_expenditures", "total_assets"), "retained_cash_flow_to_debt": ("operating_cash_flow", "total_debt"),
    }
    out = [Feature(f"log_{c}", "scale", "concept", c, (c,)) for c in ("total_assets", "revenue")]
    out += [Feature(n, "levels", "derived", None, c) for n, c in levels.items()]
    out += [Feature(f"ratio_{r.name}", "ratios", "ratio", r.name, r.inputs) for r in ro.RATIOS]
    out += [Feature(f"trend_pct_{r.name}", "trends", "trend", r.name, r.inputs) for r in ro.RATIOS]
    out += [Feature(n, "trends", "trend") for n in ("n_deteriorating_ratios", "n_improving_ratios", "max_deterioration_persistence", "n_unusual_movements")]
    out += [Feature(f"signal_{s}", "signals", "signal", s) for s in SIGNALS]
    out += [Feature(f"dim_deteriorating_{d}", "signals", "dimension", d) for d in DIMENSIONS]
    out += [Feature(n, "quality", "quality") for n in ("ratio_coverage", "fact_coverage", "periods_available", "derived_input_share", "n_conflicting_ratios")]
    return tuple(out)


FEATURES = _catalog()
NAMES = tuple(f.name for f in FEATURES)
BY_NAME = {f.name: f for f in FEATURES}
_CATEGORY = {r.name: r.category for r in ro.RATIOS}


def names_of(*families: str) -> tuple[str, ...]:
    """Names of the features of some families, in catalog order."""
    return tuple(f.name for f in FEATURES if f.family in families)


def is_missing_indicator(name: str) -> bool:
    return name.endswith("__missing")


def family_of(name: str) -> str:
    """The family of a feature or of its missing mark."""
    return BY_NAME[name.removesuffix("__missing")].family


def dimension_of(name: str) -> str | None:
    """The dimension behind a ratio's, trend's or dimension's feature."""
    f = BY_NAME[name.removesuffix("__missing")]
    return f.source if f.kind == "dimension" else _CATEGORY.get(f.source or "")


def group_of(name: str) -> str:
    """A bucket for every feature: missingness, a dimension, size, data_quality or cross_cutting."""
    if is_missing_indicator(name):
        return "missingness"
    family = family_of(name)
    return dimension_of(name) or {"scale": "size", "quality": "data_quality"}.get(family, "cross_cutting")


def concepts_of(name: str) -> tuple[str, ...]:
    """The concepts that a feature reads, none for aggregates."""
    return BY_NAME[name.removesuffix("__missing")].concepts


def catalog_frame(spark) -> DataFrame:
    """feature, family, kind, dimension, bucket and concepts, of the catalog's size."""
    rows = [(f.name, f.family, f.kind, dimension_of(f.name), group_of(f.name), list(f.concepts)) for f in FEATURES]
    return spark.createDataFrame(rows, "feature string, family string, kind string, dimension string, bucket string, concepts array<string>")


def wide_view(view: DataFrame, key: str = "trigger") -> DataFrame:
    """A row for each trigger and year: the concepts that ratios and levels read, with their status."""
    mine = {c: F.col("concept") == c for c in CONCEPTS}
    aggs = [F.max(F.when(m, F.col("value"))).alias(c) for c, m in mine.items()]
    state = [F.max(F.when(m, F.col("status"))).alias(f"{c}_status") for c, m in mine.items()]
    return view.groupBy(key, "fy").agg(*aggs, *state)


def ratio_rows(wide: DataFrame, key: str = "trigger") -> DataFrame:
    return ro.calculate(wide, (key, "fy"))


def stronger_when_higher() -> Column:
    return ~F.col("ratio").isin(*[r.name for r in ro.RATIOS if not r.higher_is_stronger])


def build(wide: DataFrame, key: str = "trigger", window: int = ho.ANALYSIS_WINDOW) -> DataFrame:
    """key, fiscal year and the 57 features of every trigger of a wide view."""
    # Everything below hangs on the pivot, which is kept until the panel is made.
    wide = wide.persist()
    series = ratio_rows(wide, key)
    trend, dims, signals = ho.report(series, key, stronger_when_higher(), window)

    latest = wide.groupBy(key).agg(F.max("fy").alias("period"), F.max_by(F.struct(*CONCEPTS), F.col("fy")).alias("x"), F.least(F.count(F.lit(1)), F.lit(window)).cast("double").alias("periods_available"))
    x = {c: F.col(f"x.{c}") for c in CONCEPTS}

    def over(n: Column, d: Column) -> Column:
        return F.when(F.abs(d) >= MIN_DENOMINATOR, n / d)

    assets = x["total_assets"]
    levels = latest.select(
        key, "period", "periods_available",
        fx.log_positive(assets).alias("log_total_assets"), fx.log_positive(x["revenue"]).alias("log_revenue"),
        over(x["current_assets"] - x["current_liabilities"], assets).alias("working_capital_to_assets"), over(x["cash"], assets).alias("cash_to_assets"), over(x["ebit"], assets).alias("ebit_to_assets"),
        over(x["revenue"], assets).alias("revenue_to_assets"), over(x["operating_cash_flow"] - x["capital_expenditures"], assets).alias("fcf_to_assets"), over(x["operating_cash_flow"], x["total_debt"]).alias("retained_cash_flow_to_debt"),
        (sum((x[c].isNotNull().cast("int") for c in INPUTS[1:]), x[INPUTS[0]].isNotNull().cast("int")) / len(INPUTS)).alias("fact_coverage"),
    )

    calculated = F.col("status") == ro.CALCULATED
    now = series.join(latest.select(key, "period"), key)
    at_latest = F.col("fy") == F.col("period")
    by_ratio = now.groupBy(key).agg(
        *[F.max_by(F.col("value"), F.when(calculated & (F.col("ratio") == r), F.col("fy"))).alias(f"ratio_{r}") for r in RATIO_NAMES],
        (F.count_if(calculated & at_latest) / len(RATIO_NAMES)).alias("ratio_coverage"),
        F.try_divide(F.count_if(calculated & at_latest & F.array_contains("warnings", "DERIVED_INPUT")), F.count_if(calculated & at_latest)).alias("derived_input_share"),
        F.count_if((F.col("status") == ro.CONFLICTING_INPUT) & at_latest).cast("double").alias("n_conflicting_ratios"),
    )
    conclusive = F.col("direction").isin("increasing", "decreasing", "stable")
    worse = F.col("health") == "deteriorating"
    by_trend = trend.groupBy(key).agg(
        *[F.max(F.when(conclusive & (F.col("ratio") == r), F.col("percent"))).alias(f"trend_pct_{r}") for r in RATIO_NAMES],
        F.count_if(worse).cast("double").alias("n_deteriorating_ratios"),
        F.count_if(F.col("health") == "improving").cast("double").alias("n_improving_ratios"),
        F.coalesce(F.max(F.when(worse, F.col("persistence"))), F.lit(0)).cast("double").alias("max_deterioration_persistence"),
        F.count_if("unusual").cast("double").alias("n_unusual_movements"),
    )
    state = F.when(F.col("dimension_status") != "insufficient", (F.col("dimension_status") == "deteriorating").cast("double"))
    by_dim = dims.groupBy(key).agg(*[F.max(F.when(F.col("category") == d, state)).alias(f"dim_deteriorating_{d}") for d in DIMENSIONS])
    by_signal = signals.groupBy(key).agg(*[F.max((F.col("signal") == s).cast("double")).alias(f"signal_{s}") for s in SIGNALS])
    out = levels.join(by_ratio, key, "left").join(by_trend, key, "left").join(by_dim, key, "left").join(by_signal, key, "left")
    out = out.fillna(0.0, [f"signal_{s}" for s in SIGNALS])
    return out.select(key, F.col("period").alias("fy"), *NAMES)


def observations(features: DataFrame, triggers: DataFrame, outcomes: DataFrame, contributing: DataFrame | None = None, key: str = "trigger") -> DataFrame:
    """Features with their key (trigger, entity, cutoff, skip_reason), outcome and contributing accessions.

    The accessions stay an array, so a panel read back can be checked for leakage again; without
    contributing, triggers have them.
    """
    kept = triggers.where("skip_reason is null").select(key, "entity", "cutoff", *(["accessions"] if contributing is None else []))
    rows = features.join(kept, key).join(outcomes, key, "left")
    return rows if contributing is None else rows.join(contributing, key, "left")


def from_rows(rows: DataFrame) -> DataFrame:
    """A flat panel read back: NaN as null, and a reason for every row without a label."""
    numbers = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("double", "float")]
    out = rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in numbers})
    if "label" in out.columns and "censoring_reason" in out.columns:
        lost = F.lit("Censored (reason not preserved in the flat row).")
        out = out.withColumn("censoring_reason", F.when(F.col("label").isNull(), F.coalesce(F.nullif("censoring_reason", F.lit("")), lost)))
    return out


def scale_history(panel: DataFrame, entity: str = "entity", order: str = "cutoff") -> DataFrame:
    """The sizes behind the logs: each observation's, and the latest known of the entity up to it."""
    from pyspark.sql import Window

    w = Window.partitionBy(entity).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = {c: F.exp(f"log_{c}") for c in ("total_assets", "revenue")}
    rows = panel.withColumns(sizes)
    return rows.select(entity, order, *sizes, *[F.last(c, ignorenulls=True).over(w).alias(f"latest_{c}") for c in sizes])


def panel_rows(panel: DataFrame, entity, as_of: Column, column: str = "entity", moment: str = "cutoff") -> DataFrame:
    """An entity's observations up to a date, in order."""
    return panel.where((F.col(column) == entity) & (F.col(moment) <= as_of)).orderBy(moment)
