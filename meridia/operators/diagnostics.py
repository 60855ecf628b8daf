"""Diagnostics and sampling: missingness, impossible values, taxonomies, bands, slopes, matched draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.operators.metrics import quantiles

EVENT_BAND = (0.1, 0.9)


def missingness(rows: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Null rate of each feature, one aggregation then an unpivot of one row for each group."""
    aggs = [F.avg(F.col(f).isNull().cast("double")).alias(f) for f in features]
    wide = (rows.groupBy(*by) if by else rows.groupBy()).agg(*aggs)
    return wide.unpivot(list(by), list(features), "feature", "null_rate")


def impossible_values(rows: DataFrame, rules: dict[str, Column], entity: str) -> DataFrame:
    """rule, n_rows and n_entities of each rule and of any."""
    flags = {k: F.coalesce(c, F.lit(False)) for k, c in rules.items()}
    anyone = F.lit(False)
    for c in flags.values():
        anyone = anyone | c
    hit = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in [*flags.items(), ("any", anyone)]])))
    return rows.select(F.col(entity).alias("_e"), hit.alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("_e").alias("n_entities"))


def taxonomy(rows: DataFrame, cases: Sequence[tuple[str, Column]], otherwise: str) -> DataFrame:
    """Counts of the first case that holds."""
    c = F.when(cases[0][1], F.lit(cases[0][0]))
    for name, when in cases[1:]:
        c = c.when(when, F.lit(name))
    return rows.groupBy(c.otherwise(F.lit(otherwise)).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def size_band(rows: DataFrame, size: str, event: str, band: tuple[float, float] = EVENT_BAND) -> DataFrame:
    """Events, and others within the quantile band of the events' sizes."""
    q = quantiles(rows.where(F.col(event)), size, band).withColumnRenamed("e", "q")
    # One row of two numbers.
    return rows.join(F.broadcast(q)).where(F.col(event) | F.col(size).between(F.col("q")[0], F.col("q")[1])).drop("q")


def quantile_bucket(rows: DataFrame, value: str, n: int, name: str = "bucket") -> DataFrame:
    """1 to n by (lo, hi] quantile edges."""
    q = quantiles(rows, value, [i / n for i in range(1, n)]).withColumnRenamed("e", "q")
    return rows.join(F.broadcast(q)).withColumn(name, F.size(F.filter("q", lambda e: F.col(value) > e)) + 1).drop("q")


def ols_slope(rows: DataFrame, by: Sequence[str], y: str, x: str, least: int = 3) -> DataFrame:
    out = rows.where(F.col(y).isNotNull()).groupBy(*by).agg(F.count(y).alias("n"), F.regr_slope(F.col(y), F.col(x)).alias("slope"))
    return out.where(F.col("n") >= least)


def matched_sample(rows: DataFrame, stratum: str, event: str, order: Sequence[Column]) -> DataFrame:
    """From each stratum as many others as it has events, in a fixed order."""
    quota = rows.groupBy(stratum).agg(F.count_if(F.col(event)).alias("_quota"))
    ranked = rows.where(~F.col(event)).withColumn("_rn", F.row_number().over(Window.partitionBy(stratum).orderBy(*order)))
    return ranked.join(quota, stratum).where(F.col("_rn") <= F.col("_quota")).drop("_rn", "_quota")


def shortfall(rows: DataFrame, drawn: DataFrame, key: str, n: int, order: Sequence[Column]) -> DataFrame:
    """Rows to top a sample up to n, in a fixed order, from those not drawn."""
    missing = max(0, n - drawn.count())
    return rows.join(drawn.select(key), key, "left_anti").orderBy(*order).limit(missing)
