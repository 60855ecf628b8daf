"""Event labels: as-of and interval joins, censoring, label completeness and gaps.

Cases are (entity, filed, resolved); observations are (entity, moment).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOREVER = "9999-12-31"
ACTIVE, UNOBSERVABLE = "active_proceeding", "window_not_observable"


def with_cases(observations: DataFrame, cases: DataFrame, entity: str, key: Sequence[str], moment: str = "moment") -> DataFrame:
    """Each observation's key with first_event (the earliest case after the moment, strictly) and in_case.

    Observations and cases are one sequence for each entity: the first case after a moment and the last
    end of those before it are running aggregates, so a hot entity costs its rows, not their product.
    """

    def at(c: str) -> Column:
        return F.unix_micros(F.col(c).cast("timestamp"))

    kinds = cases.schema["filed"].dataType
    rows = observations.select(F.struct(*key).alias("_k"), F.col(entity).alias("_e"), at(moment).alias("_t"), F.lit(None).cast(kinds).alias("_filed"), F.lit(None).cast("long").alias("_until"))
    known = cases.where(F.col(entity).isNotNull() & F.col("filed").isNotNull())
    ends = F.coalesce(at("resolved"), F.lit(2**63 - 1))
    rows = rows.unionByName(known.select(F.lit(None).cast(rows.schema["_k"].dataType).alias("_k"), F.col(entity).alias("_e"), at("filed").alias("_t"), F.col("filed").alias("_filed"), ends.alias("_until")))
    # From the end: frames that begin at the first row are summed as they go.
    later = Window.partitionBy("_e").orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("_e").orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("first_event", F.min("_filed").over(later)).withColumn("_open", F.max("_until").over(before))
    return rows.where(F.col("_k").isNotNull()).select("_k.*", "first_event", F.coalesce(F.col("_open") >= F.col("_t"), F.lit(False)).alias("in_case"))


def outcome(rows: DataFrame, horizon_days: int, complete_through: Column, moment: str = "moment") -> DataFrame:
    """label, horizon_end, days_to_event and censoring_reason of rows with first_event and in_case.

    Order: an active proceeding censors; an unobservable window censors, even with an event; then
    an event in (moment, moment + horizon] is 1, else 0.
    """
    end = F.date_add(F.to_date(moment), horizon_days)
    reason = F.when(F.col("in_case"), F.lit(ACTIVE)).when(end > complete_through, F.lit(UNOBSERVABLE))
    hit = F.col("first_event").isNotNull() & (F.to_date("first_event") <= end)
    label = F.when(reason.isNull(), F.when(hit, F.lit(1)).otherwise(F.lit(0)))
    return rows.select("*", end.alias("horizon_end"), reason.alias("censoring_reason"), label.alias("label"), F.when(label == 1, F.datediff("first_event", F.col(moment))).alias("days_to_event"))


def outcome_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"), F.count_if(F.col("label").isNull()).alias("censored"))


def completeness(cases: DataFrame, period: Column, reference: tuple[int, int], min_share: float = 0.5) -> DataFrame:
    """period, n, reference_median and complete of each period from the first reference one on.

    Counts are zero-filled; a period is complete if it isn't after the last one with at least
    min_share of the median count over the reference periods.
    """
    counts = cases.groupBy(period.cast("long").alias("period")).agg(F.count(F.lit(1)).alias("n"))
    bounds = counts.agg(F.max("period").alias("hi"))
    spine = bounds.select(F.explode(F.sequence(F.lit(reference[0]).cast("long"), F.greatest("hi", F.lit(reference[1]).cast("long")))).alias("period"))
    full = spine.join(counts, "period", "left").select("period", F.coalesce("n", F.lit(0)).alias("n"))
    middle = full.where(F.col("period").between(*reference)).agg(F.percentile("n", F.lit(0.5)).alias("reference_median"))
    # One row of numbers: bounded, so the join is broadcast.
    rows = full.join(F.broadcast(middle))
    last = rows.where((F.col("n") >= min_share * F.col("reference_median")) | (F.col("period") <= reference[1])).agg(F.max("period").alias("last_complete"))
    return rows.join(F.broadcast(last)).select("period", "n", "reference_median", (F.col("period") <= F.col("last_complete")).alias("complete"))


def gap_quantiles(gaps: DataFrame, gap: str, shares: Sequence[int] = ()) -> DataFrame:
    """n, min, p25, median, p75, p90 and max by index, without interpolation, and shares within bounds.

    The value at an index is found from running counts of distinct gaps, so no task gathers them all.
    """
    rows = gaps.where(F.col(gap).isNotNull()).groupBy(F.col(gap).alias("g")).agg(F.count(F.lit(1)).alias("k"))
    # Distinct day counts: bounded by the calendar, not by the rows.
    rows = rows.withColumn("upto", F.sum("k").over(Window.orderBy("g"))).withColumn("n", F.sum("k").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    at = [F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * q), F.col("n") - 1), F.col("g"))).alias(name) for name, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9))]
    within = [F.round(F.sum(F.when(F.col("g") <= d, F.col("k")).otherwise(0)) / F.sum("k"), 9).alias(f"within_{d}") for d in shares]
    return rows.agg(F.sum("k").alias("n"), F.min("g").alias("min"), *at, F.max("g").alias("max"), *within)
