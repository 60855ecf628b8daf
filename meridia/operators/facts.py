"""Reported facts: eligibility, as-filed views, tag policies, staged derivation, restatements.

A fact frame is long: one row for each entity, filing, concept, period label and value. Grouping
keys come first in every aggregation, so one hash partitioning by entity and concept serves a
chain of these operators.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import scalars as fx

FOUND, DERIVED, MISSING, CONFLICTING, CORRECTED = "found", "derived", "missing", "conflicting", "manually_corrected"
IMMATERIAL = 0.001


def is_resolved(status: Column | str = "status") -> Column:
    return fx.col(status).isin(FOUND, DERIVED, CORRECTED)


def effective_value(value: Column | str = "value", status: Column | str = "status", correction: Column | None = None) -> Column:
    """The correction if there is one, else a found or derived value; never a conflicting or missing one."""
    own = F.when(fx.col(status).isin(FOUND, DERIVED), fx.col(value))
    return own if correction is None else F.coalesce(correction, own)


def eligible(filings: DataFrame, cutoff: Column, filed: str = "filed", require_filed: bool = True) -> DataFrame:
    """Filings known at the cutoff; without a date they fail closed unless require_filed is false."""
    return filings.where(F.coalesce(F.col(filed) <= cutoff, F.lit(not require_filed)))


def as_of(facts: DataFrame, cutoff: Column | None, key: Sequence[str], order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """For each key the carried columns of the earliest resolved fact filed by the cutoff.

    One aggregation with a partial combine; no window and no sort of whole histories.
    """
    rows = facts if cutoff is None else eligible(facts, cutoff, order[0])
    if "status" in facts.columns:
        rows = rows.where(is_resolved())
    first = F.min_by(F.struct(*order, *carry), F.struct(*order)).alias("first")
    return rows.groupBy(*key).agg(first).select(*key, *[f"first.{c}" for c in dict.fromkeys([*order, *carry])])


def restatements(facts: DataFrame, key: Sequence[str], order: Sequence[str], value: str = "value") -> DataFrame:
    """Keys whose first value a later filing changed: the first differing value, how many differ, and its class.

    A window puts the first filing beside each later one; the aggregation by the same key needs no
    exchange of its own, and no history is gathered into an array.
    """
    rows = facts.where((F.col("status") == FOUND) & F.col(value).isNotNull()) if "status" in facts.columns else facts.where(F.col(value).isNotNull())
    extra = [c for c in ("form", "origin", "tag") if c in facts.columns]
    entry = F.struct(*order, F.col(value).cast("double").alias("v"), *extra)
    history = Window.partitionBy(*key).orderBy(*[F.col(f"e.{c}") for c in order])
    rows = rows.select(*key, entry.alias("e")).withColumn("a", F.first("e").over(history))
    later = rows.where(F.col("e.v") != F.col("a.v"))
    at = F.struct(*[F.col(f"e.{c}") for c in order])
    out = later.groupBy(*key).agg(F.min_by("e", at).alias("z"), F.first("a").alias("a"), F.count(F.lit(1)).alias("n"))
    change = F.abs(F.col("z.v") - F.col("a.v")) / F.greatest(F.abs(F.col("a.v")), F.abs(F.col("z.v")), F.lit(1.0))
    kind = F.when(change <= IMMATERIAL, F.lit("immaterial"))
    if "form" in extra:
        kind = kind.when(F.coalesce(F.col("z.form").endswith("/A") | F.col("a.form").endswith("/A"), F.lit(False)), F.lit("amendment"))
    if "origin" in extra:
        kind = kind.when(~F.col("z.origin").eqNullSafe(F.col("a.origin")), F.lit("origin_change"))
    if "tag" in extra:
        kind = kind.when(~F.col("z.tag").eqNullSafe(F.col("a.tag")), F.lit("tag_change"))
    return out.select(*key, F.col("a.v").alias("first_value"), F.col("z.v").alias("restated_value"), F.col("n").alias("n_changes"), kind.otherwise(F.lit("same_tag")).alias("kind"))


def visible_history(filings: DataFrame, entity: str, order: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """Each filing with aggregates over all the entity's filings up to and including it.

    The range self join filing x earlier filings as one running window: linear, where the join is
    quadratic in an entity's filings.
    """
    w = Window.partitionBy(entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return filings.select("*", *[m.over(w).alias(name) for name, m in measures.items()])


def direct_tags(facts: DataFrame, key: Sequence[str], tag: str = "tag", value: str = "value") -> DataFrame:
    """One row for each key and tag: its value, or status conflicting if the tag has several."""
    rows = facts.groupBy(*key, tag).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    same = F.col("lo") == F.col("hi")
    return rows.select(*key, tag, F.when(same, F.col("lo")).alias("value"), F.when(same, F.lit(FOUND)).otherwise(F.lit(CONFLICTING)).alias("status"))


def combine_alternates(tags: DataFrame, key: Sequence[str], priority: str = "priority", scope: bool = False) -> DataFrame:
    """The first tag by priority wins. Alternates that disagree conflict; with scope they only lower confidence."""
    best = F.min_by(F.struct("value", "status"), F.col(priority)).alias("best")
    lo, hi = F.min("value").alias("lo"), F.max("value").alias("hi")
    any_bad = F.bool_or(F.col("status") == CONFLICTING).alias("bad")
    rows = tags.groupBy(*key).agg(best, lo, hi, any_bad, F.count(F.lit(1)).alias("n"))
    agree = F.coalesce(fx.values_agree("lo", "hi"), F.lit(False))
    if scope:
        status, clash = F.col("best.status"), F.lit(False)
    else:
        clash = F.col("bad") | ~agree
        status = F.when(clash, F.lit(CONFLICTING)).otherwise(F.col("best.status"))
    value = F.when(status != CONFLICTING, F.col("best.value"))
    confidence = F.when((F.col("n") > 1) & ~agree, F.lit("low")).otherwise(F.lit("high"))
    return rows.select(*key, value.alias("value"), status.alias("status"), confidence.alias("confidence"), F.col("n").alias("n_tags"))


def combine_components(tags: DataFrame, key: Sequence[str], group: str = "grp", alternative: str = "alt", total: str = "is_total") -> DataFrame:
    """The total tag if present, else the sum over groups of each group's first present alternative."""
    per_alt = tags.where(~F.col(total)).groupBy(*key, group, alternative).agg(F.sum("value").alias("v"))
    per_group = per_alt.groupBy(*key, group).agg(F.min_by("v", alternative).alias("v"))
    parts = per_group.groupBy(*key).agg(F.sum("v").alias("parts"), F.count(F.lit(1)).alias("n_parts"))
    whole = tags.where(F.col(total)).groupBy(*key).agg(F.min("value").alias("whole"))
    both = parts.join(whole, list(key), "full_outer")
    return both.select(*key, F.coalesce("whole", "parts").alias("value"), F.when(F.col("whole").isNotNull(), F.lit("total")).otherwise(F.lit("components")).alias("source"), F.coalesce("n_parts", F.lit(0)).cast("long").alias("n_parts"))


def derive(wide: DataFrame, rules: Sequence[tuple[str, Sequence[str], Column]], passes: int = 2) -> DataFrame:
    """Fill unresolved concepts of a wide frame: the first rule whose inputs all exist, in passes.

    Each concept c has columns c and c_status. rules: (concept, inputs, expression).
    """
    for _ in range(passes):
        changed = {}
        for concept, inputs, expression in rules:
            ready = F.lit(True)
            for i in inputs:
                ready = ready & F.col(i).isNotNull()
            open_ = F.col(f"{concept}_status") == MISSING
            value, status = changed.get(concept, (F.col(concept), F.col(f"{concept}_status")))
            take = open_ & (status == MISSING) & ready
            changed[concept] = (F.when(take, expression).otherwise(value), F.when(take, F.lit(DERIVED)).otherwise(status))
        wide = wide.withColumns({k: v for c, (value, status) in changed.items() for k, v in ((c, value), (f"{c}_status", status))})
    return wide


def wide(facts: DataFrame, key: Sequence[str], concepts: Sequence[str]) -> DataFrame:
    """Concepts as columns c and c_status, missing where no fact is."""
    aggs = [F.max(F.when(F.col("concept") == c, F.col("value"))).alias(c) for c in concepts]
    state = [F.max(F.when(F.col("concept") == c, F.col("status"))).alias(f"{c}_status") for c in concepts]
    out = facts.groupBy(*key).agg(*aggs, *state)
    return out.fillna(MISSING, [f"{c}_status" for c in concepts])


def missing_placeholders(facts: DataFrame, key: Sequence[str], concepts: DataFrame) -> DataFrame:
    """A missing row for each key that presents a concept's statement but lacks the concept.

    concepts (concept, statement) is the catalog; Spark broadcasts it if its size allows.
    """
    presented = facts.join(concepts, "concept").select(*key, "statement").distinct()
    wanted = presented.join(concepts, "statement").select(*key, "concept")
    return wanted.join(facts.select(*key, "concept").distinct(), [*key, "concept"], "left_anti").select(*key, "concept", F.lit(MISSING).alias("status"))


def completeness(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of resolved facts, 0 of none."""
    rate = F.coalesce(F.avg(is_resolved().cast("double")), F.lit(0.0)).alias("completeness")
    return (facts.groupBy(*by) if by else facts.groupBy()).agg(rate)


def status_histogram(rows: DataFrame, by: str, statuses: Sequence[str]) -> DataFrame:
    """Zero-filled counts of each status, and the share of the first."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses]
    return rows.groupBy(by).agg(*counts, F.count(F.lit(1)).alias("n")).withColumn("coverage", F.try_divide(F.col(f"n_{statuses[0]}"), F.col("n")))


# Validations.


def identity_check(wide_rows: DataFrame, whole: str, parts: Sequence[str], relative: float = 0.01, absolute: float = 1.0) -> DataFrame:
    """whole = sum of parts within the larger tolerance; skipped where one is null."""
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    gap = F.abs(F.col(whole) - total)
    ok = gap <= F.greatest(F.lit(absolute), F.lit(relative) * F.abs(F.col(whole)))
    status = F.when(gap.isNull(), F.lit("skipped")).when(ok, F.lit("passed")).otherwise(F.lit("failed"))
    return wide_rows.withColumn("gap", gap).withColumn("check", status)


def prior_year_tie_out(wide_rows: DataFrame, entity: str, level: str, flows: Sequence[str], year: str = "fy", relative: float = 0.05, absolute: float = 10.0) -> DataFrame:
    """The year before's level plus flows against the level; only true neighbours in time count."""
    w = Window.partitionBy(entity).orderBy(year)
    prior = F.when(F.lag(year).over(w) == F.col(year) - 1, F.lag(level).over(w))
    expected = sum((F.col(f) for f in flows), prior)
    gap = F.abs(expected - F.col(level))
    ok = gap <= F.greatest(F.lit(absolute), F.lit(relative) * F.abs(F.col(level)))
    status = F.when(gap.isNull(), F.lit("skipped")).when(ok, F.lit("passed")).otherwise(F.lit("failed"))
    return wide_rows.withColumn("expected", expected).withColumn("check", status)


def sign_sanity(wide_rows: DataFrame, key: Sequence[str], non_negative: Sequence[str], part_whole: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Only the failures: negative amounts and parts above 1.001 of their whole."""
    rules = [F.when(F.col(c) < 0, F.struct(F.lit("negative").alias("rule"), F.lit(c).alias("concept"), F.col(c).cast("double").alias("value"))) for c in non_negative]
    rules += [F.when(F.col(p) > 1.001 * F.col(w), F.struct(F.lit("part_exceeds_whole").alias("rule"), F.lit(p).alias("concept"), F.col(p).cast("double").alias("value"))) for p, w in part_whole]
    return wide_rows.select(*key, F.explode(F.array_compact(F.array(*rules))).alias("x")).select(*key, "x.*")
