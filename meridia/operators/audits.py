"""Audits of resolved facts, corpora and registers: rates, funnels, coverage and accuracy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import scalars as fx
from meridia.operators import facts as fo

# Fixed values.
FINANCIAL_SIC = (6000, 6999)
MIN_ANNUAL_FILINGS = 2


def pass_rates(checks: DataFrame) -> DataFrame:
    """n_passed, n and pass_rate of each rule."""
    out = checks.groupBy("rule").agg(F.count_if("passed").alias("n_passed"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("pass_rate", F.try_divide(F.col("n_passed"), F.col("n")))


def circular_slots(canonical: DataFrame) -> DataFrame:
    """How many liabilities were derived from the identity that would check them, and how many there are."""
    mine = F.col("concept") == "total_liabilities"
    circular = mine & (F.col("status") == fo.DERIVED) & (F.col("formula") == "total_assets - total_equity")
    return canonical.agg(F.count_if(F.coalesce(circular, F.lit(False))).alias("n_circular"), F.count_if(mine).alias("n_slots"))


def contributing(used: DataFrame, key: str, source: str = "source") -> DataFrame:
    """The distinct accessions behind each key's facts, sorted as text."""
    rows = used.select(key, F.col(source).cast("string").alias("s")).distinct()
    return rows.groupBy(key).agg(F.sort_array(F.collect_list("s")).alias("accessions"))


def coverage_by_first_filing(canonical: DataFrame, filings: DataFrame) -> DataFrame:
    """entity, fy, the first date that the period was filed and the share of its facts that are resolved."""
    rows = canonical.join(filings.select("accession", "filed"), "accession")
    return rows.groupBy("entity", "fy").agg(F.min("filed").alias("first_filed"), F.avg(fo.is_resolved().cast("double")).alias("coverage"))


def value_accuracy(reference: DataFrame, canonical: DataFrame, relative: float = fx.RESOLVER_RELATIVE, absolute: float = fx.RESOLVER_ABSOLUTE) -> DataFrame:
    """Reference rows (accession, fy, concept, expected) with category: match, or why not."""
    facts = canonical.select("accession", "fy", "concept", F.when(fo.is_resolved(), F.col("value")).alias("value"), "status", "candidates")
    rows = reference.join(facts, ["accession", "fy", "concept"], "left")
    room = F.greatest(F.lit(absolute), relative * F.abs("expected"))
    category = F.when(F.abs(F.col("value") - F.col("expected")) <= room, F.lit("match")).when(F.col("status").isNull(), F.lit("not_resolved"))
    category = category.when(F.col("status") == fo.CONFLICTING, F.lit("conflict")).when(F.col("status") == fo.MISSING, F.lit("missing"))
    category = category.when(F.exists("candidates", lambda c: F.abs(c - F.col("expected")) <= room), F.lit("scope_preference"))
    category = category.when(F.abs(F.col("value") + F.col("expected")) <= room, F.lit("wrong_sign")).otherwise(F.lit("wrong_value"))
    return rows.withColumn("category", category)


def screen(companies: DataFrame, sic: str = "sic", n_annual: str = "n_annual") -> DataFrame:
    """companies with excluded: the first reason that keeps a company out of scope, or null."""
    code = F.col(sic).try_cast("int")
    reason = F.when(F.col(sic).isNull() | (F.trim(F.col(sic).cast("string")) == ""), F.lit("no_sic")).when(code.between(*FINANCIAL_SIC), F.lit("financial_sector"))
    return companies.withColumn("excluded", reason.when(F.coalesce(F.col(n_annual), F.lit(0)) < MIN_ANNUAL_FILINGS, F.lit("too_few_filings")))


def funnel(screened: DataFrame, cohort: str = "cohort") -> DataFrame:
    """Companies by cohort and reason; kept ones have a null reason."""
    return screened.groupBy(cohort, "excluded").agg(F.count(F.lit(1)).alias("n"))


def adjusted_threshold(years: DataFrame, index: DataFrame, base: float, base_year: int, year: str = "year") -> DataFrame:
    """years with threshold: base dollars of base_year by a price index (year, level); the nearest year stands in.

    index has a row for each calendar year: of bounded size, so it may be broadcast.
    """
    anchor = index.where(F.col("year") == base_year).select(F.col("level").alias("_base"))
    distinct = years.select(F.col(year).alias("_y")).distinct()
    near = distinct.join(F.broadcast(index)).groupBy("_y").agg(F.min_by("level", F.struct(F.abs(F.col("year") - F.col("_y")), "year")).alias("_level"))
    levels = near.join(F.broadcast(anchor)).select("_y", (base * F.col("_level") / F.col("_base")).alias("threshold"))
    return years.join(levels, F.col(year) == F.col("_y")).drop("_y")


def eligible_by_size(rows: DataFrame, size: str = "size") -> DataFrame:
    """kept, n and median gap to the threshold; rows without a size are counted apart."""
    state = F.when(F.col(size).isNull(), F.lit("no_size")).when(F.col(size) >= F.col("threshold"), F.lit("kept")).otherwise(F.lit("below"))
    return rows.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.median(F.col(size) - F.col("threshold")).alias("median_gap"))


def stacked_keys(rows: DataFrame, *columns: str) -> DataFrame:
    """The distinct numeric keys of several columns."""
    key = F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("key")
    return rows.select(key).where(F.col("key").rlike(r"^\d+$")).select(F.col("key").cast("long").alias("key")).distinct()


def point_in_time_frame(filings: DataFrame, event_keys: DataFrame, entity: str = "entity", year: str = "year", least: int = MIN_ANNUAL_FILINGS) -> DataFrame:
    """Entities with filings in that many years at least, that aren't event entities, and their years."""
    years = filings.select(entity, year).distinct().groupBy(entity).agg(F.count(F.lit(1)).alias("n_years"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))
    return years.where(F.col("n_years") >= least).join(event_keys.select(F.col("key").alias(entity)), entity, "left_anti")


def survivorship(frame: DataFrame, current: DataFrame, entity: str = "entity", year: str = "year") -> DataFrame:
    """year, entities that filed, and the share of them that are among the current keys."""
    now = current.select(F.col("key").alias(entity)).distinct().withColumn("_now", F.lit(True))
    rows = frame.select(year, entity).distinct().join(now, entity, "left")
    return rows.groupBy(year).agg(F.count(F.lit(1)).alias("n_entities"), F.avg(F.col("_now").isNotNull().cast("double")).alias("surviving_share"))


def joined_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many keys of left meet one of right, and how many don't."""
    mark = right.select(key).distinct().withColumn("_met", F.lit(True))
    return left.join(mark, key, "left").agg(F.count_if(F.col("_met").isNotNull()).alias("n_joined"), F.count_if(F.col("_met").isNull()).alias("n_unmatched"))


def relative_differences(pairs: DataFrame, by: str, a: str, b: str, limit: float = 0.05) -> DataFrame:
    """n, median relative difference and the share above a limit for each group."""
    gap = F.abs(F.col(a) - F.col(b)) / F.greatest(F.abs(F.col(a)), F.abs(F.col(b)), F.lit(1.0))
    return pairs.where(gap.isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.median(gap).alias("median_difference"), F.avg((gap > limit).cast("double")).alias("share_above"))


def followed_by_event(findings: DataFrame, events: DataFrame, code: str = "code", key: str = "accession") -> DataFrame:
    """For each code the distinct keys that show it, and the share of them with an event."""
    mark = events.select(key).distinct().withColumn("_event", F.lit(True))
    rows = findings.select(code, key).distinct().join(mark, key, "left")
    return rows.groupBy(code).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("_event").isNotNull().cast("double")).alias("event_share"))


def located_sections(rows: DataFrame, by: str = "section", located: str = "located", sentences: str = "n_sentences") -> DataFrame:
    """Share of documents in which a section was located, and its median number of sentences there."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(located).cast("double")).alias("located_rate"), F.median(F.when(F.col(located), F.col(sentences))).alias("median_sentences"))


def gate_effect(rows: DataFrame, by: str, asserted: str = "asserted") -> DataFrame:
    """Matches with and without the assertion gate, and the share that it lets through."""
    out = rows.groupBy(by).agg(F.count_if(F.col(asserted)).alias("n_gated"), F.count(F.lit(1)).alias("n_ungated"))
    return out.withColumn("kept_share", F.try_divide(F.col("n_gated"), F.col("n_ungated")))


def label_scores(labels: DataFrame, by: str = "code", verdict: str = "verdict") -> DataFrame:
    """Precision of judged findings, by code and over all (a null code)."""
    sets = labels.groupingSets([[F.col(by)], []], by)
    return sets.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(verdict) == "correct").cast("double")).alias("precision"))


def code_recall(expected: DataFrame, found: DataFrame, key: Sequence[str], by: str = "code") -> DataFrame:
    """Recall of each code over expected rows, silent codes at 0."""
    mark = found.select(*key, by).distinct().withColumn("_hit", F.lit(1))
    rows = expected.select(*key, by).distinct().join(mark, [*key, by], "left")
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_expected"), F.count("_hit").alias("n_found"), F.avg(F.col("_hit").isNotNull().cast("double")).alias("recall"))


def stratified(rows: DataFrame, by: str, key: Sequence[str], n: int, seed: int = 7) -> DataFrame:
    """Up to n rows of each stratum, in the order of a hash of their key: a sampling operator."""
    order = F.xxhash64(*key, F.lit(seed))
    # A window group limit acts before the exchange, so a hot stratum sends few rows.
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order, *key))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def named_totals(rows: DataFrame, by: Sequence[str], distinct: str, sums: Sequence[str], found: str, expected: str) -> DataFrame:
    """Distinct keys, sums, and recall as found over expected."""
    out = rows.groupBy(*by).agg(F.countDistinct(distinct).alias(f"n_{distinct}"), *[F.sum(c).alias(c) for c in sums])
    return out.withColumn("recall", F.try_divide(F.col(found).cast("double"), F.col(expected)))


def verify_as_of(items: DataFrame, cutoff: Column, item: str = "item", filed: str = "filed", require_filed: bool = True) -> DataFrame:
    """Items that a cutoff doesn't admit, with the days by which they are late; none is right."""
    late = ~F.coalesce(F.col(filed) <= cutoff, F.lit(not require_filed))
    return items.where(late).select(item, filed, F.datediff(filed, cutoff).alias("days_late"))


def assert_as_of(items: DataFrame, cutoff: Column, item: str = "item", filed: str = "filed", require_filed: bool = True) -> DataFrame:
    """items, failing the query on the first that the cutoff doesn't admit."""
    ok = F.coalesce(F.col(filed) <= cutoff, F.lit(not require_filed))
    message = F.concat(F.lit("not known at the cutoff: "), F.col(item).cast("string"), F.lit(" filed "), F.coalesce(F.col(filed).cast("string"), F.lit("on an unknown date")))
    return items.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
