"""Ratios with status precedence and warnings, and their changes from period to period."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ZERO_TOLERANCE = 1.0
NEAR_ZERO_SHARE = 0.02
CHANGE_EPSILON = 1e-9
CALCULATED, MISSING_INPUT, INVALID_DENOMINATOR, CONFLICTING_INPUT = "calculated", "missing_input", "invalid_denominator", "conflicting_input"


@dataclass(frozen=True)
class Ratio:
    """numerator terms (signed by their names' prefix) over a denominator concept."""

    name: str
    category: str
    numerator: tuple[str, ...]
    denominator: str
    unit: str = "x"
    negative_allowed: bool = False
    higher_is_stronger: bool = True
    #: Whether a denominator that is small beside the numerator is worth a warning.
    near_zero: bool = False

    @property
    def inputs(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([*self.numerator, self.denominator]))


#: The ratio catalog.
RATIOS = (
    Ratio("current_ratio", "liquidity", ("current_assets",), "current_liabilities"),
    Ratio("quick_ratio", "liquidity", ("cash", "accounts_receivable"), "current_liabilities"),
    Ratio("debt_to_equity", "leverage", ("total_debt",), "shareholders_equity", "x", True, False),
    Ratio("debt_to_assets", "leverage", ("total_debt",), "total_assets", "%", False, False),
    Ratio("liabilities_to_assets", "leverage", ("total_liabilities",), "total_assets", "%", False, False),
    Ratio("gross_margin", "profitability", ("gross_profit",), "revenue", "%"),
    Ratio("operating_margin", "profitability", ("operating_income",), "revenue", "%"),
    Ratio("net_profit_margin", "profitability", ("net_income",), "revenue", "%"),
    Ratio("roa", "profitability", ("net_income",), "total_assets", "%"),
    Ratio("roe", "profitability", ("net_income",), "shareholders_equity", "%", True),
    Ratio("interest_coverage", "coverage", ("ebit",), "interest_expense", near_zero=True),
    Ratio("ocf_to_debt", "cash_flow", ("operating_cash_flow",), "total_debt", "%"),
    Ratio("ocf_to_revenue", "cash_flow", ("operating_cash_flow",), "revenue", "%"),
)


def calculate(wide: DataFrame, key: Sequence[str], ratios: Sequence[Ratio] = RATIOS, zero: float = ZERO_TOLERANCE) -> DataFrame:
    """Long rows key, ratio, category, value, status, warnings of a wide frame.

    Inputs are columns; a column c_status, where there is one, tells conflicting ones. Precedence:
    conflicting, missing, a denominator below the zero tolerance, a negative one unless allowed.
    """
    rows = []
    for r in ratios:
        conflicting, missing = F.lit(False), F.lit(False)
        marks = {"status": {"derived": F.lit(False), "manually_corrected": F.lit(False)}, "confidence": {"low": F.lit(False)}}
        for c in r.inputs:
            if f"{c}_status" in wide.columns:
                conflicting = conflicting | F.coalesce(F.col(f"{c}_status") == "conflicting", F.lit(False))
            for kind, found in marks.items():
                if f"{c}_{kind}" in wide.columns:
                    for mark in found:
                        found[mark] = found[mark] | F.coalesce(F.col(f"{c}_{kind}") == mark, F.lit(False))
            missing = missing | F.col(c).isNull()
        d = F.col(r.denominator).cast("double")
        n = sum((F.col(c).cast("double") for c in r.numerator[1:]), F.col(r.numerator[0]).cast("double"))
        invalid = F.abs(d) < zero
        if not r.negative_allowed:
            invalid = invalid | (d < 0)
        status = F.when(conflicting, F.lit(CONFLICTING_INPUT)).when(missing, F.lit(MISSING_INPUT)).when(invalid, F.lit(INVALID_DENOMINATOR)).otherwise(F.lit(CALCULATED))
        value = F.when(status == CALCULATED, n / F.when(d != 0, d))
        told = [
            (F.lit(r.negative_allowed) & (d < 0), "NEGATIVE_EQUITY"), (F.lit(r.near_zero) & (F.abs(d) < NEAR_ZERO_SHARE * F.abs(n)), "NEAR_ZERO_DENOMINATOR"),
            (marks["confidence"]["low"], "LOW_CONFIDENCE_INPUT"), (marks["status"]["derived"], "DERIVED_INPUT"), (marks["status"]["manually_corrected"], "MANUAL_INPUT"),
        ]
        warnings = F.array_compact(F.array(*[F.when((status == CALCULATED) & when, F.lit(code)) for when, code in told]))
        rows.append(F.struct(F.lit(r.name).alias("ratio"), F.lit(r.category).alias("category"), value.alias("value"), status.alias("status"), warnings.alias("warnings")))
    return wide.select(*key, F.inline(F.array(*rows)))


def data_quality(series: DataFrame, key: Sequence[str]) -> DataFrame:
    """The worst warning over calculated results: low_confidence, manually_adjusted, derived_inputs or good."""
    rows = series.where(F.col("status") == CALCULATED)
    has = {code: F.coalesce(F.bool_or(F.array_contains("warnings", code)), F.lit(False)) for code in ("LOW_CONFIDENCE_INPUT", "MANUAL_INPUT", "DERIVED_INPUT")}
    level = F.when(has["LOW_CONFIDENCE_INPUT"], F.lit("low_confidence")).when(has["MANUAL_INPUT"], F.lit("manually_adjusted")).when(has["DERIVED_INPUT"], F.lit("derived_inputs")).otherwise(F.lit("good"))
    return rows.groupBy(*key).agg(level.alias("data_quality"), F.count(F.lit(1)).alias("n_calculated"))


def quality_rollup(series: DataFrame, key: Sequence[str], ratio: str = "ratio") -> DataFrame:
    """For each key the ratios with each kind of warning, sorted, and the worst level."""
    rows = data_quality(series, (*key, ratio))
    lists = [F.array_sort(F.collect_list(F.when(F.col("data_quality") == q, F.col(ratio)))).alias(q) for q in ("low_confidence", "manually_adjusted", "derived_inputs", "good")]
    worst = F.min(F.when(F.col("data_quality") == "low_confidence", 0).when(F.col("data_quality") == "manually_adjusted", 1).when(F.col("data_quality") == "derived_inputs", 2).otherwise(3))
    names = F.array(*[F.lit(x) for x in ("low_confidence", "manually_adjusted", "derived_inputs", "good")])
    return rows.groupBy(*key).agg(*lists, F.get(names, worst).alias("level"))


def last_changes(series: DataFrame, key: Sequence[str], year: str = "fy") -> DataFrame:
    """The newest change of each series, as changes() has it."""
    rows = changes(series, key, year)
    return rows.groupBy(*key).agg(F.max_by(F.struct(year, "prior", "value", "absolute", "percent"), F.col(year)).alias("c")).select(*key, "c.*")


def formatted(value: Column, unit: Column | str) -> Column:
    """A ratio as text: a multiple with x, a percentage with one place; a dash for null."""
    unit = F.lit(unit) if isinstance(unit, str) else unit
    text = F.when(unit == "%", F.format_string("%.1f%%", 100 * value)).when(unit == "x", F.format_string("%.2fx", value)).otherwise(F.format_string("%,.2f", value))
    return F.when(value.isNull(), F.lit("—")).otherwise(text)


def changes(series: DataFrame, key: Sequence[str], year: str = "fy") -> DataFrame:
    """Change from the position before, where both are calculated; gaps are never bridged."""
    w = Window.partitionBy(*key).orderBy(year)
    prior, prior_status = F.lag("value").over(w), F.lag("status").over(w)
    rows = series.select(*key, year, "value", "status", prior.alias("prior"), prior_status.alias("prior_status"))
    both = rows.where((F.col("status") == CALCULATED) & (F.col("prior_status") == CALCULATED))
    delta = F.col("value") - F.col("prior")
    return both.select(*key, year, "prior", "value", delta.alias("absolute"), F.when(F.abs("prior") >= CHANGE_EPSILON, delta / F.col("prior")).alias("percent"))
