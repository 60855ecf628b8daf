"""Maps over whole filings and entities against the same results by DataFrame expressions, and what they don't exchange."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meridia.operators import features as fe
from meridia.operators import health as ho
from meridia.operators import panels as pn
from meridia.operators import resolver as rs
from meridia.plans import registry
from meridia.plans import resolver_queries as rq

DATA = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    def cell(v):
        return round(v, 9) + 0.0 if isinstance(v, float) else v

    return sorted(repr(tuple(cell(v) for v in r)) for r in df.select(*columns).collect())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def years(spark):
    return rq.entity_years(spark, DATA).persist()


def test_panel_is_that_of_expressions(spark, years, monkeypatch):
    wide = rs.visible_years(rq.resolved_years(spark, DATA), rq.filings(spark, DATA), fe.CONCEPTS)
    monkeypatch.setattr(pn, "PAIRS", 50)
    columns = ("trigger", "fy", *fe.NAMES)
    want = rows_of(fe.build(wide), *columns)
    assert want and rows_of(rs.panel(years), *columns) == want


def test_sights_are_those_of_windows(spark, years):
    resolved, known = rq.resolved_years(spark, DATA), rq.filings(spark, DATA)
    columns = ("trigger", "cutoff", "entity", "n_periods", "skip_reason")
    assert rows_of(rs.sights(years), *columns) == rows_of(rs.asof_triggers(resolved, known), *columns)
    seen = rs.sights(years, sources=True).where("n_slots > 0").withColumn("accessions", F.sort_array("accessions"))
    assert rows_of(seen, "trigger", "accessions") == rows_of(rs.contributing(resolved, known), "trigger", "accessions")


def test_filings_without_date_or_facts_see_nothing(spark):
    day = dt.date(2023, 12, 31)
    known = spark.createDataFrame([(1, 7, None, day), (1, 8, day, day), (1, 9, day, None), (None, 6, day, day)], "entity long, accession long, filed date, period_end date")
    facts = spark.createDataFrame([(a, "us-gaap", "Assets", "USD", None, day, 5.0 + a) for a in (6, 7, 8, 9)], "accession long, namespace string, tag string, unit string, start date, end date, value double")
    years = rs.entity_years(facts, known)
    got = {r.trigger: (r.n_slots, r.n_sources, r.total) for r in rs.sights(years).collect()}
    assert got == {7: (0, 0, None), 8: (1, 1, 13.0), 9: (1, 1, 13.0), 6: (0, 0, None)}
    assert sorted((r.trigger, r.total_assets) for r in rs.seen_years(years).collect()) == [(8, 13.0), (9, 13.0)]


def test_checks_are_those_of_canonical_facts(spark):
    columns = ("entity", "accession", "fy", "rule", "subject", "passed", "difference")
    want = rows_of(rs.validations(rq.canonical(spark, DATA)), *columns)
    assert want and rows_of(registry.queries()["filing_validations"](spark, DATA), *columns) == want


@pytest.mark.parametrize("name", ["filing_validations", "panel_ratios", "panel_level_features", "panel_trend_features"])
def test_slots_and_ratios_are_not_exchanged(spark, name):
    plan = plan_of(registry.queries()[name](spark, DATA))
    assert "Aggregate" not in plan and "Window" not in plan


@pytest.mark.parametrize("name", ["history_skip_reasons", "company_history", "panel_skip_reasons", "panel_data_quality", "panel_observations"])
def test_slots_are_counted_where_they_are(spark, name):
    plan = plan_of(registry.queries()[name](spark, DATA))
    assert "collect_list" not in plan and "count(distinct" not in plan and "InMemoryTableScan" not in plan


def test_lines_are_dealt_before_they_are_multiplied(spark):
    plan = plan_of(rs.filing_facts(rq.company_facts(spark, DATA), rq.filings(spark, DATA)))
    above, _, below = plan.partition("Generate explode")
    assert "Exchange hashpartitioning(accession" in below and "BroadcastHashJoin [accession" not in plan


def test_layers_that_are_not_asked_for_are_not_made(spark):
    spark.catalog.clearCache()
    assert "lineitem" not in plan_of(registry.queries()["gaps_and_caveats"](spark, DATA))


def test_trends_of_evidence_are_made_once(spark):
    series = spark.createDataFrame([(1, "roa", "profitability", y, 0.1 * y, "calculated") for y in range(3)], "entity long, ratio string, category string, fy long, value double, status string")
    found, dims, signals = ho.report(series, "entity", fe.stronger_when_higher(), keep=True)
    assert found.storageLevel.useMemory and all("InMemoryTableScan" in plan_of(x) for x in (dims, signals))
    found.unpersist()
