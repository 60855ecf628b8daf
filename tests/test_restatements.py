"""Restatements looked up again in a map over whole entities, against the same verdicts by joins."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from meridia.operators import resolver as rs
from meridia.operators import slots as sl
from meridia.plans import registry
from meridia.plans import resolver_queries as rq

DATA = "/root/testdata/sf0.001"
FACT = "entity long, accession long, filed date, period_end date, namespace string, tag string, unit string, start date, end date, value double"
COLUMNS = ("entity", "concept", "fy", "kind", *(f"{s}_{c}" for s in sl.SIDES for c in ("value", "tag", "accession")), "verdict", "looks_like_scale_error")


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.select(*COLUMNS).collect())


def by_joins(facts, known):
    found = rs.resolve(facts, known, False).where("status = 'found' and entity is not null").join(known.where("filed is not null").select("accession", "filed"), "accession")
    e = F.struct("filed", "accession", "value", F.col("formula").alias("tag"))
    first = F.first(e).over(Window.partitionBy("entity", "concept", "fy").orderBy("filed", "accession"))
    later = found.withColumn("a", first).where(F.col("value") != F.col("a.value"))
    both = later.groupBy("entity", "concept", "fy").agg(F.first("a").alias("a"), F.min_by(e, F.struct("filed", "accession")).alias("z"))
    kind = F.when(F.col("a.tag") != F.col("z.tag"), F.lit("tag_change")).otherwise(F.lit("same_tag"))
    sides = [F.col(f"{s}.{c}").alias(f"{n}_{c}") for s, n in zip("az", sl.SIDES, strict=True) for c in ("value", "tag", "accession")]
    return rs.verified_restatements(both.select("entity", "concept", "fy", kind.alias("kind"), *sides), facts)


@pytest.mark.parametrize("size", [1, 1000, sl.FACTS])
def test_verdicts_are_those_of_joins(spark, monkeypatch, size):
    monkeypatch.setattr(sl.whole, "__defaults__", (size,))
    facts = rq.company_facts(spark, DATA, by_entity=True)
    want = rows_of(by_joins(rq.company_facts(spark, DATA), rq.filings(spark, DATA)))
    assert len(want) > 1000 and rows_of(rs.restatement_checks(facts)) == want


def test_only_lines_are_exchanged(spark):
    plan = registry.queries()["restatement_verdicts"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.partition("Generate explode")
    assert "Exchange hashpartitioning(entity" in below and "collect_set" not in plan and "Window" not in plan
    assert above.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(kind" in above and "Sort " not in above


def test_odd_facts_and_filings(spark):
    d, end, none = dt.date, dt.date(2023, 12, 31), None
    a, b, c, e = (1, 7, d(2024, 2, 1), end), (1, 8, d(2024, 3, 1), end), (1, 9, d(2024, 1, 1), none), (none, 6, d(2024, 1, 5), end)
    rows = [
        # Same tag, a thousand times more; the first value stands in euros in the later filing too.
        (*b, "us-gaap", "Assets", "USD", none, end, 5000.0), (*b, "us-gaap", "Assets", "EUR", none, end, 5.0), (*a, "us-gaap", "Assets", "USD", none, end, 5.0),
        # Off by half, and no other value of either filing: the same within 1.
        (*a, "us-gaap", "Liabilities", "USD", none, end, 2.0), (*b, "us-gaap", "Liabilities", "USD", none, end, 2.5),
        # Off by half, but a fact of another namespace and span differs.
        (*a, "us-gaap", "AssetsCurrent", "USD", none, end, 2.0), (*b, "us-gaap", "AssetsCurrent", "USD", none, end, 2.5), (*b, "x", "AssetsCurrent", "USD", d(2023, 9, 30), d(2023, 6, 30), 9.0),
        # Another tag; one without a value or an end; not a number twice.
        (*a, "us-gaap", "InventoryNet", "USD", none, end, 3.0), (*b, "us-gaap", "InventoryNetCurrent", "USD", none, end, 4.0), (*b, "us-gaap", "InventoryNet", "USD", none, end, none), (*b, "us-gaap", "InventoryNet", "USD", none, none, 8.0),
        (*a, "us-gaap", "MinorityInterest", "USD", none, end, float("nan")), (*b, "us-gaap", "MinorityInterest", "USD", none, end, float("nan")),
        # A filing without a period end, an unknown entity, and one filing only.
        (*c, "us-gaap", "Assets", "USD", none, end, 1.0), (*e, "us-gaap", "Assets", "USD", none, end, 1.0), (none, 5, d(2024, 1, 6), end, "us-gaap", "Assets", "USD", none, end, 2.0), (2, 4, d(2024, 1, 1), end, "us-gaap", "Assets", "USD", none, end, 6.0),
    ]
    facts = spark.createDataFrame(rows, FACT)
    got = rs.restatement_checks(rs.by_entity(facts))
    assert {r.concept: (r.verdict, r.looks_like_scale_error, r.first_accession, r.restated_accession) for r in got.collect()} == {
        "total_assets": ("confirmed", True, 7, 8), "total_liabilities": ("not_confirmed", False, 7, 8),
        "current_assets": ("confirmed", False, 7, 8), "inventory": ("confirmed", False, 7, 8),
    }
    assert rows_of(got) == rows_of(by_joins(facts.drop("entity", "filed", "period_end"), facts.select("entity", "accession", "filed", "period_end").distinct()))
    assert rs.restatement_checks(rs.by_entity(facts.where("value < 0"))).collect() == []
    with pytest.raises(Exception, match="not in order"):
        rs.restatement_checks(facts.where("entity = 1 and period_end is not null").coalesce(1)).collect()
