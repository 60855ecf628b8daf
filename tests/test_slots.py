"""Slots over dense matrices against the policies as DataFrame expressions, and facts without values."""

from __future__ import annotations

import datetime as dt

import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F

from meridia.operators import resolver as rs
from meridia.operators import slots as sl
from meridia.plans import resolver_queries as rq

DATA = "/root/testdata/sf0.001"


def test_slots_follow_the_policies(spark):
    facts, known = rq.company_facts(spark, DATA).where("accession % 3 = 0"), rq.filings(spark, DATA)
    cols = ["entity", "accession", "fy", "concept", "value", "status", "confidence", "origin", "formula", "candidates"]
    want = {tuple(r[:4]): tuple(r[4:]) for r in rs.direct(rs.annual_entries(facts, known)).select(cols).collect()}
    got = {tuple(r[:4]): tuple(r[4:]) for r in rs.resolve(facts, known).select(cols).collect()}
    assert want and {k: got.get(k) for k in want} == want


def test_facts_without_value_say_nothing(spark):
    day = dt.date(2023, 12, 31)
    known = spark.createDataFrame([(1, 7, day, day)], "entity long, accession long, filed date, period_end date")
    facts = spark.createDataFrame([(7, "us-gaap", t, "USD", None, day, v) for t, v in (("Assets", 5.0), ("Assets", None), ("Liabilities", None))], "accession long, namespace string, tag string, unit string, start date, end date, value double")
    rows = {r.concept: (r.value, r.status) for r in rs.resolve(facts, known, False).where(F.col("status") != "missing").collect()}
    assert rows == {"total_assets": (5.0, "found")}


def test_methods_stay_compilable(spark):
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", 65535)
    rq.canonical(spark, DATA)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_whole_filings_cross_batches():
    rows = pa.RecordBatch.from_pydict({"k": [1, 1, 2, 2, 2, 2, 3, None], "x": list(range(8))})
    for size in (1, 2, 3, 100):
        out = list(sl.whole((rows.slice(i, 1) for i in range(8)), "k", size))
        assert [x for b in out for x in b.column("x").to_pylist()] == list(range(8))
        seen = [set(b.column("k").to_pylist()) for b in out]
        assert sum(len(s) for s in seen) == 4
    assert list(sl.whole(iter([]), "k")) == []


def test_facts_of_an_accession_of_two_entities_stay_apart(spark):
    day = dt.date(2023, 12, 31)
    known = spark.createDataFrame([(1, 7, day, day), (None, 7, day, day)], "entity long, accession long, filed date, period_end date")
    facts = spark.createDataFrame([(7, "us-gaap", t, "USD", None, day, v) for t, v in (("Assets", 5.0), ("Liabilities", 2.0))], "accession long, namespace string, tag string, unit string, start date, end date, value double")
    rows = rs.resolve(facts, known, False).where("status = 'found'").select("entity", "concept", "value").collect()
    assert sorted(map(repr, rows)) == sorted(repr(r) for e in (1, None) for r in [Row(entity=e, concept="total_assets", value=5.0), Row(entity=e, concept="total_liabilities", value=2.0)])


def test_facts_are_not_gathered_and_conditions_read_settled_columns(spark):
    plan = rs.filing_facts(rq.company_facts(spark, DATA), rq.filings(spark, DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    conditions = [line for line in plan.splitlines() if "Filter" in line and "span" in line]
    assert conditions and not any("make_date" in line for line in conditions)
