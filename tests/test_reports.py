"""Registers in place against those that frames gather, and what they don't exchange or keep."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meridia.operators import assessment as am
from meridia.operators import evidence as ev
from meridia.operators import resolver as rs
from meridia.operators import views as vi
from meridia.plans import assessment_queries as aq
from meridia.plans import registry

DATA = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    return sorted(repr(tuple(r)) for r in df.select(*columns).collect())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def gathered(spark):
    return aq.register(spark, DATA)


@pytest.fixture(scope="module")
def reports(spark):
    return aq.reports(spark, DATA).persist()


def in_place(spark, name):
    plan = plan_of(registry.queries()[name](spark, DATA))
    return "InMemoryTableScan" not in plan and plan.count("Exchange hashpartitioning(entity") == 1 + (name == "register_filters")


def test_evidence_register_is_that_of_frames(spark, gathered, reports):
    want = rows_of(gathered, *am.COLUMNS)
    assert want and rows_of(am.register_rows(reports), *am.COLUMNS) == want


def test_evidence_register_is_neither_exchanged_nor_kept(spark):
    assert in_place(spark, "evidence_register")


def test_filings_that_see_nothing_have_an_empty_report(spark):
    day = dt.date(2023, 12, 31)
    known = spark.createDataFrame([(1, 7, "10-K", None, day), (1, 8, "10-K", day, day), (1, 9, "10-K", day, None), (None, 6, "10-K", day, day), (2, 5, "10-K", day, day)], "entity long, accession long, form string, filed date, period_end date")
    facts = known.where("accession != 5").withColumns({"tag": F.lit("Assets"), "value": F.lit(5.0), "start": F.lit(None).cast("date"), "end": F.lit(day), "unit": F.lit("USD"), "namespace": F.lit("us-gaap")}).drop("form")
    rows = rs.health_reports(rs.beside_filings(facts, known)).collect()
    assert {r.entity: (r.as_of, r.form, r.fy, bool(r["items"])) for r in rows} == {7: (None, "10-K", None, False), 8: (day, "10-K", 2023, True), 9: (day, "10-K", 2023, True), 6: (day, "10-K", None, False), 5: (day, "10-K", None, False)}


def test_assembly_in_place_keeps_each_id_once_and_fails_on_clashes_and_late_evidence(spark):
    def report(*items):
        cells = ", ".join("named_struct({})".format(", ".join(f"'{c}', cast({x.get(c, 'null')} as {am._TYPES.get(c, 'string')})" for c in am.COLUMNS[1:])) for x in items)
        return spark.sql(f"select 1 as entity, date '2024-01-01' as as_of, array({cells}) as items")

    a = {"evidence_id": "'a'", "filed": "date '2023-05-01'", "summary": "'x'"}
    assert len(am.assemble_items(report(a, a, a | {"evidence_id": "'b'"})).first()["items"]) == 2
    with pytest.raises(Exception, match="two contents"):
        am.assemble_items(report(a, a | {"summary": "'y'"})).collect()
    for filed in ("date '2024-01-02'", "null"):
        with pytest.raises(Exception, match="not known at the cutoff"):
            am.assemble_items(report(a | {"filed": filed})).collect()


def test_register_filters_keeps_nothing(spark):
    assert in_place(spark, "register_filters")


def test_absent_layers_are_found_in_place(spark, gathered, reports):
    assert in_place(spark, "absent_layers")
    reasons = F.create_map(*[F.lit(x) for layer in ev.LAYERS for x in (layer, layer[:1])])
    assessed = reports.select("entity")
    given = assessed.select("entity", F.explode(F.array(*[F.lit(x) for x in ev.LAYERS])).alias("layer")).withColumn("reason", F.substring("layer", 1, 1))
    want = rows_of(am.absent_layers(gathered, assessed, given), "entity", "layer", "reason")
    assert want and rows_of(am.absent_in_place(reports, reasons), "entity", "layer", "reason") == want
    with pytest.raises(Exception, match="no evidence and no reason"):
        am.absent_in_place(reports, F.create_map(F.lit("health"), F.lit("x"))).collect()


def test_findings_and_packs_are_those_of_frames(spark, gathered, reports):
    assert in_place(spark, "evidence_packs")
    found = ev.with_findings(reports).select("entity", F.inline("found"))
    columns = ("entity", "family", "rule", "subject")
    want = rows_of(ev.findings(gathered), *columns)
    assert want and rows_of(found, *columns) == want
    a = reports.select("entity", "company", "as_of", F.lit(None).cast("string").alias("period_label"))
    packs = am.packs_in_place(ev.with_findings(reports).withColumn("period_label", F.lit(None).cast("string")))
    assert rows_of(packs, "entity", "pack") == rows_of(am.evidence_pack(gathered, a, ev.findings(gathered)), "entity", "pack")


def test_cards_are_those_of_frames(spark, gathered, reports):
    assert in_place(spark, "company_cards")
    want = vi.cards(gathered, reports.select("entity", "company", "as_of"))
    columns = sorted(want.columns)
    assert rows_of(vi.cards_in_place(ev.with_findings(reports)), *columns) == rows_of(want, *columns)
