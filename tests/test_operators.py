"""Operators on small literal frames: the cases the driver tables don't hold."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from meridia.functions import python_text as tx
from meridia.functions import scalars as fx
from meridia.operators import assessment as am
from meridia.operators import audits as au
from meridia.operators import documents as do
from meridia.operators import evaluation as el
from meridia.operators import evidence as ev
from meridia.operators import facts as fo
from meridia.operators import features as fe
from meridia.operators import folds as fd
from meridia.operators import grounding as gr
from meridia.operators import health as ho
from meridia.operators import labels as lb
from meridia.operators import metrics as me
from meridia.operators import narrative as na
from meridia.operators import ratios as ro
from meridia.operators import resolver as rs
from meridia.operators import store as st
from meridia.sources import filings as so


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def d(s):
    return dt.date.fromisoformat(s)


def test_periods(spark):
    def check(start, end, m, day):
        return one(spark, fx.is_annual_period(F.lit(start).cast("date"), F.lit(end).cast("date"), m, day))

    assert check("2025-01-01", "2025-12-31", 12, 31) and check(None, "2025-12-28", 12, 31)
    assert check("2023-03-01", "2024-02-29", 2, 29) and check("2020-03-01", "2021-02-28", 2, 29)
    assert not check("2025-10-01", "2025-12-31", 12, 31) and not check("2025-01-01", "2025-12-15", 12, 31)
    assert check("2024-01-04", "2025-01-02", 12, 31)
    assert one(spark, fx.period_label(F.lit("2025-06-30").cast("date"), F.lit("Q2"))) == "FY2025-Q2"
    assert one(spark, fx.fiscal_year(F.lit("FY2024"))) == 2024 and one(spark, fx.fiscal_year(F.lit("none"))) == 0


def test_scalars(spark):
    assert one(spark, fx.values_agree(F.lit(1000.0), F.lit(1000.9))) and not one(spark, fx.values_agree(F.lit(1000.0), F.lit(1002.0)))
    assert one(spark, fx.safe_ratio(F.lit(1.0), F.lit(0.0))) is None and one(spark, fx.log_positive(F.lit(-1.0))) is None
    assert one(spark, fx.compact_number(F.lit(1234567.0))) == "1.2M" and one(spark, fx.fixed(F.lit(None).cast("double"))) == "—"
    assert one(spark, fx.humanise(F.lit("net_profit_margin"))) == "Net profit margin"
    assert one(spark, fx.collapse_space(F.lit(" a \t b "))) == "a b"
    low, high = fx.wilson(F.lit(0), F.lit(0))
    assert one(spark, low) is None and one(spark, high) is None
    assert one(spark, fx.scale_word(F.lit("in Millions of dollars"))) == 1e6


def test_text_functions():
    text = "The U.S. market fell by 3.5 percent. Acme Inc. Holdings disagreed with that view.\nA\ttable\trow that is long enough to count.\nToo short."
    spans = tx.sentences(text)
    assert [text[a:b] for a, b in spans] == ["The U.S. market fell by 3.5 percent.", "Acme Inc. Holdings disagreed with that view."]
    assert len(tx.fold("İ“x”")) == 4 and tx.fold("“A–B”") == '"a-b"'
    got = tx.number_mentions("FY2024 rose $1,234.5 million or 22% of -7 in 0001234567-25-000001, EV-MS-77ca0e19, $5bn")
    assert [t for t, *_ in got] == ["$1,234.5 million", "22%", "-7", "$5bn"]
    readings = [[(round(v, 9), round(h, 9)) for v, h in r] for *_, r in got]
    assert readings[0] == [(1234.5e6, 50000.0), (1234.5, 0.05), (-1234.5e6, 50000.0)]
    assert readings[1] == [(22.0, 0.5), (-22.0, 0.5), (0.22, 0.005)] and readings[2] == [(-7.0, 0.5)]
    assert readings[3] == [(5e9, 0.5e9), (5.0, 0.5), (-5e9, 0.5e9)]
    assert tx.render_candidates(-1500.0) == ["(1,500)", "-1,500", "1,500", "(1,500.0)", "-1,500.0", "1,500.0", "(1,500.00)", "-1,500.00", "1,500.00", "(1.5)", "-1.5", "1.5", "(1.50)", "-1.50", "1.50"]


def test_facts(spark):
    rows = [(1, d("2024-02-01"), "a", "x", 1.0, "found"), (1, d("2025-02-01"), "b", "x", 2.0, "found"), (1, d("2023-02-01"), "c", "x", 9.0, "conflicting"), (1, None, "n", "x", 0.0, "found")]
    f = spark.createDataFrame(rows, "cik long, filed date, accession string, concept string, value double, status string")
    got = fo.as_of(f, F.lit("2024-12-31").cast("date"), ("cik", "concept"), ("filed", "accession"), ("value",)).collect()
    assert [(r.value, r.accession) for r in got] == [(1.0, "a")]
    r = fo.restatements(f.where("filed is not null"), ("cik", "concept"), ("filed", "accession")).first()
    assert (r.first_value, r.restated_value, r.n_changes, r.kind) == (1.0, 2.0, 1, "same_tag")
    assert fo.completeness(f.limit(0)).first()[0] == 0.0


def test_ratio_precedence(spark):
    w = spark.createDataFrame([(1, 10.0, 0.5, "found"), (2, 10.0, -5.0, "found"), (3, None, 5.0, "found"), (4, 10.0, 5.0, "conflicting"), (5, 10.0, 4.0, "derived")], "k int, a double, b double, b_status string")
    ratios = (ro.Ratio("r", "c", ("a",), "b"), ro.Ratio("s", "c", ("a",), "b", negative_allowed=True))
    got = {(r.k, r.ratio): (r.status, r.value, r.warnings) for r in ro.calculate(w, ("k",), ratios).collect()}
    assert got[1, "r"][0] == got[2, "r"][0] == "invalid_denominator" and got[2, "s"] == ("calculated", -2.0, ["NEGATIVE_EQUITY"])
    assert got[3, "r"][0] == "missing_input" and got[4, "r"][0] == "conflicting_input" and got[5, "r"] == ("calculated", 2.5, ["DERIVED_INPUT"])


def series(values, **more):
    return [(1, "r", "c", 2010 + i, v, "calculated" if v is not None else "missing_input") for i, v in enumerate(values)]


@pytest.mark.parametrize(
    ("values", "direction", "persistence", "unusual"),
    [([], None, 0, False), ([1.0, 2.0], "insufficient", 0, False), ([1.0, None, 3.0, 4.0], "discontinuous", 0, False), ([1.0, 1.01, 1.02], "stable", 0, False), ([1.0, 2.0, 1.5, 1.8, 2.5], "increasing", 2, False),
     ([3.0, 2.0, 1.0], "decreasing", 2, False), ([0.0, 0.0, 1e-7], "stable", 0, False), ([1.0, 1.0, 1.0, 1.0, 1.0, 9.0], "increasing", 1, True), ([1.0, 1.1, 1.2, 1.31, 1.4, 9.0], "increasing", 5, True), ([None, 1.0, 2.0, 3.0, None], "increasing", 2, False)],
)
def test_trends(spark, values, direction, persistence, unusual):
    rows = spark.createDataFrame(series(values), "e int, ratio string, category string, fy int, value double, status string")
    got = ho.trends(rows, ("e", "ratio", "category"), F.lit(False)).collect()
    if direction is None:
        assert not got
        return
    assert (got[0].direction, got[0].persistence, got[0].unusual) == (direction, persistence, unusual)
    if direction in ("increasing", "decreasing"):
        assert got[0].health == ("deteriorating" if direction == "increasing" else "improving")


def test_outcomes(spark):
    obs = spark.createDataFrame([(i, i, d("2024-01-10")) for i in range(1, 6)], "id int, cik int, moment date")
    cases = [(1, d("2024-01-10"), None), (2, d("2024-01-12"), None), (3, d("2023-01-01"), d("2023-06-01")), (4, d("2024-01-01"), d("2024-01-20")), (5, d("2024-01-14"), None)]
    c = spark.createDataFrame(cases, "cik int, filed date, resolved date")
    rows = lb.with_cases(obs, c, "cik", ("id", "cik", "moment"))
    got = {r.id: (r.label, r.censoring_reason) for r in lb.outcome(rows, 3, F.lit("2024-02-01").cast("date")).collect()}
    assert got == {1: (None, "active_proceeding"), 2: (1, None), 3: (0, None), 4: (None, "active_proceeding"), 5: (0, None)}
    late = lb.outcome(rows, 3, F.lit("2024-01-11").cast("date")).where("id = 2").first()
    assert late.label is None and late.censoring_reason == "window_not_observable"


def test_leakage_fails_closed(spark):
    obs = spark.createDataFrame([(1, d("2024-01-01"), ["a", "b", "zz"])], "cik int, cutoff date, accessions array<string>")
    filed = spark.createDataFrame([("a", d("2023-01-01")), ("b", d("2024-01-02"))], "accession string, filed date")
    assert {r.accession for r in fd.leakage(obs, filed, "cik").collect()} == {"b", "zz"}


def test_metrics_against_definitions(spark):
    rnd = random.Random(1)
    rows = [(i, float(rnd.randint(0, 9)), int(rnd.random() < 0.3)) for i in range(120)]
    df = spark.createDataFrame(rows, "row_id int, score double, label int")
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(me.roc_auc(df).first().auc - want) < 1e-12
    assert me.roc_auc(df.where("label = 1")).first().auc is None
    top = sorted(rows, key=lambda r: (-r[1], r[0]))
    for r in me.alerts(df).collect():
        k = max(1, round(r.rate * 120))
        assert r.k == k and r.true_positives == sum(y for _, _, y in top[:k])
    ci = el.auc_interval(df.withColumn("c", F.col("row_id") % 30), "c", 200).first()
    assert ci.low < want < ci.high and abs(ci.auc - want) < 1e-12
    few = el.auc_interval(df.withColumn("c", F.col("row_id") % 4), "c", 50).first()
    assert few.low is None and few.high is None and few.n_clusters == 4
    values = sorted(s + i / 1000 for i, s, _ in rows)
    got = me.quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", (0.0, 0.1, 0.5, 0.77, 1.0)).first().e
    for q, v in zip((0.0, 0.1, 0.5, 0.77, 1.0), got, strict=True):
        k, part = divmod(q * 119, 1)
        assert abs(v - (values[int(k)] + (values[min(119, int(k) + 1)] - values[int(k)]) * part)) < 1e-9
    assert me.brier_log_loss(df).first().brier is None


@pytest.mark.parametrize(
    ("sentence", "code", "assertion"),
    [
        ("There is substantial doubt about our ability to continue as a going concern.", "going_concern_doubt", "asserted"),
        ("We were not in compliance with the covenants.", "covenant_breach", "asserted"), ("We are currently in compliance with all covenants.", "covenant_breach", "negated"),
        ("There was no event of default has occurred statement.", "debt_default_or_acceleration", "negated"), ("We received no notice of default.", "debt_default_or_acceleration", "negated"),
        ("We did not receive a notice of default.", "debt_default_or_acceleration", "asserted"), ("The company was not late, defaulted on its loan.", "debt_default_or_acceleration", "asserted"),
        ("If we receive a notice of default, we stop.", "debt_default_or_acceleration", "hypothetical"), ("A notice of default could follow.", "debt_default_or_acceleration", "hypothetical"),
        ("To the extent that a waiver of covenant is needed, none exists.", "covenant_waiver_or_amendment", "hypothetical"),
        ("The notice of default is described in Note 3 to the statements.", "debt_default_or_acceleration", "cross_reference"),
        ("As of December 31 a forbearance agreement may end.", "debt_restructuring", "asserted"), ("Moody\u2019s downgraded our credit rating.", "credit_rating_downgrade", "asserted"),
    ],
)
def test_moods(spark, sentence, code, assertion):
    df = spark.createDataFrame([(1, sentence)], "id int, sentence string")
    got = {r.code: r.assertion for r in na.statements(df, ("id",), gate=False).collect()}
    assert got[code] == assertion
    assert (code in {r.code for r in na.statements(df, ("id",)).collect()}) == (assertion in ("asserted", "negated"))


def test_statements(spark):
    excluded = ["The agreement provides that we obtained a waiver.", "An impairment was recorded without any amount.", "Nothing to see in this plain sentence."]
    df = spark.createDataFrame(list(enumerate(excluded)), "id int, sentence string")
    assert na.statements(df, ("id",), gate=False).count() == 0
    long = "\u0130\U0001f642 " + "word " * 150 + "we obtained a waiver " + "tail " * 100
    r = na.statements(spark.createDataFrame([(1, long)], "id int, sentence string"), ("id",)).first()
    assert len(r.quote) == 400 and long[r.quote_start : r.quote_start + 400] == r.quote and long[r.trigger_start :].startswith("obtained a waiver")
    assert sum(len(c.patterns) for c in na.CATALOG) == 54 and len(na.CATALOG) == 12
    docs = spark.createDataFrame([(1, "\u00dcn\u00efcode \U0001f642 sentence that is long enough. Another one that is long enough too.")], "id int, text string")
    assert all(r.verbatim for r in na.verify_quotes(na.sentences(docs, ("id", "text"))).collect())


def test_analyze(spark):
    risk = "Item 1A. Risk Factors\n" + "We received a notice of default from our lenders last week.\n" * 2 + "Plain words that fill the body of this item. " * 6
    text = "Item 1. Business\n" + "We sell things to people in many places. " * 8 + "\n" + risk + "\nItem 1B. Unresolved Staff Comments\nNone of this ends in the item before. We filed voluntary petitions under chapter 11 here.\nItem 2. Properties\n" + "Land. " * 50
    docs = spark.createDataFrame([(1, text), (2, "no items at all"), (3, None)], "id int, text string")
    found, coverage = na.analyze(docs, ("id",))
    rows = found.collect()
    assert [(r.id, r.section_id, r.code, text[r.char_start : r.char_end]) for r in rows] == [(1, "item_1a", "debt_default_or_acceleration", "We received a notice of default from our lenders last week.")]
    located = {(r.id, r.section_id): (r.located, r.reason is None) for r in coverage.collect()}
    assert located[1, "item_1a"] == (True, True) and len(located) == 9 and sum(a for a, _ in located.values()) == 1
    assert all(a == b for a, b in located.values())
    assert [(k, a) for k, a, b in do.sections_of(text)] == [("item_1", 0), ("item_1a", text.index("Item 1A"))]
    assert do.sections_of(text)[1][2] == text.index("Item 1B") and do.missing_sections(text) == ["item_7", "item_8"]
    assert [r.codes for r in na.codes(found, ("id",)).collect()] == [["debt_default_or_acceleration"]]


def test_forbidden_wording(spark):
    bad = ["There is a 40% chance of default", "We recommend declining the loan", "We assigned a rating of BB", "It will go bankrupt", "The firm is creditworthy"]
    good = ["There is not 40% chance of it", "We recommend a review", "Debt rose", None]
    df = spark.createDataFrame([(t,) for t in bad + good], "t string")
    assert [r.x for r in df.select(gr.forbidden(F.col("t")).alias("x")).collect()] == [True] * 5 + [False] * 4


def test_documents(spark):
    page = "<html><title>t</title><body><h1>Item 1. Business</h1><p>" + "words " * 60 + "</p><p>Consolidated balance sheet</p><table><tr><th colspan=2>A</th><th>2024</th></tr><tr><td rowspan=2>Cash</td><td>x</td><td>1,500</td></tr><tr><td>y</td><td>2</td></tr></table><h1>Item 1A. Risk</h1><p>" + "risk " * 60 + "</p></body></html>"
    pages = spark.createDataFrame([(1, page), (2, None)], "id int, html string")
    rows = do.extract(pages, ("id",)).withColumn("s", do.sections("text")).orderBy("id").collect()
    r = rows[0]
    assert r.tables[0].rows == [["A", "", "2024"], ["Cash", "x", "1,500"], ["", "y", "2"]] and "balance sheet" in r.tables[0].context
    assert [s.section_id for s in r.s] == ["item_1", "item_1a"] and all(r.text[b.start : b.end].strip() for b in r.blocks)
    assert rows[1].errors == ["empty"]
    t = spark.createDataFrame([([["Cash", "1"], ["Debt", "2"], ["Total", "3"]],)], "rows array<array<string>>")
    assert t.select(do.looks_financial(F.col("rows"))).first()[0]
    facts = spark.createDataFrame([(1, "cash", 1500000.0), (1, "debt", 77.0)], "id int, concept string, value double")
    cells = spark.createDataFrame([(1, "$ 1,500")], "id int, cell string")
    assert {x.concept: x.corroborated for x in do.corroborate(facts, cells, ("id",)).collect()} == {"cash": True, "debt": False}


def test_grounding(spark):
    ev = spark.createDataFrame([("d", "e1", [0.125, 1500.0], "Cash fell sharply", "cash"), ("d", "e2", [7.0], None, "other")], "draft_id string, evidence_id string, numbers array<double>, quote string, summary string")
    claims = [("d", 0, "finding", "Margin was 12.5%", ["e1"], None), ("d", 1, "finding", "It was 7 times", ["e1"], None), ("d", 2, "finding", "It was 99", ["e1"], None), ("d", 3, "finding", "x", ["zz"], None), ("d", 4, "finding", "x", [], None), ("d", 5, "finding", "x", ["e1"], "cash  FELL"), ("d", 6, "finding", "x", ["e1"], "cash rose")]
    c = spark.createDataFrame(claims, "draft_id string, idx int, kind string, text string, evidence_ids array<string>, quote string")
    got = {r.idx: (r.codes, r.accepted) for r in gr.check_claims(c, ev).collect()}
    assert got[0] == ([], True) and got[1] == (["MISCITED_NUMBER"], True) and got[2] == (["UNGROUNDED_NUMBER"], False)
    assert got[3] == (["UNKNOWN_EVIDENCE"], False) and got[4] == (["NO_CITATION"], False) and got[5] == ([], True) and got[6] == (["UNVERIFIED_QUOTE"], False)
    a = spark.createDataFrame([("d", 2, 1)], "draft_id string, n_contradictions int, n_absent_layers int")
    assert gr.obligations(c, a).first().codes == ["MISSING_DISAGREEMENT", "MISSING_LIMITATION"]


def test_store(spark, tmp_path):
    s = st.Store(spark, str(tmp_path / "store"))
    now = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, d("2024-01-01"), '{"b": 1, "a": 2}', now), (1, d("2024-02-01"), "{}", now), (2, d("2024-01-01"), "{}", now)], "cik long, as_of date, payload string, recorded_at timestamp")
    assert s.record_assessments(rows) == 3 and s.record_assessments(rows) == 0
    assert s.record_assessments(rows.withColumn("payload", F.replace("payload", F.lit('"b": 1, "a": 2'), F.lit('"a": 2, "b": 1')))) == 0
    ids = [r.assessment_id for r in s.table("assessment").orderBy("cik", "as_of").collect()]
    draft = spark.createDataFrame([(ids[1], "m", "{}", now)], "assessment_id string, model string, payload string, recorded_at timestamp")
    assert s.record_drafts(draft) == 1
    with pytest.raises(st.AppendOnlyViolation):
        s.record_drafts(draft.withColumn("assessment_id", F.lit("AS-none")))
    states = {r.assessment_id: r.state for r in s.history().collect()}
    assert states[ids[0]] == "superseded" and states[ids[1]] == "draft"
    assert s.verified("assessment").count() == 3 and s.counts() == {"assessment": 3, "draft": 1, "review": 0}


def test_sources(spark, tmp_path):
    text = '{"cik": 7, "entityName": "X", "facts": {"us-gaap": {"Assets": {"label": "a", "units": {"USD": [{"end": "2024-12-31", "val": 5.0, "accn": "q", "fy": 2024, "fp": "FY", "form": "10-K", "filed": "2025-02-01"}]}}}}}'
    (tmp_path / "f.json").write_text(text)
    r = so.read_company_facts(spark, str(tmp_path / "f.json")).first()
    assert (r.cik, r.concept, r.unit, r.val, r.filed, r.start) == (7, "Assets", "USD", 5.0, d("2025-02-01"), None)
    subs = spark.createDataFrame([(7, (["10-K", "8-K", "10-K"], ["b", "c", "a"], ["2024-02-01", "2024-03-01", "2023-02-01"], ["2023-12-31", "", ""], ["x.htm", "y.htm", "z.htm"]))], f"cik long, recent struct<{so.RECENT.replace(' array', ':array')}>")
    assert [x.accession for x in so.annual_filings(subs).collect()] == ["a", "b"]
    (tmp_path / "e.csv").write_text("cik,f,r1,r2\n12,1/5/2020,,2021-01-02\nabc,2020-01-01,,\n13,bad,,\n0,2020-01-01,,\n")
    assert [tuple(x) for x in so.read_event_table(spark, str(tmp_path / "e.csv"), "cik", "f", ("r1", "r2")).collect()] == [(12, d("2020-01-05"), d("2021-01-02"))]
    line = f"{'10-K':<12}{'ACME Ünion':<62}{'123':<12}{'2024-01-02':<12}"
    (tmp_path / "i.txt").write_bytes((line + "\n" + line.replace("10-K", "8-K ") + "\n").encode("latin-1"))
    assert [tuple(x) for x in so.read_fixed_width_index(spark, str(tmp_path / "i.txt")).collect()] == [("10-K", "ACME Ünion", 123, d("2024-01-02"))]
    files = spark.createDataFrame([("a.pdf", 9, b"%PDF-1.4 x"), ("b.pdf", 9, b"nope"), ("c.exe", 9, b"x"), ("d.html", 0, b""), ("e.htm", 9, b"<html>")], "path string, length long, content binary")
    assert {x.path: x.code for x in so.validate_uploads(files).collect()} == {"a.pdf": None, "b.pdf": "not_a_pdf", "c.exe": "unsupported_type", "d.html": "empty_file", "e.htm": None}
    assert so.load_panel(spark, str(tmp_path / "none"), ("a",)).count() == 0


FACT = "entity int, accession string, namespace string, tag string, unit string, start date, end date, value double"


def reported(rows):
    """(tag, start, end, value) rows of one filing as company facts."""
    return [(1, "a", "us-gaap", tag, "USD", d(start) if start else None, d(end), value) for tag, start, end, value in rows]


def resolved(spark, rows, more=()):
    facts = spark.createDataFrame([*reported(rows), *more], FACT)
    filings = spark.createDataFrame([(1, "a", "10-K", d("2025-02-01"), d("2024-12-31"))], "entity int, accession string, form string, filed date, period_end date")
    return {(r.concept, r.fy): r for r in rs.resolve(facts, filings).collect()}


def test_resolver_policies(spark):
    end, start = "2024-12-31", "2024-01-01"
    got = resolved(spark, [
        ("NetIncomeLoss", start, end, 100.0), ("ProfitLoss", start, end, 130.0), ("GrossProfit", start, end, 5.0), ("GrossProfit", "2024-10-01", end, 1.0), ("GrossProfit", start, "2024-09-30", 2.0),
        ("InventoryNet", None, end, 1000.0), ("InventoryNetCurrent", None, end, 1000.5), ("AccountsReceivableNetCurrent", None, end, 10.0), ("ReceivablesNetCurrent", None, end, 99.0),
        ("Assets", None, end, 900.0), ("Assets", None, end, 901.0), ("LongTermDebtCurrent", None, end, 3.0), ("ShortTermBorrowings", None, end, 4.0), ("CommercialPaper", None, end, 50.0),
        ("LongTermDebtNoncurrent", None, end, 20.0), ("StockholdersEquity", None, end, 300.0), ("Revenues", None, end, 77.0),
    ], [(1, "a", "us-gaap", "OperatingIncomeLoss", "EUR", d(start), d(end), 5.0), (1, "a", "dei", "OperatingIncomeLoss", "USD", d(start), d(end), 5.0)])
    r = got["net_income", 2024]
    assert (r.value, r.status, r.confidence, r.candidates) == (100.0, "found", "medium", [130.0])
    assert (got["gross_profit", 2024].value, got["gross_profit", 2024].confidence) == (5.0, "high")
    assert got["inventory", 2024].value == 1000.0 and got["inventory", 2024].candidates == [1000.5]
    assert got["accounts_receivable", 2024].status == "conflicting" and got["accounts_receivable", 2024].value is None
    assert got["total_assets", 2024].status == "conflicting" and got["total_assets", 2024].candidates == [900.0, 901.0]
    r = got["short_term_debt", 2024]
    assert (r.value, r.status, r.origin, r.formula) == (7.0, "derived", "derived", "LongTermDebtCurrent + ShortTermBorrowings")
    assert (got["total_debt", 2024].value, got["total_debt", 2024].formula) == (27.0, "short_term_debt + long_term_debt")
    assert (got["total_equity", 2024].value, got["total_equity", 2024].formula) == (300.0, "shareholders_equity")
    # An instant under a duration's tag, another unit and another namespace are no facts; the gaps are missing.
    assert got["revenue", 2024].status == got["operating_income", 2024].status == got["total_liabilities", 2024].status == "missing"
    assert ("operating_cash_flow", 2024) not in got and ("free_cash_flow", 2024) not in got


def test_resolver_derives_to_the_end_and_keeps_opening_balances(spark):
    end = "2024-12-31"
    got = resolved(spark, [("Assets", None, end, 1000.0), ("StockholdersEquity", None, end, 300.0), ("MinorityInterest", None, end, 50.0), ("StockholdersEquity", None, "2022-12-31", 200.0), ("LongTermDebtAndCapitalLeaseObligationsCurrent", None, end, 9.0), ("DebtCurrent", None, "2023-12-31", 5.0), ("CommercialPaper", None, "2023-12-31", 5.0)])
    assert got["total_equity", 2024].value == 350.0 and got["total_liabilities", 2024].value == 650.0
    assert {k for k, y in got if y == 2022} == {"shareholders_equity", "total_equity"}
    assert (got["short_term_debt", 2024].status, got["short_term_debt", 2024].confidence) == ("found", "medium")
    assert (got["short_term_debt", 2023].value, got["short_term_debt", 2023].confidence) == (5.0, "high")


def test_validations(spark):
    rows = [(1, "a", 2024, c, "s", v, st, "high", "reported", f, []) for c, v, st, f in [
        ("total_assets", 100.0, "found", None), ("total_liabilities", 60.0, "derived", "total_assets - total_equity"), ("total_equity", 40.0, "found", None), ("cash", 50.0, "found", None),
        ("operating_cash_flow", 20.0, "found", None), ("investing_cash_flow", -5.0, "found", None), ("financing_cash_flow", -5.0, "found", None), ("current_assets", 101.0, "found", None), ("inventory", -3.0, "found", None)]]
    rows += [(1, "a", 2023, "cash", "s", 10.0, "found", "high", "reported", None, [])]
    c = spark.createDataFrame(rows, "entity int, accession string, fy int, concept string, statement string, value double, status string, confidence string, origin string, formula string, candidates array<double>")
    got = {(r.rule, r.subject): (r.passed, r.difference) for r in rs.validations(c).collect()}
    assert got == {("cash_tie_out", "cash"): (False, 30.0), ("sign_sanity", "inventory"): (False, -3.0), ("sign_sanity", "current_assets in total_assets"): (False, 1.0)}
    open_ = c.withColumn("formula", F.lit(None).cast("string"))
    assert {(r.rule, r.passed) for r in rs.validations(open_).where("rule = 'balance_sheet_equation'").collect()} == {("balance_sheet_equation", True)}


def test_catalogs():
    assert len(fe.FEATURES) == 57 and len(set(fe.NAMES)) == 57 and len(el.specs()) == 12
    assert [len(fe.names_of(f)) for f in fe.FAMILIES] == [2, 6, 13, 17, 14, 5]
    assert fe.group_of("ratio_roa__missing") == "missingness" and fe.group_of("ratio_roa") == "profitability" and fe.group_of("log_revenue") == "size"
    assert fe.group_of("fact_coverage") == "data_quality" and fe.group_of("n_unusual_movements") == "cross_cutting" and fe.dimension_of("cash_to_assets") is None
    assert fe.concepts_of("trend_pct_quick_ratio") == ("cash", "accounts_receivable", "current_liabilities")


def test_ratio_warnings_and_quality(spark):
    rows = [(1, 2020, 100.0, 1.0, "found", "high"), (1, 2021, 100.0, 50.0, "derived", "low"), (1, 2022, 100.0, 50.0, "manually_corrected", "high")]
    w = spark.createDataFrame(rows, "e int, fy int, ebit double, interest_expense double, interest_expense_status string, interest_expense_confidence string")
    ratios = (ro.Ratio("interest_coverage", "coverage", ("ebit",), "interest_expense", near_zero=True), ro.Ratio("other", "coverage", ("ebit",), "interest_expense"))
    got = {(r.fy, r.ratio): r.warnings for r in ro.calculate(w, ("e", "fy"), ratios).collect()}
    assert got[2020, "interest_coverage"] == ["NEAR_ZERO_DENOMINATOR"] and got[2020, "other"] == []
    assert got[2021, "other"] == ["LOW_CONFIDENCE_INPUT", "DERIVED_INPUT"] and got[2022, "other"] == ["MANUAL_INPUT"]
    s = ro.calculate(w, ("e", "fy"), ratios)
    q = {r.fy: r.data_quality for r in ro.data_quality(s, ("fy",)).collect()}
    assert q == {2020: "good", 2021: "low_confidence", 2022: "manually_adjusted"}
    r = ro.quality_rollup(s, ("e",)).first()
    assert r.level == "low_confidence" and r.low_confidence == ["interest_coverage", "other"]
    assert one(spark, ro.formatted(F.lit(0.1234), "%")) == "12.3%" and one(spark, ro.formatted(F.lit(None).cast("double"), "x")) == "\u2014"


def test_evidence_merges_and_gates(spark):
    stamps = spark.createDataFrame([(1, "a", "10-K", d("2024-02-01"))], "entity int, accession string, form string, filed date")
    said = spark.createDataFrame([(1, "covenant_breach", "asserted", "moderate", "cv.breach", "item_7", 5, "q1"), (1, "covenant_breach", "asserted", "moderate", "cv.breach", "item_1a", 9, "q0")], "entity int, code string, assertion string, specificity string, pattern string, section_id string, char_start int, quote string")
    cover = spark.createDataFrame([(1, "item_3", False, None), (1, "item_7", True, None)], "entity int, section_id string, located boolean, reason string")
    rows = am.narrative_evidence(said, cover, stamps)
    got = {r.kind: r for r in rows.collect()}
    assert got["narrative_signal"].quote == "q0" and got["narrative_signal"].dimension == "leverage" and "2 occurrence(s)" in got["narrative_signal"].summary
    assert got["coverage_gap"].evidence_id.startswith("EV-NC-") and len(got["coverage_gap"].evidence_id) == 14
    a = spark.createDataFrame([(1, d("2024-03-01"))], "entity int, as_of date")
    assert am.assemble(rows.unionByName(rows), a).count() == 2
    with pytest.raises(Exception, match="not known at the cutoff"):
        am.assemble(rows, a.withColumn("as_of", F.lit("2024-01-01").cast("date"))).collect()
    clash = rows.unionByName(rows.withColumn("summary", F.lit("other")))
    with pytest.raises(Exception, match="two contents under"):
        ev.merged(clash).collect()
    with pytest.raises(Exception, match="no evidence and no reason"):
        am.absent_layers(rows, a, spark.createDataFrame([(1, "model", "x")], "entity int, layer string, reason string")).collect()
    assert [r.concern for r in am.newly_elevated(spark.createDataFrame([("k", "quiet", "elevated"), ("l", "elevated", "elevated"), ("m", None, "elevated")], "concern string, before string, after string")).collect()] == ["k", "m"]


def test_caveats(spark):
    parts = spark.createDataFrame([(1, "ratio_roa", 0.3, "profitability"), (1, "ratio_roa__missing", -0.4, "missingness"), (1, "n_unusual_movements", 0.1, "cross_cutting")], "entity int, feature string, contribution double, bucket string")
    rows = spark.createDataFrame([(1, 2.0, 1e-3)], "entity int, periods_available double, reconstruction_error double")
    inputs = spark.createDataFrame([(1, "ratio_roa", "net_income", "derived", "low"), (1, "ratio_roa", "total_assets", "found", "high")], "entity int, feature string, concept string, status string, confidence string")
    got = {(r.code, r.subject) for r in am.caveats(parts, rows, inputs, slope=0.5, cohort_confounded=True).collect()}
    assert got == {("missingness_driven", None), ("not_calibrated", None), ("base_rate_not_portfolio", None), ("cohort_confounded", None), ("unstable_attribution", None), ("limited_history", None), ("provenance_incomplete", "n_unusual_movements"), ("derived_input", "net_income"), ("low_confidence_input", "net_income")}


def test_walk_forward_and_permutation(spark):
    rnd = random.Random(2)
    rows = [(i, 2000 + i % 4, float(x := rnd.random()), rnd.random() if i % 3 else None, int(rnd.random() < x)) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id int, year int, a double, b double, label int")
    spec = el.Spec("l", "logistic", ("a", "b"))
    out = el.walk_forward(spec, df, (2000, 2002, 2003), ("row_id", "label"))
    got = out.collect()
    assert {r.fold for r in got} == {2002, 2003} and len(got) == 200
    assert me.roc_auc(out).first().auc > 0.65
    held = el.walk_forward(spec, df, (2003,), ("row_id",), test=F.col("row_id") % 2 == 0)
    assert {r.row_id % 2 for r in held.collect()} <= {0}
    dealt = el.permuted(df, "a", "row_id", 1, bucket_rows=50)
    assert sorted(r.a for r in dealt.collect()) == sorted(r[2] for r in rows) and dealt.columns == df.columns
    model = el.fit(spec, df)
    importance = el.permutation_importance(df, ("a", "b"), lambda x: el.score(spec, model, x), "row_id", repeats=2)
    assert importance[0][0] == "a" and importance[0][1] > 0.1
    slope, _ = el.calibration_fit(df.select(F.col("a").alias("score"), "label"))
    assert 0.4 < slope < 1.8 and el.calibration_fit(df.select(F.lit(2.0).alias("score"), "label")) == (None, None)


def test_screens(spark):
    c = spark.createDataFrame([(1, "6022", 5), (2, None, 5), (3, "2000", 1), (4, "2000", 3), (5, " ", 9)], "cik int, sic string, n_annual int")
    assert {r.cik: r.excluded for r in au.screen(c).collect()} == {1: "financial_sector", 2: "no_sic", 3: "too_few_filings", 4: None, 5: "no_sic"}
    items = spark.createDataFrame([("a", d("2024-01-01")), ("b", None), ("c", d("2024-03-01"))], "item string, filed date")
    late = {r.item: r.days_late for r in au.verify_as_of(items, F.lit("2024-02-01").cast("date")).collect()}
    assert late == {"b": None, "c": 29}
    with pytest.raises(Exception, match="unknown date"):
        au.assert_as_of(items.where("item != 'c'"), F.lit("2024-02-01").cast("date")).collect()
    drafts = spark.createDataFrame([('{"headline": {"text": "x", "evidence_ids": ["e"]}, "claims": []}',)], "payload string")
    assert gr.parse_drafts(drafts).first().draft.headline.text == "x"
    with pytest.raises(Exception):
        gr.parse_drafts(spark.createDataFrame([("not json",)], "payload string")).collect()


def test_sources_without_network(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"0": {"cik_str": 7, "ticker": "X", "title": "x"}, "1": {"cik_str": 7, "ticker": "Y", "title": "y"}, "2": {"cik_str": 9, "ticker": "Z", "title": "z"}}')
    assert sorted(r.cik for r in so.company_tickers(spark.read.text(str(tmp_path / "t.json"), wholetext=True)).collect()) == [7, 9]
    (tmp_path / "c.csv").write_bytes("CikBefore,CikEmerging,Name\n1,2,Ünion\n2,,b\n".encode("latin-1"))
    cases = so.read_cases(spark, str(tmp_path / "c.csv"))
    assert cases.first().Name == "Ünion" and sorted(r.key for r in au.stacked_keys(cases, "CikBefore", "CikEmerging").collect()) == [1, 2]
    assert so.read_documents(spark, str(tmp_path / "t.json")).first().length > 10
    facts = spark.createDataFrame([("Assets", "a"), ("Assets", "b"), ("Cash", "a")], "concept string, accn string")
    assert so.reference_rows(facts, ("Assets",), "a").count() == 1
    panel = spark.createDataFrame([(1, float("nan"), None, ""), (2, 2.0, 1, None)], "entity int, x double, label int, censoring_reason string")
    so.write_panel(panel, str(tmp_path / "p"))
    back = {r.entity: r for r in fe.from_rows(spark.read.parquet(str(tmp_path / "p"))).collect()}
    assert back[1].x is None and back[1].censoring_reason.startswith("Censored") and back[2].censoring_reason is None


def test_restatement_verdicts(spark):
    facts = spark.createDataFrame([("a", "T", d("2024-12-31"), 5.0), ("b", "T", d("2024-12-31"), 9000.0), ("b", "U", d("2024-12-31"), 7.0)], "accession string, tag string, end date, value double")
    rows = [(1, 2024, "same_tag", 5.0, "T", "a", 9000.0, "T", "b"), (2, 2024, "tag_change", 5.0, "T", "a", 7.0, "U", "b"), (3, 2024, "same_tag", 5.0, "T", "a", 6.0, "T", "zz"), (4, 2024, "same_tag", 5.0, None, "a", 6.0, "T", "b"), (5, 2024, "same_tag", 9.0, "T", "a", 9000.0, "T", "b")]
    df = spark.createDataFrame(rows, "entity int, fy long, kind string, first_value double, first_tag string, first_accession string, restated_value double, restated_tag string, restated_accession string")
    got = {r.entity: (r.verdict, r.looks_like_scale_error) for r in rs.verified_restatements(df, facts).collect()}
    assert got == {1: ("confirmed", False), 2: ("confirmed", False), 3: ("accession_absent", False), 4: ("unverifiable", False), 5: ("not_confirmed", True)}


def test_saved_model_and_explanation(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(i, float(x := rnd.random()), rnd.random() if i % 3 else None, int(rnd.random() < x)) for i in range(200)]
    df = spark.createDataFrame(rows, "entity int, ratio_roa double, log_revenue double, label int")
    spec = el.Spec("l", "logistic", ("ratio_roa", "log_revenue"))
    used = el.final_model(spec, df, str(tmp_path / "m"), {"rows": 200})
    assert used == ["ratio_roa", "log_revenue", "log_revenue__missing"] and "l" in spark.read.json(str(tmp_path / "m/metadata")).first().metadata
    model = el.fit(spec, df)
    parts = el.attributed(model, df, ("entity",))
    from pyspark.ml.functions import vector_to_array

    links = model[0].transform(el.mo.with_missing_indicators(df, [], ["log_revenue"])[0]).select("entity", F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("link"))
    assert el.reconstruction_error(parts, links, ("entity",)).first().reconstruction_error < 1e-6
    facts = spark.createDataFrame([(1, "net_income", 5.0, "found")], "entity int, concept string, value double, status string")
    got = {r.feature: r for r in el.explained(parts.where("entity = 1"), fe.catalog_frame(spark), facts).collect()}
    assert got["log_revenue__missing"].bucket == "missingness" and got["ratio_roa"].bucket == "profitability"
    assert [e.concept for e in got["ratio_roa"].evidence] == ["net_income"] and sorted(r.place for r in got.values()) == [1, 2, 3]
    with pytest.raises(TypeError):
        el.attributed(el.fit(el.Spec("g", "gradient_boosting", ("ratio_roa",)), df), df, ("entity",))
