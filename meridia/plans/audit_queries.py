"""Queries of audits and corpus screens, and of scalar functions over columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.functions import python_text as tx
from meridia.functions import scalars as fx
from meridia.operators import audits as au
from meridia.operators import narrative as na
from meridia.operators import ratios as ro
from meridia.plans import frames as fr
from meridia.plans.registry import query

# Customers as companies, orders as their filings, parts as event entities.
COMPANIES = """companies AS (SELECT c_custkey AS entity, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(5900 + (c_custkey * 37) % 1300 AS VARCHAR) END AS sic,
 CASE WHEN c_custkey % 2 = 0 THEN 'event' ELSE 'comparison' END AS cohort, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_annual FROM customer)"""


def _companies(spark, sf_dir):
    n = fr.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.count(F.lit(1)).alias("n_annual"))
    c = fr.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"))
    sic = F.when(F.col("entity") % 11 != 0, (5900 + (F.col("entity") * 37) % 1300).cast("string"))
    return c.join(n, "entity", "left").select("entity", sic.alias("sic"), F.when(F.col("entity") % 2 == 0, F.lit("event")).otherwise(F.lit("comparison")).alias("cohort"), "n_annual")


@query(f"""WITH {COMPANIES} SELECT cohort, CASE WHEN sic IS NULL THEN 'no_sic' WHEN CAST(sic AS INT) BETWEEN 6000 AND 6999 THEN 'financial_sector' WHEN n_annual < 2 THEN 'too_few_filings' END AS excluded, count(*) AS n FROM companies GROUP BY ALL""")
def scope_funnel(spark, sf_dir):
    return au.funnel(au.screen(_companies(spark, sf_dir)))


_INDEX = [(1993, 100.0), (1994, 103.0), (1995, 106.0), (1996, 109.5), (1997, 111.0)]


@query(f"""WITH idx AS (SELECT * FROM (VALUES {', '.join(f'({y}, {v})' for y, v in _INDEX)}) t(y, level)), o AS (SELECT o_orderkey, o_totalprice AS size, year(o_orderdate) AS year FROM orders),
near AS (SELECT year, arg_min(level, (abs(y - year), y)) AS level FROM (SELECT DISTINCT year FROM o), idx GROUP BY year),
j AS (SELECT CASE WHEN o_orderkey % 13 <> 0 THEN size END AS size, 100000.0 * level / 106.0 AS threshold FROM o JOIN near USING (year))
SELECT CASE WHEN size IS NULL THEN 'no_size' WHEN size >= threshold THEN 'kept' ELSE 'below' END AS state, count(*) AS n, round(median(size - threshold), 4) AS median_gap FROM j GROUP BY 1""")
def size_threshold(spark, sf_dir):
    o = fr.table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice")).alias("size"), F.year("o_orderdate").alias("year"))
    rows = au.adjusted_threshold(o, spark.createDataFrame(_INDEX, "year int, level double"), 100000.0, 1995)
    return au.eligible_by_size(rows).withColumn("median_gap", F.round("median_gap", 4))


@query("SELECT DISTINCT k AS key FROM (SELECT l_partkey AS k FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem)")
def stacked_keys(spark, sf_dir):
    return au.stacked_keys(fr.table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


FRAME = "frame AS (SELECT DISTINCT o_custkey AS entity, year(o_orderdate) AS year FROM orders), marked AS (SELECT DISTINCT l_suppkey AS key FROM lineitem WHERE l_quantity > 45)"


def _frame(spark, sf_dir):
    filings = fr.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").cast("long").alias("year"))
    marked = au.stacked_keys(fr.table(spark, sf_dir, "lineitem").where("l_quantity > 45"), "l_suppkey")
    return filings, marked


@query(f"WITH {FRAME} SELECT entity, count(*) AS n_years, min(year) AS first_year, max(year) AS last_year FROM frame WHERE entity NOT IN (SELECT key FROM marked) GROUP BY entity HAVING count(*) >= 2")
def point_in_time_frame(spark, sf_dir):
    return au.point_in_time_frame(*_frame(spark, sf_dir))


@query(f"WITH {FRAME} SELECT year, count(*) AS n_entities, count(*) FILTER (WHERE entity IN (SELECT key FROM marked)) / count(*) AS surviving_share FROM frame GROUP BY year")
def survivorship_by_year(spark, sf_dir):
    return au.survivorship(*_frame(spark, sf_dir))


@query("WITH k AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linenumber >= 3) SELECT count(*) FILTER (WHERE o_orderkey IN (SELECT k FROM k)) AS n_joined, count(*) FILTER (WHERE o_orderkey NOT IN (SELECT k FROM k)) AS n_unmatched FROM orders")
def joined_coverage(spark, sf_dir):
    right = fr.table(spark, sf_dir, "lineitem").where("l_linenumber >= 3").select(F.col("l_orderkey").alias("k"))
    return au.joined_coverage(fr.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), right, "k")


@query("""WITH p AS (SELECT l_returnflag AS flag, abs(l_extendedprice - l_quantity * 1500) / greatest(abs(l_extendedprice), abs(l_quantity * 1500), 1.0) AS gap FROM lineitem)
SELECT flag, count(*) AS n, round(median(gap), 9) AS median_difference, avg(CAST(gap > 0.05 AS INT)) AS share_above FROM p GROUP BY flag""")
def relative_differences(spark, sf_dir):
    rows = fr.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("a"), (F.col("l_quantity") * 1500).alias("b"))
    return au.relative_differences(rows, "flag", "a", "b").withColumn("median_difference", F.round("median_difference", 9))


@query("""WITH f AS (SELECT DISTINCT l_returnflag AS code, l_orderkey AS accession FROM lineitem), e AS (SELECT o_orderkey AS accession FROM orders WHERE o_orderstatus = 'F')
SELECT code, count(*) AS n, count(*) FILTER (WHERE accession IN (SELECT accession FROM e)) / count(*) AS event_share FROM f GROUP BY code""")
def followed_by_event(spark, sf_dir):
    found = fr.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("code"), F.col("l_orderkey").alias("accession"))
    return au.followed_by_event(found, fr.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("accession")))


@query("""WITH r AS (SELECT l_shipmode AS section, l_quantity > 20 AS located, CAST(l_linenumber AS BIGINT) AS n FROM (SELECT *, l_returnflag AS l_shipmode FROM (SELECT l_quantity, l_linenumber, l_returnflag FROM lineitem)))
SELECT section, count(*) AS n, avg(CAST(located AS INT)) AS located_rate, median(n) FILTER (WHERE located) AS median_sentences FROM r GROUP BY section""")
def located_sections(spark, sf_dir):
    rows = fr.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("section"), (F.col("l_quantity") > 20).alias("located"), F.col("l_linenumber").cast("long").alias("n_sentences"))
    return au.located_sections(rows)


@query("""WITH r AS (SELECT l_returnflag AS code, CASE WHEN l_discount > 0.03 THEN 'correct' ELSE 'wrong' END AS verdict FROM lineitem)
SELECT code, count(*) AS n, avg(CAST(verdict = 'correct' AS INT)) AS "precision" FROM r GROUP BY GROUPING SETS ((code), ())""")
def label_precision(spark, sf_dir):
    rows = fr.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("code"), F.when(F.col("l_discount") > 0.03, F.lit("correct")).otherwise(F.lit("wrong")).alias("verdict"))
    return au.label_scores(rows)


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS k, l_returnflag AS code FROM lineitem), f AS (SELECT DISTINCT l_orderkey AS k, l_returnflag AS code FROM lineitem WHERE l_quantity > 30)
SELECT code, count(*) AS n_expected, count(f.k) AS n_found, count(f.k) / count(*) AS recall FROM e LEFT JOIN f USING (k, code) GROUP BY code""")
def code_recall(spark, sf_dir):
    li = fr.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("code"), "l_quantity")
    return au.code_recall(li, li.where("l_quantity > 30"), ("k",))


@query("SELECT l_returnflag AS code, least(count(*), 25) AS n FROM lineitem GROUP BY ALL")
def stratified_pools(spark, sf_dir):
    li = fr.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("code"), "l_orderkey", "l_linenumber", "l_partkey")
    return au.stratified(li, "code", ("l_orderkey", "l_linenumber", "l_partkey"), 25).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag AS flag, count(DISTINCT l_orderkey) AS n_l_orderkey, round(sum(l_tax), 6) AS l_tax, round(sum(l_discount), 6) AS l_discount, round(sum(l_tax) / sum(l_discount), 9) AS recall FROM lineitem GROUP BY ALL")
def named_totals(spark, sf_dir):
    out = au.named_totals(fr.table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "flag"), ("flag",), "l_orderkey", ("l_tax", "l_discount"), "l_tax", "l_discount")
    return out.select("flag", "n_l_orderkey", *[F.round(c, 6).alias(c) for c in ("l_tax", "l_discount")], F.round("recall", 9).alias("recall"))


@query("SELECT o_orderkey AS item, CAST(o_orderdate AS DATE) AS filed, date_diff('day', DATE '1998-06-01', CAST(o_orderdate AS DATE)) AS days_late FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1998-06-01'")
def as_of_gate_refusals(spark, sf_dir):
    items = fr.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.to_date("o_orderdate").alias("filed"))
    return au.verify_as_of(items, F.to_date(F.lit("1998-06-01"))).withColumn("days_late", F.col("days_late").cast("long"))


@query("SELECT count(*) AS n, min(CAST(o_orderdate AS DATE)) AS first FROM orders")
def as_of_gate_admits(spark, sf_dir):
    """The gate over items that it all admits: it fails the query on the first that it doesn't."""
    items = fr.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.to_date("o_orderdate").alias("filed"))
    return au.assert_as_of(items, F.to_date(F.lit("2100-01-01"))).agg(F.count(F.lit(1)).alias("n"), F.min("filed").alias("first"))


# Scalars.

_X = "(l_extendedprice + 0.003 + l_linenumber * 0.0001)"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN {_X} >= 1000 THEN printf('%.1fK', {_X} / 1000) ELSE printf('%.1f', {_X}) END AS compact, printf('%.2f', {_X}) AS fixed, printf('%.1f%%', 100 * (l_tax + 0.00013)) AS percent,
 printf('%.2fx', {_X}) AS multiple, upper(substring(l_returnflag, 1, 1)) || ' flag of line' AS shown, CASE WHEN l_tax > 0.01 THEN round(ln(l_tax), 9) END AS log_tax, CASE WHEN abs(l_discount) > 0 THEN round(l_tax / l_discount, 9) END AS ratio,
 CAST(regexp_extract('FY' || year(l_shipdate) || '-Q1', '(\\d{{4}})', 1) AS INTEGER) AS fiscal_year, 0.5 * pow(10.0, -CAST(l_linenumber AS DOUBLE)) * 1000 AS half_ulp, printf('%.4g', {_X}) AS short_text, printf('%+.4g', -{_X}) AS signed_text FROM lineitem""")
def scalar_formats(spark, sf_dir):
    li = fr.table(spark, sf_dir, "lineitem")
    x = F.col("l_extendedprice") + 0.003 + F.col("l_linenumber") * 0.0001
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", fx.compact_number(x).alias("compact"), fx.fixed(x).alias("fixed"), fx.percent(F.col("l_tax") + 0.00013).alias("percent"), ro.formatted(x, "x").alias("multiple"),
        fx.humanise(F.concat(F.lower("l_returnflag"), F.lit("_flag_of_line"))).alias("shown"), F.round(fx.log_positive(F.when(F.col("l_tax") > 0.01, F.col("l_tax"))), 9).alias("log_tax"), F.round(fx.safe_ratio("l_tax", "l_discount"), 9).alias("ratio"),
        fx.fiscal_year(F.concat(F.lit("FY"), F.year("l_shipdate").cast("string"), F.lit("-Q1"))).alias("fiscal_year"), fx.half_ulp(F.col("l_linenumber"), 1000.0).alias("half_ulp"), tx.short_float(x).alias("short_text"), tx.signed_float(-x).alias("signed_text"),
    )


_CELL = """CASE l_orderkey % 7 WHEN 0 THEN format('{:,.2f}', l_extendedprice) WHEN 1 THEN '(' || format('{:,.2f}', l_extendedprice) || ')' WHEN 2 THEN '$ ' || printf('%.2f', l_extendedprice) WHEN 3 THEN '$(' || printf('%.2f', l_extendedprice) || ')'
 WHEN 4 THEN printf('%.2f', l_extendedprice) || '*' WHEN 5 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'n/a' ELSE '-' END ELSE 'see ' || l_returnflag END"""


@query(f"""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, {_CELL} AS cell FROM lineitem), p AS (SELECT *, regexp_replace(cell, '[^0-9.]', '', 'g') AS digits, cell LIKE '%(%' AS paren, cell IN ('n/a', '-') AS blank, cell LIKE 'see %' AS words FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, cell, CASE WHEN blank OR words THEN NULL WHEN paren THEN -CAST(digits AS DOUBLE) ELSE CAST(digits AS DOUBLE) END AS value, paren AS is_negative_paren, blank AS is_blank_marker FROM p""")
def parse_numeric(spark, sf_dir):
    """Prices printed as table cells and read back."""
    x, k = F.col("l_extendedprice"), F.col("l_orderkey") % 7
    grouped, plain = F.format_string("%,.2f", x), F.format_string("%.2f", x)
    cell = F.when(k == 0, grouped).when(k == 1, F.concat(F.lit("("), grouped, F.lit(")"))).when(k == 2, F.concat(F.lit("$ "), plain)).when(k == 3, F.concat(F.lit("$("), plain, F.lit(")"))).when(k == 4, F.concat(plain, F.lit("*")))
    cell = cell.when(k == 5, F.when(F.col("l_linenumber") % 2 == 0, F.lit("n/a")).otherwise(F.lit("-"))).otherwise(F.concat(F.lit("see "), "l_returnflag"))
    rows = fr.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", cell.alias("cell"))
    return rows.select("*", fx.parse_numeric("cell").alias("p")).select("l_orderkey", "l_linenumber", "l_partkey", "cell", F.col("p.value").cast("double").alias("value"), "p.is_negative_paren", "p.is_blank_marker")


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, floor(l_extendedprice / 10) * 500 * CASE WHEN l_partkey % 5 = 0 THEN -1.0 ELSE 1.0 END AS value FROM lineitem),
f AS (SELECT v.*, abs(value) / s AS x, s, p FROM v, (SELECT unnest([1.0, 1000.0, 1000000.0]) AS s), (SELECT unnest([0, 1, 2]) AS p)),
t AS (SELECT *, CASE p WHEN 0 THEN format('{:,.0f}', x) WHEN 1 THEN format('{:,.1f}', x) ELSE format('{:,.2f}', x) END AS shown FROM f),
k AS (SELECT * FROM t WHERE abs(CAST(replace(shown, ',', '') AS DOUBLE) - x) < 1e-9 * greatest(1.0, x))
SELECT l_partkey, value, count(DISTINCT shown) * CASE WHEN any_value(value) < 0 THEN 3 ELSE 1 END AS n_forms, min(shown) AS least FROM k GROUP BY l_partkey, value""")
def render_candidates(spark, sf_dir):
    value = F.floor(F.col("l_extendedprice") / 10) * 500 * F.when(F.col("l_partkey") % 5 == 0, -1.0).otherwise(1.0)
    rows = fr.table(spark, sf_dir, "lineitem").select("l_partkey", value.alias("value")).distinct().withColumn("c", tx.candidates("value"))
    bare = F.filter("c", lambda s: ~s.startswith("-") & ~s.startswith("("))
    return rows.select("l_partkey", "value", F.size("c").cast("long").alias("n_forms"), F.array_min(bare).alias("least"))


@query("""SELECT doc_id, md5(translate(lower(replace(text, 'İ', 'ı')), '‘’“”–—•' || chr(160), '''''""---' || ' ')) AS view_md5, length(text) AS n FROM documents""")
def match_view(spark, sf_dir):
    """Texts in plain lower case of unchanged length."""
    d = fr.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(na.view("text").cast("binary")).alias("view_md5"), F.length(na.view("text")).cast("long").alias("n"))


@query("""SELECT o_orderkey, list_aggregate(list_sort(list_distinct(['FY ' || year(o_orderdate), 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate)])), 'string_agg', ';') AS tokens,
 CASE o_orderkey % 4 WHEN 0 THEN 1e3 WHEN 1 THEN 1e6 WHEN 2 THEN 1e9 END AS scale, replace(o_orderkey || '-25-' || o_custkey, '-', '') AS compact, 'cash_to_assets' AS base FROM orders""")
def text_tokens(spark, sf_dir):
    """Fiscal tokens, scale words, compact accessions and features without their missing mark."""
    o = fr.table(spark, sf_dir, "orders")
    y = F.year("o_orderdate").cast("string")
    text = F.concat(F.lit("In fy "), y, F.lit(", FY "), y, F.lit(" and Q"), F.quarter("o_orderdate").cast("string"), F.lit(" "), y)
    unit = F.element_at(F.array(*[F.lit(s) for s in ("In Thousands", "(in millions)", "USD billions", "as reported")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    accession = F.concat_ws("-", F.col("o_orderkey").cast("string"), F.lit("25"), F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", F.array_join(tx.period_tokens(text), ";").alias("tokens"), fx.scale_word(unit).alias("scale"), fx.strip_dashes(accession).alias("compact"), fx.base_feature(F.lit("cash_to_assets__missing")).alias("base"))


@query()
def content_ids(spark, sf_dir):
    """Ids and payload hashes: equal contents share theirs."""
    o = fr.table(spark, sf_dir, "orders")
    payload = F.to_json(F.struct("o_custkey", "o_orderstatus"))
    return o.select("o_orderkey", tx.content_id("EV-DS-", 4)(F.col("o_custkey").cast("string")).alias("evidence_id"), tx.payload_hash(payload).alias("payload_hash"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_shipdate AS DATE) - 100 END AS start, CAST(l_shipdate AS DATE) AS "end", CASE WHEN l_partkey % 2 = 0 THEN 'instant' ELSE 'duration' END AS nature FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, (start IS NULL) = (nature = 'instant') AS fits, CASE WHEN (start IS NULL) = (nature = 'instant') THEN "end" END AS "end" FROM r""")
def typed_periods(spark, sf_dir):
    end = F.to_date("l_shipdate")
    p = fx.period_of(F.when(F.col("l_linenumber") % 2 == 0, F.date_sub(end, 100)), end, F.when(F.col("l_partkey") % 2 == 0, F.lit("instant")).otherwise(F.lit("duration")))
    rows = fr.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", p.alias("p"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.col("p").isNotNull().alias("fits"), "p.end")
