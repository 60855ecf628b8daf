"""The driver tables as the engine's frames, in Spark and as common table expressions for the oracle.

Customers stand in for filers, orders for filings, line items for reported facts, the ship year for
the fiscal period, events for proceedings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONCEPTS = ("quantity", "extendedprice", "discount", "tax")
FIRST_YEAR, LAST_YEAR = 1995, 2001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str, by_filing: bool = False) -> DataFrame:
    """Line items with their filing: entity, filed, accession, line, fy and the four amounts.

    by_filing deals them by accession whatever their size, so that what multiplies them runs in as many
    tasks as the shuffle has, and their facts lie by filing already.
    """
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("accession"), F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("filed"))
    li = table(spark, sf_dir, "lineitem")
    li = li.select(F.col("l_orderkey").alias("accession"), F.col("l_linenumber").cast("long").alias("line"), F.year("l_shipdate").cast("long").alias("fy"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("state"), *[F.col(f"l_{c}").alias(c) for c in CONCEPTS])
    return li.join(o.hint("merge") if by_filing else o, "accession")


LINES = """lines AS (
  SELECT o_custkey AS entity, CAST(o_orderdate AS DATE) AS filed, o_orderkey AS accession, CAST(l_linenumber AS BIGINT) AS line,
         CAST(year(l_shipdate) AS BIGINT) AS fy, l_partkey AS part, l_suppkey AS supplier, l_returnflag AS flag, l_linestatus AS state,
         l_quantity AS quantity, l_extendedprice AS extendedprice, l_discount AS discount, l_tax AS tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, filed, accession, line, part, supplier, fy, concept, value."""
    keys = ["entity", "filed", "accession", "line", "part", "supplier", "fy"]
    return lines(spark, sf_dir).select(*keys, *CONCEPTS).unpivot(keys, list(CONCEPTS), "concept", "value")


FACTS = LINES + ", facts AS (" + " UNION ALL ".join(f"SELECT entity, filed, accession, line, part, supplier, fy, '{c}' AS concept, {c} AS value FROM lines" for c in CONCEPTS) + ")"


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, fy and sums of each customer's ship years, gaps included up to the last year."""
    li = lines(spark, sf_dir)
    sums = li.groupBy("entity", "fy").agg(
        F.round(F.sum("extendedprice"), 4).alias("price"), F.round(F.sum(F.col("extendedprice") * F.col("discount")), 4).alias("reduction"),
        F.round(F.sum(F.col("extendedprice") * F.col("tax")), 4).alias("duty"), F.round(F.sum("quantity"), 4).alias("quantity"),
    )
    spine = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_acctbal").alias("balance"), F.explode(F.sequence(F.lit(FIRST_YEAR).cast("long"), F.lit(LAST_YEAR).cast("long"))).alias("fy"))
    return spine.join(sums, ["entity", "fy"], "left")


YEARLY = (
    LINES
    + f""", sums AS (
  SELECT entity, fy, round(sum(extendedprice), 4) AS price, round(sum(extendedprice * discount), 4) AS reduction,
         round(sum(extendedprice * tax), 4) AS duty, round(sum(quantity), 4) AS quantity FROM lines GROUP BY entity, fy),
spine AS (SELECT c_custkey AS entity, c_acctbal AS balance, y AS fy FROM customer, range({FIRST_YEAR}, {LAST_YEAR + 1}) t(y)),
yearly AS (SELECT s.entity, s.fy, s.balance, price, reduction, duty, quantity FROM spine s LEFT JOIN sums USING (entity, fy))"""
)
