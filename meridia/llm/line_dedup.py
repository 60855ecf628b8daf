"""Cross-site line deduplication by distinct-site spread, in DataFrame operations only.

A line (trimmed of spaces; blank lines never count) seen on ``min_sites`` distinct sites or more
is boilerplate. Its first occurrence, in the document of the smallest id, stays; every other goes.
So text that many sites copied survives once.

Spread is estimated by HyperLogLog sketches of the sites of each line hash, merged by the
aggregation; lines whose estimate is within ``margin`` of the threshold are counted exactly, so
the decision is exact for any error of the sketches below the margin.

How it scales. Lines travel as two 64-bit hashes. The first aggregation, which combines before
its exchange, drops all lines with fewer occurrences than min_sites; sketches are made for the
rest only. Joins on a hot line can be split by adaptive execution; the texts are exchanged once,
by row key, against the removed line numbers of each document.

Edge cases. Null text stays null and has no lines; null sites don't count; null ids come after
all others. Rows sharing an id that is a line's first each keep it. A very long text is one row, its
lines an array of it. Empty tables give no rows, further columns are carried along; where one is
called as a count is, the count's name gets underscores after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm import _shared as sh

MIN_SITES, MARGIN, LG_K = 10, 0.25, 12
LAST = 2**63 - 1


def lines_of(docs: DataFrame, site_col: str) -> DataFrame:
    """rk, doc, site, pos, h1, h2: a row for each line that isn't blank."""
    lines = docs.select(
        sh.row_key().alias("rk"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
        F.col(site_col).alias("site"),
        F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"),
    ).select("rk", "doc", "site", "pos", F.trim("line").alias("line"))
    return lines.where("line != ''").select("rk", "doc", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN, site_col: str = "source") -> DataFrame:
    """h1, h2, first (the smallest document) of each boilerplate line."""
    lines = lines_of(docs, site_col)
    key = ["h1", "h2"]
    often = lines.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first")).where(F.col("n") >= min_sites)
    often = sh.held(often.select(*key, "first"))
    spread = (
        lines.select(*key, "site")
        .join(often, key)
        .groupBy(*key, "first")
        .agg(F.hll_sketch_agg(F.col("site").cast("string"), LG_K).alias("sketch"))
        .select(*key, "first", F.hll_sketch_estimate("sketch").alias("estimate"))
    )
    spread = sh.held(spread)
    low, high = min_sites * (1 - margin) - 1, min_sites * (1 + margin) + 1
    near = spread.where(F.col("estimate").between(low, high)).select(*key, "first")
    exact = (
        lines.select(*key, "site")
        .join(near, key)
        .groupBy(*key, "first")
        .agg(F.count_distinct("site").alias("sites"))
        .where(F.col("sites") >= min_sites)
        .select(*key, "first")
    )
    return spread.where(F.col("estimate") > high).select(*key, "first").unionByName(exact)


def counts_of(docs: DataFrame) -> tuple[str, str]:
    """Names of the two counts that line_dedup adds to docs."""
    return sh.fresh("_n_lines", docs.columns), sh.fresh("_n_removed", docs.columns)


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN, site_col: str = "source") -> DataFrame:
    """docs with text cut, and _n_lines (not blank) and _n_removed (or sh.fresh names of them)."""
    n_lines, n_removed = counts_of(docs)
    key = ["h1", "h2"]
    bad = boilerplate(docs, min_sites, margin, site_col)
    gone = (
        lines_of(docs, site_col)
        .join(bad, key)
        .groupBy("rk", *key, (F.col("doc") == F.col("first")).alias("own"))
        .agg(F.collect_set("pos").alias("at"))
        .select("rk", F.when(F.col("own"), F.array_except("at", F.array(F.array_min("at")))).otherwise(F.col("at")).alias("at"))
        .groupBy("rk")
        .agg(F.flatten(F.collect_list("at")).alias("gone"))
        .where(F.size("gone") > 0)
    )
    base = docs.select(sh.row_key().alias("rk"), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    base = base.select("rk", "row")
    full = base.join(gone.hint("shuffle_hash"), "rk", "left").select("row", "gone")
    text = F.col("row.text")
    split = F.split(text, "\n", -1)
    kept = F.filter(split, lambda x, i: ~F.array_contains(F.col("gone"), i))
    full = full.select(
        *[F.col(f"row.`{c}`").alias(c) if c != "text" else F.when(F.col("gone").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("text") for c in docs.columns],
        F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.filter(split, lambda x: F.trim(x) != ""))).cast("long").alias(n_lines),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(n_removed),
    )
    return full


def op10_line_dedup(spark, sf_dir) -> DataFrame:
    """The whole table with cross-site lines removed: counts and the md5 of the text that is left."""
    docs = sh.documents(spark, sf_dir).select("doc_id", "text", "source")
    out = line_dedup(docs)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


ORACLE_SQL = f"""
WITH docs AS (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, source, unnest(parts) AS raw, generate_subscripts(parts, 1) AS pos FROM docs
),
bad AS (
  SELECT trim(raw) AS line, min(doc_id) AS first FROM lines WHERE trim(raw) <> ''
  GROUP BY trim(raw) HAVING count(DISTINCT source) >= {MIN_SITES}
),
marked AS (
  SELECT l.doc_id, l.pos, l.raw, trim(l.raw) <> '' AS filled,
         b.line IS NOT NULL AND NOT (l.doc_id = b.first
           AND row_number() OVER (PARTITION BY l.doc_id, trim(l.raw) ORDER BY l.pos) = 1) AS gone
  FROM lines l LEFT JOIN bad b ON trim(l.raw) = b.line
)
SELECT doc_id,
       CAST(count(*) FILTER (WHERE filled) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
       md5(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_md5
FROM marked GROUP BY doc_id
"""
