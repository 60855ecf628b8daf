"""Readers of the parsed shapes: company facts, filings, event tables, index files, uploads.

Fetching is left to the landing zone; these take files that Spark can read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "array<struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string,frame:string>>"
FACTS = f"cik bigint, entityName string, facts map<string,map<string,struct<label:string,units:map<string,{ENTRY}>>>>"
ANNUAL_FORMS = ("10-K", "10-K/A", "10-KT", "10-K405")
RECENT = "form array<string>, accessionNumber array<string>, filingDate array<string>, reportDate array<string>, primaryDocument array<string>"
STANDARD_NAMESPACES = ("us-gaap", "dei", "srt", "ifrs-full", "invest", "country", "currency")
MIN_UPLOAD, MAX_UPLOAD = 1_000, 50_000_000


def company_facts(texts: DataFrame, column: str = "value") -> DataFrame:
    """One row for each reported fact of companyfacts JSON texts; bad namespaces give none."""
    j = texts.select(F.from_json(F.col(column), FACTS).alias("j")).select(F.col("j.cik").alias("cik"), F.explode("j.facts").alias("namespace", "concepts"))
    j = j.select("cik", "namespace", F.explode("concepts").alias("concept", "c")).select("cik", "namespace", "concept", F.explode("c.units").alias("unit", "entries"))
    rows = j.select("cik", "namespace", "concept", "unit", F.inline("entries"))
    return rows.withColumns({c: F.to_date(F.substring(c, 1, 10)) for c in ("start", "end", "filed")})


def read_company_facts(spark: SparkSession, path: str) -> DataFrame:
    return company_facts(spark.read.text(path, wholetext=True))


def annual_filings(submissions: DataFrame, recent: str = "recent", key: str = "cik") -> DataFrame:
    """Arrays of columns to rows: annual forms with a primary document, by (filed, accession)."""
    r = F.col(recent)
    rows = submissions.select(key, F.inline(F.arrays_zip(r["form"].alias("form"), r["accessionNumber"].alias("accession"), r["filingDate"].alias("filed"), r["reportDate"].alias("period"), r["primaryDocument"].alias("primary_document"))))
    rows = rows.where(F.col("form").isin(*ANNUAL_FORMS) & (F.coalesce("primary_document", F.lit("")) != ""))
    return rows.withColumns({"filed": F.to_date("filed"), "period": F.to_date(F.nullif("period", F.lit("")))}).orderBy("filed", "accession")


def submissions_pages(recent: DataFrame, overflow: DataFrame) -> DataFrame:
    """The inlined page and the overflow pages as one."""
    return recent.unionByName(overflow, allowMissingColumns=True)


def either_date(*columns: str):
    """The first column that parses in one of two formats."""
    return F.coalesce(*[F.coalesce(F.try_to_date(c, "yyyy-MM-dd"), F.try_to_date(c, "M/d/yyyy")) for c in columns])


def company_tickers(texts: DataFrame, column: str = "value") -> DataFrame:
    """The distinct companies of a JSON map of ticker entries."""
    entry = "map<string,struct<cik_str:bigint,ticker:string,title:string>>"
    rows = texts.select(F.explode(F.map_values(F.from_json(F.col(column), entry))).alias("e"))
    return rows.where("e.cik_str is not null").select(F.col("e.cik_str").alias("cik")).distinct()


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Landed filing documents: path, length and content."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """A case register, unpacked, in Latin-1."""
    return spark.read.csv(path, header=True, encoding="ISO-8859-1", multiLine=True)


def reference_rows(facts: DataFrame, concepts: tuple[str, ...], accession: str) -> DataFrame:
    """What one filing reported under reference concepts, comparatives included."""
    return facts.where(F.col("concept").isin(*concepts) & (F.col("accn") == accession))


def write_panel(panel: DataFrame, path: str) -> None:
    """A panel as Parquet, in place of the one before."""
    panel.write.mode("overwrite").parquet(path)


def event_table(rows: DataFrame, entity: str, filed: str, resolved: tuple[str, ...]) -> DataFrame:
    """entity, filed and resolved; rows with an odd entity or date are dropped."""
    e = F.col(entity).cast("string")
    out = rows.select(F.when(e.rlike(r"^\d+$"), e.try_cast("long")).alias("cik"), either_date(filed).alias("filed"), either_date(*resolved).alias("resolved"))
    return out.where("cik is not null and cik != 0 and filed is not null")


def read_event_table(spark: SparkSession, path: str, entity: str, filed: str, resolved: tuple[str, ...]) -> DataFrame:
    return event_table(spark.read.csv(path, header=True), entity, filed, resolved)


def fixed_width_index(lines: DataFrame, forms: tuple[str, ...] = ANNUAL_FORMS, column: str = "value") -> DataFrame:
    """form [0:12], company [12:74], cik [74:86], filed [86:98] of index lines."""
    part = lambda a, n: F.trim(F.substring(column, a + 1, n))
    rows = lines.select(part(0, 12).alias("form"), part(12, 62).alias("company"), part(74, 12).try_cast("long").alias("cik"), F.try_to_date(part(86, 12), "yyyy-MM-dd").alias("filed"))
    return rows.where(F.col("form").isin(*forms) & F.col("cik").isNotNull())


def read_fixed_width_index(spark: SparkSession, path: str) -> DataFrame:
    return fixed_width_index(spark.read.option("encoding", "ISO-8859-1").csv(path, sep="\x01", schema="value string", quote=""))


def validate_uploads(files: DataFrame, max_bytes: int = MAX_UPLOAD) -> DataFrame:
    """(path, length, content) with the first rejection code of suffix, emptiness, size and magic bytes."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    head = F.lower(F.decode(F.substring("content", 1, 1024), "ISO-8859-1"))
    code = F.when(~suffix.isin("pdf", "htm", "html"), F.lit("unsupported_type")).when(F.col("length") == 0, F.lit("empty_file")).when(F.col("length") > max_bytes, F.lit("too_large"))
    code = code.when((suffix == "pdf") & ~head.startswith("%pdf-"), F.lit("not_a_pdf")).when((suffix != "pdf") & ~head.contains("<"), F.lit("unreadable"))
    return files.select("path", "length", code.alias("code"))


def load_panel(spark: SparkSession, path: str, keep: tuple[str, ...], prefix: str = "ratio_") -> DataFrame:
    """Key columns and those of a prefix; a missing path is an empty frame of strings."""
    from pyspark.errors import AnalysisException

    try:
        panel = spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in keep))
    return panel.select(*keep, *[c for c in panel.columns if c.startswith(prefix)])
