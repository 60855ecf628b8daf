"""An append-only store in Parquet: idempotent inserts by content ids, hash checks and history views.

Rows are never updated or deleted by this API; readers re-verify stored hashes. Parquet has no
triggers, so that is weaker than a database that refuses updates, and it's stated here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridia.functions import python_text as tx

SCHEMA_VERSION = 1
TABLES = {
    "assessment": "assessment_id string, cik long, as_of date, payload string, payload_hash string, recorded_at timestamp",
    "draft": "draft_id string, assessment_id string, model string, payload string, payload_hash string, recorded_at timestamp",
    "review": "review_id string, draft_id string, assessment_id string, status string, supersedes string, payload string, payload_hash string, recorded_at timestamp",
}
KEYS = {"assessment": "assessment_id", "draft": "draft_id", "review": "review_id"}
PARENTS = {"draft": [("assessment_id", "assessment")], "review": [("assessment_id", "assessment"), ("draft_id", "draft")]}


class AppendOnlyViolation(ValueError):
    """A row under a known id differs, or a parent is missing."""


class Store:
    """Tables below one folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._exists = lambda p: (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(h)
        version = f"{self.path}/version"
        if self._exists(version):
            have = spark.read.parquet(version).first()[0]
            if have != SCHEMA_VERSION:
                raise ValueError(f"schema version {have}, not {SCHEMA_VERSION}; the store doesn't migrate")
        else:
            spark.createDataFrame([(SCHEMA_VERSION,)], "version int").coalesce(1).write.parquet(version)

    def table(self, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        if not self._exists(path):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(path)

    def _append(self, name: str, rows: DataFrame) -> int:
        key = KEYS[name]
        rows = rows.withColumn("payload_hash", tx.payload_hash("payload")).select(*[c.split()[0] for c in TABLES[name].split(", ")])
        rows = rows.dropDuplicates([key, "payload_hash"])
        have = self.table(name)
        clash = rows.join(have.select(key, F.col("payload_hash").alias("_h")), key).where("_h != payload_hash")
        twice = rows.groupBy(key).count().where("count > 1")
        if clash.take(1) or twice.take(1):
            raise AppendOnlyViolation(f"another {name} is recorded under an id")
        for column, parent in PARENTS.get(name, ()):
            orphans = rows.where(F.col(column).isNotNull()).join(self.table(parent).select(F.col(KEYS[parent]).alias(column)), column, "left_anti")
            if orphans.take(1):
                raise AppendOnlyViolation(f"{name} without its {parent}")
        new = rows.join(have.select(key), key, "left_anti")
        before = have.count()
        new.write.mode("append").parquet(f"{self.path}/{name}")
        return self.table(name).count() - before

    def record_assessments(self, rows: DataFrame) -> int:
        """Rows of (cik, as_of, payload, recorded_at); the id is their content's. Returns how many are new."""
        text = F.concat_ws("|", F.col("cik").cast("string"), F.col("as_of").cast("string"), tx.payload_hash("payload"))
        return self._append("assessment", rows.withColumn("assessment_id", tx.content_id("AS-")(text)))

    def record_drafts(self, rows: DataFrame) -> int:
        """Rows of (assessment_id, model, payload, recorded_at); rejected drafts are kept too."""
        text = F.concat_ws("|", "assessment_id", "model", tx.payload_hash("payload"))
        return self._append("draft", rows.withColumn("draft_id", tx.content_id("DR-")(text)))

    def record_reviews(self, rows: DataFrame) -> int:
        return self._append("review", rows)

    def verified(self, name: str) -> DataFrame:
        """The table's rows; reading one whose payload doesn't match its hash fails."""
        rows = self.table(name).withColumn("_h", tx.payload_hash("payload"))
        ok = F.when(F.col("_h") == F.col("payload_hash"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit(f"{name} changed: "), F.col(KEYS[name]))).cast("string"))
        return rows.withColumn("payload", ok).drop("_h")

    def counts(self) -> dict[str, int]:
        return {t: self.table(t).count() for t in TABLES}

    def history(self) -> DataFrame:
        """Assessments with their latest draft, effective review, state and rank (1 is current)."""
        return history(self.table("assessment"), self.table("draft"), self.table("review"))


def latest_per_key(rows: DataFrame, key: str, order: list) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def effective_review(reviews: DataFrame, key: str = "assessment_id") -> DataFrame:
    """The latest review of each key that no other one supersedes."""
    free = reviews.join(reviews.where("supersedes is not null").select(F.col("supersedes").alias("review_id")).distinct(), "review_id", "left_anti")
    return latest_per_key(free, key, [F.desc("recorded_at"), F.desc("review_id")])


def history(assessments: DataFrame, drafts: DataFrame, reviews: DataFrame) -> DataFrame:
    draft = latest_per_key(drafts, "assessment_id", [F.desc("recorded_at"), F.desc("draft_id")]).select("assessment_id", "draft_id")
    review = effective_review(reviews).select("assessment_id", "review_id", F.col("status").alias("review_status"))
    rank = F.row_number().over(Window.partitionBy("cik").orderBy(F.desc("as_of"), F.desc("recorded_at"), "assessment_id"))
    rows = assessments.withColumn("rank", rank).join(draft, "assessment_id", "left").join(review, "assessment_id", "left")
    state = F.when(F.col("rank") > 1, F.lit("superseded")).when(F.col("review_status").isNull(), F.lit("draft")).otherwise(F.col("review_status"))
    return rows.withColumn("state", state)


def watchlist(assessments: DataFrame, drafts: DataFrame, reviews: DataFrame) -> DataFrame:
    """The current assessment of each company, in the order of the company."""
    return history(assessments, drafts, reviews).where("rank = 1").orderBy("cik")
