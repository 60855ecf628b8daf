"""Walk-forward folds, company hold-outs, temporal and leakage assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_TRAIN_EVENTS, MIN_TEST_EVENTS, HOLDOUT = 20, 1, 30


def year_counts(rows: DataFrame, year: str = "year", label: str = "label", entity: str = "entity") -> DataFrame:
    return rows.groupBy(year).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(label).cast("long")).alias("n_events"), F.countDistinct(entity).alias("n_entities"))


def walk_forward(rows: DataFrame, min_train: int = MIN_TRAIN_EVENTS, min_test: int = MIN_TEST_EVENTS) -> DataFrame:
    """test_year, train_rows, train_events, test_rows and test_events of the eligible expanding folds.

    Only yearly counts are windowed; rows are aggregated once.
    """
    before = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    y = year_counts(rows)
    y = y.select("year", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("train_rows"), F.coalesce(F.sum("n_events").over(before), F.lit(0)).alias("train_events"), F.col("n_rows").alias("test_rows"), F.col("n_events").alias("test_events"))
    return y.where((F.col("train_events") >= min_train) & (F.col("test_events") >= min_test)).withColumnRenamed("year", "test_year")


def is_held_out(entity: Column, percent: int = HOLDOUT) -> Column:
    """A fixed share of entities, by the crc32 of their id as text."""
    return F.pmod(F.crc32(entity.cast("string").cast("binary")), F.lit(100)) < percent


def held_out_folds(rows: DataFrame, folds: DataFrame, percent: int = HOLDOUT, held: Column | None = None) -> DataFrame:
    """Folds with training rows of companies not held out and test rows of those held out."""
    held = is_held_out(F.col("entity"), percent) if held is None else held
    y = rows.groupBy("year", held.alias("held")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("e"))
    f = folds.select("test_year")
    # A row for each fold and year: small by construction.
    both = f.join(y, F.col("year") <= F.col("test_year"))
    train, test = ~F.col("held") & (F.col("year") < F.col("test_year")), F.col("held") & (F.col("year") == F.col("test_year"))
    out = both.groupBy("test_year").agg(*[F.sum(F.when(c, F.col(v)).otherwise(0)).alias(name) for c, v, name in ((train, "n", "train_rows"), (train, "e", "train_events"), (test, "n", "test_rows"), (test, "e", "test_events"))])
    return out.where((F.col("train_rows") > 0) & (F.col("test_rows") > 0))


def temporal_violations(rows: DataFrame, folds: DataFrame, date: str = "date") -> DataFrame:
    """Folds whose latest training date isn't before their earliest test date; none is right."""
    y = rows.groupBy("year").agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    both = folds.select("test_year").join(y, F.col("year") <= F.col("test_year"))
    out = both.groupBy("test_year").agg(F.max(F.when(F.col("year") < F.col("test_year"), F.col("hi"))).alias("train_max"), F.min(F.when(F.col("year") == F.col("test_year"), F.col("lo"))).alias("test_min"))
    return out.where(F.col("train_max") >= F.col("test_min"))


def leakage(observations: DataFrame, filings: DataFrame, entity: str, cutoff: str = "cutoff", accessions: str = "accessions") -> DataFrame:
    """Contributing filings of unknown date, or filed after the cutoff; none is right."""
    used = observations.select(entity, cutoff, F.explode(accessions).alias("accession"))
    joined = used.join(filings.select("accession", "filed"), "accession", "left")
    return joined.where(F.col("filed").isNull() | (F.col("filed") > F.col(cutoff)))
