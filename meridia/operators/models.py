"""Hazard models: imputed, standardised logistic regression, linear attribution, heuristic scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Fixed value.
ROUNDS = 150


def with_missing_indicators(rows: DataFrame, features: Sequence[str], indicators: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """f__missing columns for the features with any null in these rows, or for the given ones, by name."""
    if indicators is None:
        nulls = rows.agg(F.lit(0).alias("_"), *[F.bool_or(F.col(f).isNull()).alias(f) for f in features]).first().asDict()
        indicators = [f for f in features if nulls[f]]
    return rows.withColumns({f"{f}__missing": F.col(f).isNull().cast("double") for f in indicators}), list(indicators)


def logistic(features: Sequence[str], label: str = "label", c: float = 0.1, n: int | None = None) -> Pipeline:
    """Median imputation, standardisation, logistic regression with an L2 penalty 1 / (c n)."""
    filled = [f"{f}__x" for f in features]
    return Pipeline(
        stages=[
            Imputer(strategy="median", inputCols=list(features), outputCols=filled, relativeError=0.0001),
            VectorAssembler(inputCols=filled, outputCol="raw"),
            StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
            LogisticRegression(featuresCol="scaled", labelCol=label, regParam=1.0 / (c * n) if n else 0.01, elasticNetParam=0.0, standardization=False, maxIter=100, tol=1e-9),
        ]
    )


def boosting(features: Sequence[str], label: str = "label") -> Pipeline:
    """Boosted trees of few leaves. Native nulls and early stopping have no counterpart: imputed, fixed rounds."""
    filled = [f"{f}__x" for f in features]
    return Pipeline(
        stages=[
            Imputer(strategy="median", inputCols=list(features), outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="scaled"),
            GBTClassifier(featuresCol="scaled", labelCol=label, maxDepth=2, minInstancesPerNode=40, maxIter=ROUNDS, stepSize=0.05, seed=20260917),
        ]
    )


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))


def contributions(model: PipelineModel, rows: DataFrame, features: Sequence[str], key: Sequence[str]) -> DataFrame:
    """key, feature, contribution and baseline: coefficient times scaled value; they sum to the link score."""
    lr = model.stages[-1]
    weights = F.array(*[F.lit(float(w)) for w in lr.coefficients])
    names = F.array(*[F.lit(f) for f in features])
    x = vector_to_array("scaled")
    parts = F.arrays_zip(names.alias("feature"), F.zip_with(x, weights, lambda a, b: a * b).alias("contribution"))
    return model.transform(rows).select(*key, F.inline(parts), F.lit(float(lr.intercept)).alias("baseline")).toDF(*key, "feature", "contribution", "baseline")


def by_group(parts: DataFrame, key: Sequence[str], group: str, top: int = 4) -> DataFrame:
    """Sum, share of the absolute total, count and the top features of each group."""
    rows = parts.groupBy(*key, group).agg(F.sum("contribution").alias("total"), F.sum(F.abs("contribution")).alias("size"), F.count(F.lit(1)).alias("n"), F.slice(F.reverse(F.array_sort(F.collect_list(F.struct(F.abs("contribution").alias("a"), "feature")))), 1, top).alias("t"))
    whole = rows.groupBy(*key).agg(F.sum("size").alias("whole"))
    return rows.join(whole, list(key)).select(*key, group, "total", F.try_divide(F.col("size"), F.col("whole")).alias("share"), "n", F.transform("t", lambda e: e["feature"]).alias("top_features"))


def heuristic(rows: DataFrame, feature: str, sign: int = 1) -> DataFrame:
    """The signed feature as a score; null scores below every other, all-null ones 0."""
    s = F.col(feature).cast("double") * sign
    least = rows.agg(F.min(s).alias("least"))
    return rows.join(F.broadcast(least)).withColumn("score", F.coalesce(s, F.col("least") - 1, F.lit(0.0))).drop("least")
