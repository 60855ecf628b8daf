"""Walk-forward evaluation: model specs, out-of-fold scores, paired differences, calibration, importance, robustness.

Folds are trained one after another on the driver's word, each a distributed fit; what is pooled are
scored rows. Resampling gives clusters Poisson weights from a hash of their id, so a resample needs no
exchange of its own and clusters stay whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.operators import features as fe
from meridia.operators import metrics as me
from meridia.operators import models as mo

MIN_CLUSTERS, SAMPLES, SEED = 5, 1000, 20260917
CLIP = 1e-6


@dataclass(frozen=True)
class Spec:
    """A candidate: a heuristic by one feature, a logistic regression with penalty c, or boosted trees."""

    name: str
    family: str
    features: tuple[str, ...]
    sign: int = 1
    c: float = 0.1


def specs() -> tuple[Spec, ...]:
    """Four heuristics, six logistic regressions of growing families, a weak penalty, and boosting."""
    out = [
        Spec("heuristic_leverage", "heuristic", ("ratio_debt_to_assets",)),
        Spec("heuristic_working_capital", "heuristic", ("working_capital_to_assets",), -1),
        Spec("heuristic_ebit_to_assets", "heuristic", ("ebit_to_assets",), -1),
        Spec("heuristic_phase7_deterioration", "heuristic", ("n_deteriorating_ratios",)),
    ]
    out += [Spec("logistic_" + "+".join(fe.FAMILIES[:k]), "logistic", fe.names_of(*fe.FAMILIES[:k])) for k in range(1, len(fe.FAMILIES) + 1)]
    return (*out, Spec("logistic_all_weak_penalty", "logistic", fe.NAMES, c=1.0), Spec("gradient_boosting_all", "gradient_boosting", fe.NAMES))


def fit(spec: Spec, train: DataFrame, label: str = "label") -> tuple[PipelineModel, list[str]] | None:
    """The fitted model and its columns; None with one class only. A feature without values in training is left out."""
    n = train.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(label).alias("k"), *[F.count(f).alias(f"n_{f}") for f in spec.features]).first()
    if n.k < 2:
        return None
    used = [f for f in spec.features if n[f"n_{f}"]]
    if spec.family == "logistic":
        rows, marks = mo.with_missing_indicators(train, used)
        used += [f"{m}__missing" for m in marks]
        return mo.logistic(used, label, spec.c, n.n).fit(rows), used
    return mo.boosting(used, label).fit(train), used


def score(spec: Spec, model: tuple[PipelineModel, list[str]] | None, rows: DataFrame) -> DataFrame:
    """rows with score, on the columns that training had."""
    if spec.family == "heuristic":
        return mo.heuristic(rows, spec.features[0], spec.sign)
    pipeline, used = model
    marks = [u.removesuffix("__missing") for u in used if fe.is_missing_indicator(u)]
    return mo.score(pipeline, mo.with_missing_indicators(rows, [], marks)[0])


def walk_forward(spec: Spec, rows: DataFrame, years: Sequence[int], keep: Sequence[str], year: str = "year", label: str = "label", test: Column | None = None) -> DataFrame | None:
    """keep, fold and score of the test rows of each year, by a model of the years before; None without any fold.

    years are the eligible test years, a handful. test narrows the rows that are scored, and keeps them
    out of training too: a company hold-out.
    """
    known = rows.where(F.col(label).isNotNull())
    pooled = None
    for y in years:
        train, held = known.where(F.col(year) < y), known.where(F.col(year) == y)
        if test is not None:
            train, held = train.where(~test), held.where(test)
        model = None if spec.family == "heuristic" else fit(spec, train, label)
        if model is None and spec.family != "heuristic":
            continue
        part = score(spec, model, held).select(*keep, F.lit(y).alias("fold"), F.col("score").cast("double").alias("score"))
        pooled = part if pooled is None else pooled.unionByName(part)
    return pooled


def weights(cluster: str, samples: int = SAMPLES, seed: int = SEED) -> Column:
    """An array of Poisson(1) weights of a cluster, one for each resample, from a hash of its id."""
    draws = F.transform(F.sequence(F.lit(1), F.lit(samples)), lambda b: (F.pmod(F.xxhash64(F.col(cluster), b, F.lit(seed)), F.lit(1_000_003)) + 0.5) / 1_000_003.0)
    cuts = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)
    return F.transform(draws, lambda u: sum(((u > c).cast("int") for c in cuts[1:]), (u > cuts[0]).cast("int")))


def resampled_auc(rows: DataFrame, cluster: str, score_col: str = "score", samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """sample and the AUC of each resample of clusters: rows combine to cluster and score before weights are drawn."""
    cells = rows.groupBy(F.col(cluster).alias("_c"), F.col(score_col).alias("s")).agg(F.sum(F.col("label").cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    long = cells.select("s", "pos", "n", F.posexplode(weights("_c", samples, seed)).alias("sample", "w")).where("w > 0")
    s = long.groupBy("sample", "s").agg(F.sum(F.col("w") * F.col("pos")).alias("pos"), F.sum(F.col("w") * F.col("n")).alias("n")).withColumn("neg", F.col("n") - F.col("pos"))
    below = Window.partitionBy("sample").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("lower", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    return s.groupBy("sample").agg(F.try_divide(F.sum(F.col("pos") * (F.col("lower") + F.col("neg") / 2.0)), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def _interval(values: DataFrame, column: str, clusters: DataFrame) -> DataFrame:
    out = values.agg(F.percentile(column, F.lit(0.025)).alias("low"), F.percentile(column, F.lit(0.975)).alias("high"), F.count(column).alias("n_samples"))
    # Single rows.
    out = out.join(F.broadcast(clusters))
    enough = (F.col("n_clusters") >= MIN_CLUSTERS) & (F.col("n_samples") > 0)
    return out.select(*[F.when(enough, F.col(c)).alias(c) for c in ("low", "high")], "n_samples", "n_clusters")


def auc_interval(rows: DataFrame, cluster: str, samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """auc, low and high by resampled clusters; no interval with fewer than five of them."""
    clusters = rows.agg(F.countDistinct(cluster).alias("n_clusters"))
    out = _interval(resampled_auc(rows, cluster, "score", samples, seed), "auc", clusters)
    return me.roc_auc(rows).select("auc").join(F.broadcast(out))


def delta_auc(rows: DataFrame, cluster: str, a: str = "score_a", b: str = "score_b", samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """delta, low and high of AUC(b) - AUC(a) over the same resamples; no interval with fewer than five clusters."""
    clusters = rows.agg(F.countDistinct(cluster).alias("n_clusters"))
    one = resampled_auc(rows, cluster, a, samples, seed).select("sample", F.col("auc").alias("x"))
    two = resampled_auc(rows, cluster, b, samples, seed).select("sample", F.col("auc").alias("y"))
    out = _interval(one.join(two, "sample").select((F.col("y") - F.col("x")).alias("d")), "d", clusters)
    point = [me.roc_auc(rows.select(F.col(c).alias("score"), "label")).select(F.col("auc").alias(n)) for c, n in ((a, "x"), (b, "y"))]
    delta = point[0].join(F.broadcast(point[1])).select((F.col("y") - F.col("x")).alias("delta"))
    return delta.join(F.broadcast(out))


def calibration_fit(rows: DataFrame, label: str = "label") -> tuple[float | None, float | None]:
    """Slope and intercept of the outcome's log-odds on the score's; none unless scores are probabilities of two classes."""
    facts = rows.agg(F.countDistinct(label).alias("k"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    if facts.k < 2 or facts.lo < 0 or facts.hi > 1:
        return None, None
    p = F.least(F.greatest(F.col("score"), F.lit(CLIP)), F.lit(1 - CLIP))
    x = VectorAssembler(inputCols=["_logit"], outputCol="_x").transform(rows.select(F.col(label).cast("double").alias("_y"), F.ln(p / (1 - p)).alias("_logit")))
    m = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=0.0, standardization=False, maxIter=200, tol=1e-10).fit(x)
    return float(m.coefficients[0]), float(m.intercept)


def permuted(rows: DataFrame, column: str, key: str, seed: int, bucket_rows: int = 5000) -> DataFrame:
    """rows with a column's values dealt anew within random buckets: a window never orders the whole table."""
    n = max(1, -(-rows.count() // bucket_rows))
    w = Window.partitionBy("_b").orderBy(F.xxhash64(key, F.lit(seed)), key)
    first = F.first(column).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    at_end = F.row_number().over(w) == F.count(F.lit(1)).over(Window.partitionBy("_b"))
    dealt = F.when(at_end, first).otherwise(F.lead(column).over(w))
    return rows.withColumn("_b", F.pmod(F.xxhash64(key, F.lit(seed + 1)), F.lit(n))).withColumn(column, dealt).drop("_b")


def permutation_importance(rows: DataFrame, columns: Sequence[str], scored: Callable[[DataFrame], DataFrame], key: str, repeats: int = 5, top: int = 15, seed: int = SEED) -> list[tuple[str, float, float]]:
    """(feature, mean drop of the AUC, share of repeats with a drop) of the features that matter most."""
    whole = me.roc_auc(scored(rows)).first().auc
    out = []
    for column in columns:
        drops = [whole - (me.roc_auc(scored(permuted(rows, column, key, seed + r))).first().auc or 0.0) for r in range(repeats)]
        out.append((column, sum(drops) / repeats, sum(d > 0 for d in drops) / repeats))
    return sorted(out, key=lambda x: (-x[1], x[0]))[:top]


def relabelled(rows: DataFrame, label: Column) -> DataFrame:
    """rows under another question: a cohort's mark or a sampling design's, for separability probes."""
    return rows.withColumn("label", label.cast("int"))


def by_slices(scored: DataFrame, slices: dict[str, Column], least: int = 0) -> DataFrame:
    """slice, n, n_events and auc of each part of the scored rows: cohorts, years, all but a sector, held-out companies."""
    mark = F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in slices.items()]))).alias("slice")
    return me.roc_auc(scored.select("score", "label", mark), ("slice",), least)


def ladder(scores: DataFrame, names: Sequence[str], key: Sequence[str], cluster: str, samples: int = SAMPLES) -> list[tuple[str, str, DataFrame]]:
    """(a, b, delta_auc) of each neighbouring pair of models; scores (key, model, score, label, cluster)."""
    wide = scores.groupBy(*key, cluster, "label").pivot("model", list(names)).agg(F.first("score"))
    return [(a, b, delta_auc(wide.where(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()).select(F.col(f"`{a}`").alias("score_a"), F.col(f"`{b}`").alias("score_b"), "label", cluster), cluster, samples=samples)) for a, b in zip(names, names[1:], strict=False)]


def reconstruction_error(parts: DataFrame, links: DataFrame, key: Sequence[str]) -> DataFrame:
    """The largest gap between baseline plus contributions and the model's own link score."""
    sums = parts.groupBy(*key).agg((F.first("baseline") + F.sum("contribution")).alias("told"))
    return sums.join(links, list(key)).agg(F.max(F.abs(F.col("told") - F.col("link"))).alias("reconstruction_error"))


def artefact_shares(parts: DataFrame, key: Sequence[str], bucket: str = "bucket") -> DataFrame:
    """For each key the share of the absolute contribution from missing marks, and from filing artefacts."""
    size = F.abs("contribution")

    def share(*names: str) -> Column:
        return F.try_divide(F.sum(F.when(F.col(bucket).isin(*names), size).otherwise(0.0)), F.sum(size))

    return parts.groupBy(*key).agg(share("missingness").alias("missingness_share"), share("missingness", "data_quality").alias("artefact_share"))


def ranked_parts(parts: DataFrame, key: Sequence[str], top: int | None = None) -> DataFrame:
    """Contributions in the order of their size, numbered; the first top of them if asked."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(F.abs("contribution")), "feature"))
    out = parts.withColumn("place", place)
    return out if top is None else out.where(F.col("place") <= top)


def feature_shares(parts: DataFrame, feature: str = "feature") -> DataFrame:
    """Mean and share of the absolute contribution of each feature over all rows."""
    rows = parts.groupBy(feature).agg(F.avg(F.abs("contribution")).alias("mean_size"), F.sum(F.abs("contribution")).alias("size"))
    # One row.
    return rows.join(F.broadcast(rows.agg(F.sum("size").alias("whole")))).select(feature, "mean_size", F.try_divide(F.col("size"), F.col("whole")).alias("share"))


def stability(shares: DataFrame, group: str = "grp") -> DataFrame:
    """Quantiles of each group's share over resampled refits (refit, grp, share)."""
    q = F.percentile("share", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return shares.groupBy(group).agg(q.alias("q"), F.count(F.lit(1)).alias("n")).select(group, F.col("q")[0].alias("low"), F.col("q")[1].alias("median"), F.col("q")[2].alias("high"), "n")


def out_of_fold_parts(spec: Spec, rows: DataFrame, years: Sequence[int], key: Sequence[str], year: str = "year", label: str = "label") -> DataFrame | None:
    """Contributions of each test row under its own fold's logistic model."""
    known, pooled = rows.where(F.col(label).isNotNull()), None
    for y in years:
        model = fit(spec, known.where(F.col(year) < y), label)
        if model is None:
            continue
        pipeline, used = model
        marks = [u.removesuffix("__missing") for u in used if fe.is_missing_indicator(u)]
        held = mo.with_missing_indicators(known.where(F.col(year) == y), [], marks)[0]
        part = mo.contributions(pipeline, held, used, tuple(key)).withColumn("fold", F.lit(y))
        pooled = part if pooled is None else pooled.unionByName(part)
    return pooled


def final_model(spec: Spec, rows: DataFrame, path: str, metadata: dict, label: str = "label") -> list[str]:
    """The model of all labelled rows, saved with a row of metadata beside it; its columns."""
    import json

    pipeline, used = fit(spec, rows.where(F.col(label).isNotNull()), label)
    pipeline.write().overwrite().save(f"{path}/model")
    facts = {"name": spec.name, "family": spec.family, "columns": used, **metadata}
    rows.sparkSession.createDataFrame([(json.dumps(facts, sort_keys=True),)], "metadata string").write.mode("overwrite").json(f"{path}/metadata")
    return used


def attributed(model: tuple[PipelineModel, list[str]], rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Contributions by the attributor of the model's kind; only linear models have one here."""
    pipeline, used = model
    if not hasattr(pipeline.stages[-1], "coefficients"):
        raise TypeError("no attribution for this kind of model")
    marks = [u.removesuffix("__missing") for u in used if fe.is_missing_indicator(u)]
    return mo.contributions(pipeline, mo.with_missing_indicators(rows, [], marks)[0], used, tuple(key))


def explained(parts: DataFrame, catalog: DataFrame, facts: DataFrame, key: str = "entity", top: int = 8) -> DataFrame:
    """Each key's leading contributions in order, with their bucket and the facts behind them as an array.

    parts (key, feature, contribution), catalog as fe.catalog_frame(), facts (key, concept, value, status).
    """
    base = F.regexp_replace("feature", "__missing$", "")
    named = ranked_parts(parts, (key,), top).withColumn("_f", base).join(F.broadcast(catalog.select(F.col("feature").alias("_f"), "bucket", "concepts")), "_f", "left")
    bucket = F.when(F.col("feature").endswith("__missing"), F.lit("missingness")).otherwise(F.coalesce("bucket", F.lit("cross_cutting")))
    rows = named.withColumn("bucket", bucket).withColumn("concept", F.explode_outer("concepts"))
    joined = rows.join(facts.select(key, "concept", "value", "status"), [key, "concept"], "left")
    link = F.when(F.col("value").isNotNull(), F.struct("concept", "value", "status"))
    return joined.groupBy(key, "place", "feature", "contribution", "bucket").agg(F.array_sort(F.collect_list(link)).alias("evidence"))
