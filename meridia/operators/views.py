"""Serving views: layer reads, headlines, reasons, series, comparisons, version tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import scalars as fx
from meridia.operators import evidence as ev
from meridia.operators.metrics import running

REASONS = ("contradiction", "severe_disclosure", "score_elevated", "coverage_gap", "no_evidence", "other")


def layer_reads(register: DataFrame, entities: DataFrame) -> DataFrame:
    """One row for each entity and layer, unknown where nothing votes."""
    grid = entities.select("entity").distinct().withColumn("layer", F.explode(F.array(*[F.lit(x) for x in ev.LAYERS])))
    return grid.join(ev.reads(register), ["entity", "layer"], "left").fillna("unknown", ["concern"])


def reason_buckets(register: DataFrame) -> DataFrame:
    """entity and the first reason in the fixed order that holds."""
    severe = (F.col("kind") == "narrative_signal") & (F.col("assertion") == "asserted") & (F.col("specificity") == "high")
    flags = register.groupBy("entity").agg(F.bool_or(F.coalesce(severe, F.lit(False))).alias("severe"), F.bool_or((F.col("kind") == "model_score") & (F.col("concern") == "elevated")).alias("score"), F.bool_or(F.col("kind") == "coverage_gap").alias("gap"))
    against = ev.findings(register).where("family = 'contradiction'").select("entity").distinct().withColumn("against", F.lit(True))
    rows = flags.join(against, "entity", "left")
    reason = F.when(F.col("against"), F.lit(REASONS[0])).when(F.col("severe"), F.lit(REASONS[1])).when(F.col("score"), F.lit(REASONS[2])).when(F.col("gap"), F.lit(REASONS[3])).otherwise(F.lit(REASONS[5]))
    return rows.select("entity", reason.alias("reason"))


def _has(when: Column) -> Column:
    return F.count_if(F.coalesce(when, F.lit(False)))


def cards(register: DataFrame, assessments: DataFrame) -> DataFrame:
    """One row for each assessed entity: counts, a headline and a concern of each layer, and why it needs attention."""
    kind = F.col("kind")
    worse = (kind == "dimension_status") & F.col("summary").rlike("^[a-z_]+: deteriorating ")
    known = (kind == "dimension_status") & (F.col("concern") != "unknown")
    stated = (kind == "narrative_signal") & (F.col("assertion") == "asserted")
    severe = stated & (F.col("specificity") == "high")
    counts = register.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_evidence"), _has(kind == "dimension_status").alias("n_dimensions"), _has(worse).alias("n_worse"), _has(known).alias("n_known"), _has(kind == "health_signal").alias("n_signals"),
        F.max(F.when(kind == "model_score", F.col("share"))).alias("percentile"), _has(kind == "model_score").alias("n_scores"), _has(kind == "model_caveat").alias("n_caveats"),
        _has(kind == "narrative_signal").alias("n_statements"), _has(stated).alias("n_stated"), _has(severe).alias("n_severe"), F.min(F.when(severe, F.col("code"))).alias("severe_code"), _has(kind == "coverage_gap").alias("n_gaps"),
    )
    rows = assessments.join(counts, "entity", "left").fillna(0, [c for c in counts.columns if c.startswith("n_")])
    against = ev.findings(register).groupBy("entity").agg(F.count_if(F.col("family") == "contradiction").alias("n_contradictions"), F.count_if(F.col("family") == "corroboration").alias("n_corroborations"))
    concern = layer_reads(register, assessments).groupBy("entity").pivot("layer", list(ev.LAYERS)).agg(F.first("concern"))
    return _headlines(rows.join(against, "entity", "left").join(concern, "entity", "left").fillna(0, ["n_contradictions", "n_corroborations"]))


def cards_in_place(reports: DataFrame) -> DataFrame:
    """cards() of registers in place, with_findings(): the same columns, of each entity's own array."""
    def having(when) -> Column:
        return F.filter("items", lambda x: F.coalesce(when(x), F.lit(False)))

    def of(kind: str):
        return lambda x: x["kind"] == kind

    def stated(x: Column) -> Column:
        return (x["kind"] == "narrative_signal") & (x["assertion"] == "asserted")

    severe = having(lambda x: stated(x) & (x["specificity"] == "high"))
    counted = {
        "n_evidence": F.col("items"), "n_dimensions": having(of("dimension_status")), "n_worse": having(lambda x: (x["kind"] == "dimension_status") & x["summary"].rlike("^[a-z_]+: deteriorating ")),
        "n_known": having(lambda x: (x["kind"] == "dimension_status") & (x["concern"] != "unknown")), "n_signals": having(of("health_signal")), "n_scores": having(of("model_score")), "n_caveats": having(of("model_caveat")),
        "n_statements": having(of("narrative_signal")), "n_stated": having(stated), "n_severe": severe, "n_gaps": having(of("coverage_gap")),
        "n_contradictions": F.filter("found", lambda x: x["family"] == "contradiction"), "n_corroborations": F.filter("found", lambda x: x["family"] == "corroboration"),
    }
    cells = [F.size(x).cast("long").alias(c) for c, x in counted.items()]
    percentile = F.array_max(F.transform(having(of("model_score")), lambda x: x["share"]))
    kept = [c for c in reports.columns if c not in ("items", "found")]
    return _headlines(reports.select(*kept, *cells, percentile.alias("percentile"), F.array_min(F.transform(severe, lambda x: x["code"])).alias("severe_code")))


def _headlines(out: DataFrame) -> DataFrame:
    health = F.when(F.col("n_dimensions") == 0, F.lit("Not run")).when(F.col("n_worse") > 0, F.format_string("%d of %d dimensions deteriorating", "n_worse", "n_dimensions")).when(F.col("n_known") > 0, F.lit("No dimension deteriorating")).otherwise(F.lit("No conclusive trend"))
    model = F.when(F.col("n_scores") == 0, F.lit("Not scored")).when(F.col("percentile").isNull(), F.lit("No ranking position")).otherwise(F.concat(F.bround("percentile").cast("long").cast("string"), F.lit("th percentile")))
    more = F.when(F.col("n_severe") > 1, F.format_string(" +%d more", F.col("n_severe") - 1)).otherwise(F.lit(""))
    told = F.when(F.col("n_statements") + F.col("n_gaps") == 0, F.lit("Not read")).when(F.col("n_severe") > 0, F.concat(fx.humanise("severe_code"), more)).when(F.col("n_stated") > 0, F.format_string("%d disclosure(s) stated", "n_stated")).otherwise(F.lit("Nothing stated"))
    all_up = (F.col("model") == "elevated") & (F.col("health") == "elevated") & (F.col("narrative") == "elevated")
    reasons = F.array_compact(F.array(F.when(F.col("n_contradictions") > 0, F.lit("disagreement")), F.when(all_up, F.lit("all_elevated")), F.when(F.col("n_severe") > 0, F.lit("severe_disclosure")), F.when(F.col("n_gaps") > 0, F.lit("coverage"))))
    return out.withColumns({"health_headline": health, "model_headline": model, "narrative_headline": told, "attention": reasons})


def drivers(register: DataFrame, limit: int = 8) -> DataFrame:
    """Attribution groups of each entity by share, the largest first; filing artefacts are marked, not left out."""
    rows = register.where("kind = 'model_driver'")
    place = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("share"), "evidence_id"))
    return rows.withColumn("place", place).where(F.col("place") <= limit).select("entity", "place", "grp", F.col("numbers")[0].alias("contribution"), "share", F.col("grp").isin("missingness", "data_quality").alias("is_artefact"), "evidence_id")


def coverage(history: DataFrame, cards_of: DataFrame) -> DataFrame:
    """Cards of every current assessment, with its state and watch status."""
    return cards_of.join(history.select("entity", "assessment_id", "state", "watch_status"), "entity")


def workspace(register: DataFrame, assessments: DataFrame, findings: DataFrame) -> DataFrame:
    """One row for each entity: its card and, as arrays, its drivers, disclosures, gaps, caveats and findings.

    An entity's evidence is bounded by its report, so the arrays are.
    """
    def gathered(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        return rows.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

    said = ev.of_kind(register, "narrative_signal").withColumn("order", F.when(F.col("assertion") == "asserted", 0).otherwise(1)).withColumn("severity", F.when(F.col("specificity") == "high", 0).when(F.col("specificity") == "moderate", 1).otherwise(2))
    parts = [
        gathered(drivers(register), "drivers", "place", "grp", "share"), gathered(said, "disclosures", "order", "severity", "code", "quote"), gathered(ev.of_kind(register, "coverage_gap"), "gaps", "code", "summary"),
        gathered(ev.of_kind(register, "model_caveat"), "caveats", "code", "summary"), gathered(findings, "findings", "family", "rule", "subject"),
    ]
    out = cards(register, assessments)
    for p in parts:
        out = out.join(p, "entity", "left")
    return out


def series_summary(series: DataFrame, key: Sequence[str], year: str = "fy") -> DataFrame:
    """latest and first observed values, and their difference where two are observed."""
    seen = F.when(F.col("value").isNotNull(), F.col(year))
    rows = series.groupBy(*key).agg(F.max_by("value", seen).alias("latest"), F.min_by("value", seen).alias("first"), F.count("value").alias("n_observed"))
    return rows.select(*key, "latest", F.when(F.col("n_observed") >= 2, F.col("latest") - F.col("first")).alias("change"), "n_observed")


def comparison(series: DataFrame, entities: Sequence, ratios: Sequence[str]) -> DataFrame:
    """Latest values of the chosen entities, one column for each ratio."""
    rows = series.where(F.col("entity").isin(*entities) & F.col("value").isNotNull())
    last = rows.groupBy("entity", "ratio").agg(F.max_by("value", "fy").alias("value"))
    return last.groupBy("entity").pivot("ratio", list(ratios)).agg(F.first("value"))


def version_table(history: DataFrame) -> DataFrame:
    """Versions of each company in the order of their record."""
    w = Window.partitionBy("cik").orderBy("recorded_at", "assessment_id")
    return history.withColumn("version", F.row_number().over(w).cast("long"))


def group_shares_by_era(parts: DataFrame, eras: Sequence, era: str = "era", group: str = "grp", least: int = 50) -> DataFrame:
    """Share of the absolute contribution of each group, one column for each era with enough rows."""
    enough = parts.groupBy(era).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(era)
    rows = parts.join(enough, era).groupBy(era, group).agg(F.sum(F.abs("contribution")).alias("size"))
    total = rows.groupBy(era).agg(F.sum("size").alias("total"))
    rows = rows.join(total, era).withColumn("share", F.try_divide(F.col("size"), F.col("total")))
    return rows.groupBy(group).pivot(era, list(eras)).agg(F.first("share")).na.fill(0.0)


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with averaged ties."""
    ranked = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    for c in (a, b):
        s = running(ranked.groupBy(c).agg(F.count(F.lit(1)).alias("_k")), c, "_k")
        ranked = ranked.join(s.select(c, (F.col("upto") - (F.col("_k") - 1) / 2.0).alias(f"_r_{c}")), c)
    return ranked.agg(F.corr(f"_r_{a}", f"_r_{b}").alias("rho"), F.count(F.lit(1)).alias("n"))


def recently_filed(events: DataFrame, filings: DataFrame, years: int = 3) -> DataFrame:
    """Events of entities that filed in the event's year or the given years before it."""
    f = filings.select(F.col("entity").alias("_e"), F.col("year").alias("_y")).distinct()
    return events.join(f, (F.col("entity") == F.col("_e")) & F.col("_y").between(F.col("year") - years, F.col("year")), "left_semi")


def year_moves(ranks: DataFrame) -> DataFrame:
    """Each entity's percentile move to the following year; gaps don't count."""
    nxt = ranks.select("entity", (F.col("year") - 1).alias("year"), F.col("pct_rank").alias("_next"))
    return ranks.join(nxt, ["entity", "year"]).select("entity", "year", (F.col("_next") - F.col("pct_rank")).alias("move"))
