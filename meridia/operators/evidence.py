"""Evidence registers: reads, agreement and contradiction rules, and the diff of two registers.

A register is one row for each piece of evidence: entity, evidence_id, identity_key, layer, kind,
dimension, concern (elevated, quiet, unknown), code, assertion, specificity, share, grp. Rules are
aggregations by entity into a few flags, then one array of findings; no rule compares rows pairwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.operators.health import settled

LAYERS = ("model", "health", "narrative")
ELEVATED_PERCENTILE, QUIET_PERCENTILE = 90.0, 50.0
MATERIAL_DRIVER, ARTEFACT_LIMIT = 0.10, 0.35


def concern_of_percentile(p: Column) -> Column:
    return F.when(p >= ELEVATED_PERCENTILE, F.lit("elevated")).when(p < QUIET_PERCENTILE, F.lit("quiet")).otherwise(F.lit("unknown"))


def votes(register: DataFrame) -> DataFrame:
    """Rows that count for a read: narrative ones if negated, or asserted with enough specificity."""
    narrative = F.col("layer") == "narrative"
    ok = (F.col("assertion") == "negated") | ((F.col("assertion") == "asserted") & F.col("specificity").isin("high", "moderate"))
    return register.where(~narrative | F.coalesce(ok, F.lit(False)))


def resolved_concern(concern: str = "concern") -> Column:
    """An aggregate: any elevated wins, else any quiet, else unknown."""
    return F.when(F.bool_or(F.col(concern) == "elevated"), F.lit("elevated")).when(F.bool_or(F.col(concern) == "quiet"), F.lit("quiet")).otherwise(F.lit("unknown"))


def reads(register: DataFrame, by: Sequence[str] = ("entity", "layer")) -> DataFrame:
    return votes(register).groupBy(*by).agg(resolved_concern().alias("concern"))


def merge(register: DataFrame) -> DataFrame:
    """Each entity's id once; the number of different rows under it, which must be 1."""
    content = F.to_json(F.struct(*[c for c in register.columns if c != "evidence_id"]))
    return register.withColumn("_c", content).groupBy("entity", "evidence_id").agg(F.countDistinct("_c").alias("n_versions"), F.min_by(F.struct(*register.columns), "_c").alias("r"), F.count(F.lit(1)).alias("n_rows"))


def merged(register: DataFrame) -> DataFrame:
    """Each id once; two different contents under one id fail the query."""
    rows = merge(register)
    message = F.concat(F.lit("two contents under "), F.col("evidence_id"), F.lit(" of "), F.col("entity").cast("string"))
    ok = F.when(F.col("n_versions") == 1, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return rows.where(ok).select("r.*")


def of_kind(register: DataFrame, kind: str | None = None, layer: str | None = None, dimension: str | None = None) -> DataFrame:
    """The rows of a kind, a layer or a dimension."""
    for column, wanted in (("kind", kind), ("layer", layer), ("dimension", dimension)):
        if wanted is not None:
            register = register.where(F.col(column) == wanted)
    return register


def filtered(register: DataFrame, layers: Sequence[str] = (), concerns: Sequence[str] = ()) -> DataFrame:
    """The rows of some layers and concerns; no choice means all."""
    if layers:
        register = register.where(F.col("layer").isin(*layers))
    return register.where(F.col("concern").isin(*concerns)) if concerns else register


def cited(register: DataFrame, concern: str, by: Sequence[str] = ("entity", "layer")) -> DataFrame:
    """The ids that vote for a concern, sorted."""
    return votes(register).where(F.col("concern") == concern).groupBy(*by).agg(F.array_sort(F.collect_list("evidence_id")).alias("evidence_ids"))


def quoted_ids(register: DataFrame) -> DataFrame:
    """The distinct ids with a quote."""
    return register.where("layer = 'narrative' and quote is not null").select("entity", "evidence_id").distinct()


def _facts(register: DataFrame) -> DataFrame:
    """One row for each entity with everything the rules ask."""
    v = votes(register)
    layer = {name: F.coalesce(F.when(F.bool_or((F.col("layer") == name) & (F.col("concern") == "elevated")), F.lit("elevated")).when(F.bool_or((F.col("layer") == name) & (F.col("concern") == "quiet")), F.lit("quiet")), F.lit("unknown")).alias(name) for name in LAYERS}
    a = v.groupBy("entity").agg(*layer.values())
    severe = (F.col("kind") == "narrative_signal") & (F.col("assertion") == "asserted") & (F.col("specificity") == "high")
    gap = F.col("kind") == "coverage_gap"
    artefact = F.sum(F.when(F.col("grp").isin("missingness", "data_quality"), F.col("share")).otherwise(0.0))
    score = F.bool_or((F.col("kind") == "model_score") & (F.col("concern") == "elevated"))
    b = register.groupBy("entity").agg(
        F.coalesce(F.bool_or(severe), F.lit(False)).alias("severe"), F.coalesce(F.bool_or(gap), F.lit(False)).alias("gap"), F.round(artefact, 9).alias("artefact_share"), F.coalesce(score, F.lit(False)).alias("score_elevated"),
        F.array_sort(F.array_intersect(F.collect_set(F.when(F.col("assertion") == "asserted", F.col("code"))), F.collect_set(F.when(F.col("assertion") == "negated", F.col("code"))))).alias("both"),
    )
    drivers = register.where("kind = 'model_driver' and dimension is not null").groupBy("entity", "dimension").agg(F.sum("share").alias("share"), resolved_concern().alias("driver"))
    states = register.where("layer = 'health' and dimension is not null").groupBy("entity", "dimension").agg(resolved_concern().alias("state"))
    joined = drivers.join(states, ["entity", "dimension"], "full_outer")
    c = joined.groupBy("entity").agg(
        F.array_sort(F.collect_list(F.when((F.col("share") >= MATERIAL_DRIVER) & F.col("driver").isin("elevated", "quiet") & F.col("state").isin("elevated", "quiet") & (F.col("driver") != F.col("state")), F.col("dimension")))).alias("split"),
        F.array_sort(F.collect_list(F.when((F.col("driver") == "elevated") & (F.col("state") == "elevated"), F.col("dimension")))).alias("agree"),
        F.max_by(F.struct("dimension", "state"), F.when(F.col("share").isNotNull(), F.struct("share", "dimension"))).alias("top"),
    )
    return b.join(a, "entity", "left").join(c, "entity", "left").fillna("unknown", list(LAYERS))


def _found(rule: str, when: Column, subject: Column | None = None) -> Column:
    item = F.struct(F.lit(rule).alias("rule"), (F.lit("") if subject is None else subject).alias("subject"))
    return F.array_compact(F.array(F.when(F.coalesce(when, F.lit(False)), item)))


def _each(rule: str, subjects: Column) -> Column:
    return F.transform(F.coalesce(subjects, F.array().cast("array<string>")), lambda s: F.struct(F.lit(rule).alias("rule"), s.alias("subject")))


def findings(register: DataFrame) -> DataFrame:
    """entity, family (contradiction or corroboration), rule and subject: seven and four rules."""
    f = _facts(register)
    against, for_ = _rules()
    one = f.select("entity", F.lit("contradiction").alias("family"), F.inline(against))
    return one.unionByName(f.select("entity", F.lit("corroboration").alias("family"), F.inline(for_)))


def _rules() -> tuple[Column, Column]:
    """Contradictions and corroborations of a row of _facts(), as arrays."""
    m, h, n = F.col("model"), F.col("health"), F.col("narrative")
    against = F.concat(
        _found("model_elevated_health_quiet", (m == "elevated") & (h == "quiet")),
        _found("severe_disclosure_model_quiet", F.col("severe") & (m == "quiet")),
        _found("severe_disclosure_health_quiet", F.col("severe") & (h == "quiet")),
        _each("asserted_and_negated", F.col("both")),
        _each("driver_against_dimension", F.col("split")),
        _found("score_from_artefacts", F.col("score_elevated") & (F.col("artefact_share") >= ARTEFACT_LIMIT)),
        _found("coverage_gap", F.col("gap") & (n != "elevated")),
    )
    for_ = F.concat(
        _found("three_layers_elevated", (m == "elevated") & (h == "elevated") & (n == "elevated")),
        _each("dimension_agrees", F.col("agree")),
        _found("top_driver_confirmed", F.col("top.state") == "elevated", F.col("top.dimension")),
        _found("model_and_severe_disclosure", (m == "elevated") & F.col("severe")),
    )
    return against, for_


def with_findings(reports: DataFrame) -> DataFrame:
    """Registers in place (entity, items and more) with findings() as an array, found, of structs family, rule and subject, and the concerns of layers."""
    items = F.col("items")

    def read(rows: Column) -> Column:
        heard = F.transform(rows, lambda x: x["concern"])
        return F.when(F.array_contains(heard, "elevated"), F.lit("elevated")).when(F.array_contains(heard, "quiet"), F.lit("quiet")).otherwise(F.lit("unknown"))

    def of_layer(name: str) -> Column:
        return F.filter(items, lambda x: (x["layer"] == name) & voted(x))

    def named(family: str, rules: Column) -> Column:
        return F.transform(rules, lambda r: F.struct(F.lit(family).alias("family"), r["rule"].alias("rule"), r["subject"].alias("subject")))

    def voted(x: Column) -> Column:
        ok = (x["assertion"] == "negated") | ((x["assertion"] == "asserted") & x["specificity"].isin("high", "moderate"))
        return (x["layer"] != "narrative") | F.coalesce(ok, F.lit(False))

    def any_of(when) -> Column:
        return F.exists(items, lambda x: F.coalesce(when(x), F.lit(False)))

    def codes(assertion: str) -> Column:
        return F.transform(F.filter(items, lambda x: (x["assertion"] == assertion) & x["code"].isNotNull()), lambda x: x["code"])

    artefacts = F.filter(items, lambda x: x["grp"].isin("missingness", "data_quality") & x["share"].isNotNull())
    columns = {name: read(of_layer(name)) for name in LAYERS}
    columns |= {
        "severe": any_of(lambda x: (x["kind"] == "narrative_signal") & (x["assertion"] == "asserted") & (x["specificity"] == "high")), "gap": any_of(lambda x: x["kind"] == "coverage_gap"),
        "artefact_share": F.round(F.aggregate(artefacts, F.lit(0.0), lambda s, x: s + x["share"]), 9), "score_elevated": any_of(lambda x: (x["kind"] == "model_score") & (x["concern"] == "elevated")),
        "both": F.array_sort(F.array_intersect(codes("asserted"), codes("negated"))),
        "_d": F.filter(items, lambda x: (x["kind"] == "model_driver") & x["dimension"].isNotNull()), "_s": F.filter(items, lambda x: (x["layer"] == "health") & x["dimension"].isNotNull()),
    }
    kept = [F.col(c) for c in reports.columns]
    # Generators part the steps, or each would compute those before it again for every use.
    rows = settled(reports.select(*kept, *[x.alias(c) for c, x in columns.items()]))

    def of(name: str, d: Column) -> Column:
        return F.filter(name, lambda x: x["dimension"] == d)

    def dimension(d: Column) -> Column:
        shares = F.filter(F.transform(of("_d", d), lambda x: x["share"]), lambda s: s.isNotNull())
        share = F.when(F.size(shares) > 0, F.aggregate(shares, F.lit(0.0), lambda a, s: a + s))
        return F.struct(share.alias("share"), d.alias("dimension"), F.when(F.size(of("_d", d)) > 0, read(of("_d", d))).alias("driver"), F.when(F.size(of("_s", d)) > 0, read(of("_s", d))).alias("state"))

    names = F.array_union(F.transform("_d", lambda x: x["dimension"]), F.transform("_s", lambda x: x["dimension"]))
    rows = settled(rows.withColumn("_by", F.transform(names, dimension)))
    clear = ("elevated", "quiet")
    split = F.filter("_by", lambda x: F.coalesce((x["share"] >= MATERIAL_DRIVER) & x["driver"].isin(*clear) & x["state"].isin(*clear) & (x["driver"] != x["state"]), F.lit(False)))
    agree = F.filter("_by", lambda x: F.coalesce((x["driver"] == "elevated") & (x["state"] == "elevated"), F.lit(False)))
    top = F.array_max(F.filter("_by", lambda x: x["share"].isNotNull()))
    rows = rows.withColumns({"split": F.array_sort(F.transform(split, lambda x: x["dimension"])), "agree": F.array_sort(F.transform(agree, lambda x: x["dimension"])), "top": top})
    against, for_ = _rules()
    return settled(settled(rows).select(*kept, *LAYERS, F.concat(named("contradiction", against), named("corroboration", for_)).alias("found")))


def diff(previous: DataFrame, current: DataFrame, key: Sequence[str], content: str) -> DataFrame:
    """appeared, resolved or changed keys of two registers; unchanged ones drop out."""
    p = previous.select(*key, F.col(content).alias("before"))
    c = current.select(*key, F.col(content).alias("after"))
    both = p.withColumn("_p", F.lit(True)).join(c.withColumn("_c", F.lit(True)), list(key), "full_outer")
    kind = F.when(F.col("_p").isNull(), F.lit("appeared")).when(F.col("_c").isNull(), F.lit("resolved")).when(~F.col("before").eqNullSafe(F.col("after")), F.lit("changed"))
    return both.select(*key, "before", "after", kind.alias("change")).where("change is not null")
