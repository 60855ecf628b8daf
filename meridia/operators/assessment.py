"""Assessments: evidence rows of the three layers, their union behind the as-of gate, and its renderings.

An evidence row has one id made of what it says and one key made of what it is about, so that a later
register can be compared with an earlier one. Layers are unions of selects; ids are the only Python.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions import python_text as tx
from meridia.operators import audits as au
from meridia.operators import evidence as ev
from meridia.operators import reports as rp
from meridia.operators.health import settled

# Fixed values.
KIND_TAGS = {
    "dimension_status": "DS", "ratio_trend": "RT", "health_signal": "HS", "ratio_change": "RC", "data_quality_caveat": "DQ",
    "model_score": "MS", "model_driver": "MD", "model_caveat": "MC", "narrative_signal": "NS", "coverage_gap": "NC",
}
NARRATIVE_DIMENSIONS = {
    "covenant_breach": "leverage", "covenant_waiver_or_amendment": "leverage", "debt_default_or_acceleration": "leverage", "debt_restructuring": "leverage",
    "credit_rating_downgrade": "leverage", "liquidity_shortfall": "liquidity", "dividend_suspension": "cash_flow", "asset_impairment": "profitability",
}
HEALTH_DIMENSIONS = ("liquidity", "leverage", "profitability", "coverage", "cash_flow")
ARTEFACT_GROUPS = ("missingness", "data_quality")
MISSINGNESS_CAVEAT, SLOPE_BAND, RECONSTRUCTION_TOLERANCE, MIN_PERIODS, TOP = 0.35, (0.8, 1.25), 1e-6, 3, 8

COLUMNS = ("entity", "evidence_id", "identity_key", "layer", "kind", "dimension", "concern", "summary", "numbers", "period_label", "accession", "form", "filed", "quote", "code", "assertion", "specificity", "share", "grp")
_TYPES = {"numbers": "array<double>", "filed": "date", "share": "double"}
ITEMS = "array<struct<" + ", ".join(f"{c}: {_TYPES.get(c, 'string')}" for c in COLUMNS[1:]) + ">>"


def item(layer: str, kind: str, subject: Column, content: Sequence[Column], **columns: Column) -> Column:
    """An evidence row of COLUMNS but entity, as a struct; columns that aren't given are null, and evidence_id is what the id is made of."""
    key = F.concat_ws(":", F.lit(layer), F.lit(kind), subject)
    known = {"layer": F.lit(layer), "kind": F.lit(kind), "concern": F.lit("unknown"), **columns}
    text = F.concat_ws("|", key, *[F.coalesce(c.cast("string"), F.lit("")) for c in content])
    return F.struct(text.alias("evidence_id"), key.alias("identity_key"), *[known.get(c, F.lit(None)).cast(_TYPES.get(c, "string")).alias(c) for c in COLUMNS[3:]])


def _made(rows: DataFrame, kind: str, it: Column) -> DataFrame:
    out = rows.select("entity", it.alias("_i")).select("entity", "_i.*")
    return out.withColumn("evidence_id", tx.content_id(f"EV-{KIND_TAGS[kind]}-", 4)("evidence_id")).select(*COLUMNS)


def register(rows: DataFrame, layer: str, kind: str, subject: Column, content: Sequence[Column], **columns: Column) -> DataFrame:
    """Evidence rows of one kind; columns that aren't given are null. rows have entity."""
    return _made(rows, kind, item(layer, kind, subject, content, **columns))


def concern_of(health: Column) -> Column:
    """How a direction or a dimension's status reads."""
    return F.when(health.isin("deteriorating", "mixed"), F.lit("elevated")).when(health.isin("improving", "stable"), F.lit("quiet")).otherwise(F.lit("unknown"))


def health_evidence(trends: DataFrame, dimensions: DataFrame, signals: DataFrame, changes: DataFrame, quality: DataFrame, stamps: DataFrame) -> DataFrame:
    """Dimension statuses, ratio trends, signals, last changes and data-quality caveats as evidence.

    stamps (entity, period_label, accession, form, filed) names the filing that closed each window; all
    other frames have entity.
    """
    s = stamps.select("entity", "period_label", "accession", "form", "filed")
    stamp = {c: F.col(c) for c in ("period_label", "accession", "form", "filed")}
    known = F.col("health").isin("improving", "stable", "deteriorating")
    counts = trends.groupBy("entity", "category").agg(F.count(F.lit(1)).alias("n"), F.count_if(known).alias("n_known"), F.concat_ws(", ", F.array_sort(F.collect_list(F.when(F.col("health") == "deteriorating", F.col("ratio"))))).alias("worse"))
    d = dimensions.join(counts, ["entity", "category"]).join(s, "entity")
    told = F.concat(F.format_string("%s: %s over %s (%d of %d ratios conclusive", "category", "dimension_status", "period_label", "n_known", "n"), F.when(F.col("worse") != "", F.concat(F.lit("; deteriorating: "), "worse")).otherwise(F.lit("")), F.lit(")"))
    out = register(d, "health", "dimension_status", F.col("category"), [F.col("dimension_status"), F.col("period_label"), F.col("worse")], dimension=F.col("category"), concern=concern_of(F.col("dimension_status")), summary=told, **stamp)
    t = trends.join(s, "entity")
    change = F.format_string("%s: %s (%s) across %d calculated period(s) in %s", "ratio", "health", "direction", "n_calculated", "period_label")
    change = F.concat(change, F.coalesce(F.concat(F.lit("; change "), tx.signed_float("absolute")), F.lit("")), F.when(F.col("persistence") > 0, F.format_string("; %d consecutive period(s) same direction", "persistence")).otherwise(F.lit("")))
    numbers = F.array_compact(F.array("absolute"))
    out = out.unionByName(register(t, "health", "ratio_trend", F.col("ratio"), [F.col("health"), F.col("direction"), F.col("period_label"), tx.short_float("absolute")], dimension=F.col("category"), concern=concern_of(F.col("health")), summary=change, numbers=numbers, **stamp))
    g = signals.join(s, "entity")
    out = out.unionByName(register(g, "health", "health_signal", F.concat_ws(":", F.col("signal"), F.coalesce("ratio", F.lit("cross_dimension"))), [F.col("period_label")], dimension=F.col("category"), concern=F.lit("elevated"), summary=F.concat_ws(": ", F.col("signal"), F.col("ratio")), code=F.col("signal"), **stamp))
    c = changes.join(s, "entity")
    moved = F.concat(F.col("ratio"), F.lit(" moved "), tx.short_float("absolute"), F.format_string(" to FY%d", "fy"))
    out = out.unionByName(register(c, "health", "ratio_change", F.col("ratio"), [F.col("fy"), tx.short_float("absolute")], summary=moved, numbers=F.array_compact(F.array("absolute", "prior", "value")), **stamp))
    q = quality.join(s, "entity")
    return out.unionByName(register(q, "data_quality", "data_quality_caveat", F.col("caveat"), [F.col("period_label"), F.concat_ws("|", "ratios")], summary=F.concat(F.size("ratios").cast("string"), F.lit(" ratio(s) carry "), F.replace("caveat", F.lit("_"), F.lit(" ")), F.lit(": "), F.concat_ws(", ", "ratios")), **stamp))


def model_evidence(scores: DataFrame, groups: DataFrame, caveats: DataFrame) -> DataFrame:
    """The score by its percentile, the attribution of each group, and every caveat.

    scores (entity, model, score, percentile, period_label, accession, filed), groups (entity, grp, total,
    share, n) and caveats (entity, code, subject, message); the raw score decides no concern.
    """
    s = scores.select("entity", "model", "score", F.col("percentile").cast("double").alias("percentile"), "period_label", "accession", "filed")
    out = _made(s, "model_score", _score())
    g = groups.join(s.select("entity", "period_label", "accession", "filed"), "entity")
    out = out.unionByName(_made(g, "model_driver", _driver(F.col)))
    c = caveats.join(s.select("entity", "period_label", "accession", "filed"), "entity")
    return out.unionByName(_made(c, "model_caveat", _caveat(F.col)))


_MODEL_STAMP = ("period_label", "accession", "filed")


def _score() -> Column:
    stamp = {c: F.col(c) for c in _MODEL_STAMP}
    place = F.when(F.col("percentile").isNull(), F.lit("no population supplied, so no ranking position")).otherwise(F.concat(tx.short_float("percentile"), F.lit("th percentile of the scored population")))
    told = F.concat(F.col("model"), F.lit(" scores "), tx.short_float("score"), F.lit(" for "), F.coalesce("period_label", F.lit("")), F.lit(": "), place, F.lit(". The score is a ranking position, not a probability of default."))
    return item("model", "model_score", F.col("model"), [F.col("period_label"), tx.short_float("score"), F.coalesce(tx.short_float("percentile"), F.lit("none"))], concern=ev.concern_of_percentile(F.col("percentile")), summary=told, numbers=F.array_compact(F.array("score", "percentile")), share=F.col("percentile"), **stamp)


def _driver(of: Callable[[str], Column]) -> Column:
    """of gives a group's grp, total and share, and its stamp."""
    grp, total, share = (of(c) for c in ("grp", "total", "share"))
    side = F.when(total > 0, F.lit("elevated")).when(total < 0, F.lit("quiet")).otherwise(F.lit("unknown"))
    part = F.concat(grp, F.lit(" contributes "), tx.signed_float(total), F.lit(" to the score ("), tx.short_float(100 * share), F.lit("% of total absolute attribution)"))
    return item("model", "model_driver", grp, [of("period_label"), tx.short_float(total), tx.short_float(share)], dimension=F.when(grp.isin(*HEALTH_DIMENSIONS), grp), concern=side, summary=part, numbers=F.array(total, 100 * share), share=share, grp=grp, **{c: of(c) for c in _MODEL_STAMP})


def _caveat(of: Callable[[str], Column]) -> Column:
    """of gives a caveat's code, subject and message, and its stamp."""
    code, message = of("code"), of("message")
    return item("model", "model_caveat", F.concat_ws(":", code, F.coalesce(of("subject"), F.lit(""))), [of("period_label"), message], summary=F.concat_ws(": ", code, message), code=code, **{c: of(c) for c in _MODEL_STAMP})


def narrative_evidence(statements: DataFrame, coverage: DataFrame, stamps: DataFrame) -> DataFrame:
    """One row for each code and mood that a filing states, with its first quote, and one for each section not located."""
    s = stamps.select("entity", "accession", "form", "filed")
    out = _made(stated(statements, ("entity",)).join(s, "entity"), "narrative_signal", _statement(F.col))
    c = coverage.where("not located").join(s, "entity")
    return out.unionByName(_made(c, "coverage_gap", _gap(F.col)))


_NARRATIVE_STAMP = ("accession", "form", "filed")


def stated(statements: DataFrame, key: Sequence[str]) -> DataFrame:
    """For each key, code and assertion the first statement as f, and their number n."""
    first = F.min_by(F.struct("quote", "specificity", "pattern", "section_id", "char_start"), F.struct("section_id", "char_start", "pattern"))
    return statements.groupBy(*key, "code", "assertion").agg(first.alias("f"), F.count(F.lit(1)).alias("n"))


def _statement(of: Callable[[str], Column]) -> Column:
    """of gives the columns of stated() and their stamp."""
    code, assertion, f, n = (of(c) for c in ("code", "assertion", "f", "n"))
    mood = F.when(assertion == "asserted", F.lit("states")).when(assertion == "negated", F.lit("explicitly denies")).otherwise(F.lit("discusses (conditionally)"))
    concern = F.when(assertion == "asserted", F.lit("elevated")).when(assertion == "negated", F.lit("quiet")).otherwise(F.lit("unknown"))
    about = F.create_map(*[F.lit(x) for kv in NARRATIVE_DIMENSIONS.items() for x in kv])
    told = F.concat(F.lit("The filer "), mood, F.lit(" "), F.replace(code, F.lit("_"), F.lit(" ")), F.format_string(" (%d occurrence(s) in %s; specificity %s)", n, F.coalesce(f["section_id"], F.lit("the filing")), f["specificity"]))
    return item("narrative", "narrative_signal", F.concat_ws(":", code, assertion), [of("accession"), f["quote"], n], dimension=F.try_element_at(about, code), concern=concern, summary=told, quote=f["quote"], code=code, assertion=assertion, specificity=f["specificity"], **{c: of(c) for c in _NARRATIVE_STAMP})


def _gap(of: Callable[[str], Column]) -> Column:
    """of gives a section's section_id and reason, and its stamp."""
    section, reason = of("section_id"), of("reason")
    gap = F.concat(section, F.lit(" was not located in this filing ("), F.coalesce(reason, F.lit("no reason recorded")), F.lit("), so no signal from it could have been found either way"))
    return item("narrative", "coverage_gap", section, [of("accession"), F.coalesce(reason, F.lit("not located"))], summary=gap, code=section, **{c: of(c) for c in _NARRATIVE_STAMP})


# Registers in place: a row for each entity with its evidence as an array, items, of structs of COLUMNS but
# entity. An entity's evidence is bounded by its report, so nothing gathers, merges or joins it by exchange.


def health_items(items: Column, label: Column, accession: Column, form: Column, filed: Column) -> Column:
    """The items of resolver.health_reports() spelled out: health_evidence() of one entity."""
    words = {"identity_key": rp.KEYS, "layer": rp.LAYERS, "kind": rp.KINDS, "dimension": rp.DIMENSIONS, "code": rp.CODES}
    table = {c: F.array(*[F.lit(x).cast("string") for x in w]) for c, w in words.items()} | {"concern": F.array(*[F.lit(x) for x in rp.CONCERNS])}
    stamp = {"period_label": label, "accession": accession, "form": form, "filed": filed}

    def one(x: Column) -> Column:
        cells = {c: F.get(table[c], x["k"].cast("int")) for c in words} | {"concern": F.get(table["concern"], x["concern"].cast("int"))} | {c: x[c] for c in ("evidence_id", "summary")} | stamp
        cells["numbers"] = F.when(cells["kind"].isin("ratio_trend", "ratio_change"), x["numbers"])
        return F.struct(*[cells.get(c, F.lit(None)).cast(_TYPES.get(c, "string")).alias(c) for c in COLUMNS[1:]])

    return F.transform(items, one)


def model_items(scored: Column, groups: Sequence[dict[str, Column]], caveats: Sequence[tuple[Column, dict[str, Column]]]) -> Column:
    """model_evidence() of a row that is scored: its score, groups and the caveats that hold; ids are still to be made."""

    def beside(own: dict[str, Column]) -> Callable[[str], Column]:
        return lambda c: own[c] if c in own else F.col(c)

    each = F.array(_score(), *[_driver(beside(g)) for g in groups], *[F.when(holds, _caveat(beside(c))) for holds, c in caveats])
    return F.coalesce(F.when(scored, F.array_compact(each)), F.array().cast(ITEMS))


def narrative_items(said: Column, gaps: Column) -> Column:
    """narrative_evidence() of a row with stated() as an array and sections not located as (section_id, reason); ids are still to be made."""

    def within(x: Column, own: Sequence[str]) -> Callable[[str], Column]:
        return lambda c: x[c] if c in own else F.col(c)

    return F.concat(F.transform(said, lambda x: _statement(within(x, ("code", "assertion", "f", "n")))), F.transform(gaps, lambda x: _gap(within(x, ("section_id", "reason")))))


def with_ids(rows: DataFrame, items: str) -> DataFrame:
    """Rows whose items, from item(), get their ids."""
    tags = F.create_map(*[F.lit(x) for kind, tag in KIND_TAGS.items() for x in (kind, f"EV-{tag}-")])
    ids = tx.content_ids(F.transform(items, lambda x: F.element_at(tags, x["kind"])), F.transform(items, lambda x: x["evidence_id"]))
    rows = settled(settled(rows).withColumn("_ids", ids))
    return rows.withColumn(items, F.transform(items, lambda x, i: x.withField("evidence_id", F.get("_ids", i)))).drop("_ids")


def assemble_items(reports: DataFrame, items: str = "items") -> DataFrame:
    """assemble() in place, of reports (entity, as_of, items): each id once, nothing filed after as_of."""
    whole = F.col(items)
    each, ids = F.array_distinct(whole), F.size(F.array_distinct(F.transform(whole, lambda x: x["evidence_id"])))
    clash = F.raise_error(F.concat(F.lit("two contents under an id of "), F.col("entity").cast("string")))
    merged = F.when(ids == F.size(whole), whole).when(ids == F.size(each), each).otherwise(clash.cast(reports.schema[items].dataType))
    rows = settled(settled(reports).withColumn(items, merged))
    late = F.filter(whole, lambda x: ~F.coalesce(x["filed"] <= F.col("as_of"), F.lit(False)))
    message = F.concat(F.lit("not known at the cutoff: "), late[0]["evidence_id"], F.lit(" filed "), F.coalesce(late[0]["filed"].cast("string"), F.lit("on an unknown date")))
    return rows.where(F.when(F.size(late) == 0, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def register_rows(reports: DataFrame, *columns: str) -> DataFrame:
    """The rows of registers in place: COLUMNS, or some of them."""
    return reports.select("entity", F.inline("items")).select(*columns or COLUMNS)


def absent_in_place(reports: DataFrame, reasons: Column) -> DataFrame:
    """absent_layers() in place; reasons is a map of layers."""
    have = F.transform("items", lambda x: x["layer"])
    rows = reports.select("entity", F.explode(F.array_except(F.array(*[F.lit(x) for x in ev.LAYERS]), have)).alias("layer"), reasons.alias("_r"))
    message = F.concat(F.lit("no evidence and no reason for "), F.col("layer"))
    return rows.select("entity", "layer", F.coalesce(F.try_element_at("_r", F.col("layer")), F.raise_error(message).cast("string")).alias("reason"))


def assemble(evidence: DataFrame, assessments: DataFrame, merged: bool = True) -> DataFrame:
    """The register of assessments (entity, as_of): each id once, nothing filed after as_of.

    An id with two different contents, or evidence that the cutoff doesn't admit, fails the query.
    """
    rows = ev.merged(evidence) if merged else evidence
    rows = rows.join(assessments.select("entity", "as_of"), "entity")
    return au.assert_as_of(rows, F.col("as_of"), "evidence_id").select(*COLUMNS)


def absent_layers(evidence: DataFrame, assessments: DataFrame, reasons: DataFrame) -> DataFrame:
    """entity, layer and reason of the layers without evidence; a layer without a reason fails the query.

    reasons (entity, layer, reason) says why a layer didn't run.
    """
    grid = assessments.select("entity").withColumn("layer", F.explode(F.array(*[F.lit(x) for x in ev.LAYERS])))
    rows = grid.join(evidence.select("entity", "layer").distinct(), ["entity", "layer"], "left_anti").join(reasons, ["entity", "layer"], "left")
    message = F.concat(F.lit("no evidence and no reason for "), F.col("layer"))
    return rows.withColumn("reason", F.coalesce("reason", F.raise_error(message).cast("string")))


def caveats(parts: DataFrame, rows: DataFrame, inputs: DataFrame, slope: float | None = None, cohort_confounded: bool = False, sampled_base_rate: bool = True) -> DataFrame:
    """entity, code, subject and message of every reason not to take a score at face value, each once.

    parts (entity, feature, contribution, bucket), rows (entity, periods_available, reconstruction_error),
    inputs (entity, feature, concept, status, confidence): the facts behind each feature.
    """
    total = parts.groupBy("entity").agg(F.sum(F.abs("contribution")).alias("all"), F.sum(F.when(F.col("bucket") == "missingness", F.abs("contribution")).otherwise(0.0)).alias("missing"))
    base = rows.join(total, "entity", "left").withColumn("share", F.coalesce(F.try_divide(F.col("missing"), F.col("all")), F.lit(0.0)))
    slope_off = slope is not None and not SLOPE_BAND[0] <= slope <= SLOPE_BAND[1]
    whole = [
        (F.col("share") >= MISSINGNESS_CAVEAT, "missingness_driven", F.format_string("%.0f%% of this prediction's absolute contribution comes from missingness indicators.", 100 * F.col("share"))),
        (F.lit(slope_off), "not_calibrated", F.lit(f"The model's calibration slope is {slope or 0:.2f} (1.0 would be calibrated). Read the output as a position in a ranking.")),
        (F.lit(sampled_base_rate), "base_rate_not_portfolio", F.lit("The training base rate is set by how the corpus was sampled, not by any real portfolio. Compare companies by rank.")),
        (F.lit(cohort_confounded), "cohort_confounded", F.lit("This model was trained against a comparison cohort selected for having survived.")),
        (F.col("reconstruction_error") > RECONSTRUCTION_TOLERANCE, "unstable_attribution", F.lit("Contributions reconstruct the model's own score only approximately.")),
        (F.col("periods_available") < MIN_PERIODS, "limited_history", F.format_string("Only %.0f fiscal period(s) of history back this observation.", "periods_available")),
    ]
    none = F.lit(None).cast("string")
    found = F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), none.alias("subject"), message.alias("message"))) for when, code, message in whole]))
    out = base.select("entity", F.inline(found))
    # The leading contributors that aren't missing marks, and the facts that they rest on.
    real = parts.where("bucket != 'missingness'").groupBy("entity").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct(F.abs("contribution").alias("a"), "feature")))), 1, TOP).alias("top"))
    lead = real.select("entity", F.explode(F.transform("top", lambda t: t["feature"])).alias("feature"))
    facts = lead.join(inputs, ["entity", "feature"], "left")
    traced = facts.groupBy("entity", "feature").agg(F.count("concept").alias("n")).where("n = 0").groupBy("entity").agg(F.array_sort(F.collect_list("feature")).alias("untraced"))
    out = out.unionByName(traced.select("entity", F.lit("provenance_incomplete").alias("code"), F.col("untraced")[0].alias("subject"), F.concat(F.lit("These leading contributors have no single filing to point at: "), F.concat_ws(", ", "untraced"), F.lit(".")).alias("message")))
    for when, code, text in ((F.col("status") == "derived", "derived_input", " was derived rather than reported directly by the filer."), (F.col("confidence") == "low", "low_confidence_input", " resolved with low confidence.")):
        out = out.unionByName(facts.where(when).select("entity", F.lit(code).alias("code"), F.col("concept").alias("subject"), F.concat("concept", F.lit(text)).alias("message")))
    return out.dropDuplicates(["entity", "code", "subject"])


def evidence_for(features: DataFrame, catalog: DataFrame, facts: DataFrame) -> DataFrame:
    """entity, feature, concept, value, status and confidence: the facts behind features.

    features (entity, feature), catalog (feature, concepts) of the catalog's size, facts (entity, concept, …)
    of the period that is explained.
    """
    named = features.join(F.broadcast(catalog.select("feature", F.explode("concepts").alias("concept"))), "feature")
    return named.join(facts, ["entity", "concept"])


# Renderings.


def evidence_pack(evidence: DataFrame, assessments: DataFrame, findings: DataFrame) -> DataFrame:
    """entity and the text that a drafter gets: items by id, absent layers left to the caller, findings in order.

    assessments: entity, company, as_of, period_label. A company's evidence is bounded by its report.
    """
    items = evidence.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("evidence_id", _line(F.col).alias("line")))).alias("i"))
    found = findings.groupBy("entity").agg(F.array_sort(F.collect_list(_finding(F.col))).alias("f"))
    return _packs(assessments.join(items, "entity", "left").join(found, "entity", "left"))


def packs_in_place(reports: DataFrame) -> DataFrame:
    """evidence_pack() of registers in place (entity, company, as_of, period_label, items, found)."""
    i = F.array_sort(F.transform("items", lambda x: F.struct(x["evidence_id"].alias("evidence_id"), _line(lambda c: x[c]).alias("line"))))
    f = F.array_sort(F.transform("found", lambda x: _finding(lambda c: x[c])))
    return _packs(reports.select("entity", "company", "as_of", "period_label", i.alias("i"), f.alias("f")))


def _line(of: Callable[[str], Column]) -> Column:
    return F.concat_ws(" ", F.concat(F.lit("["), of("evidence_id"), F.lit("]")), F.concat(F.lit("("), F.concat_ws("/", of("layer"), of("kind"), of("concern")), F.lit(")")), of("summary"), F.concat(F.lit('quote: "'), of("quote"), F.lit('"')))


def _finding(of: Callable[[str], Column]) -> Column:
    return F.concat_ws(" ", F.lit("-"), F.upper(of("family")), of("rule"), F.nullif(of("subject"), F.lit("")))


def _packs(rows: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    lines = F.coalesce(F.transform("i", lambda x: x["line"]), none)
    head = F.concat(F.lit("COMPANY: "), "company", F.lit("\nAS OF: "), F.col("as_of").cast("string"), F.coalesce(F.concat(F.lit(" | fiscal period "), "period_label"), F.lit("")))
    pack = F.concat_ws("\n", head, F.lit(""), F.concat(F.lit("EVIDENCE PACK ("), F.size(lines).cast("string"), F.lit(" items)")), lines, F.when(F.size(F.coalesce("f", none)) > 0, F.lit("\nFINDINGS")), F.coalesce("f", none))
    return rows.select("entity", pack.alias("pack"))


def requests(packs: DataFrame, system: str, max_tokens: int = 8000) -> DataFrame:
    """entity, the request as a struct, and its fingerprint."""
    body = F.struct(F.lit(max_tokens).alias("max_tokens"), F.lit(system).alias("system"), F.col("pack").alias("user"))
    return packs.select("entity", body.alias("request"), tx.content_id("", 8)(F.to_json(body)).alias("fingerprint"))


def newly_elevated(changes: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """Changes of a register whose concern is elevated now and wasn't before."""
    return changes.where((F.col(after) == "elevated") & ~F.coalesce(F.col(before) == "elevated", F.lit(False)))
