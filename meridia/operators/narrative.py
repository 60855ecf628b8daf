"""Disclosure statements: catalog patterns over sentences, mood of each statement, duplicates, quotes, coverage.

Patterns are the catalog's, each one expression over a sentence's plain view, so a scan of texts
evaluates all of them without a cross join. The view has the sentence's length in code points, so
places found in it are those of the text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import python_text as tx
from meridia.functions import scalars as fx
from meridia.operators import disclosures as di
from meridia.operators.disclosures import CATALOG, Definition

# Fixed values.
SEVERITY = {"high": 0, "moderate": 1, "low": 2}
SECTIONS = ("item_1a", "item_3", "item_7")
MOODS = ("asserted", "negated", "cross_reference", "hypothetical")
EMITTED = ("asserted", "negated")


def view(text: Column | str) -> Column:
    """text in lower case with plain punctuation, of the same length in code points."""
    # Lower case of the dotted capital I has two characters; astral ones would shift places.
    known = {**di.PLAIN, "\u0130": "\u0131"}
    plain = F.translate(text, "".join(known), "".join(known.values()))
    return F.regexp_replace(F.lower(plain), r"[\x{10000}-\x{10FFFF}]", "?")


def _any(patterns: Sequence[str], text: Column) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def mood(sentence: Column, at: Column, length: Column) -> Column:
    """negated, cross_reference, hypothetical or asserted, of a trigger at a 1-based place of a sentence's view.

    In this order: a negation right before the trigger, a denial up to its end, a pointer anywhere, a
    condition before it, a statement of fact before it, a modal anywhere.
    """
    near_from = F.greatest(at - di.ADJACENT_CHARS, F.lit(1))
    begin = F.greatest(at - di.WINDOW_CHARS, F.lit(1))
    near, before, through = F.substring(sentence, near_from, at - near_from), F.substring(sentence, begin, at - begin), F.substring(sentence, begin, at - begin + length)
    return (
        F.when(near.rlike(di.ADJACENT_NEGATION), F.lit("negated"))
        .when(_any(di.COMPLIANCE_DENIAL, through), F.lit("negated"))
        .when(_any(di.CROSS_REFERENCE, sentence), F.lit("cross_reference"))
        .when(_any(di.CONDITIONAL, before), F.lit("hypothetical"))
        .when(_any(di.FACTUAL, before), F.lit("asserted"))
        .when(_any(di.MODAL, sentence), F.lit("hypothetical"))
        .otherwise(F.lit("asserted"))
    )


def sentences(docs: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """key, start, end and sentence; offsets are code points of the document."""
    spans = tx.sentence_spans(F.col(text))
    # Sentences are cut before the explode, so the document isn't carried along with each of them.
    cut = docs.select(*key, F.col(text).alias("_t"), spans.alias("_s")).select(*key, F.transform("_s", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring("_t", s["start"] + 1, s["end"] - s["start"]).alias("sentence"))).alias("_s"))
    return cut.select(*key, F.inline("_s"))


def statements(rows: DataFrame, key: Sequence[str], catalog: Sequence[Definition] = CATALOG, sentence: str = "sentence", hypothetical: bool = False, gate: bool = True) -> DataFrame:
    """A row for each sentence and pattern that matches: code, pattern, specificity, assertion, quote and places.

    trigger_start and quote_start count from the sentence's begin. Denials and assertions are emitted,
    hypotheticals if asked for; without the gate every match is.
    """
    v = F.col("_view")
    found = []
    for d in catalog:
        fits = F.lit(True)
        if d.requires:
            fits = fits & v.rlike(d.requires)
        if d.excludes:
            fits = fits & ~v.rlike(d.excludes)
        for name, pattern in d.patterns:
            hit = F.struct(F.lit(d.code).alias("code"), F.lit(d.specificity).alias("specificity"), F.lit(name).alias("pattern"), F.regexp_instr(v, F.lit(pattern)).alias("at"), F.regexp_extract(v, pattern, 0).alias("trigger"))
            found.append(F.when(v.rlike(pattern) & fits, hit))
    out = rows.withColumn("_view", view(sentence))
    out = out.select(*key, F.col(sentence).alias("sentence"), "_view", F.explode(F.array_compact(F.array(*found))).alias("m")).select(*key, "sentence", "_view", "m.*")
    out = out.withColumn("assertion", mood(v, F.col("at"), F.length("trigger")))
    if gate:
        out = out.where(F.col("assertion").isin(*EMITTED, *(["hypothetical"] if hypothetical else [])))
    size, start, slack = F.length("sentence"), F.col("at") - 1, F.lit(di.MAX_QUOTE_CHARS) - F.length("trigger")
    begin = F.when(size <= di.MAX_QUOTE_CHARS, F.lit(0)).when(slack <= 0, start).otherwise(F.greatest(F.lit(0), start - F.floor(slack / 2)))
    end = F.when(size <= di.MAX_QUOTE_CHARS, size).when(slack <= 0, start + F.length("trigger")).otherwise(F.least(size, begin + di.MAX_QUOTE_CHARS))
    out = out.withColumns({"quote_start": begin.cast("int"), "quote_end": end.cast("int")})
    quote = F.substring("sentence", F.col("quote_start") + 1, F.col("quote_end") - F.col("quote_start"))
    return out.select(*key, "sentence", "code", "specificity", "pattern", "trigger", start.alias("trigger_start"), "assertion", "quote_start", quote.alias("quote"))


def deduplicate(rows: DataFrame, key: Sequence[str], text: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key and text with white space collapsed."""
    norm = fx.collapse_space(view(text))
    w = Window.partitionBy(*key, "_norm").orderBy(*order)
    return rows.withColumn("_norm", norm).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_norm", "_rn")


def analyze(docs: DataFrame, key: Sequence[str], wanted: Sequence[str] = SECTIONS, text: str = "text", catalog: Sequence[Definition] = CATALOG, hypothetical: bool = False) -> tuple[DataFrame, DataFrame]:
    """(statements, coverage) of documents by their sections.

    Statements have section_id and places in the document, each distinct one once, the first of it;
    coverage has a row for every wanted section, located or not, with its characters and sentences.
    """
    from meridia.operators import documents as do

    located = docs.select(*key, F.col(text).alias("_t"), F.explode_outer(do.sections(text)).alias("s")).where(F.col("s.section_id").isin(*wanted))
    body = F.substring("_t", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    bodies = located.select(*key, F.col("s.section_id").alias("section_id"), F.col("s.start").alias("section_start"), body.alias("body"))
    rows = sentences(bodies, (*key, "section_id", "section_start"), "body")
    found = statements(rows, (*key, "section_id", "section_start", "start"), catalog, hypothetical=hypothetical)
    found = found.withColumns({"char_start": F.col("section_start") + F.col("start") + F.col("quote_start"), "char_end": F.col("section_start") + F.col("start") + F.col("quote_start") + F.length("quote")})
    order = ("section_id", "char_start", "pattern")
    unique = deduplicate(found, (*key, "code"), "quote", order).drop("section_start", "start", "quote_start", "sentence")
    counts = rows.groupBy(*key, "section_id").agg(F.count(F.lit(1)).alias("sentences"))
    have = bodies.select(*key, "section_id", F.length("body").alias("characters")).join(counts, [*key, "section_id"], "left")
    every = docs.select(*key).distinct().select(*key, F.explode(F.array(*[F.lit(s) for s in wanted])).alias("section_id"))
    coverage = every.join(have, [*key, "section_id"], "left")
    reason = F.when(F.col("characters").isNull(), F.lit("section not located in this document"))
    coverage = coverage.select(*key, "section_id", F.col("characters").isNotNull().alias("located"), F.coalesce("characters", F.lit(0)).alias("characters"), F.coalesce("sentences", F.lit(0)).cast("long").alias("sentences"), reason.alias("reason"))
    return unique, coverage


def codes(found: DataFrame, key: Sequence[str], asserted_only: bool = True) -> DataFrame:
    """The distinct codes of each document, sorted."""
    rows = found.where("assertion = 'asserted'") if asserted_only else found
    return rows.groupBy(*key).agg(F.array_sort(F.collect_set("code")).alias("codes"))


def verify_quotes(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows with verbatim: the text at [start, end) is the sentence."""
    return rows.withColumn("verbatim", F.substring(F.col(text), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("sentence"))


def ordered(rows: DataFrame) -> DataFrame:
    """Asserted first, then by severity and code."""
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return rows.orderBy(F.when(F.col("assertion") == "asserted", 0).otherwise(1), F.try_element_at(rank, F.col("specificity")), "code")


def sweep(rows: DataFrame, key: Sequence[str], per_document: int = 3, seed: int = 7, words: dict[str, str] = di.SWEEP, sentence: str = "sentence") -> DataFrame:
    """Sentences with a code's broad words, a few of each document in hash order, and whether the catalog caught them.

    A sampling operator: rows have the document's key, start and the sentence.
    """
    v = view(sentence)
    hits = F.array_compact(F.array(*[F.when(v.rlike(pattern), F.lit(code)) for code, pattern in words.items()]))
    pool = rows.select(*key, "start", sentence, F.explode(hits).alias("code"))
    caught = statements(rows, (*key, "start"), sentence=sentence).where("assertion = 'asserted'").select(*key, "start", "code").distinct().withColumn("_caught", F.lit(True))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(*key, "start", "code", F.lit(seed)), "start", "code"))
    # The limit acts before the exchange too.
    few = pool.withColumn("_place", place).where(F.col("_place") <= per_document).drop("_place")
    return few.join(caught, [*key, "start", "code"], "left").withColumn("caught_by_catalog", F.coalesce("_caught", F.lit(False))).drop("_caught")
