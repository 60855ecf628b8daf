"""The disclosure catalog: what each code's patterns are, what a sentence must or mustn't hold besides."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Definition:
    """A code, how much it says alone, its patterns by name, and the contexts that it needs or excludes."""

    code: str
    specificity: str
    patterns: tuple[tuple[str, str], ...]
    requires: str | None = None
    excludes: str | None = None


# Patterns over lower-case text with plain punctuation, and cue words of each mood.
DEBT = r"(?:credit (?:agreement|facility|agreements|facilities)|indenture|\bnotes?\b|\bloan\b|term loan|revolv(?:er|ing)|debentures?|senior secured|\bdebt\b|borrowings?)"
CONTRACT_TERMS = r"\bcustomar(?:y|ily)\b|\bprovides? (?:that|for)\b|\btermination events\b|\bevents? of default (?:include|including)\b|\bas long as\b|\brequires?[^.]{0,40}\bthat we maintain\b"
DEFINITIONAL = r"\b(?:an|the) entity\b|\bis defined as\b|\basu \d|\basc \d"
AMOUNTS = r"(?:\$|million|billion|charge|expense|during|year ended|quarter)"
CATALOG = (
    Definition(
        "going_concern_doubt", "high",
        (
            ("gc.substantial_doubt", r"substantial doubt[^.]{0,80}?(?:ability to )?continue as a \bgoing concern\b"),
            ("gc.doubt_exists", r"(?:substantial doubt (?:exists|existed)|there exists? substantial doubt)"),
            ("gc.raise_doubt", r"(?:raise|create)[sd]?\s+substantial doubt"),
            ("gc.auditor_paragraph", r"\bgoing concern\b[^.]{0,40}(?:uncertainty|explanatory) paragraph"),
            ("gc.auditor_opinion", r"(?:report|opinion)[^.]{0,80}\bgoing concern\b (?:uncertainty|qualification)"),
            ("gc.dependent_upon", r"continue as a \bgoing concern\b is dependent"),
        ),
        excludes=DEFINITIONAL,
    ),
    Definition(
        "covenant_breach", "moderate",
        (
            ("cv.not_in_compliance", rf"(?:was|were|are|is|not been|have not been)\s+not in compliance[^.]{{0,60}}(?:covenant|{DEBT})"),
            ("cv.not_comply", r"(?:did not|do not|does not|failed to)\s+(?:comply with|satisfy|meet)[^.]{0,60}covenant"),
            ("cv.breach", r"(?:breach(?:ed|es)?|violat(?:ed|ion|ions)) (?:of |the )?[^.]{0,40}covenant"),
            ("cv.covenant_violation", r"covenant (?:breach|violation|default|non-?compliance)"),
            ("cv.non_compliance", r"non-?compliance with[^.]{0,40}covenant"),
            ("cv.compliance_statement", r"(?<!not )\bin compliance with\b[^.]{0,40}covenant"),
        ),
        excludes=CONTRACT_TERMS,
    ),
    Definition(
        "covenant_waiver_or_amendment", "high",
        (
            ("wv.obtained_waiver", r"(?:obtain(?:ed|ing)?|receiv(?:ed|ing)|sought|seek(?:ing)?|negotiat(?:ed|ing))\s+(?:a |the |certain )?\bwaivers?\b"),
            ("wv.waiver_of_covenant", r"\bwaivers?\b (?:of|from|under)[^.]{0,60}(?:covenant|default|compliance)"),
            ("wv.amend_to_avoid", rf"amend(?:ed|ment|ments)?[^.]{{0,80}}{DEBT}[^.]{{0,80}}(?:covenant|compliance|default)"),
            ("wv.covenant_relief", r"\bcovenant\b (?:relief|holiday|suspension|amendment)"),
        ),
        excludes=CONTRACT_TERMS,
    ),
    Definition(
        "debt_default_or_acceleration", "high",
        (
            ("df.event_of_default", r"(?:an? |the )?events? of default (?:has|have) occurred|(?:an? |the )?events? of default (?:is|are) continuing"),
            ("df.default_occurred", r"(?:we|the company)[^.]{0,40}(?:defaulted|are in default|is in default|was in default|were in default)"),
            ("df.notice_of_default", r"notice of (?:default|acceleration)"),
            ("df.accelerated", rf"{DEBT}[^.]{{0,60}}(?:has been|have been|were|was) accelerated"),
            ("df.reclassified_current", r"reclassif(?:ied|ication)[^.]{0,80}(?:as|to) (?:a )?current (?:liabilit|maturit|portion)"),
            ("df.missed_payment", r"(?:fail(?:ed|ure) to (?:make|pay)|did not (?:make|pay)|elected to defer)[^.]{0,60}(?:interest|principal) payment"),
            ("df.grace_period", r"(?:30|thirty|60|sixty)-day grace period"),
        ),
        excludes=CONTRACT_TERMS,
    ),
    Definition(
        "debt_restructuring", "high",
        (
            ("rs.forbearance", r"forbearance (?:agreement|period)"),
            ("rs.rsa", r"restructuring support agreement"),
            ("rs.exchange_offer", r"(?:exchange offer|debt exchange|distressed exchange)"),
            ("rs.advisers", r"(?:engaged|retained|hired)[^.]{0,60}(?:restructuring|financial) (?:advisors?|advisers?)"),
            ("rs.restructuring_of_debt", rf"restructur(?:e|ing)[^.]{{0,40}}(?:our |its |the )?(?:indebtedness|capital structure|{DEBT})"),
            ("rs.negotiations_with_lenders", r"(?:negotiations|discussions) with[^.]{0,50}(?:lenders|noteholders|creditors|holders of)"),
        ),
    ),
    Definition(
        "bankruptcy_contemplated", "high",
        (
            ("bk.filed_petition", r"(?:filed|commenced)[^.]{0,60}(?:voluntary )?(?:petitions?|cases?) (?:for relief )?under chapter (?:7|11)"),
            ("bk.seek_protection", r"(?:seek|sought|pursue|consider(?:ing)?|evaluat(?:e|ing)|prepar(?:e|ing))[^.]{0,60}(?:protection under|relief under|filing under)[^.]{0,30}(?:chapter (?:7|11)|bankruptcy code)"),
            ("bk.prepackaged", r"(?:pre-?packaged|pre-?arranged) (?:plan|bankruptcy|chapter 11)"),
            ("bk.debtor_in_possession", r"debtor-?in-?possession"),
        ),
    ),
    Definition(
        "liquidity_shortfall", "moderate",
        (
            ("lq.not_sufficient", r"(?:cash|liquidity|resources|funds|capital resources|working capital|borrowing capacity)[^.]{0,60}(?:will not|are not|is not|may not) be sufficient"),
            ("lq.insufficient", r"\binsufficient\b (?:liquidity|cash|funds|capital|resources)"),
            ("lq.unable_to_meet", r"unable to (?:meet|satisfy|fund)[^.]{0,40}(?:obligations|commitments|liabilities|requirements)"),
            ("lq.substantial_need", r"(?:immediate|urgent|substantial) need for (?:additional )?(?:capital|liquidity|financing)"),
            ("lq.drew_down_revolver", r"(?:drew|drawn|borrowed)[^.]{0,50}(?:full|entire|remaining|available)[^.]{0,40}(?:revolv|credit facility)"),
        ),
        excludes=DEFINITIONAL,
    ),
    Definition(
        "material_weakness", "low",
        (
            ("mw.identified", r"(?:identified|concluded|determined)[^.]{0,80}material weakness(?:es)?"),
            ("mw.existed", r"material weakness(?:es)? (?:in|existed|exists|was|were|identified)"),
            ("mw.not_effective", r"(?:internal control|disclosure controls)[^.]{0,80}(?:were|was|are|is) not effective"),
            ("mw.restatement", r"(?:restate(?:d|ment)|revised)[^.]{0,60}(?:previously issued|prior period|historical)[^.]{0,40}financial statements"),
        ),
    ),
    Definition(
        "dividend_suspension", "moderate",
        (
            ("dv.suspended", r"(?:suspend(?:ed|ing)?|eliminat(?:ed|ing)|discontinu(?:ed|ing)|ceased paying)[^.]{0,40}(?:our |the |quarterly |common stock )?dividend"),
            ("dv.no_longer_pay", r"(?:no longer (?:pay|declare)|will not (?:pay|declare))[^.]{0,30}dividend"),
            ("dv.reduced", r"\b(?:reduc(?:ed|tion)|cut)\b[^.]{0,30}(?:in |of |our |the )?(?:quarterly )?\bdividend\b"),
        ),
    ),
    Definition(
        "delisting_notice", "high",
        (
            ("dl.notice", r"(?:notice|notification|letter)[^.]{0,80}(?:nyse|nasdaq|new york stock exchange|the exchange)[^.]{0,80}(?:non-?compliance|not in compliance|listing standard|minimum)"),
            ("dl.non_compliance_listing", r"(?:not in compliance|non-?compliance|failed to (?:satisfy|meet))[^.]{0,60}(?:continued )?listing (?:standards?|requirements?|rules?|criteria|criterion)"),
            ("dl.delisted", r"(?:was|were|has been|have been|will be) (?:de-?listed|suspended from (?:trading|listing))"),
            ("dl.transferred_otc", r"(?:transferred|moved|began trading)[^.]{0,50}(?:over-?the-?counter|otc (?:markets|pink))"),
        ),
    ),
    Definition(
        "credit_rating_downgrade", "moderate",
        (
            ("rt.downgraded", r"(?:downgrad(?:ed|e|es|ing)|lowered)[^.]{0,80}(?:our|the company's|its)?[^.]{0,30}(?:credit )?ratings?"),
            ("rt.agency_action", r"(?:moody's|standard & poor's|s&p|fitch)[^.]{0,80}(?:downgrad|lowered|reduced|negative outlook|credit watch)"),
        ),
    ),
    Definition(
        "asset_impairment", "low",
        (
            ("im.recorded", r"\b(?:recorded|recognized|recognised|incurred|took)\b[^.]{0,60}\bimpairment\b"),
            ("im.goodwill", r"\b(?:goodwill|asset|long-?lived|full cost ceiling)\b[^.]{0,30}\bimpairment\b"),
            ("im.write_down", r"(?:write-?(?:down|off)|wrote (?:down|off))[^.]{0,60}(?:goodwill|assets|carrying value)"),
        ),
        requires=AMOUNTS,
    ),
)

#: Broad words of each code, for a pool that recall is judged on.
SWEEP = {
    "going_concern_doubt": r"going concern|substantial doubt", "covenant_breach": r"covenant", "covenant_waiver_or_amendment": r"waiver|waive", "debt_default_or_acceleration": r"default|accelerat",
    "debt_restructuring": r"restructur|forbearance|exchange offer", "bankruptcy_contemplated": r"bankrupt|chapter 11|chapter 7", "liquidity_shortfall": r"liquidity|sufficient cash", "material_weakness": r"material weakness|internal control",
    "dividend_suspension": r"dividend", "delisting_notice": r"delist|listing standard|nyse|nasdaq", "credit_rating_downgrade": r"downgrad|credit rating", "asset_impairment": r"impairment|write-down|wrote off",
}

ADJACENT_CHARS, WINDOW_CHARS, MAX_QUOTE_CHARS = 14, 220, 400
ADJACENT_NEGATION = r"(?:\bno|\bnot|\bnever|\bwithout(?:\s+(?:a|any))?)\s+$"
COMPLIANCE_DENIAL = (
    r"\bwe (?:were|are|have been|had been|have remained|remain(?:ed|s)?) (?:currently )?in compliance\b",
    r"\bthe company (?:was|is|has been|remain(?:ed|s)?) (?:currently )?in compliance\b",
    r"(?<!not )\bin compliance with all\b",
    r"\bno (?:event of )?defaults? (?:has|have) occurred\b",
    r"\bnone of\b",
)
CROSS_REFERENCE = (
    r"\b(?:see|refer to|described in|discussed in|set forth in|included in|as defined in)\b[^.]{0,60}\b(?:note|item|section|part|exhibit|schedule|discussion)\b",
    r"\bfor (?:further|additional|more) (?:discussion|information|detail)\b",
)
CONDITIONAL = (
    r"\bif\b", r"\bunless\b", r"\bshould we\b", r"\bshould the\b", r"\bwere we to\b", r"\bin the event\b", r"\bto the extent that\b",
    r"\bcan(?:not)? be (?:no )?assurance\b", r"\bcan(?:not)? (?:provide|give|offer|assure)\b", r"\bany failure\b", r"\ba failure\b", r"\bfailure to\b", r"\brisk that\b",
)
FACTUAL = (
    r"\bthere exists\b", r"\bexists? substantial doubt\b", r"\bsubstantial doubt exists\b", r"\braise[sd]? substantial doubt\b", r"\bcreate[sd]? substantial doubt\b",
    r"\bwe (?:have|had|were|was|are|is)\b", r"\bthe company (?:has|had|were|was|is)\b",
    r"\bwe (?:breached|defaulted|failed|obtained|received|entered|filed|suspended|eliminated)\b",
    r"\bas of (?:december|january|february|march|april|may|june|july|august|september|october|november)\b",
    r"\bduring (?:the year|fiscal|20\d\d)\b", r"\beffective\b",
)
MODAL = (r"\bmay\b", r"\bmight\b", r"\bcould\b", r"\bwould\b", r"\bcan\b", r"\bwe expect\b", r"\bwe anticipate\b", r"\bis designed to\b", r"\bcould result\b", r"\bpotential(?:ly)?\b")

#: One character for one, so offsets hold.
PLAIN = {
    "\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201b": "'", "\u2032": "'", "\u00b4": "'", "\u0060": "'",
    "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u2033": '"',
    "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2014": "-", "\u2015": "-", "\u2212": "-",
    "\u00a0": " ", "\u2002": " ", "\u2003": " ", "\u2009": " ", "\u200a": " ", "\u202f": " ", "\ufeff": " ",
    "\u2022": "-", "\u00b7": "-",
}
