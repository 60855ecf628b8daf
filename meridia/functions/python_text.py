"""Text functions that need code-point offsets, hashing or Python's number formats (Arrow UDFs)."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridia.operators.disclosures import PLAIN

# Types as objects: a worker that imports this module has no session to parse them with.
STRING, INT, DOUBLE = T.StringType(), T.IntegerType(), T.DoubleType()


def rows_of(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(k, v) for k, v in fields.items()]))


# Fixed values.
MIN_SENTENCE_CHARS, MAX_SENTENCE_CHARS = 25, 1200
ABBREVIATIONS = frozenset(
    (
        "inc", "corp", "co", "ltd", "llc", "lp", "llp", "plc", "sa", "nv", "ag",
        "no", "nos", "art", "sec", "reg", "para", "pp", "vs", "cf", "ch",
        "approx", "mm", "bn", "mtpa", "cwt",
        "us", "u.s", "uk", "u.k", "eu", "st", "mt", "ft",
        "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sept", "sep", "oct", "nov", "dec",
    )
)
_FOLD = str.maketrans(PLAIN)
_BOUNDARY = re.compile(r"""[.!?]["\u201d\u2019)]?\s+(?=["\u201c\u2018(]?[A-Z0-9])""")
_LAST_TOKEN = re.compile(r"([A-Za-z][A-Za-z.]*|\d+)\Z")
NUMBER = re.compile(
    r"(?P<cur>[$€£])?\s*(?P<sign>[-+\u2212\u2013])?\s*(?P<num>\d{1,3}(?:,\d{3})+|\d+)(?:\.(?P<frac>\d+))?"
    r"\s*(?P<scale>hundred|thousand|million|billion|trillion|bn|mm|[kmb])?\s*(?P<pct>%|\spercent|\spct)?",
    re.I,
)
CITATION = re.compile(r"EV-[A-Z]{2}-[0-9a-f]{8}", re.I)
PERIOD = re.compile(r"\b\d{10}-\d{2}-\d{6}\b|\bFY\s?\d{4}\b|\bQ[1-4]\s?\d{4}\b", re.I)
SCALES = {"hundred": 1e2, "thousand": 1e3, "k": 1e3, "million": 1e6, "m": 1e6, "mm": 1e6, "billion": 1e9, "bn": 1e9, "b": 1e9, "trillion": 1e12}


def fold(text: str) -> str:
    """Typographic characters as plain ones, lower case, of unchanged length."""
    out = text.translate(_FOLD)
    return "".join(low if len(low := c.lower()) == 1 else c for c in out)


def _abbreviates(line: str, at: int) -> bool:
    """Whether the full stop at a place of the line ends an abbreviation, an initial or a list number."""
    if line[at] != ".":
        return False
    # No abbreviation is longer than this.
    begin = max(0, at - 40)
    m = _LAST_TOKEN.search(line[begin:at])
    if m is None:
        return False
    token = m.group()
    if token.isdigit():
        return begin + m.start() == 0
    return len(token) == 1 or token.rstrip(".").lower() in ABBREVIATIONS


def sentences(text: str | None, shortest: int = MIN_SENTENCE_CHARS, longest: int = MAX_SENTENCE_CHARS) -> list[tuple[int, int]]:
    """Spans of sentences, in code points; lines end sentences and lines with tabs are tables."""
    out: list[tuple[int, int]] = []
    at = 0
    for line in (text or "").split("\n"):
        begin, at = at, at + len(line) + 1
        if "\t" in line or not line.strip():
            continue
        cuts = [0, *(m.end() for m in _BOUNDARY.finditer(line) if not _abbreviates(line, m.start())), len(line)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            s = line[a:b]
            lead, size = len(s) - len(s.lstrip()), len(s.strip())
            if size and shortest <= size <= longest:
                out.append((begin + a + lead, begin + a + lead + size))
    return out


def number_mentions(text: str | None) -> list[tuple[str, int, int, list[tuple[float, float]]]]:
    """(text, start, end, readings) of the numbers in a text; a reading is a value and half a unit of its last place.

    A scaled number may also stand for itself, an unsigned one for its negative, a percentage for a rate.
    """
    masked = PERIOD.sub(lambda m: " " * len(m.group()), CITATION.sub(lambda m: " " * len(m.group()), text or ""))
    out = []
    for m in NUMBER.finditer(masked):
        places = len(m["frac"] or "")
        bare = float(m["num"].replace(",", "") + ("." + m["frac"] if m["frac"] else ""))
        if m["sign"] in ("-", "\u2212", "\u2013"):
            bare = -bare
        scale = SCALES.get((m["scale"] or "").lower(), 1.0)
        half = 0.5 * 10.0**-places
        readings = [(bare * scale, half * scale)]
        if scale != 1.0:
            readings.append((bare, half))
        if m["sign"] is None:
            readings.append((-bare * scale, half * scale))
        if m["pct"]:
            readings.append((bare * scale / 100, half * scale / 100))
        out.append((m.group().strip(), m.start(), m.end(), readings))
    return out


@F.pandas_udf(rows_of(start=INT, end=INT))
def sentence_spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"start": a, "end": b} for a, b in sentences(t)])


@F.pandas_udf(rows_of(text=STRING, start=INT, end=INT, readings=rows_of(value=DOUBLE, tolerance=DOUBLE)))
def numbers(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"text": s, "start": a, "end": b, "readings": [{"value": v, "tolerance": h} for v, h in r]} for s, a, b, r in number_mentions(t)])


def period_tokens(text):
    """Fiscal labels, quarters and accession numbers, upper case with single blanks, each once, sorted."""
    found = F.regexp_extract_all(F.upper(text), F.lit(r"\b(\d{10}-\d{2}-\d{6}|FY\s?\d{4}|Q[1-4]\s?\d{4})\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\s+", " "))))


@F.pandas_udf(STRING)
def folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fold(t))


@F.pandas_udf(STRING)
def short_float(values: pd.Series) -> pd.Series:
    """Four significant digits, as Python prints them."""
    return values.map(lambda x: None if pd.isna(x) else f"{x:.4g}")


@F.pandas_udf(STRING)
def signed_float(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if pd.isna(x) else f"{x:+.4g}")


def content_id(prefix: str, size: int = 8):
    """A UDF: prefix and the blake2s hash of a text, size bytes in hex."""

    @F.pandas_udf(STRING)
    def made(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: prefix + hashlib.blake2s((t or "").encode(), digest_size=size).hexdigest())

    return made


@F.pandas_udf(T.ArrayType(STRING))
def content_ids(prefixes: pd.Series, texts: pd.Series) -> pd.Series:
    """content_id() of 4 bytes of each of some texts, under its own prefix."""
    return pd.Series([[p + hashlib.blake2s((t or "").encode(), digest_size=4).hexdigest() for p, t in zip(*x, strict=True)] for x in zip(prefixes, texts, strict=True)])


@F.pandas_udf(STRING)
def payload_hash(payloads: pd.Series) -> pd.Series:
    """blake2s of JSON with sorted keys; of the text itself if it isn't JSON."""

    def one(p: str | None) -> str:
        try:
            p = json.dumps(json.loads(p or ""), sort_keys=True, separators=(",", ":"))
        except ValueError:
            p = p or ""
        return hashlib.blake2s(p.encode()).hexdigest()

    return payloads.map(one)


def render_candidates(value: float | None) -> list[str]:
    """The printed forms of a value: scales of 1, thousands and millions, 0 to 2 places, exact only."""
    if value is None:
        return []
    out = []
    for scale in (1.0, 1e3, 1e6):
        for places in (0, 1, 2):
            x = abs(value) / scale
            s = f"{x:,.{places}f}"
            if abs(float(s.replace(",", "")) - x) < 1e-9 * max(1.0, x):
                out += [f"({s})", f"-{s}", s] if value < 0 else [s]
    return list(dict.fromkeys(out))


@F.pandas_udf(T.ArrayType(STRING))
def candidates(values: pd.Series) -> pd.Series:
    return values.map(lambda v: render_candidates(None if pd.isna(v) else float(v)))
