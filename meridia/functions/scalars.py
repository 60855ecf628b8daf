"""Column expressions: periods, tolerances, ratios, ranks, formats and intervals.

All are built-in expressions, so they stay inside whole-stage code generation. A null input gives
null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
RESOLVER_RELATIVE, RESOLVER_ABSOLUTE = 0.001, 1.0
ANNUAL_SPAN_DAYS = (350, 380)
FISCAL_YEAR_END_TOLERANCE_DAYS = 10
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
BLANK_MARKERS = ("-", "–", "—", "--", "n/a", "nm", "nil")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def values_agree(a: Column | str, b: Column | str, relative: float = RESOLVER_RELATIVE, absolute: float = RESOLVER_ABSOLUTE) -> Column:
    """|a - b| within the larger of an absolute and a relative tolerance."""
    a, b = col(a), col(b)
    return F.abs(a - b) <= F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(a), F.abs(b)))


def safe_ratio(n: Column | str, d: Column | str, zero: float = 0.0) -> Column:
    """n / d, null where the denominator's size is at most zero."""
    n, d = col(n), col(d)
    return F.when(F.abs(d) > zero, n / d)


def log_positive(x: Column | str) -> Column:
    return F.when(col(x) > 0, F.ln(col(x)))


def fiscal_year(label: Column | str) -> Column:
    """The first run of four digits as a number, 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(col(label), r"(\d{4})", 1), F.lit("")).cast("int"), F.lit(0))


def period_label(end: Column | str, fp: Column | str | None = None) -> Column:
    """FY and the year of the end; another fiscal period as a suffix."""
    base = F.concat(F.lit("FY"), F.year(col(end)).cast("string"))
    if fp is None:
        return base
    fp = col(fp)
    return F.when(fp.isNull() | (fp == "FY"), base).otherwise(F.concat(base, F.lit("-"), fp))


def parse_period_label(text: Column | str) -> Column:
    """struct(nature, end) of "Year ended December 31, 2025" (duration) or a bare date (instant); null without one."""
    text = col(text)
    date = r"([A-Za-z]+)\.?\s+(\d{1,2}),?\s+(\d{4})"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(text, date, 1)))
    day, year = F.regexp_extract(text, date, 2).try_cast("int"), F.regexp_extract(text, date, 3).try_cast("int")
    end = F.when(month > 0, F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day)))
    nature = F.when(text.rlike(r"(?i)years?\s+ended"), F.lit("duration")).otherwise(F.lit("instant"))
    return F.when(end.isNotNull(), F.struct(nature.alias("nature"), end.alias("end")))


def period_of(start: Column | str, end: Column | str, nature: Column | str) -> Column:
    """struct(nature, start, end) of a reported fact; null where it isn't of the nature that is expected."""
    start, end, nature = col(start), col(end), col(nature)
    fits = end.isNotNull() & (start.isNull() == (nature == "instant"))
    return F.when(fits, F.struct(nature.alias("nature"), start.alias("start"), end.alias("end")))


def year_end(year: Column, month: Column | int, day: Column | int) -> Column:
    """The date of a fiscal year-end; a day beyond the month's end is its last day."""
    month = month if isinstance(month, Column) else F.lit(month)
    day = day if isinstance(day, Column) else F.lit(day)
    first = F.make_date(year, month, F.lit(1))
    return F.date_add(first, F.least(day, F.day(F.last_day(first))) - 1)


def day_distance(end: Column | str, month: Column | int, day: Column | int) -> Column:
    """Days to the nearest fiscal year-end of the year before, the same and the next."""
    end = col(end)
    gaps = [F.abs(F.datediff(end, year_end(F.year(end) + k, month, day))) for k in (-1, 0, 1)]
    return F.least(*gaps)


def is_annual_period(start: Column | str, end: Column | str, month: Column | int, day: Column | int) -> Column:
    """An instant at a year-end, or a duration of a year that ends at one."""
    start, end = col(start), col(end)
    span = F.datediff(end, start)
    near = day_distance(end, month, day) <= FISCAL_YEAR_END_TOLERANCE_DAYS
    return near & (start.isNull() | span.between(*ANNUAL_SPAN_DAYS))


def parse_numeric(cell: Column | str) -> Column:
    """struct(value, is_negative_paren, is_blank_marker, reason) of a table cell."""
    raw = F.trim(F.regexp_replace(col(cell), r"[\s\u00a0]+", " "))
    bare = F.trim(F.regexp_replace(raw, "[*†‡]+", ""))
    blank = F.lower(bare).isin(*BLANK_MARKERS)
    paren = bare.rlike(r"^\(.*\)$") | bare.rlike(r"^\$\s*\(.*\)$")
    plain = F.regexp_replace(bare, r"[\s$,()]", "")
    good = plain.rlike(r"^-?(\d+(\.\d*)?|\.\d+)$")
    number = F.when(good & ~blank, plain.try_cast("decimal(38,10)"))
    value = F.when(paren, -number).otherwise(number)
    reason = F.when(raw.isNull() | (bare == ""), "empty").when(blank, "blank_marker").when(~good, "not_numeric")
    return F.struct(value.alias("value"), F.coalesce(paren & good, F.lit(False)).alias("is_negative_paren"), F.coalesce(blank, F.lit(False)).alias("is_blank_marker"), reason.alias("reason"))


def scale_word(text: Column | str) -> Column:
    """thousands, millions or billions, whichever is named, in this order."""
    low = F.lower(col(text))
    return F.when(low.contains("thousand"), F.lit(1e3)).when(low.contains("million"), F.lit(1e6)).when(low.contains("billion"), F.lit(1e9))


def compact_number(x: Column | str) -> Column:
    """1234567 as 1.2M; a dash for null."""
    x = col(x)
    out = F.when(x.isNull(), F.lit("—"))
    for limit, suffix in ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")):
        out = out.when(F.abs(x) >= limit, F.concat(F.format_string("%.1f", x / limit), F.lit(suffix)))
    return out.otherwise(F.format_string("%.1f", x))


def fixed(x: Column | str, places: int = 2) -> Column:
    """Fixed places; a dash for null."""
    return F.when(col(x).isNull(), F.lit("—")).otherwise(F.format_string(f"%.{places}f", col(x)))


def percent(x: Column | str, places: int = 1) -> Column:
    return F.when(col(x).isNull(), F.lit("—")).otherwise(F.format_string(f"%.{places}f%%", 100 * col(x)))


def humanise(x: Column | str) -> Column:
    """Underscores as blanks, the first letter a capital."""
    s = F.replace(col(x), F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1_000_000))


def collapse_space(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(x), r"[\s\u00a0]+", " "))


def strip_dashes(x: Column | str) -> Column:
    return F.replace(col(x), F.lit("-"), F.lit(""))


def base_feature(x: Column | str) -> Column:
    """A feature's name without its missing mark."""
    return F.regexp_replace(col(x), "__missing$", "")


def half_ulp(decimals: Column | int, scale: Column | float = 1.0) -> Column:
    """Half a unit of the last printed place."""
    d = decimals if isinstance(decimals, Column) else F.lit(decimals)
    s = scale if isinstance(scale, Column) else F.lit(scale)
    return F.lit(0.5) * F.pow(F.lit(10.0), -d) * s


def wilson(k: Column | str, n: Column | str, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Low and high of the Wilson score interval, within 0 and 1; null where n is 0."""
    k, n = col(k).cast("double"), col(n).cast("double")
    p = k / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    ok = n > 0
    return F.when(ok, F.greatest(F.lit(0.0), mid - half)), F.when(ok, F.least(F.lit(1.0), mid + half))
