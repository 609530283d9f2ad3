"""Text and JSON functions as columns: extraction cascades, claim checks, parsers and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(text: Column) -> Column:
    """The first JSON object or array of an answer: a fenced block, the whole text, or the outermost braces; else null."""
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull() & c.rlike(r"^\s*[\[{]"), F.regexp_replace(c, r"^\s+|\s+$", ""))
    block = F.regexp_extract(text, r"(?s)```(?:json)?(.*?)```", 1)
    # from the first opening brace to the last closing one
    braces = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    return F.coalesce(valid(block), valid(text), valid(braces))


def compacted(text: Column) -> Column:
    """An answer of over 600 characters as its JSON; without any, cut to 800 if it is over 1200."""
    short = F.concat(F.substring(text, 1, 800), F.lit("\n...(cut)"))
    return F.when(F.length(text) <= 600, text).otherwise(F.coalesce(json_text(text), F.when(F.length(text) > 1200, short).otherwise(text)))


def first_number(text: Column, label: str, unit: str = "") -> Column:
    """The first number after a label, with an optional unit behind it."""
    return F.regexp_extract(text, rf"(?:{label})[\s=:~]*([+-]?[0-9]+(?:\.[0-9]+)?){unit}", 1).try_cast("double")


def deviates(claimed: Column, real: Column, limit: float) -> Column:
    """True where a claim is off the real value by more than a share of it; unknown or zero values never are."""
    return F.coalesce((real != 0) & (F.abs(claimed - real) / F.abs(real) > limit), F.lit(False))


def position_percent(text: Column) -> Column:
    """"a-b%" is the middle, "a%" is a, anything else 5: the mean of the first number and one joined to it by a dash."""
    digits = r"[0-9]+(?:\.[0-9]+)?"
    ends = F.split(F.regexp_extract(text, rf"{digits}(?:\s*-\s*{digits})?", 0), "-")
    low, high = F.trim(F.get(ends, F.lit(0))).try_cast("double"), F.trim(F.get(ends, F.lit(1))).try_cast("double")
    return F.coalesce((low + high) / 2, low, F.lit(5.0))


def market_cap(text: Column) -> Column:
    """Market value in units of 1e8 from text with thousands commas and unit signs; 0 if it is none."""
    s = F.trim(F.regexp_replace(text, ",", ""))
    number = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
    plain = number(s)
    return F.when(s.contains("亿"), number(F.regexp_replace(s, "亿", ""))).when(s.contains("万"), number(F.regexp_replace(s, "万", "")) / 10000).otherwise(F.when(plain > 1e6, plain / 1e8).otherwise(plain))


def industry_name(text: Column) -> Column:
    """An industry's name without the scheme's and the tier's mark."""
    return F.regexp_replace(text, r"\(申万\)|Ⅱ", "")


def display_width(text: Column) -> Column:
    """Width in a terminal: ideographs, their punctuation and full-width forms count two."""
    wide = "[^\\u4E00-\\u9FFF\\u3000-\\u303F\\uFF00-\\uFFEF]"
    return F.length(text) + F.length(F.regexp_replace(text, wide, ""))


def stars(value: Column) -> Column:
    """0 to 5 stars from a number, rounded and clamped."""
    return F.repeat(F.lit("*"), F.greatest(F.lit(0), F.least(F.lit(5), F.round(value))).cast("int"))


def signed_percent(value: Column) -> Column:
    return F.format_string("%+.1f%%", value.cast("double"))


def market_prefix(code: Column) -> Column:
    """The exchange that a six-digit code belongs to, before it."""
    head = F.substring(code, 1, 1)
    return F.concat(F.when(head.isin("6", "5"), "sh").when(head.isin("4", "8"), "bj").otherwise("sz"), code)


def without_prefix(symbol: Column) -> Column:
    """A symbol's code without the two letters of its exchange."""
    return F.substring(symbol, 3, 1000)


def risk_fragment(text: Column, markers: tuple[str, ...], stops: str = "[.;]", least: int = 5) -> Column:
    """Up to three clauses that begin with a marker word and end at a stop; short ones and repeats are left out."""
    parts = [F.trim(F.regexp_extract(text, rf"({m}[^.;]*)", 1)) for m in markers]
    return F.slice(F.array_distinct(F.filter(F.array(*parts), lambda x: F.length(x) >= least)), 1, 3)


def joined_known(separator: str, **parts: Column) -> Column:
    """key:value of the known parts."""
    return F.concat_ws(separator, *[F.when(v.isNotNull(), F.concat(F.lit(f"{k}:"), v.cast("string"))) for k, v in parts.items()])
