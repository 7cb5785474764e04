"""Scalar column functions: codes, names, amounts, odds, fees."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def division(code: Column, ranges: list[tuple[int, int, str]]) -> Column:
    """The label of the range that holds the code, else UNKNOWN."""
    return F.coalesce(*(F.when(code.between(lo, hi), F.lit(name)) for lo, hi, name in ranges), F.lit("UNKNOWN"))


def two_digits(code: Column) -> Column:
    """The first two of a four-digit code."""
    return F.substring(F.lpad(code.cast("string"), 4, "0"), 1, 2)


def ticker(symbol: Column) -> Column:
    return F.upper(F.replace(F.trim(symbol), F.lit("."), F.lit("-")))


def vendor_id(value: Column) -> Column:
    """A whole number as digits, anything else as trimmed text."""
    x = value.try_cast("double")
    return F.when(x.isNotNull() & (x == F.floor(x)), F.floor(x).cast("string")).otherwise(F.trim(value.cast("string")))


def percent(text: Column) -> Column:
    """A percentage in (0, 100] from text, else NULL."""
    x = F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)", 1)
    v = F.when(x != "", x.cast("double"))
    return F.when((v > 0) & (v <= 100), v)


def confidence(value: Column) -> Column:
    """Clamped to [0, 1]; not finite is NULL."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))


def amount_range(label: Column) -> tuple[Column, Column]:
    """``$1,001 - $15,000`` -> (1001, 15000); ``Over $n`` -> (n + 1, NULL)."""
    found = F.regexp_extract_all(F.regexp_replace(label, ",", ""), F.lit(r"\$\s*([0-9]+)"), F.lit(1))
    n = F.transform(found, lambda x: x.cast("long"))
    over = F.lower(label).startswith("over")
    lo = F.when(over, F.get(n, F.lit(0)) + 1).otherwise(F.get(n, F.lit(0)))
    return lo, F.when(~over, F.get(n, F.lit(1)))


def devig(odds: Column) -> Column:
    """Fair chances of decimal odds; NULL unless the implied sum lies in (0.9, 1.3)."""
    inverse = F.transform(odds, lambda x: 1 / x)
    total = F.aggregate(inverse, F.lit(0.0), lambda a, x: a + x)
    return F.when((total > 0.9) & (total < 1.3), F.transform(inverse, lambda x: x / total))


def taker_fee(price: Column, rate: float = 0.07) -> Column:
    return rate * price * (1 - price)


def collapse_space(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def contains_evidence(evidence: Column, text: Column) -> Column:
    """Normalised containment; empty evidence never counts."""
    e = collapse_space(evidence)
    return F.coalesce((F.length(e) > 0) & F.contains(collapse_space(text), e), F.lit(False))


def item_codes(text: Column, anchored: bool = True) -> Column:
    """Sorted distinct ``Item n.nn`` codes, at line starts or anywhere."""
    pattern = r"(?im)^\s*item\s+([1-9]\.[0-9]{2})(?![0-9])" if anchored else r"(?i)item\s+([0-9]+\.[0-9]+)"
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))))


# Legal suffixes of company names; the tails that name a company's group; names of the government.
SUFFIXES = ("INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY", "COMPANIES", "LTD", "LIMITED", "PLC", "LLC", "LLP", "LP", "NV", "SA", "AG", "SE", "&")
GROUP_TAIL = r"\s+AND\s+(?:ITS\s+|THEIR\s+)?(?:GLOBAL\s+|CONTROLLED\s+|WHOLLY\s+OWNED\s+)?(?:AFFILIATES|SUBSIDIARIES|AFFILIATED\s+COMPANIES)\s*$"
GOVERNMENT = r"^(?:U ?S |UNITED STATES |FEDERAL )(?:FEDERAL )?GOVERNMENT(?: AGENCIES| ENTITIES| AND ITS AGENCIES)?$"


@F.pandas_udf(StringType())
def _nfkc(names: pd.Series) -> pd.Series:
    return names.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def company_name(name: Column) -> Column:
    """NFKC form in upper case, without parentheses, a state marker (``/DE/``) at the end, punctuation, the tail that names a group, legal
    suffixes (never the last word left) and leading THE; names of the government are one."""
    x = F.regexp_replace(F.upper(F.translate(_nfkc(name), "\u2019\u2018\u201c\u201d", "''\"\"")), r"\([^)]*\)", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"/\s*[A-Z]{2,3}\s*/?\s*$", " "), r"[/ ]+$", "")
    x = F.regexp_replace(F.regexp_replace(x, "[.']", ""), '[,"\u2013\u2014/-]', " ")
    x = F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), GROUP_TAIL, "")
    x = F.regexp_replace(F.regexp_replace(x, rf"(?<=[^ ])( ({'|'.join(SUFFIXES)}))+$", ""), "^(THE )+(?=[^ ])", "")
    return F.when(x.rlike(GOVERNMENT), "US GOVERNMENT").when(x == "", F.trim(F.upper(name))).otherwise(x)


def option_symbol(name: Column) -> dict[str, Column]:
    """``BTC-26JUL24-60000-C`` -> currency, expiry date, strike, right."""
    part = lambda i: F.regexp_extract(name, r"^([A-Z]+)-(\d{1,2}[A-Z]{3}\d{2})-(\d+)-([CP])$", i)
    e = part(2)
    months = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
    mon = F.array_position(F.array(*map(F.lit, months)), F.regexp_extract(e, "([A-Z]+)", 1))
    day, year = F.regexp_extract(e, r"^(\d+)", 1), F.regexp_extract(e, r"(\d+)$", 1)
    expiry = F.when(e != "", F.make_date(F.lit(2000) + year.cast("int"), mon.cast("int"), day.cast("int")))
    blank = lambda c: F.when(c != "", c)
    return {"currency": blank(part(1)), "expiry": expiry, "strike": blank(part(3)).cast("double"), "right": blank(part(4))}


def epoch_date(value: Column) -> Column:
    """UTC date of epoch milli- or microseconds."""
    ms = F.when(value >= 10**14, F.floor(value / 1000)).otherwise(value)
    return F.to_date(F.timestamp_millis(ms.cast("long")))
