"""Lexical forms of the XSD datatypes: canonical values as JVM columns, and validity of Python strings.

The patterns follow XML Schema 1.1 part 2. Facets on values (day of month, integer ranges, time zones up to 14:00)
are checked besides the pattern.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
_TZ = r"(?:Z|[+-](?:(?:0[0-9]|1[0-3]):[0-5][0-9]|14:00))?"
_YEAR = r"(?:[1-9][0-9]{3,}|0[0-9]{3})"
_LEAP = r"[0-9]*(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)"  # of the years, those with a 29 February
_DAY = (
    rf"-?(?:{_YEAR}-(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|1[0-9]|2[0-8]))"
    rf"|(?={_YEAR}-){_LEAP}-02-29)"
)
_TIME = r"(?:(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?|24:00:00(?:\.0+)?)"
_NUM = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)"
# fixed values: the whole numbers that bound XSD's derived integer types
_RANGES = {
    "integer": (None, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1), "nonNegativeInteger": (0, None), "positiveInteger": (1, None),
    "long": (-(2**63), 2**63 - 1), "int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1), "byte": (-(2**7), 2**7 - 1),
    "unsignedLong": (0, 2**64 - 1), "unsignedInt": (0, 2**32 - 1), "unsignedShort": (0, 2**16 - 1), "unsignedByte": (0, 2**8 - 1),
}
INTEGER_TYPES = tuple(_RANGES)
_PATTERNS = {
    "integer": r"[+-]?[0-9]+",
    "decimal": _NUM,
    "double": rf"{_NUM}(?:[eE][+-]?[0-9]+)?|[+-]?INF|NaN",
    "float": rf"{_NUM}(?:[eE][+-]?[0-9]+)?|[+-]?INF|NaN",
    "boolean": r"true|false|1|0",
    "date": _DAY + _TZ,
    "dateTime": f"{_DAY}T{_TIME}{_TZ}",
    "dateTimeStamp": f"{_DAY}T{_TIME}{_TZ[:-1]}",
    "time": _TIME + _TZ,
    "gYear": r"-?(?:[1-9][0-9]{3,}|0[0-9]{3})" + _TZ,
    "gYearMonth": r"-?(?:[1-9][0-9]{3,}|0[0-9]{3})-(?:0[1-9]|1[0-2])" + _TZ,
    "gMonth": r"--(?:0[1-9]|1[0-2])" + _TZ,
    "gDay": r"---(?:0[1-9]|[12][0-9]|3[01])" + _TZ,
    "gMonthDay": r"--(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|[12][0-9]))" + _TZ,
    "duration": r"-?P(?=[0-9T])(?:[0-9]+Y)?(?:[0-9]+M)?(?:[0-9]+D)?(?:T(?=[0-9])(?:[0-9]+H)?(?:[0-9]+M)?(?:[0-9]+(?:\.[0-9]+)?S)?)?",
    "dayTimeDuration": r"-?P(?=[0-9T])(?:[0-9]+D)?(?:T(?=[0-9])(?:[0-9]+H)?(?:[0-9]+M)?(?:[0-9]+(?:\.[0-9]+)?S)?)?",
    "yearMonthDuration": r"-?P(?=[0-9])(?:[0-9]+Y)?(?:[0-9]+M)?",
    "hexBinary": r"(?:[0-9a-fA-F]{2})*",
    "base64Binary": r"(?:(?:[A-Za-z0-9+/] ?){4})*(?:(?:[A-Za-z0-9+/] ?){3}[A-Za-z0-9+/]|(?:[A-Za-z0-9+/] ?){2}[AEIMQUYcgkosw048] ?=|[A-Za-z0-9+/] ?[AQgw] ?= ?=)?",
    "language": r"[a-zA-Z]{1,8}(?:-[a-zA-Z0-9]{1,8})*",
}
_COMPILED = {k: re.compile(v) for k, v in _PATTERNS.items()}
_WHITE = " \t\n\r"


def valid(datatype: str, text: str) -> bool:
    """Whether text is a lexical form of the XSD type (a local name such as "integer"), outer white space ignored. Unknown and string types take every text."""
    s = text.strip(_WHITE)
    if datatype in _RANGES:
        if not _COMPILED["integer"].fullmatch(s):
            return False
        low, high = _RANGES[datatype]
        if low is None and high is None:
            return True
        digits = s.lstrip("+-").lstrip("0") or "0"
        n = int(digits) if len(digits) < 40 else 10**40
        n = -n if s[0] == "-" else n
        return (low is None or n >= low) and (high is None or n <= high)
    pattern = _COMPILED.get(datatype)
    if pattern is None:
        return True
    return bool(pattern.fullmatch(s))


# ---- JVM columns ----


def trimmed(v: Column) -> Column:
    return F.btrim(v, F.lit(_WHITE))


def _full(s: Column, pattern: str) -> Column:
    return s.rlike(rf"\A(?:{pattern})\z")


def _digits(whole: Column, fraction: Column | None, negative: Column) -> Column:
    w = F.regexp_replace(whole, r"^0+", "")
    w = F.when(w == "", "0").otherwise(w)
    if fraction is None:
        text = w
    else:
        f = F.regexp_replace(fraction, r"0+$", "")
        text = F.when(f == "", w).otherwise(F.concat(w, F.lit("."), f))
    return F.when(negative & (text != "0"), F.concat(F.lit("-"), text)).otherwise(text)


def canonical(v: Column, value_type: str) -> Column:
    """A text that is equal for equal values of the type and null where v isn't a lexical form of it.

    Numbers and booleans by value, doubles by their 64-bit value (-0 as 0), dates by calendar day without zone,
    dateTimes by instant with a missing zone read as UTC (fractions of any length). A dateTime beyond the years that
    Spark's date holds (seven digits) counts as not valid.
    """
    kind = value_type.rpartition(":")[2].rpartition("#")[2]
    if kind in ("string", "anyURI"):
        return v
    one = F.transform(F.array(trimmed(v)), lambda s: _canonical(s, kind))  # s is used often and trimmed once
    return F.get(one, F.lit(0))


def _canonical(s: Column, kind: str) -> Column:
    if kind == "integer":
        ok = _full(s, _PATTERNS["integer"])
        return F.when(ok, _digits(F.regexp_replace(s, r"^[+-]", ""), None, s.startswith("-")))
    if kind == "decimal":
        ok = _full(s, _PATTERNS["decimal"])
        return F.when(ok, _digits(F.regexp_extract(s, r"^[+-]?([0-9]*)", 1), F.regexp_extract(s, r"\.([0-9]*)$", 1), s.startswith("-")))
    if kind in ("double", "float"):
        n = F.when(s.isin("INF", "+INF"), F.lit("Infinity")).when(s == "-INF", F.lit("-Infinity")).otherwise(s)
        x = n.try_cast("double")
        return F.when(_full(s, _PATTERNS["double"]), F.when(x == 0, F.lit("0.0")).otherwise(x.cast("string")))
    if kind == "boolean":
        return F.when(s.isin("true", "1"), F.lit("true")).when(s.isin("false", "0"), F.lit("false"))
    if kind == "date":
        return F.when(_full(s, _PATTERNS["date"]), F.regexp_replace(F.regexp_extract(s, r"^(-?[0-9]+-..-..)", 1), "^-0000", "0000"))
    if kind == "dateTime":
        day = F.unix_date(F.regexp_extract(s, "^(.*)T", 1).try_cast("date")).cast("long")
        clock = F.regexp_extract(s, "T(.*)$", 1)
        zone = F.regexp_extract(clock, r"([+-].*)$", 1)
        off = F.coalesce((F.substring(zone, 2, 2).try_cast("long") * 60 + F.substring(zone, 5, 2).try_cast("long")) * F.when(zone.startswith("-"), -1).otherwise(1), F.lit(0))
        sec = day * 86400 + F.substring(clock, 1, 2).try_cast("long") * 3600 + F.substring(clock, 4, 2).try_cast("long") * 60 + F.substring(clock, 7, 2).try_cast("long") - off * 60
        return F.when(_full(s, _PATTERNS["dateTime"]), F.concat(sec.cast("string"), F.lit("."), F.regexp_extract(clock, r"\.([0-9]*[1-9])0*([Z+-].*)?$", 1)))
    raise ValueError(f"no canonical form for {kind}")


def typed(canon: Column, value_type: str) -> Column:
    """The canonical text as a column of the Spark type; integers and decimals beyond 38 digits give null there."""
    kind = value_type.rpartition(":")[2].rpartition("#")[2]
    if kind == "integer":
        return canon.try_cast("decimal(38,0)")
    if kind == "decimal":
        return canon.try_cast("decimal(38,18)")
    if kind in ("double", "float"):
        return canon.try_cast("double")
    if kind == "boolean":
        return canon.try_cast("boolean")
    if kind == "date":
        return canon.try_cast("date")
    if kind == "dateTime":
        sec = F.split_part(canon, F.lit("."), F.lit(1)).try_cast("long")
        micro = F.rpad(F.split_part(canon, F.lit("."), F.lit(2)), 6, "0").try_cast("long")
        return F.when(sec.between(-62135596800, 253402300799), F.timestamp_micros(sec * 1_000_000 + F.coalesce(micro, F.lit(0))).cast("timestamp_ntz"))
    return canon
