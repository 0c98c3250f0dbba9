"""Conversions of single values, as column expressions.

Matching at the beginning only, as ``^`` patterns do, leaves the rest of a value aside; a value
that doesn't match comes back as it was unless said otherwise.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Converter = Callable[[Column], Column]


#: What counts as white space at the ends of a value (fixed values).
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(v: Column) -> Column:
    return F.btrim(v, F.lit(SPACES))


def _dated(v: Column, pattern: str, *parts: str | int) -> Column:
    """The groups (numbers, padded to two digits if negative) and strings joined, where it matches."""
    s = strip(v)
    joined = F.concat(
        *(F.lit(p) if isinstance(p, str) else F.lpad(F.regexp_extract(s, pattern, -p), 2, "0") if p < 0 else F.regexp_extract(s, pattern, p) for p in parts)
    )
    return F.when(s.rlike(pattern), joined).otherwise(v)


def date_mdy_to_dmy(v: Column) -> Column:
    return _dated(v, r"^(\d{1,2})/(\d{1,2})/(\d{4})", 2, "/", 1, "/", 3)


def date_dmy_to_iso(v: Column) -> Column:
    return _dated(v, r"^(\d{1,2})/(\d{1,2})/(\d{4})", 3, "-", -2, "-", -1)


def date_ymd_to_iso(v: Column) -> Column:
    return _dated(v, r"^(\d{4})(\d{2})(\d{2})", 1, "-", 2, "-", 3)


def date_marc_to_iso(v: Column) -> Column:
    """ISO dates stay, YYYYMMDD and YYYY (then 1 January) are converted."""
    s = strip(v)
    return (
        F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s)
        .when(s.rlike(r"^\d{8}"), date_ymd_to_iso(s))
        .when(s.rlike(r"^\d{4}$"), F.concat(s, F.lit("-01-01")))
        .otherwise(v)
    )


def case_title(v: Column) -> Column:
    """A capital after every non-letter, also after an apostrophe."""
    runs = F.regexp_extract_all(v, F.lit(r"(\p{L}+|[^\p{L}]+)"))

    def titled(r: Column) -> Column:
        first = F.upper(F.substring(r, 1, 1))  # some letters become two, the second of which stays small
        return F.concat(F.substring(first, 1, 1), F.lower(F.substring(first, F.lit(2), F.length(first))), F.lower(F.substring(r, F.lit(2), F.length(r))))

    return F.array_join(F.transform(runs, titled), "")


def case_sentence(v: Column) -> Column:
    return F.concat(F.upper(F.substring(v, 1, 1)), F.substring(v, F.lit(2), F.length(v)))


def normalize_spaces(v: Column) -> Column:
    return strip(F.regexp_replace(v, r"\s+", " "))


def strip_punctuation(v: Column) -> Column:
    return strip(F.regexp_replace(strip(v), r"[.,:;/]+$", ""))


def clean_isbn(v: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(v), r"\s*\([^)]*\)\s*$", ""), r"[\s-]", "")


def clean_lccn(v: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(v, r"\s+", ""), r"/.*$", "")


def extract_year(v: Column) -> Column:
    found = F.regexp_extract(v, r"\b(\d{4})\b", 1)
    return F.when(found != "", found).otherwise(v)


def isbn13(v: Column) -> Column:
    """Thirteen digits stay; an ISBN-10 gets the prefix 978 and its check digit."""
    bare = clean_isbn(v)
    body = F.concat(F.lit("978"), F.substring(bare, 1, 9))
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(12)),
        F.lit(0),
        lambda acc, i: acc + F.substring(body, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 1).otherwise(3),
    )
    check = F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string")
    return F.when(bare.rlike(r"^\d{13}$"), bare).when(bare.rlike(r"^\d{9}[\dXx]$"), F.concat(body, check)).otherwise(v)


def oclc_number(v: Column) -> Column:
    """The digits after (OCoLC), else null."""
    found = F.regexp_extract(v, r"^\(OCoLC\)\s*(\d+)", 1)
    return F.when(found != "", found)


def gender(v: Column) -> Column:
    low = F.lower(strip(v))
    return F.when(low.startswith("f"), "F").when(low.startswith("m"), "M").otherwise("")


def first_char(v: Column) -> Column:
    return F.upper(F.substring(strip(v), 1, 1))


def truncate(v: Column, length: int = 120) -> Column:
    return F.when(F.length(v) > length, F.concat(F.substring(v, 1, length), F.lit("…"))).otherwise(v)


def file_safe(v: Column, length: int = 50) -> Column:
    return F.substring(F.regexp_replace(v, r"[^\p{L}\p{N}_-]", "_"), 1, length)


def sql_escape(v: Column) -> Column:
    """With backslashes before backslashes and quotes."""
    return F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def sql_double(v: Column) -> Column:
    return F.replace(v, F.lit("'"), F.lit("''"))


def strict_date(v: Column, pattern: str) -> Column:
    """A date in this pattern as ISO, anything else as it was."""
    return F.coalesce(F.date_format(F.try_to_timestamp(strip(v), F.lit(pattern)), "yyyy-MM-dd"), v)


def split_part(v: Column, delimiter: str, index: int) -> Column:
    """One of the non-empty parts, from the end if negative; out of range: as it was."""
    parts = F.filter(F.transform(F.split(v, re.escape(delimiter)), strip), lambda p: p != "")
    place = F.lit(index) if index >= 0 else F.size(parts) + index
    return F.coalesce(F.get(parts, place), v)


def name_split(v: Column, part: str) -> Column:
    """Surname, first or middle name of ``Last, First Middle`` or ``First Middle Last``."""
    s = strip(v)
    comma = s.contains(",")
    given = F.when(comma, strip(F.regexp_extract(s, r"^[^,]*,(.*)$", 1))).otherwise(s)
    words = F.filter(F.split(given, r"\s+"), lambda w: w != "")
    n = F.size(words)
    if part == "surname":
        return F.when(comma, strip(F.regexp_extract(s, r"^([^,]*),", 1))).otherwise(F.coalesce(F.get(words, n - 1), F.lit("")))
    first = F.when(comma | (n > 1), F.coalesce(F.get(words, 0), F.lit(""))).otherwise("")
    if part == "firstname":
        return first
    if part == "middlename":
        last = F.when(comma, n).otherwise(n - 1)
        return F.when(last > 1, F.array_join(F.slice(words, 2, F.greatest(last - 1, F.lit(0))), " ")).otherwise("")
    raise ValueError(f"no part of a name: {part!r}")


def java_pattern(pattern: str) -> str:
    """A Python pattern for Java's engine: Unicode classes, named groups."""
    return "(?U)" + re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)


def java_template(replacement: str) -> str:
    """A replacement with ``\\1`` or ``\\g<1>`` in Java's form; a bare dollar is itself."""
    out = replacement.replace("$", "\\$")
    return re.sub(r"\\g<(\w+)>|\\(\d)", lambda m: f"${{{m[1]}}}" if m[1] and not m[1].isdigit() else f"${m[1] or m[2]}", out)


def substitute(spec: str) -> Converter:
    """``s/pattern/replacement/flags`` with any delimiter: the first match, or all with g; i
    ignores case. A pattern that isn't valid leaves values as they are."""
    if len(spec) < 2 or spec[0] != "s":
        return lambda v: v
    parts = spec[2:].split(spec[1])
    if len(parts) < 2:
        return lambda v: v
    pattern, replacement, flags = parts[0], parts[1], parts[2] if len(parts) > 2 else ""
    try:
        re.compile(pattern)
    except re.error:
        return lambda v: v
    java = ("(?i)" if "i" in flags else "") + java_pattern(pattern)
    if "g" in flags:
        return lambda v: F.regexp_replace(v, java, java_template(replacement))
    # the first match only: the pattern takes the rest of the value along, as the last group
    groups = re.compile(pattern).groups
    return lambda v: F.regexp_replace(v, f"(?s)(?:{java})(?<therest>.*)$" if groups else f"(?s){java}(?<therest>.*)$", java_template(replacement) + "${therest}")


def lookup(table: dict[str, str]) -> Converter:
    """The table's value for exactly this one, else for it in any case, else itself."""
    if not table:
        return lambda v: v
    exact = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    lower = {k.lower(): v for k, v in reversed([*table.items()])}
    loose = F.create_map(*(F.lit(x) for kv in lower.items() for x in kv))
    return lambda v: F.coalesce(F.try_element_at(exact, v), F.try_element_at(loose, F.lower(v)), v)


# ---- what Spark has no expression for: Arrow-batched, pre-filtered by its callers


@F.pandas_udf(T.StringType())
def nfc(v: pd.Series) -> pd.Series:
    return v.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


@F.pandas_udf(T.StringType())
def _without_marks(v: pd.Series) -> pd.Series:
    return v.map(lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)), na_action="ignore")


@F.pandas_udf(T.StringType())
def ascii_fold(v: pd.Series) -> pd.Series:
    """Nearest ASCII: compatibility forms, without marks and what has no ASCII form."""
    return v.map(lambda s: unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode(), na_action="ignore")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


@F.pandas_udf(T.StringType())
def _html_text(v: pd.Series) -> pd.Series:
    def text(s: str) -> str:
        parser = _Text()
        parser.feed(s)
        parser.close()
        return "".join(parser.parts)

    return v.map(text, na_action="ignore")


def clean_html(v: Column) -> Column:
    """Text without tags, entities decoded; values without markup skip Python."""
    return F.when(v.rlike("[<&]"), _html_text(v)).otherwise(v)


def normalize_text(v: Column) -> Column:
    """For comparison: without marks, lower case, no punctuation, single spaces."""
    plain = F.when(F.length(v) == F.octet_length(v), v).otherwise(_without_marks(v))
    return normalize_spaces(F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}_\s]", ""))


#: Conversions by the names that rules use.
PRESETS: dict[str, Converter] = {
    "date_mdy_to_dmy": date_mdy_to_dmy,
    "date_dmy_to_iso": date_dmy_to_iso,
    "date_ymd_to_iso": date_ymd_to_iso,
    "date_marc_to_iso": date_marc_to_iso,
    "case_upper": F.upper,
    "case_lower": F.lower,
    "case_title": case_title,
    "case_sentence": case_sentence,
    "text_trim": strip,
    "text_normalize_spaces": normalize_spaces,
    "text_strip_punctuation": strip_punctuation,
    "clean_isbn": clean_isbn,
    "clean_lccn": clean_lccn,
    "clean_html": clean_html,
    "extract_year": extract_year,
    "extract_isbn13": isbn13,
    "const_value": lambda v: v,
}


def preset(name: str) -> Converter:
    """The conversion of this name; unknown ones leave values as they are."""
    return PRESETS.get(name, lambda v: v)
