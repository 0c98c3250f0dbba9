"""Batch edits of records, and generated content fields."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibloom.functions import extract
from bibloom.functions.text import java_pattern, java_template, strip
from bibloom.model import FIELD, FIELDS, control, datafield, is_control, subfield
from bibloom.operators.fieldmaps import set_value

Edit = Callable[[DataFrame], DataFrame]


def _edit_values(change: Callable[[Column], Column], tag: str | None, code: str | None) -> Edit:
    def one(f: Column) -> Column:
        chosen = F.lit(True) if tag is None else f["tag"] == tag
        if code is not None:
            chosen = chosen & ~is_control(f)
        subs = F.transform(f["subfields"], lambda s: (F.when(s["code"] == code, s.withField("value", change(s["value"]))).otherwise(s) if code else s.withField("value", change(s["value"]))))
        return F.when(chosen, F.when(is_control(f), f.withField("data", change(f["data"]))).otherwise(f.withField("subfields", subs))).otherwise(f)

    return lambda bibs: bibs.withColumn("fields", F.transform("fields", one))


def find_replace(find: str, replacement: str, tag: str | None = None, code: str | None = None, case_sensitive: bool = True, whole: bool = False) -> Edit:
    """Literal replacement in values; ``whole`` replaces values that equal the text only."""
    if whole:
        same = (lambda v: v == find) if case_sensitive else (lambda v: F.lower(v) == find.lower())
        return _edit_values(lambda v: F.when(same(v), F.lit(replacement)).otherwise(v), tag, code)
    if case_sensitive:
        return _edit_values(lambda v: F.replace(v, F.lit(find), F.lit(replacement)), tag, code)
    pattern = "(?iu)" + "".join(f"\\{c}" if c in r"\^$.|?*+()[]{}" else c for c in find)
    return _edit_values(lambda v: F.regexp_replace(v, pattern, re.sub(r"([\\$])", r"\\\1", replacement)), tag, code)


def regex_replace(pattern: str, replacement: str, tag: str | None = None, code: str | None = None, ignore_case: bool = False) -> Edit:
    """All matches, with group references as in Python."""
    java = ("(?i)" if ignore_case else "") + java_pattern(pattern)
    return _edit_values(lambda v: F.regexp_replace(v, java, java_template(replacement)), tag, code)


def inserted(fields: Column, new: Column) -> Column:
    """The field put before the first one of a greater tag."""
    lesser = F.filter(fields, lambda f: f["tag"] <= new["tag"])
    greater = F.filter(fields, lambda f: f["tag"] > new["tag"])
    return F.concat(lesser, F.array(new).cast(FIELDS), greater)


def add_field(tag: str, subfields: Sequence[tuple[str, str]] = (), data: str | None = None, ind1: str = " ", ind2: str = " ", if_exists: str | None = None, if_missing: str | None = None) -> Edit:
    """A new field in the place of its tag, if a tag exists or is missing where asked."""
    new = control(tag, data or "") if tag < "010" else datafield(tag, F.array(*(subfield(c, v) for c, v in subfields)), ind1, ind2)
    test = F.lit(True)
    if if_exists:
        test = test & extract.has_tag(if_exists)
    if if_missing:
        test = test & ~extract.has_tag(if_missing)
    return lambda bibs: bibs.withColumn("fields", F.when(test, _by_tag(F.concat("fields", F.array(new).cast(FIELDS)))).otherwise(F.col("fields")))


def _by_tag(fields: Column) -> Column:
    keyed = F.transform(fields, lambda f, i: F.struct(f["tag"].alias("tag"), i.alias("i"), f.alias("f")))
    order = lambda x, y: F.when(x["tag"] < y["tag"], -1).when(x["tag"] > y["tag"], 1).when(x["i"] < y["i"], -1).otherwise(1)
    return F.transform(F.array_sort(keyed, order), lambda k: k["f"])


def delete_field(tag: str, code: str | None = None, containing: str | None = None) -> Edit:
    """Fields of a tag, or their subfields of a code; only those whose value contains a text, in
    any case, if one is given. A field left without subfields goes too."""
    has = (lambda v: F.contains(F.lower(v), F.lit(containing.lower()))) if containing else (lambda v: F.lit(True))
    if code is None:
        text = lambda f: F.when(is_control(f), f["data"]).otherwise(F.array_join(F.transform(f["subfields"], lambda s: s["value"]), " "))
        return lambda bibs: bibs.withColumn("fields", F.filter("fields", lambda f: ~((f["tag"] == tag) & has(text(f)))))
    less = lambda f: f.withField("subfields", F.filter(f["subfields"], lambda s: ~((s["code"] == code) & has(s["value"]))))
    kept = F.transform("fields", lambda f: F.when(f["tag"] == tag, less(f)).otherwise(f))
    return lambda bibs: bibs.withColumn("fields", F.filter(kept, lambda f: (f["tag"] != tag) | (F.size(f["subfields"]) > 0)))


def call_numbers(class_spec: str = "082$a", target: str = "852", code: str = "h", prefix: str = "") -> Edit:
    """Class number, space, first letter of the author; records that have the target, or no
    class number, stay."""
    author = F.upper(F.substring(strip(extract.first("100$a", default="")), 1, 1))
    number = F.concat(F.lit(prefix), extract.first(class_spec), F.when(author != "", F.concat(F.lit(" "), author)).otherwise(F.lit("")))
    there = F.size(extract.values(f"{target}${code}")) > 0

    def edit(bibs: DataFrame) -> DataFrame:
        at = F.array_position(F.transform("fields", lambda f: f["tag"]), target)
        new = F.array(subfield(code, number))
        added = F.transform("fields", lambda f, i: F.when(i + 1 == at, f.withField("subfields", F.concat(f["subfields"], new))).otherwise(f))
        made = F.when(at > 0, added).otherwise(F.concat("fields", F.array(datafield(target, new)).cast(FIELDS)))
        return bibs.withColumn("fields", F.when(there | extract.first(class_spec).isNull(), F.col("fields")).otherwise(made))

    return edit


def constant(tag: str, code: str | None, value: str) -> Edit:
    return lambda bibs: bibs.withColumn("fields", set_value(F.col("fields"), tag, code, value))


def macro(*edits: Edit) -> Edit:
    """Edits one after another, each on the result of the one before."""
    return lambda bibs: reduce(lambda df, edit: edit(df), edits, bibs)


# ---- content, media and carrier types; fixed values of the cataloguing rules

#: Term and code of the content by the type of record (leader, byte 6).
CONTENT = {
    "a": ("text", "txt"),
    "c": ("notated music", "ntm"),
    "d": ("notated music", "ntm"),
    "e": ("cartographic image", "cri"),
    "f": ("cartographic image", "cri"),
    "g": ("two-dimensional moving image", "tdi"),
    "i": ("spoken word", "spw"),
    "j": ("performed music", "prm"),
    "k": ("still image", "sti"),
    "m": ("computer program", "cop"),
    "o": ("other", "xxx"),
    "p": ("text", "txt"),
    "r": ("three-dimensional form", "tdf"),
    "t": ("text", "txt"),
}
#: Term and code of the medium by the type of record.
MEDIA = {
    "a": ("unmediated", "n"),
    "c": ("unmediated", "n"),
    "d": ("unmediated", "n"),
    "e": ("unmediated", "n"),
    "f": ("unmediated", "n"),
    "g": ("video", "v"),
    "i": ("audio", "s"),
    "j": ("audio", "s"),
    "k": ("unmediated", "n"),
    "m": ("computer", "c"),
    "o": ("unmediated", "n"),
    "p": ("unmediated", "n"),
    "r": ("unmediated", "n"),
    "t": ("unmediated", "n"),
}
#: Term and code of the carrier by the type of record and bibliographic level (leader, bytes 6 and 7).
CARRIER = {
    "ab": ("volume", "nc"),
    "ai": ("online resource", "cr"),
    "am": ("volume", "nc"),
    "as": ("volume", "nc"),
    "cm": ("volume", "nc"),
    "dm": ("volume", "nc"),
    "em": ("sheet", "nb"),
    "fm": ("sheet", "nb"),
    "gm": ("videodisc", "vd"),
    "im": ("audio disc", "sd"),
    "jm": ("audio disc", "sd"),
    "km": ("sheet", "nb"),
    "mm": ("online resource", "cr"),
    "om": ("volume", "nc"),
    "pm": ("volume", "nc"),
    "rm": ("object", "nr"),
    "tm": ("volume", "nc"),
}


def _terms(table: dict[str, tuple[str, str]], *keys: Column, default: tuple[str, str]) -> tuple[Column, Column]:
    out = []
    for k in (0, 1):
        terms = F.create_map(*(F.lit(x) for key, value in table.items() for x in (key, value[k])))
        out.append(F.coalesce(*(F.try_element_at(terms, key) for key in keys), F.lit(default[k])))
    return out[0], out[1]


def type_fields(overwrite: bool = False) -> Edit:
    """336, 337 and 338 from the leader, where missing or, if asked, in place of what is there."""
    kind, both = F.substring("leader", 7, 1), F.substring("leader", 7, 2)
    rules = [
        ("336", "rdacontent", _terms(CONTENT, kind, default=("text", "txt"))),
        ("337", "rdamedia", _terms(MEDIA, kind, default=("unmediated", "n"))),
        ("338", "rdacarrier", _terms(CARRIER, both, F.concat(kind, F.lit("m")), default=("volume", "nc"))),
    ]

    def edit(bibs: DataFrame) -> DataFrame:
        for tag, source, (term, code) in rules:
            new = datafield(tag, F.array(subfield("a", term), subfield("b", code), subfield("2", source)))
            rest = _without(tag)
            wanted = F.lit(True) if overwrite else ~extract.has_tag(tag)
            bibs = bibs.withColumn("fields", F.when(wanted, inserted(rest, new.cast(FIELD))).otherwise(F.col("fields")))
        return bibs

    return edit


def _without(tag: str) -> Column:
    return F.filter("fields", lambda f: f["tag"] != tag)


def type_scan(bibs: DataFrame) -> DataFrame:
    """One row: records without 336, 337, 338, and with all of them."""
    has = {t: extract.has_tag(t) for t in ("336", "337", "338")}
    return bibs.agg(*(F.count_if(~h).alias(f"missing_{t}") for t, h in has.items()), F.count_if(has["336"] & has["337"] & has["338"]).alias("complete"), F.count(F.lit(1)).alias("records"))
