"""Tables of patrons, holds and circulation: conversion by rules, ids, validation, differences."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibloom.functions import text
from bibloom.functions.extract import first
from bibloom.model import rendered

#: Names that a role's column may have, the preferred first (fixed values).
ALIASES = {
    "patron": ("patron_id", "borrowernumber", "patron_barcode", "patron_cardnumber", "cardnumber", "borrower_barcode"),
    "bib": ("biblio_id", "biblionumber", "legacy_bib_id", "bib_control_number", "bib_001", "control_number", "legacy_biblionumber"),
    "item": ("item_id", "itemnumber", "legacy_item_barcode", "item_barcode", "barcode"),
    "date": ("hold_date", "reserve_date", "placed_date", "reservedate"),
    "pickup": ("pickup_library_id", "branchcode", "pickup_branch"),
    "expiry": ("expiration_date", "expirationdate"),
}


def by_alias(rows: DataFrame, roles: Sequence[str] = tuple(ALIASES)) -> DataFrame:
    """Columns renamed to the roles they have, whatever their case and outer spaces; others keep
    their names."""
    lower = {c.strip().lower(): c for c in rows.columns}
    names = {}
    for role in roles:
        found = next((lower[a] for a in ALIASES[role] if a in lower), None)
        if found is not None and found not in names:
            names[found] = role
    return rows.withColumnsRenamed(names)


@dataclass(frozen=True)
class ColumnMap:
    """kind: copy, const, regex, lookup, preset, date (pattern), split (delimiter, index), name
    (part), gender, first_char, upper, lower, title."""

    target: str
    source: str | None = None
    kind: str = "copy"
    argument: object = None


def _converted(m: ColumnMap) -> Column:
    v = F.coalesce(text.strip(F.col(m.source).cast("string")), F.lit("")) if m.source else F.lit("")
    makers = {
        "copy": lambda a: v,
        "const": lambda a: F.when(v != "", F.lit(a)).otherwise(F.lit("")) if m.source else F.lit(a),
        "regex": lambda a: F.regexp_replace(v, text.java_pattern(a[0]), text.java_template(a[1])),
        "lookup": lambda a: text.lookup(a)(v),
        "preset": lambda a: text.preset(a)(v),
        "date": lambda a: text.strict_date(v, a),
        "split": lambda a: text.split_part(v, *a),
        "name": lambda a: text.name_split(v, a),
        "gender": lambda a: text.gender(v),
        "first_char": lambda a: text.first_char(v),
        "upper": lambda a: F.upper(v),
        "lower": lambda a: F.lower(v),
        "title": lambda a: text.case_title(v),
    }
    return makers[m.kind](m.argument)


@dataclass(frozen=True)
class ValueRule:
    """What becomes of a header's values: rename or merge to target, delete to blank or the whole
    row (mode blank, exclude_row)."""

    header: str
    sources: tuple[str, ...]
    operation: str = "rename"
    target: str = ""
    mode: str = field(default="blank")


def convert(rows: DataFrame, maps: Sequence[ColumnMap], rules: Sequence[ValueRule] = (), layout: Sequence[str] | None = None) -> DataFrame:
    """One column for each target (of the layout, where given; empty where unmapped), values by
    the last rule that names them, rows left out where a rule says so."""
    made = {m.target: _converted(m) for m in maps}
    out = rows.select(*(made.get(h, F.lit("")).alias(h) for h in (layout or made)))
    excluded = F.lit(False)
    for header in dict.fromkeys(r.header for r in rules):
        own = [r for r in rules if r.header == header]
        last = {v: r for r in own for v in r.sources}
        new = {v: "" if r.operation == "delete" else r.target for v, r in last.items() if not (r.operation == "delete" and r.mode == "exclude_row")}
        gone = [v for v, r in last.items() if r.operation == "delete" and r.mode == "exclude_row"]
        if gone:
            excluded = excluded | F.col(header).isin(*gone)
        if new:
            terms = F.create_map(*(F.lit(x) for kv in new.items() for x in kv))
            out = out.withColumn(f"_{header}", F.coalesce(F.try_element_at(terms, F.col(header)), F.col(header)))
    kept = out.where(~excluded)
    columns = [c for c in out.columns if not c.startswith("_")]
    return kept.select(*(F.col(f"_{c}" if f"_{c}" in out.columns else c).alias(c) for c in columns))


def auto_map(columns: Sequence[str], headers: Sequence[str]) -> tuple[dict[str, str], list[str]]:
    """Columns that are headers, in any case and with outer spaces, and those that are none."""
    known = {h.lower(): h for h in headers}
    found = {c: known[c.strip().lower()] for c in columns if c.strip().lower() in known}
    return found, [c for c in columns if c not in found]


def union(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows with all columns, empty where a table lacks one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).fillna("")


def resolve(rows: DataFrame, ids: DataFrame, keys: dict[str, str], optional: Sequence[str] = ()) -> DataFrame:
    """Legacy ids to new ones: for each column -> entity type of ``keys`` a column new_<column>,
    and ``resolved``, which optional ones don't decide unless they are given."""
    out, ok = rows, F.lit(True)
    for column, entity in keys.items():
        own = ids.where(F.col("entity_type") == entity).select(F.col("legacy_id").alias(column), F.col("new_id").alias(f"new_{column}"))
        out = out.join(own, column, "left")
        there = F.col(f"new_{column}").isNotNull()
        ok = ok & (there | (F.coalesce(F.col(column), F.lit("")) == "") if column in optional else there)
    return out.withColumn("resolved", ok)


def unresolved(rows: DataFrame, ids: DataFrame, column: str, entity: str) -> DataFrame:
    """(column): distinct values without a new id."""
    own = ids.where(F.col("entity_type") == entity).select(F.col("legacy_id").alias(column))
    values = rows.select(text.strip(F.col(column)).alias(column)).where(F.col(column) != "").distinct()
    return values.join(own, column, "left_anti")


def validate(rows: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row: valid, invalid, and how many rows lack each required column."""
    empty = {c: F.coalesce(text.strip(F.col(c)), F.lit("")) == "" for c in required}
    bad = reduce(lambda a, b: a | b, empty.values())
    return rows.agg(F.count_if(~bad).alias("valid"), F.count_if(bad).alias("invalid"), *(F.count_if(e).alias(f"no_{c}") for c, e in empty.items()))


def _last(rows: DataFrame, key: str, order: str, payload: list[str]) -> DataFrame:
    """The last row of each key, by an aggregation that combines before the shuffle."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*payload), order).alias("row")).select(key, "row.*")


def record_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(marc_001, change, tags) between two states of records, by 001 (the last of equals):
    added, removed or changed, with the tags whose fields differ."""

    def flat(bibs: DataFrame, name: str) -> DataFrame:
        pairs = F.transform("fields", lambda f: F.struct(f["tag"].alias("tag"), F.when(f["tag"] == "001", text.strip(f["data"])).otherwise(rendered(f)).alias("text")))
        keyed = bibs.select(text.strip(first("001")).alias("marc_001"), "record_index", pairs.alias(name)).where(F.col("marc_001").isNotNull())
        return _last(keyed, "marc_001", "record_index", [name])

    both = flat(old, "before").join(flat(new, "after"), "marc_001", "full")
    none = F.array().cast("array<struct<tag:string,text:string>>")
    before, after = F.coalesce("before", none), F.coalesce("after", none)
    tags = F.array_sort(F.array_distinct(F.transform(F.concat(before, after), lambda p: p["tag"])))
    texts = lambda side, t: F.transform(F.filter(side, lambda p: p["tag"] == t), lambda p: p["text"])
    differ = F.filter(tags, lambda t: texts(before, t) != texts(after, t))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return both.select("marc_001", change.alias("change"), F.array_join(differ, ",").alias("tags")).where((F.col("change") != "changed") | (F.col("tags") != ""))


def row_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, column, before, after) of every differing cell; rows on one side only differ in all
    their non-empty cells."""
    columns = sorted((set(old.columns) | set(new.columns)) - {key})

    def cells(rows: DataFrame, name: str) -> DataFrame:
        have = [c for c in columns if c in rows.columns]
        pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)) for c in have)))
        return rows.select(key, pairs.alias("p")).select(key, "p.*")

    both = cells(old, "before").join(cells(new, "after"), [key, "column"], "full")
    return both.select(key, "column", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after")).where(F.col("before") != F.col("after"))


def change_counts(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row: keys added, removed, kept."""
    a = old.select(key).distinct().withColumn("old", F.lit(True))
    b = new.select(key).distinct().withColumn("new", F.lit(True))
    both = a.join(b, key, "full")
    return both.agg(F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("new").isNull()).alias("removed"), F.count_if(F.col("old") & F.col("new")).alias("kept"))


# ---- scripts for the target system


def circulation_script(rows: DataFrame) -> DataFrame:
    """(line): an INSERT for every resolved loan, a comment for others; the return date defaults
    to the issue date."""
    q = lambda c: F.concat(F.lit("'"), text.sql_double(F.col(c)), F.lit("'"))
    returned = F.when(F.coalesce(F.col("returndate"), F.lit("")) == "", q("issuedate")).otherwise(q("returndate"))
    values = F.concat_ws(", ", F.col("new_patron").cast("string"), F.col("new_item").cast("string"), q("issuedate"), returned, q("branchcode"))
    good = F.concat(F.lit("INSERT INTO old_issues (borrowernumber, itemnumber, issuedate, returndate, branchcode) VALUES ("), values, F.lit(");"))
    return rows.select(F.when(F.col("resolved"), good).otherwise(F.concat(F.lit("-- SKIPPED "), F.concat_ws(" ", "patron", "item"))).alias("line"))


#: Table and columns of the inserted values of each controlled header; a column takes so many
#: characters of the value, or what stands there (fixed values).
VALUE_TABLES = {
    "categorycode": ("categories", {"categorycode": 10, "description": 100, "category_type": "'A'", "enrolmentperiod": "99"}),
    "branchcode": ("branches", {"branchcode": 10, "branchname": 100}),
    "title": ("authorised_values", {"category": "'BOR_TITLES'", "authorised_value": 80, "lib": 200}),
    "lost": ("authorised_values", {"category": "'LOST'", "authorised_value": 80, "lib": 200}),
}


def value_script(counts: DataFrame) -> DataFrame:
    """(header, value, line): INSERT IGNORE for controlled values, with their counts."""
    out = F.lit(None).cast("string")
    cell = lambda x: F.concat(F.lit("'"), text.sql_escape(F.substring(text.strip(F.col("value")), 1, x)), F.lit("'")) if isinstance(x, int) else F.lit(x)
    for header, (name, cells) in VALUE_TABLES.items():
        values = F.concat_ws(", ", *(cell(x) for x in cells.values()))
        line = F.concat(F.lit(f"INSERT IGNORE INTO {name} ({', '.join(cells)}) VALUES ("), values, F.lit("); -- "), F.col("n").cast("string"))
        out = F.when(F.col("header") == header, line).otherwise(out)
    return counts.select("header", "value", out.alias("line")).where(F.col("line").isNotNull())
