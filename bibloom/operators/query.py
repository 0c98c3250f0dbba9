"""Queries over field specs: selection, conditions, order and limit, as DataFrame operations.

There is no query text of its own: conditions are tuples, and ``view`` gives Spark SQL a table
with one column for each spec. Comparisons ignore case and outer spaces; a repeated value is
compared as all of them joined by ``; ``.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibloom.functions import extract
from bibloom.functions.text import java_pattern, strip


class Condition(NamedTuple):
    """``logic`` (and, or) joins a condition to all before it, from left to right."""

    spec: str
    operator: str
    value: str | None = None
    logic: str = "and"



def test(spec: str, operator: str, value: str | None = None) -> Column:
    """A condition on a record as a boolean column."""
    v = F.lower(strip(extract.joined(spec)))
    w = F.lit((value or "").strip().lower())
    op = " ".join(operator.lower().split())
    if op in (">", "<", ">=", "<="):
        # as numbers where both are, else as text
        x, y = v.try_cast("double"), w.try_cast("double")
        pairs = {">": (x > y, v > w), "<": (x < y, v < w), ">=": (x >= y, v >= w), "<=": (x <= y, v <= w)}
        number, text = pairs[op]
        return F.when(x.isNotNull() & y.isNotNull(), number).otherwise(text)
    tests = {
        "=": lambda: v == w,
        "!=": lambda: v != w,
        "<>": lambda: v != w,
        "contains": lambda: v.contains(w),
        "not contains": lambda: ~v.contains(w),
        "like": lambda: v.like((value or "").strip().lower()),
        "not like": lambda: ~v.like((value or "").strip().lower()),
        "starts with": lambda: v.startswith(w),
        "exists": lambda: v != "",
        "missing": lambda: v == "",
        "not exists": lambda: v == "",
    }
    if op not in tests:
        raise ValueError(f"unknown operator {operator!r}")
    return tests[op]()


def where(conditions: Sequence[Condition]) -> Column:
    """All conditions, joined strictly from left to right; none is true."""
    out: Column | None = None
    for c in map(lambda c: Condition(*c), conditions):
        one = test(c.spec, c.operator, c.value)
        out = one if out is None else out | one if c.logic.lower() == "or" else out & one
    return F.lit(True) if out is None else out


def select(
    bibs: DataFrame,
    specs: Sequence[str],
    conditions: Sequence[Condition] = (),
    order_by: str | None = None,
    descending: bool = False,
    limit: int | None = None,
    limit_first: bool = False,
) -> DataFrame:
    """record_index and one column for each spec of the records that meet the conditions.

    Sorting ignores case, with the record index for ties, so a limit is the same each time; it
    becomes a top-k. ``limit_first`` takes the first records in scan order and sorts these.
    """
    found = bibs.where(where(conditions))
    if limit_first and limit is not None:
        found = found.orderBy("record_index").limit(limit)
    key = F.lower(extract.joined(order_by)) if order_by else None
    columns = [F.col("record_index"), *(extract.joined(s).alias(s) for s in specs)]
    if key is None:
        out = found.select(*columns)
        return out.orderBy("record_index").limit(limit) if limit is not None and not limit_first else out
    out = found.select(*columns, key.alias("_key")).orderBy(F.col("_key").desc() if descending else F.col("_key").asc(), "record_index")
    return (out.limit(limit) if limit is not None and not limit_first else out).drop("_key")


def view(bibs: DataFrame, specs: Sequence[str]) -> DataFrame:
    """A flat table of the specs whose columns compare without regard to case, for Spark SQL."""
    return bibs.select("record_index", *(strip(extract.joined(s)).cast("string collate UTF8_LCASE").alias(s) for s in specs))


def criteria(rules: Sequence[dict], logic: str = "all") -> Column:
    """A filter of rules {tag, subfield, operator, value}: all or any of them. ``regex`` keeps
    case; unknown operators are false; no rules are true."""
    tests: list[Column] = []
    for r in rules:
        spec = r["tag"] + (f"${r['subfield']}" if r.get("subfield") else "")
        op = {"equals": "=", "not_contains": "not contains", "starts_with": "starts with"}.get(r["operator"], r["operator"])
        if op == "regex":
            tests.append(extract.joined(spec).rlike(java_pattern(r.get("value") or "")))
        elif op in ("=", "contains", "not contains", "starts with", "exists", "missing"):
            tests.append(test(spec, op, r.get("value")))
        else:
            tests.append(F.lit(False))
    if not tests:
        return F.lit(True)
    out = tests[0]
    for one in tests[1:]:
        out = out & one if logic == "all" else out | one
    return out


def first_record_specs(bibs: DataFrame, conditions: Sequence[Condition] = (), most: int = 50) -> list[str]:
    """The specs of the first record that meets the conditions: control tags, and the subfields
    of the first field of each tag. One row comes to the driver."""
    row = bibs.where(where(conditions)).orderBy("record_index").limit(1).first()
    specs: list[str] = []
    seen: set[str] = set()
    for f in row["fields"] if row else []:
        if f["tag"] in seen:
            continue
        seen.add(f["tag"])
        specs += [f["tag"]] if f["subfields"] is None else list(dict.fromkeys(f"{f['tag']}${s['code']}" for s in f["subfields"]))
    return specs[:most]
