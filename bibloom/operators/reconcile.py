"""Reconciling controlled values by rules, in records and in tables."""

from __future__ import annotations

import json
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibloom.functions.text import java_pattern, strip
from bibloom.model import FIELDS, SUBFIELD, once


@dataclass(frozen=True)
class Case:
    """One case of a split: the same field has another subfield of this value (same_field), a
    field has a value (other_field), the value matches (regex), or always (default)."""

    kind: str
    target: str
    code: str | None = None
    tag: str | None = None
    value: str | None = None


@dataclass(frozen=True)
class Rule:
    """operation: rename or merge (to target), split (cases), delete (mode subfield or field)."""

    code: str
    sources: tuple[str, ...]
    operation: str = "rename"
    target: str | None = None
    cases: tuple[Case, ...] = field(default=())
    mode: str = "subfield"


def _split(cases: Sequence[Case], v: Column, f: Column, fields: Column) -> Column:
    out: Column | None = None
    for c in cases:
        if c.kind == "same_field":
            test = _field_has(f, c.code, c.value)
        elif c.kind == "other_field":
            test = _record_has(fields, c.tag, c.code, c.value)
        elif c.kind == "regex":
            test = v.rlike(java_pattern(c.value or ""))
        else:
            test = F.lit(True)
        out = F.when(test, F.lit(c.target)) if out is None else out.when(test, F.lit(c.target))
    return F.coalesce(out, v) if out is not None else v


def _field_has(f: Column, code: str | None, value: str | None) -> Column:
    return F.exists(F.coalesce(f["subfields"], F.array()), lambda s: (s["code"] == code) & (strip(s["value"]) == value))


def _record_has(fields: Column, tag: str | None, code: str | None, value: str | None) -> Column:
    return F.exists(fields, lambda f: (f["tag"] == tag) & (_field_has(f, code, value) if code else strip(F.coalesce(f["data"], F.lit(""))) == value))


_SEPARATOR = "\x1f"
_ENTRY = "struct<code:string,value:string,operation:string,target:string,split:int>"


def _rule_table(rules: Sequence[Rule]) -> tuple[Column, int, list[Rule]]:
    """The last rule of each code and value, in buckets by their checksum; the number of buckets; the
    rules that split, which an entry names by number.

    The buckets are one constant of the plan, read from JSON when the plan is made: a look-up reads
    one bucket of an entry or so, however many rules there are.
    """
    last = {(r.code, v): r for r in rules for v in r.sources}
    splits = list(dict.fromkeys(r for r in last.values() if r.operation == "split"))
    n = max(1, 2 * len(last))
    buckets: list[list[dict]] = [[] for _ in range(n)]
    for (code, v), r in last.items():
        kind = f"delete {r.mode}" if r.operation == "delete" else "split" if r.operation == "split" else "set"
        entry = {"code": code, "value": v, "operation": kind, "target": r.target, "split": splits.index(r) if kind == "split" else None}
        buckets[zlib.crc32(f"{code}{_SEPARATOR}{v}".encode()) % n].append(entry)
    return F.from_json(F.lit(json.dumps(buckets)), f"array<array<{_ENTRY}>>"), n, splits


def apply_rules(bibs: DataFrame, rules: Sequence[Rule], tag: str = "952") -> DataFrame:
    """Item fields with their values reconciled: each subfield by the last rule that names its
    code and trimmed value. Rules are data, not expressions, but for the cases of splits."""
    table, n, splits = _rule_table(rules)
    codes = sorted({r.code for r in rules})

    def rule(s: Column) -> Column:
        value = strip(s["value"])
        place = F.pmod(F.crc32(F.concat(s["code"], F.lit(_SEPARATOR), value)), F.lit(n)).cast("int")
        found = F.get(F.filter(F.get(table, place), lambda e: (e["code"] == s["code"]) & (e["value"] == value)), F.lit(0))
        return F.when(s["code"].isin(*codes), found)  # no checksums of subfields that no rule is about

    def new_value(s: Column, r: Column, f: Column) -> Column:
        out = F.when(r["operation"] == "set", r["target"])
        for k, split in enumerate(splits):
            out = out.when(r["split"] == k, _split(split.cases, s["value"], f, F.col("fields")))
        return out.otherwise(s["value"])

    def told(f: Column) -> Column:
        found = F.transform(F.coalesce(f["subfields"], F.array().cast(f"array<{SUBFIELD}>")), lambda s: F.struct(s.alias("s"), rule(s).alias("r")))
        return F.struct(f.alias("f"), F.when(f["tag"] == tag, found).alias("told"))

    def changed(x: Column) -> Column:
        kept = F.filter(x["told"], lambda y: ~y["r"]["operation"].eqNullSafe(F.lit("delete subfield")))
        subfields = F.transform(kept, lambda y: y["s"].withField("value", new_value(y["s"], y["r"], x["f"])))
        return F.when(x["told"].isNull() | x["f"]["subfields"].isNull(), x["f"]).otherwise(x["f"].withField("subfields", subfields))

    gone = lambda x: F.exists(F.coalesce(x["told"], F.array()), lambda y: y["r"]["operation"].eqNullSafe(F.lit("delete field")))
    return bibs.withColumn("fields", once(F.transform(F.filter(F.transform("fields", told), lambda x: ~gone(x)), changed).cast(FIELDS)))


def coverage(values: DataFrame, rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., n, covered): whether scanned values have a rule; ``rules`` has the keys."""
    named = rules.select(*keys).distinct().withColumn("covered", F.lit(True))
    return values.join(named, [*keys], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def needed(scans: Sequence[DataFrame], known: DataFrame) -> DataFrame:
    """(value, n) over all scans of values that the target doesn't know yet, the commonest first."""
    both = scans[0].select("value", "n")
    for s in scans[1:]:
        both = both.unionByName(s.select("value", "n"))
    sums = both.groupBy("value").agg(F.sum("n").alias("n"))
    return sums.join(known.select("value").distinct(), "value", "left_anti").orderBy(F.col("n").desc(), "value")
