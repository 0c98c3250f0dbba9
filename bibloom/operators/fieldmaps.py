"""Declarative field maps: building target fields from source fields."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibloom.functions.text import lookup, preset, substitute
from bibloom.model import FIELDS, control, datafield, once, subfield


@dataclass(frozen=True)
class FieldMap:
    """One rule. kind: copy, const, regex (s/a/b/g), lookup, preset, or function (a column
    function, which is how plugins take part)."""

    source: str
    target: str
    source_code: str | None = None
    target_code: str | None = None
    kind: str = "copy"
    argument: str | dict | Callable[[Column], Column] | None = None
    delete_source: bool = field(default=False, compare=False)

    def problems(self) -> list[str]:
        out = []
        for tag in (self.target,) if self.kind == "const" else (self.source, self.target):
            if len(tag) != 3 or not tag.isdigit():
                out.append(f"{tag!r} is no tag")
        if self.kind not in ("copy", "const", "regex", "lookup", "preset", "function"):
            out.append(f"unknown kind {self.kind!r}")
        elif self.kind != "copy" and self.argument is None:
            out.append(f"{self.kind} needs an argument")
        return out

    def convert(self, v: Column) -> Column:
        makers = {"copy": lambda a: lambda x: x, "regex": substitute, "lookup": lookup, "preset": preset, "function": lambda a: a}
        return makers[self.kind](self.argument)(v)


def _no_fields() -> Column:
    return F.array().cast(FIELDS)


def _source_values(m: FieldMap, f: Column) -> Column:
    if m.source < "010":
        return F.array(F.coalesce(f["data"], F.lit("")))
    if m.source_code:
        return F.transform(F.filter(f["subfields"], lambda s: s["code"] == m.source_code), lambda s: s["value"])
    return F.array(F.array_join(F.transform(f["subfields"], lambda s: s["value"]), " "))


def _apply_group(fields: Column, maps: Sequence[FieldMap]) -> Column:
    """Maps of one source and target: each source field makes one target field of all values."""
    source, target = maps[0].source, maps[0].target
    own = F.filter(fields, lambda f: f["tag"] == source)

    def build(f: Column) -> Column:
        return F.flatten(F.array(*(_converted(m, f) for m in maps)))

    made = F.filter(F.transform(own, build), lambda subs: F.size(subs) > 0)
    if target < "010":
        value = F.get(F.get(made, 0), 0)["value"]
        rest = F.filter(fields, lambda f: f["tag"] != target)
        return F.when(F.size(made) > 0, F.concat(rest, F.array(control(target, value)).cast(FIELDS))).otherwise(fields)
    return F.concat(fields, F.transform(made, lambda subs: datafield(target, subs)).cast(FIELDS))


def _converted(m: FieldMap, f: Column) -> Column:
    values = F.filter(_source_values(m, f), lambda v: v.isNotNull() & (v != ""))
    return F.transform(values, lambda v: subfield(m.target_code or "a", m.convert(v)))


def set_value(fields: Column, tag: str, code: str | None, value: str) -> Column:
    """A constant: control fields are overwritten or made; with a code it is added to the first
    field of the tag or makes one; without, it makes a new field with $a."""
    if tag < "010":
        return F.concat(F.filter(fields, lambda f: f["tag"] != tag), F.array(control(tag, value)).cast(FIELDS))
    new = F.array(datafield(tag, F.array(subfield(code or "a", F.lit(value))))).cast(FIELDS)
    if code is None:
        return F.concat(fields, new)
    at = F.array_position(F.transform(fields, lambda f: f["tag"]), tag)
    added = F.transform(
        fields,
        lambda f, i: F.when(i + 1 == at, f.withField("subfields", F.concat(f["subfields"], F.array(subfield(code, F.lit(value)))))).otherwise(f),
    )
    return F.when(at > 0, added).otherwise(F.concat(fields, new))


def apply_maps(bibs: DataFrame, maps: Sequence[FieldMap]) -> DataFrame:
    """Apply rules group by group of equal source and target, in order of first appearance, so
    that later ones see earlier results; then constants; then deletion of moved sources.

    Each group is one projection, made once: a filter on the result isn't moved below it, where it would
    do the work of all groups again. Rules with problems raise.
    """
    bad = [p for m in maps for p in m.problems()]
    if bad:
        raise ValueError("; ".join(bad))
    groups: dict[tuple[str, str], list[FieldMap]] = {}
    for m in maps:
        if m.kind != "const":
            groups.setdefault((m.source, m.target), []).append(m)
    for group in groups.values():
        bibs = bibs.withColumn("fields", once(_apply_group(F.col("fields"), group)))
    for m in maps:
        if m.kind == "const":
            bibs = bibs.withColumn("fields", once(set_value(F.col("fields"), m.target, m.target_code, str(m.argument))))
    gone = sorted({m.source for m in maps if m.delete_source and m.source != m.target})
    return bibs.withColumn("fields", once(F.filter("fields", lambda f: ~f["tag"].isin(*gone)))) if gone else bibs


def map_statistics(bibs: DataFrame, maps: Sequence[FieldMap]) -> DataFrame:
    """(rule, applied, skipped): source fields with a value for each rule, and records without."""
    def applied(m: FieldMap) -> Column:
        own = F.filter("fields", lambda f: f["tag"] == m.source)
        return F.size(F.filter(F.transform(own, lambda f: F.size(F.filter(_source_values(m, f), lambda v: v != ""))), lambda n: n > 0))

    each = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), (F.lit(1) if m.kind == "const" else applied(m)).alias("n")) for k, m in enumerate(maps))))
    flat = bibs.select(each.alias("e")).select("e.*")
    return flat.groupBy("rule").agg(F.sum("n").alias("applied"), F.count_if(F.col("n") == 0).alias("skipped"))
