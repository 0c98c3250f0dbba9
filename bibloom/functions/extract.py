"""Values of a record's fields by spec: ``TAG`` or ``TAG$code``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_spec(spec: str) -> tuple[str, str | None]:
    tag, _, code = spec.strip().partition("$")
    if len(tag) != 3 or len(code) > 1:
        raise ValueError(f"not a field spec: {spec!r}")
    return tag, code or None


def values(spec: str, fields: Column | str = "fields", keep_empty: bool = False) -> Column:
    """All values of a spec in order, as an array; a data field without code is its subfields'
    values joined by spaces."""
    tag, code = split_spec(spec)
    fields = F.col(fields) if isinstance(fields, str) else fields
    own = F.filter(fields, lambda f: f["tag"] == tag)
    if code:
        found = F.flatten(
            F.transform(own, lambda f: F.transform(F.filter(F.coalesce(f["subfields"], F.array()), lambda s: s["code"] == code), lambda s: s["value"]))
        )
    else:
        found = F.transform(own, lambda f: F.coalesce(f["data"], F.array_join(F.transform(f["subfields"], lambda s: s["value"]), " ")))
    return found if keep_empty else F.filter(found, lambda v: v.isNotNull() & (v != ""))


def joined(spec: str, fields: Column | str = "fields") -> Column:
    """All values joined by ``; ``; empty if there is none."""
    return F.array_join(values(spec, fields, keep_empty=True), "; ")


def first(spec: str, fields: Column | str = "fields", default: str | None = None) -> Column:
    found = F.get(values(spec, fields), 0)
    return found if default is None else F.coalesce(found, F.lit(default))


def has_tag(tag: str, fields: Column | str = "fields") -> Column:
    return F.exists(F.col(fields) if isinstance(fields, str) else fields, lambda f: f["tag"] == tag)
