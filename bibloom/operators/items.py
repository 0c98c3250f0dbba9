"""Joining item rows to records as holdings fields, and merging record files."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bibloom.functions import extract
from bibloom.functions.text import strip
from bibloom.model import FIELDS, datafield, once, subfield

#: Item columns (in lower case) and the subfield each goes to (fixed values of the format).
ITEM_COLUMNS = {
    "homebranch": "a", "holdingbranch": "b", "location": "c", "callnumber": "o", "barcode": "p", "itype": "y", "itemtype": "y",
    "ccode": "8", "notforloan": "7", "damaged": "4", "itemlost": "1", "withdrawn": "0", "copynumber": "t", "enumchron": "h", "itemnotes": "z",
}


def _subfields(columns: Sequence[str], mapping: dict[str, str] | None, constants: dict[str, str] | None, cell: Callable[[str], Column] = F.col) -> Column:
    """Trimmed values (``cell`` gives a column's), empty ones too, then constants."""
    pairs = [(c, mapping[c]) for c in columns if c in mapping] if mapping else [(c, ITEM_COLUMNS[c.lower()]) for c in columns if c.lower() in ITEM_COLUMNS]
    subs = [subfield(code, strip(cell(c).cast("string"))) for c, code in pairs]
    subs += [subfield(code, F.lit(value)) for code, value in (constants or {}).items()]
    return F.array(*subs) if subs else F.array().cast("array<struct<code:string,value:string>>")


def _field(subfields: Column) -> Column:
    """The 952 field of the subfields that aren't empty, null if none; they are bound by a lambda, so
    that they are made once."""
    kept = F.filter(subfields, lambda s: s["value"] != "")
    return F.get(F.transform(F.array(kept), lambda k: F.when(F.size(k) > 0, datafield("952", k))), F.lit(0))


def item_field(columns: Sequence[str], mapping: dict[str, str] | None = None, constants: dict[str, str] | None = None) -> Column:
    """An item row as a field: trimmed values that aren't empty, then constants; null if none.

    A mapping of one's own names columns exactly, the default one in any case."""
    return _field(_subfields(columns, mapping, constants))


def attach_items(bibs: DataFrame, items: DataFrame, key: str, order: Sequence[str], match_spec: str = "001", mapping: dict[str, str] | None = None, constants: dict[str, str] | None = None, need_001: bool = False) -> DataFrame:
    """Append to each record one 952 field for every item whose key is among the record's match
    values: values in their order, items of one value in the given order.

    Keys and plain item columns are shuffled to each other, each column once; fields are made of
    them after that, a record's own join its collected items by record index. Records without items
    stay as they are.
    """
    columns = [c for c in items.columns if c != key]
    used = [c for c in columns if c in mapping] if mapping else [c for c in columns if c.lower() in ITEM_COLUMNS]
    # an item without any value makes no field
    some = F.lit(any((constants or {}).values()))
    for c in used:
        some = some | F.coalesce(strip(F.col(c).cast("string")) != "", F.lit(False))
    names = {c: f"c{k}" for k, c in enumerate(dict.fromkeys([*used, *order]))}
    row = F.struct(*(F.col(c).alias(name) for c, name in names.items()))
    rows = items.where(some).select(once(strip(F.col(key).cast("string"))).alias("_key"), row.alias("_row")).where(F.col("_key") != "")
    probed = bibs.where(extract.has_tag("001")) if need_001 else bibs
    keys = probed.select("file_id", "record_index", F.posexplode_outer(F.transform(extract.values(match_spec), strip)).alias("_nth", "_key"))
    found = keys.join(rows, "_key").groupBy("file_id", "record_index").agg(F.collect_list(F.struct("_nth", "_row")).alias("_found"))

    def built(x: Column) -> Column:
        cell = lambda c: x["_row"][names[c]]
        own = _field(_subfields(used, mapping, constants, cell))
        return F.struct(x["_nth"].alias("_nth"), F.struct(*(cell(c).alias(names[c]) for c in dict.fromkeys(order))).alias("_order"), own.alias("_item"))

    joined = bibs.join(found, ["file_id", "record_index"], "left")
    joined = joined.withColumn("_found", once(F.sort_array(F.transform("_found", built))))
    more = F.coalesce(F.col("_found._item"), F.array().cast(FIELDS))
    return joined.withColumn("fields", once(F.concat("fields", more))).drop("_found")


#: Codes, joined by commas, that are a digit or small letter each: their plain order is the wanted one.
_PLAIN_CODES = "^[0-9a-z](?:,[0-9a-z])*+$"


def sorted_fields(fields: Column | str = "fields") -> Column:
    """Fields by tag and each one's subfields digits first, then letters in any case, then
    others; both sorts keep the order of equals."""
    fields = F.col(fields) if isinstance(fields, str) else fields

    def by_code(f: Column) -> Column:
        code = lambda s: F.coalesce(s["code"], F.lit(""))

        def rank(s: Column) -> Column:
            c = F.lower(F.substring(code(s), 1, 1))
            plain = F.when(c == "", 3).when(c.between("0", "9"), 0).when(c.between("a", "z"), 1).when(c < "\x80", 2)
            return plain.when(c.rlike(r"\p{L}"), 1).otherwise(2)  # patterns only for what isn't ASCII

        some = f["subfields"]
        keyed = F.transform(some, lambda s, i: F.struct(rank(s), F.lower(code(s)), i, s.alias("s")))
        short = F.transform(some, lambda s, i: F.struct(s["code"], i, s.alias("s")))
        listed = F.array_join(some["code"], ",")  # without nulls, so the length tells of them
        plain = listed.rlike(_PLAIN_CODES) & (F.octet_length(listed) == 2 * F.size(some) - 1)
        inner = lambda k: k["s"]
        return f.withField("subfields", F.when(plain, F.transform(F.sort_array(short), inner)).otherwise(F.transform(F.sort_array(keyed), inner)))

    keyed = F.transform(fields, lambda f, i: F.struct(f["tag"].alias("tag"), i.alias("i"), by_code(f).alias("f")))
    return F.transform(F.sort_array(keyed), lambda k: k["f"])  # no two have one tag and place


def union_files(files: Sequence[DataFrame]) -> DataFrame:
    """All records in the order of the files, with new record indices; counts come from one small
    aggregation, not from a sort of everything."""
    tagged = reduce(DataFrame.unionByName, [f.withColumn("_file", F.lit(k)) for k, f in enumerate(files)])
    counts = tagged.groupBy("_file").agg(F.max("record_index").alias("m"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_file", F.coalesce(F.sum(F.col("m") + 1).over(before), F.lit(0)).alias("_offset"))
    return tagged.join(F.broadcast(offsets), "_file").withColumn("record_index", F.col("record_index") + F.col("_offset")).drop("_file", "_offset")


def first_by(bibs: DataFrame, spec: str = "001") -> DataFrame:
    """The first record of each value; records without one all stay."""
    key = extract.first(spec)
    named = bibs.withColumn("_key", key)
    firsts = named.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.min("record_index").alias("record_index"))
    kept = named.join(firsts, ["_key", "record_index"], "left_semi").drop("_key")
    return kept.unionByName(named.where(F.col("_key").isNull()).drop("_key"))
