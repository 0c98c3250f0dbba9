"""Looking into record files: samples, single records, pages and previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibloom.functions import extract
from bibloom.functions.text import strip
from bibloom.model import is_control, rendered
from bibloom.operators.profile import VOCABULARY


def record_at(bibs: DataFrame, record_index: int) -> DataFrame:
    """The record with an index: a filter, which reaches the file where the index is stored."""
    return bibs.where(F.col("record_index") == record_index)


def page(rows: DataFrame, order: Sequence[str], offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit in an order that should be total; a top-k of both together."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def first_records(bibs: DataFrame, n: int, titled: bool = False) -> DataFrame:
    """The first records by index; only those with a title where asked for."""
    found = bibs.where(extract.has_tag("245")) if titled else bibs
    return found.orderBy("record_index").limit(n)


def stratified_sample(bibs: DataFrame, first: int, more: int, scan: int, seed: int = 0) -> DataFrame:
    """The first titled records, and as many more drawn from the next ones up to ``scan``, with
    their place in column stratum (first, drawn). The draw orders by a seeded hash of the index, so
    it is the same each time and needs no pass of its own."""
    pool = first_records(bibs, scan, titled=True)
    head = pool.orderBy("record_index").limit(first).withColumn("stratum", F.lit("first"))
    rest = pool.orderBy("record_index").offset(first)
    drawn = rest.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("record_index").cast("string"))), "record_index").limit(more)
    return head.unionByName(drawn.withColumn("stratum", F.lit("drawn")))


def with_item_value(bibs: DataFrame, category: str, value: str, most: int = 5) -> DataFrame:
    """The first records one of whose items has a value of a vocabulary, trimmed."""
    if category not in VOCABULARY:
        raise ValueError(f"unknown vocabulary {category!r}")
    code = VOCABULARY[category]
    has = lambda f: (f["tag"] == "952") & F.exists(F.coalesce(f["subfields"], F.array()), lambda s: (s["code"] == code) & (strip(s["value"]) == value))
    return bibs.where(F.exists("fields", has)).orderBy("record_index").limit(most)


def compact_text(bibs: DataFrame, number: str = "record_index") -> DataFrame:
    """(record_index, text): a heading, the leader and a line for each field, for reading."""
    line = lambda f: F.concat(F.lit("="), f["tag"], F.lit("  "), rendered(f))
    head = F.concat(F.lit("--- Record "), F.col(number).cast("string"), F.lit(" ---"))
    return bibs.select("record_index", F.concat_ws("\n", head, F.concat(F.lit("=LDR  "), F.coalesce("leader", F.lit(""))), F.transform("fields", line)).alias("text"))


def strings_by_tag(bibs: DataFrame) -> DataFrame:
    """(record_index, tag, texts): each tag's fields as text in order, the 001 trimmed; what two
    versions of a record are compared by."""
    text = lambda f: F.when(f["tag"] == "001", strip(f["data"])).otherwise(rendered(f))
    tags = F.array_distinct(F.transform("fields", lambda f: f["tag"]))
    each = F.transform(tags, lambda t: F.struct(t.alias("tag"), F.transform(F.filter("fields", lambda f: f["tag"] == t), text).alias("texts")))
    return bibs.select("record_index", F.explode(each).alias("e")).select("record_index", "e.*")


def flattened(bibs: DataFrame) -> DataFrame:
    """(file_id, record_index, cells): a map from TAG or TAG$code to the last value of that name."""
    pairs = F.transform(
        "fields",
        lambda f: F.when(is_control(f), F.array(F.struct(f["tag"].alias("k"), F.coalesce(f["data"], F.lit("")).alias("v")))).otherwise(
            F.transform(f["subfields"], lambda s: F.struct(F.concat(f["tag"], F.lit("$"), s["code"]).alias("k"), F.coalesce(s["value"], F.lit("")).alias("v")))
        ),
    )
    rows = bibs.select("file_id", "record_index", F.flatten(pairs).alias("p"))
    names = F.array_distinct(F.transform("p", lambda x: x["k"]))
    last = lambda k: F.element_at(F.filter("p", lambda x: x["k"] == k), -1)["v"]
    return rows.select("file_id", "record_index", F.map_from_arrays(names, F.transform(names, last)).alias("cells"))


def cell(name: str, cells: str = "cells") -> Column:
    return F.coalesce(F.try_element_at(cells, F.lit(name)), F.lit(""))


def items_of(bibs: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Item rows of a record file: the trimmed key and the named cells as columns; rows without
    a key are left out."""
    flat = flattened(bibs).select(strip(cell(key)).alias("key"), *(cell(c).alias(c) for c in columns))
    return flat.where(F.col("key") != "")


#: Column of each field of a patron record (fixed values of such files).
PATRON_TAGS = {
    "001": "patron_id", "100$a": "surname", "100$b": "firstname", "270$a": "address", "270$b": "city",
    "270$c": "state", "270$e": "zipcode", "270$k": "email", "270$m": "phone",
}


def patrons_of(bibs: DataFrame, tags: dict[str, str] | None = None) -> DataFrame:
    """A row for each patron record: the first value that isn't empty of each spec, trimmed;
    empty where there is none. Records without any of them are left out."""
    tags = tags or PATRON_TAGS
    rows = bibs.select(*(extract.first(spec).alias(f"_{k}") for k, spec in enumerate(tags)))
    some = F.coalesce(*(F.col(c) for c in rows.columns)).isNotNull()
    return rows.where(some).select(*(F.coalesce(strip(F.col(f"_{k}")), F.lit("")).alias(name) for k, name in enumerate(tags.values())))


def harvest_page(bibs: DataFrame, offset: int = 0, size: int = 100) -> DataFrame:
    """(record_index, identifier, resumption_token) of a page of a harvest: the control number or
    the index, and, on every row, where the next page begins (null on the last)."""
    rows = bibs.where(F.col("record_index") >= offset).orderBy("record_index").limit(size + 1)
    more = rows.agg(F.count(F.lit(1)) > size).scalar()
    here = rows.orderBy("record_index").limit(size)
    identifier = F.coalesce(extract.first("001"), F.col("record_index").cast("string"))
    return here.select("record_index", identifier.alias("identifier"), F.when(more, F.lit(str(offset + size))).alias("resumption_token"))
