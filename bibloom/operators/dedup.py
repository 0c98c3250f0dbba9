"""Duplicate records: match keys, clusters, survivors and merged holdings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibloom.functions import extract
from bibloom.functions.text import clean_isbn, normalize_text, oclc_number, strip
from bibloom.model import FIELDS

#: Rules by name: (spec, exact or normalised) of each field of the key (fixed values).
PRESETS = {"001": [("001", "exact")], "isbn": [("020$a", "normalised")], "title_author": [("245$a", "normalised"), ("100$a", "normalised")], "oclc": [("035$a", "exact")]}


def match_key(rule: Sequence[tuple[str, str]]) -> Column:
    """The values joined by two bars; null if any is missing."""
    parts: list[Column] = []
    for spec, kind in rule:
        v = extract.first(spec)
        if spec == "035$a":
            v = oclc_number(v)
        elif kind == "normalised":
            v = clean_isbn(v) if spec == "020$a" else normalize_text(v)
        else:
            v = strip(v)
        parts.append(F.when(v != "", v))
    whole = parts[0].isNotNull()
    for p in parts[1:]:
        whole = whole & p.isNotNull()
    return F.when(whole, F.concat_ws("||", *parts))


def keyed(bibs: DataFrame, rule: Sequence[tuple[str, str]]) -> DataFrame:
    """Records with match_key and the figures that survivors are chosen by."""
    items = F.size(F.filter("fields", lambda f: f["tag"] == "952"))
    return bibs.withColumns({"match_key": match_key(rule), "field_count": F.size("fields"), "item_count": items})


def clusters(bibs: DataFrame, rule: Sequence[tuple[str, str]], keep: str = "first", chosen: DataFrame | None = None) -> DataFrame:
    """(match_key, record_index, marc_001, field_count, item_count, survivor) of every record
    that shares its key. keep: first, most_fields or most_items; ties go to the first. ``chosen``
    (match_key, primary_index) overrides it."""
    rows = keyed(bibs, rule).where(F.col("match_key").isNotNull())
    rows = rows.select("match_key", "record_index", extract.first("001").alias("marc_001"), "field_count", "item_count")
    metric = {"first": F.lit(0), "most_fields": -F.col("field_count"), "most_items": -F.col("item_count")}[keep]
    # an aggregation, not a window: it combines before the shuffle however many share a key
    best = rows.groupBy("match_key").agg(F.min_by("record_index", F.struct(metric, "record_index")).alias("best"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    if chosen is not None:
        best = best.join(chosen, "match_key", "left").withColumn("best", F.coalesce("primary_index", "best"))
    found = rows.join(best.select("match_key", "best"), "match_key")
    return found.withColumn("survivor", F.col("record_index") == F.col("best")).drop("best")


def deduplicate(bibs: DataFrame, rule: Sequence[tuple[str, str]], keep: str = "first", merge_items: bool = False, chosen: DataFrame | None = None) -> DataFrame:
    """The records without duplicates. ``merge_items`` gives the survivor the 952 fields of the
    others, in their order."""
    found = clusters(bibs, rule, keep, chosen)
    out = bibs.join(found.where(~F.col("survivor")).select("record_index"), "record_index", "left_anti")
    if not merge_items:
        return out.select(bibs.columns)
    gone = found.where(~F.col("survivor")).select("match_key", "record_index")
    owners = found.where("survivor").select("match_key", F.col("record_index").alias("owner"))
    items = F.filter("fields", lambda f: f["tag"] == "952")
    donated = bibs.select("record_index", items.alias("items")).join(gone, "record_index").join(owners, "match_key")
    donated = donated.groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("record_index", "items"))).alias("d"))
    more = F.coalesce(F.flatten(F.col("d.items")), F.array().cast(FIELDS))
    joined = out.join(donated.withColumnRenamed("owner", "record_index"), "record_index", "left")
    return joined.withColumn("fields", F.concat("fields", more)).select(bibs.columns)
