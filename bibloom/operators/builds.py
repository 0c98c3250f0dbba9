"""Building output files: field maps, items, field order and duplicates as one plan.

Nothing is written between the steps; each is a projection or one join, so a build is a single
job however many of them take part.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibloom.functions import extract
from bibloom.model import once
from bibloom.operators import items, profile
from bibloom.operators.fieldmaps import FieldMap, apply_maps


@dataclass(frozen=True)
class ItemJoin:
    """Item rows, their key column and order, and what the key is compared with."""

    rows: DataFrame
    key: str
    order: Sequence[str]
    match_spec: str = "001"
    mapping: dict[str, str] | None = None
    constants: dict[str, str] = field(default_factory=dict)

    def attach(self, bibs: DataFrame) -> DataFrame:
        return items.attach_items(bibs, self.rows, self.key, self.order, self.match_spec, self.mapping, self.constants, need_001=True)


def sound(maps: Sequence[FieldMap]) -> list[FieldMap]:
    """The rules without problems; a build leaves the others out."""
    return [m for m in maps if not m.problems()]


def sort_records(bibs: DataFrame) -> DataFrame:
    return bibs.withColumn("fields", once(items.sorted_fields()))


def transform(bibs: DataFrame, maps: Sequence[FieldMap]) -> DataFrame:
    """Records of any files with the sound rules applied and their fields in order; file_id and
    record_index stay, so each file can be written by itself."""
    return sort_records(apply_maps(bibs, sound(maps)))


def missing_tags(bibs: DataFrame, maps: Sequence[FieldMap]) -> DataFrame:
    """(file_id, tag): source tags of the rules that the first record of a file lacks."""
    expected = sorted({m.source for m in sound(maps) if m.kind != "const"})
    # a number for each file, not tags of records, which an aggregation would have to sort
    first = bibs.groupBy("file_id").agg(F.min("record_index").alias("record_index"))
    found = bibs.join(F.broadcast(first), ["file_id", "record_index"])
    lacking = F.array_except(F.array(*(F.lit(t) for t in expected)), F.transform("fields", lambda f: f["tag"]))
    return found.select("file_id", F.explode(lacking).alias("tag"))


def merge(files: Sequence[DataFrame], join: ItemJoin | None = None) -> DataFrame:
    """The records of all files in their order, with items, fields in order; records that share a
    001 all stay (``duplicates`` names them)."""
    both = items.union_files(files)
    return sort_records(join.attach(both) if join else both)


def build(files: Sequence[DataFrame], maps: Sequence[FieldMap] = (), join: ItemJoin | None = None) -> DataFrame:
    """Union, sound field maps, items and field order in one plan. Without rules records pass
    as they are; records without a 001 get no items. A further column n_joined counts the items
    that were added to a record."""
    mapped = apply_maps(items.union_files(files), sound(maps))
    holdings = F.size(F.filter("fields", lambda f: f["tag"] == "952"))
    before = mapped.withColumn("_before", holdings)
    joined = join.attach(before) if join else before
    counted = joined.withColumn("n_joined", holdings - F.col("_before")).drop("_before")
    return sort_records(counted)


def duplicates(built: DataFrame) -> DataFrame:
    """(value, n) of the control numbers that several records have."""
    return profile.duplicates(built, "001")


def summary(built: DataFrame) -> DataFrame:
    """One row: total_records, items_joined, without_001."""
    total = F.coalesce(F.sum("n_joined"), F.lit(0)).alias("items_joined")
    return built.agg(F.count(F.lit(1)).alias("total_records"), total, F.count_if(~extract.has_tag("001")).alias("without_001"))
