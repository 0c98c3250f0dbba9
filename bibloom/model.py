"""The bibliographic record as a DataFrame row, and its flat form.

A record has a leader and an ordered array of fields; tags and subfield codes may repeat and
their order counts. Control fields (tags below 010) have data, the others subfields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUBFIELD = "struct<code:string,value:string>"
FIELD = f"struct<tag:string,ind1:string,ind2:string,data:string,subfields:array<{SUBFIELD}>>"
FIELDS = f"array<{FIELD}>"
BIB_SCHEMA = f"file_id string, record_index bigint, leader string, fields {FIELDS}"


def _column(x: Column | str | None) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def once(x: Column) -> Column:
    """The same values, computed in one place: Catalyst neither moves filters through an
    expression that isn't deterministic nor puts it in the place of its mentions."""
    return F.when(F.spark_partition_id() >= 0, x)


def subfield(code: Column | str, value: Column | str | None) -> Column:
    return F.struct(_column(code).cast("string").alias("code"), _column(value).cast("string").alias("value"))


def control(tag: Column | str, data: Column | str) -> Column:
    return F.struct(
        _column(tag).alias("tag"),
        F.lit(None).cast("string").alias("ind1"),
        F.lit(None).cast("string").alias("ind2"),
        _column(data).cast("string").alias("data"),
        F.lit(None).cast(f"array<{SUBFIELD}>").alias("subfields"),
    )


def datafield(tag: Column | str, subfields: Column, ind1: Column | str = " ", ind2: Column | str = " ") -> Column:
    return F.struct(
        _column(tag).alias("tag"),
        _column(ind1).cast("string").alias("ind1"),
        _column(ind2).cast("string").alias("ind2"),
        F.lit(None).cast("string").alias("data"),
        subfields.cast(f"array<{SUBFIELD}>").alias("subfields"),
    )


def fields(*some: Column) -> Column:
    """An array of fields; null ones are left out."""
    return F.array_compact(F.array(*(f.cast(FIELD) for f in some)))


def is_control(field: Column) -> Column:
    return field["tag"] < "010"


def to_long(bibs: DataFrame) -> DataFrame:
    """One row for each subfield (or control field): file_id, record_index, field_pos, tag, ind1,
    ind2, is_control, sub_pos, code (null for control fields), value."""
    # outer: an inner explode makes Catalyst filter on the array first, which computes it twice
    one = bibs.select("file_id", "record_index", F.posexplode_outer("fields").alias("field_pos", "f")).where(F.col("f").isNotNull())
    sub = F.when(is_control(F.col("f")), F.array(subfield(F.lit(None), F.col("f.data")))).otherwise(F.col("f.subfields"))
    one = one.select("*", F.posexplode_outer(sub).alias("sub_pos", "s")).where(F.col("s").isNotNull())
    return one.select(
        "file_id",
        "record_index",
        "field_pos",
        F.col("f.tag").alias("tag"),
        F.col("f.ind1").alias("ind1"),
        F.col("f.ind2").alias("ind2"),
        is_control(F.col("f")).alias("is_control"),
        "sub_pos",
        F.col("s.code").alias("code"),
        F.col("s.value").alias("value"),
    )


def rendered(field: Column) -> Column:
    """A field as text: control data, or indicators and subfields with their codes."""
    subs = F.array_join(F.transform(field["subfields"], lambda s: F.concat(F.lit("$"), s["code"], s["value"])), "")
    return F.when(is_control(field), field["data"]).otherwise(F.concat(field["ind1"], field["ind2"], subs))


def each_field(bibs: DataFrame, tag: str, *keep: str) -> DataFrame:
    """One row for each field of a tag, in column f."""
    own = F.filter("fields", lambda f: f["tag"] == tag)
    return bibs.select(*keep, F.explode_outer(own).alias("f")).where(F.col("f").isNotNull())
