"""ISO 2709 files: records end with 0x1D, fields with 0x1E, subfields begin with 0x1F.

Files are split at record ends by the text source, so large ones are read by many tasks; the
directory is decoded with expressions on bytes. Lengths and offsets count bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bibloom.model import BIB_SCHEMA, FIELD, FIELDS, SUBFIELD, is_control, once

_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
#: Largest lengths that a directory and a leader can hold.
FIELD_BYTES, RECORD_BYTES = 9999, 99999


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, record_index, raw): the records of the files in order of path and place, without
    their end marks. The index of a record is its place in its split plus the records of the
    splits before, which are counted in a pass of their own."""
    lines = spark.read.option("lineSep", "\x1d").text(path)
    rows = lines.select(F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("start"), "value")
    rows = rows.where(F.regexp_replace("value", r"[\s\x1a]+", "") != "").withColumn("_id", F.monotonically_increasing_id())
    splits = rows.groupBy("file_id", "start").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first"))
    before = Window.orderBy("file_id", "start").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
    offsets = splits.select("file_id", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    joined = rows.join(offsets, ["file_id", "start"])  # a row for each split; Spark broadcasts it where it is small
    return joined.select("file_id", (F.col("_id") + F.col("shift")).alias("record_index"), F.regexp_replace("value", r"^[\r\n]+", "").alias("raw"))


def _text(b: Column) -> Column:
    return F.regexp_replace(F.make_valid_utf8(b.cast("string")), _CONTROL, "")


def directories(raw: DataFrame) -> DataFrame:
    """Raw records with their bytes (b), the place where data begins (base) and the directory, as an
    array of tag, size and at; those whose leader or directory can't be read are left out."""
    data = F.col("raw").cast("binary")
    base = F.substring(data, 13, 5).cast("string").try_cast("int")
    bytes_ = raw.withColumn("b", once(data)).withColumn("base", base)
    bytes_ = bytes_.where((F.octet_length("b") >= 25) & F.col("base").between(25, F.octet_length("b")))
    entries = bytes_.withColumn("entries", F.floor((F.col("base") - 25) / 12).cast("int"))
    directory = F.transform(
        F.when(F.col("entries") > 0, F.sequence(F.lit(0), F.col("entries") - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            F.substring(F.col("b"), 25 + 12 * i, F.lit(3)).cast("string").alias("tag"),
            F.substring(F.col("b"), 28 + 12 * i, F.lit(4)).cast("string").try_cast("int").alias("size"),
            F.substring(F.col("b"), 32 + 12 * i, F.lit(5)).cast("string").try_cast("int").alias("at"),
        ),
    )
    sound = F.forall("directory", lambda d: d["size"].isNotNull() & d["at"].isNotNull() & (F.col("base") + d["at"] + d["size"] <= F.octet_length("b") + 1))
    return entries.withColumn("directory", once(directory)).where(sound).drop("entries")


def decode(raw: DataFrame) -> DataFrame:
    """Records of raw ones; those whose leader or directory can't be read are left out. Bytes that
    aren't UTF-8 are replaced and control characters removed."""
    parsed = directories(raw)

    def field(d: Column) -> Column:
        body = F.substring(F.col("b"), F.col("base") + d["at"] + 1, d["size"] - 1)
        parts = F.split(F.make_valid_utf8(F.substring(body, F.lit(3), F.octet_length(body)).cast("string")), "\x1f")
        subs = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.struct(F.substring(p, 1, 1).alias("code"), F.regexp_replace(F.substring(p, F.lit(2), F.length(p)), _CONTROL, "").alias("value")))
        ctl = d["tag"] < "010"
        ind = lambda k: F.when(~ctl, F.substring(body, k, 1).cast("string"))
        return F.struct(d["tag"].alias("tag"), ind(1).alias("ind1"), ind(2).alias("ind2"), F.when(ctl, _text(body)).alias("data"), F.when(~ctl, subs).cast(f"array<{SUBFIELD}>").alias("subfields"))

    found = F.transform("directory", field).cast(FIELDS)
    return parsed.select("file_id", "record_index", F.substring("b", 1, 24).cast("string").alias("leader"), found.alias("fields"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return decode(raw_records(spark, path))


def _body(f: Column) -> Column:
    subs = F.array_join(F.transform(f["subfields"], lambda s: F.concat(F.lit("\x1f"), s["code"], s["value"])), "")
    return F.when(is_control(f), f["data"]).otherwise(F.concat(f["ind1"], f["ind2"], subs))


def encode(bibs: DataFrame) -> DataFrame:
    """(file_id, record_index, raw, oversize) without end marks; oversize records exceed what a
    directory can say and must not be written."""
    bodies = bibs.withColumn("bodies", once(F.transform("fields", lambda f: F.struct(f["tag"].alias("tag"), F.concat(_body(f), F.lit("\x1e")).alias("text")))))
    return assembled(bodies).select("file_id", "record_index", "raw", "oversize")


def assembled(bodies: DataFrame) -> DataFrame:
    """The columns raw and oversize for rows with a leader and bodies, an array of tags and texts
    that end in 0x1E: the directory and the lengths in the leader are made anew."""
    sizes = bodies.withColumn("sizes", once(F.transform("bodies", lambda x: F.octet_length(x["text"]))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def entry(acc: Column, k: Column) -> Column:
        size = F.get(F.col("sizes"), k)
        line = F.concat(F.get(F.col("bodies"), k)["tag"], F.lpad(size.cast("string"), 4, "0"), F.lpad(acc["at"].cast("string"), 5, "0"))
        return F.struct((acc["at"] + size).alias("at"), F.concat(acc["text"], line).alias("text"))

    places = F.when(F.size("bodies") > 0, F.sequence(F.lit(0), F.size("bodies") - 1)).otherwise(F.array().cast("array<int>"))
    made = sizes.withColumn("dir", once(F.aggregate(places, start, entry)))
    base = 25 + 12 * F.size("bodies")
    length = base + F.col("dir.at") + 1
    leader = F.rpad(F.coalesce("leader", F.lit("")), 24, " ")
    head = F.concat(F.lpad(length.cast("string"), 5, "0"), F.substring(leader, 6, 7), F.lpad(base.cast("string"), 5, "0"), F.substring(leader, 18, 7))
    raw = F.concat(head, F.col("dir.text"), F.lit("\x1e"), F.array_join(F.transform("bodies", lambda x: x["text"]), ""))
    oversize = (length > RECORD_BYTES) | F.exists("sizes", lambda n: n > FIELD_BYTES)
    return made.withColumns({"raw": raw, "oversize": oversize}).drop("sizes", "dir")


def write(bibs: DataFrame, path: str) -> None:
    """Files of all records that fit the format, in ranges of the record index."""
    rows = encode(bibs).where(~F.col("oversize"))
    rows.repartitionByRange("record_index").sortWithinPartitions("record_index").select("raw").write.option("lineSep", "\x1d").text(path)


__all__ = ["BIB_SCHEMA", "FIELD", "decode", "encode", "raw_records", "read", "write"]
