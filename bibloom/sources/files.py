"""Which format a file has, what reads it, and which file of a project counts.

Formats are told by what Spark reads of the beginning of a file, so any store will do.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bibloom.functions.text import ascii_fold, strip
from bibloom.model import once
from bibloom.operators.samples import flattened, items_of, patrons_of
from bibloom.sources import delimited, formats, iso2709, tabular

#: Files of the steps in the order in which each kind of step takes its source (fixed values).
SOURCE_ORDER = {
    "push": ("Biblios-mapped-items", "merged_deduped", "output", "merged"),
    "explore": ("output", "Biblios-mapped-items", "merged_deduped", "merged"),
    "items": ("merged_deduped", "output", "merged"),
}


def record_format(first: DataFrame) -> DataFrame:
    """(file_id, record_index, format) of the first records of files, raw in column raw: iso2709
    if the text begins with five digits and a field can be read, mrk if its first line that isn't
    blank begins with = and three digits, else null."""
    digits = first.where(F.col("raw").rlike("^[0-9]{5}"))
    readable = iso2709.decode(digits.select("file_id", "record_index", "raw")).where(F.size("fields") > 0).select("file_id", "record_index", F.lit(True).alias("_iso"))
    joined = first.join(readable, ["file_id", "record_index"], "left")
    line = F.regexp_extract("raw", r"^\s*([^\r\n]*)", 1)
    kind = F.when(F.col("_iso"), "iso2709").when(line.rlike("^=[0-9]{3}"), "mrk")
    return joined.select("file_id", "record_index", kind.alias("format"))


def sniff(spark: SparkSession, path: str) -> str | None:
    """The format of a record file, or None; one row comes to the driver."""
    head = spark.read.option("lineSep", "\x1d").text(path).limit(1)
    row = record_format(head.select(F.lit(path).alias("file_id"), F.lit(0).alias("record_index"), F.col("value").alias("raw"))).first()
    return row["format"] if row else None


def read_records(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Records of a file; the format by its ending (.mrk and .txt are text) where it isn't given."""
    kind = kind or ("mrk" if path.lower().endswith((".mrk", ".txt")) else "iso2709")
    return formats.read_mnemonic(spark, path) if kind == "mrk" else iso2709.read(spark, path)


def count_records(spark: SparkSession, path: str, kind: str | None = None) -> tuple[str, int]:
    kind = kind or ("mrk" if path.lower().endswith((".mrk", ".txt")) else "iso2709")
    return kind, read_records(spark, path, kind).count()


def category(filename: str) -> str:
    """What a new file is taken for: marc, items (record files named so) or items_csv."""
    name = filename.rsplit("/", 1)[-1].lower()
    if name.endswith((".csv", ".tsv", ".json")):
        return "items_csv"
    return "items" if "item" in name and name.endswith(".mrc") else "marc"


def read_items(spark: SparkSession, path: str, key: str, kind: str | None = None) -> DataFrame:
    """Item rows with the trimmed key in column key; rows without one are left out. kind: mrc,
    json or csv, by the ending where it isn't given."""
    kind = kind or {"mrc": "mrc", "json": "json"}.get(path.rsplit(".", 1)[-1].lower(), "csv")
    if kind == "mrc":
        bibs = iso2709.read(spark, path)
        names = [r[0] for r in flattened(bibs).select(F.explode(F.map_keys("cells"))).distinct().orderBy("col").collect()]  # as many as columns
        return items_of(bibs, key, [n for n in names if n != key])
    rows = tabular.read_json_rows(spark, path) if kind == "json" else delimited.read(spark, path)
    keyed = rows.withColumn("_key", strip(F.col(f"`{key}`").cast("string")))
    return keyed.where(F.col("_key") != "").drop(key).withColumnRenamed("_key", "key")


def read_patrons(spark: SparkSession, path: str, row_tag: str | None = None, tags: dict[str, str] | None = None, **text: Any) -> DataFrame:
    """Patron rows by the file's ending: record files, XML, JSON, else delimited text, whose header
    is the first line of three cells or more unless ``text``, settings of ``delimited.read``, say
    otherwise."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending in ("mrc", "marc"):
        return patrons_of(iso2709.read(spark, path), tags)
    if ending == "xml":
        return tabular.read_xml_rows(spark, path, row_tag)
    if ending == "json":
        return tabular.read_json_rows(spark, path)
    return delimited.read(spark, path, **{"header": True, "min_columns": 3, **text})


def resolve_source(found: Sequence[str], step: str, explicit: str | None = None) -> str | None:
    """The file that a step reads: the one asked for if it is there, else the first by the step's
    order, else the first transformed one by name."""
    if explicit and explicit in found:
        return explicit
    names = {f.rsplit("/", 1)[-1].rsplit(".", 1)[0]: f for f in sorted(found, reverse=True)}
    best = next((names[n] for n in SOURCE_ORDER[step] if n in names), None)
    return best or min((f for f in found if f.endswith("_transformed.mrc")), default=None)


def bucket_of(value: Column) -> Column:
    """The part of a file name that a value gives: up to 50 letters, digits, - and _."""
    safe = F.substring(F.regexp_replace(value, r"[^\p{L}\p{N}_-]", "_"), 1, 50)
    return F.when(value.isNull(), "_no_value_").when(safe == "", "_empty_").otherwise(safe)


def write_split(bibs: DataFrame, bucket: Column, path: str) -> None:
    """Record files, one folder for each bucket, in the order of the records."""
    raw = iso2709.encode(bibs.select("file_id", "record_index", "leader", "fields")).where(~F.col("oversize"))
    named = raw.join(bibs.select("file_id", "record_index", bucket.alias("bucket")), ["file_id", "record_index"])
    placed = named.repartitionByRange("bucket", "record_index").sortWithinPartitions("bucket", "record_index")
    placed.select("bucket", "raw").write.partitionBy("bucket").option("lineSep", "\x1d").text(path)


# ---- bytes that aren't UTF-8


def utf8_statistics(raw: DataFrame, samples: int = 5) -> DataFrame:
    """One row: total_records, bad_record_count, nonascii_record_count, and the first indices of
    bad ones; raw records are bytes or strings in column raw."""
    data = F.col("raw").cast("binary")
    bad = ~F.is_valid_utf8(data.cast("string"))
    wide = F.octet_length(data) != F.octet_length(F.encode(F.regexp_replace(F.make_valid_utf8(data.cast("string")), r"[^\x00-\x7F]", ""), "UTF-8"))
    marked = raw.select("record_index", bad.alias("bad"), wide.alias("wide"))
    first = marked.where("bad").orderBy("record_index").limit(samples).agg(F.sort_array(F.collect_list("record_index"))).scalar()
    counts = marked.agg(F.count(F.lit(1)).alias("total_records"), F.count_if("bad").alias("bad_record_count"), F.count_if("wide").alias("nonascii_record_count"))
    return counts.withColumn("bad_indices", F.array_join(first, ","))


MODES = ("skip", "replace", "transliterate")


def repaired(raw: DataFrame, mode: str) -> DataFrame:
    """(file_id, record_index, raw, mended): raw records without bad ones (skip), with U+FFFD in the
    place of what can't be read (replace), or with bad ones reduced to ASCII letters (transliterate);
    others stay as they are, byte for byte.

    A bad record is cut by its old directory, each field is mended, and directory and leader are made
    anew, as the lengths change. Bad records that can't be cut, or are too long for the format then,
    are left out.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    columns = ["file_id", "record_index", "raw", "mended"]
    text = F.col("raw").cast("binary").cast("string")
    good = raw.where(F.is_valid_utf8(text)).withColumns({"raw": text, "mended": F.lit(False)}).select(*columns)
    if mode == "skip":
        return good
    cut = iso2709.directories(raw.where(~F.is_valid_utf8(text)))
    body = lambda d: F.make_valid_utf8(F.substring(F.col("b"), F.col("base") + d["at"] + 1, d["size"] - 1).cast("string"))
    # one text for all fields, which their end marks part
    whole = F.array_join(F.transform("directory", lambda d: F.translate(body(d), "\x1e", "")), "\x1e")
    cut = cut.withColumn("whole", whole)
    if mode == "transliterate":
        cut = cut.withColumn("whole", ascii_fold("whole"))
    mended = F.arrays_zip(F.col("directory.tag").alias("tag"), F.split("whole", "\x1e").alias("text"))
    bodies = F.transform(F.when(F.size("directory") > 0, mended), lambda x: F.struct(x["tag"].alias("tag"), F.concat(x["text"], F.lit("\x1e")).alias("text")))
    leader = F.make_valid_utf8(F.substring("b", 1, 24).cast("string"))
    rows = cut.select("file_id", "record_index", leader.alias("leader"), F.coalesce(bodies, F.array().cast("array<struct<tag:string,text:string>>")).alias("bodies"))
    made = iso2709.assembled(rows.withColumn("bodies", once(F.col("bodies")))).where(~F.col("oversize"))
    return good.unionByName(made.withColumn("mended", F.lit(True)).select(*columns))
