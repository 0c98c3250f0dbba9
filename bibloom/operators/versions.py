"""Versions of a set of records with a tree of digests, so that a difference reads what differs.

A version is stored in buckets by the hash of the control number. A bucket's digest is made of its
records' digests, and the root's of the buckets'. Versions of equal roots are equal; of others only
the buckets whose digests differ are read and compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bibloom.functions import extract
from bibloom.functions.text import strip
from bibloom.model import BIB_SCHEMA, rendered
from bibloom.operators.tables import record_changes

BUCKETS = 256


def _key() -> Column:
    return strip(extract.first("001"))


def digests(bibs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, records, digest): of the records with a control number, the last of equal ones, by
    what ``record_changes`` compares. A digest doesn't depend on the order of the records: it is made
    of their number, and the sum and the exclusive or of their hashes."""
    text = F.transform("fields", lambda f: F.struct(f["tag"].alias("tag"), F.when(f["tag"] == "001", strip(f["data"])).otherwise(rendered(f)).alias("text")))
    keyed = bibs.select(_key().alias("key"), "record_index", F.xxhash64(F.to_json(text)).alias("h"), F.crc32(F.to_json(text)).alias("c")).where(F.col("key").isNotNull())
    last = keyed.groupBy("key").agg(F.max_by(F.struct("h", "c"), "record_index").alias("last"))
    one = F.xxhash64("key", "last.h", "last.c")
    sums = last.groupBy(_bucket(F.col("key"), buckets).alias("bucket")).agg(
        F.count(F.lit(1)).alias("records"), F.sum(one.cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("last.c", "key", "last.h")).alias("x")
    )
    return sums.select("bucket", "records", F.md5(F.concat_ws(":", "records", "s", "x")).alias("digest"))


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def root(digests: DataFrame) -> str:
    """The digest of a whole version, of as many rows as there are buckets."""
    each = F.sort_array(F.collect_list(F.struct("bucket", "digest")))
    return digests.agg(F.md5(F.to_json(each)).alias("root")).first()["root"]


def _places(path: str, number: int) -> tuple[str, str]:
    return f"{path}/records/version={number}", f"{path}/digests/version={number}"


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The versions below a path; one counts from when its digests are written, which is last."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/digests")
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("version="))


def save(bibs: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """Store the records as the next version below a path, and return its number. All versions of a
    path take the same number of buckets. Records without a control number are stored beside them."""
    spark = bibs.sparkSession
    number = max(numbers(spark, path), default=0) + 1
    records, tree = _places(path, number)
    key = _key()
    rows = bibs.select("file_id", "record_index", "leader", "fields").withColumn("bucket", F.coalesce(_bucket(key, buckets), F.lit(-1)))
    rows.repartitionByRange("bucket", "record_index").sortWithinPartitions("bucket", "record_index").write.partitionBy("bucket").parquet(records)
    digests(read(spark, path, number), buckets).coalesce(1).write.parquet(tree)
    return number


def read(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The records of a version, with their bucket."""
    return spark.read.schema(f"{BIB_SCHEMA}, bucket int").parquet(_places(path, number)[0])


def differing(spark: SparkSession, path: str, old: int, new: int) -> list[int]:
    """The buckets whose digests differ; their number is bounded by that of the buckets."""
    a, b = (spark.read.parquet(_places(path, n)[1]).select("bucket", F.col("digest").alias(name)) for n, name in ((old, "a"), (new, "b")))
    return [r["bucket"] for r in a.join(b, "bucket", "full").where(~F.col("a").eqNullSafe(F.col("b"))).orderBy("bucket").collect()]


def changes(spark: SparkSession, path: str, old: int, new: int) -> DataFrame:
    """(marc_001, change, tags) between two stored versions, as ``record_changes`` gives them, from
    the buckets that differ alone."""
    here = F.col("bucket").isin(*differing(spark, path, old, new))
    return record_changes(*(read(spark, path, n).where(here) for n in (old, new)))
