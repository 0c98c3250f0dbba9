"""Single records of large ISO 2709 files by their places: a stored table of byte offsets, and a data
source that turns a filter on record_index into reads of these bytes alone.

    write_offsets(spark, "bibs.mrc", "bibs.offsets")
    read(spark, "bibs.offsets").where("record_index = 4711")
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.window import Window

from bibloom.sources import iso2709

#: Bytes of a file that are read for neighbouring records at once.
READ_BYTES = 1 << 22


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, record_index, start, size): the bytes of each record of the files, as the records
    are numbered by ``iso2709.raw_records``, without line breaks before it and its end mark.

    A split's records follow each other, so that a record begins where the sizes before it in the
    split end, after the splits before in the file.
    """
    lines = spark.read.option("lineSep", "\x1d").text(path)
    rows = lines.select(F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("split"), "value")
    skipped = F.octet_length(F.regexp_extract("value", r"^[\r\n]*", 0))
    rows = rows.select(
        "file_id", "split", F.monotonically_increasing_id().alias("_id"), F.octet_length("value").alias("_n"), skipped.alias("_skipped"),
        (F.regexp_replace("value", r"[\s\x1a]+", "") != "").alias("_sound"),
    )
    splits = rows.groupBy("file_id", "split").agg(F.sum(F.col("_n").cast("bigint") + 1).alias("_bytes"), F.count_if("_sound").alias("_records"))
    before = Window.orderBy("file_id", "split").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
    within = Window.partitionBy("file_id").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    begins = splits.select("file_id", "split", F.coalesce(F.sum("_bytes").over(within), F.lit(0)).alias("_begin"), F.coalesce(F.sum("_records").over(before), F.lit(0)).alias("_first"))
    place = Window.partitionBy("file_id", "split").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.withColumns({"_ahead": F.coalesce(F.sum(F.col("_n").cast("bigint") + 1).over(place), F.lit(0)), "_earlier": F.coalesce(F.count_if("_sound").over(place), F.lit(0))})
    joined = ahead.where("_sound").join(begins, ["file_id", "split"])
    return joined.select(
        "file_id",
        (F.col("_first") + F.col("_earlier")).alias("record_index"),
        (F.col("_begin") + F.col("_ahead") + F.col("_skipped")).alias("start"),
        (F.col("_n") - F.col("_skipped")).cast("bigint").alias("size"),
    )


def write_offsets(spark: SparkSession, path: str, index: str) -> None:
    """Store the offsets, sorted, so that few row groups have to be read for some indexes."""
    found = offsets(spark, path)
    found.repartitionByRange("record_index").sortWithinPartitions("record_index").write.option("parquet.block.size", 1 << 20).parquet(index)


class Stretch(InputPartition):
    """Neighbouring records of one file: their indexes, starts and sizes."""

    def __init__(self, file_id: str, records: list[tuple[int, int, int]]):
        self.file_id, self.records = file_id, records


def opened(path: str):
    """A file of any file system that is known by its URI, for reads at places."""
    system, inner = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1) if path.startswith("file:/") else f"file://{path}")
    return system.open_input_file(inner)


class IndexedReader(DataSourceReader):
    """Reads records at their places; takes filters on record_index, by = or IN."""

    def __init__(self, index: str):
        self.index, self.wanted = index, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("record_index",):
                own = {f.value}
            elif isinstance(f, In) and f.attribute == ("record_index",):
                own = set(f.value)
            else:
                yield f
                continue
            self.wanted = own if self.wanted is None else self.wanted & own

    def partitions(self) -> list[InputPartition]:
        system, inner = fs.FileSystem.from_uri(self.index if "://" in self.index else f"file://{self.index.removeprefix('file:')}")
        table = ds.dataset(inner, format="parquet", filesystem=system)
        chosen = None if self.wanted is None else ds.field("record_index").isin(pa.array(sorted(self.wanted), pa.int64()))
        out: list[InputPartition] = []
        for batch in table.to_batches(columns=["file_id", "record_index", "start", "size"], filter=chosen):
            rows = sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True), key=lambda r: (r[0], r[2]))
            now: Stretch | None = None
            for file_id, i, start, size in rows:
                if now is None or file_id != now.file_id or start + size - now.records[0][1] > READ_BYTES:
                    now = Stretch(file_id, [])
                    out.append(now)
                now.records.append((i, start, size))
        return out or [Stretch("", [])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        assert isinstance(partition, Stretch)
        if not partition.records:
            return
        with opened(partition.file_id) as f:
            raws, runs = [], []
            for _, start, size in partition.records:  # records that follow each other are one read
                if runs and start - sum(runs[-1]) in (0, 1):
                    runs[-1][1] = start + size - runs[-1][0]
                else:
                    runs.append([start, size])
            blocks = {start: f.read_at(size, start) for start, size in runs}
            at = iter(runs)
            run = next(at)
            for _, start, size in partition.records:
                while start >= sum(run):
                    run = next(at)
                raws.append(blocks[run[0]][start - run[0] : start - run[0] + size])
        ids = [r[0] for r in partition.records]
        yield pa.RecordBatch.from_arrays([pa.array([partition.file_id] * len(ids)), pa.array(ids, pa.int64()), pa.array(raws, pa.binary())], names=["file_id", "record_index", "raw"])


class IndexedRecords(DataSource):
    """Format ``iso2709_indexed``; its path is that of the stored offsets."""

    @classmethod
    def name(cls) -> str:
        return "iso2709_indexed"

    def schema(self) -> str:
        return "file_id string, record_index bigint, raw binary"

    def reader(self, schema) -> IndexedReader:
        return IndexedReader(self.options["path"])


def read(spark: SparkSession, index: str) -> DataFrame:
    """(file_id, record_index, raw) of the records in stored offsets, as ``iso2709.decode`` takes
    them. Filters on record_index by = and IN choose the bytes that are read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IndexedRecords)
    rows = spark.read.format("iso2709_indexed").load(index)
    return rows.withColumn("raw", F.col("raw").cast("string"))


def record_at(spark: SparkSession, index: str, *record_index: int) -> DataFrame:
    """The decoded records with some indexes."""
    return iso2709.decode(read(spark, index).where(F.col("record_index").isin(*record_index) if len(record_index) > 1 else F.col("record_index") == record_index[0]))
