"""Helpers shared by the corpus operators: durable intermediate tables, ranks without a
global window, and batch-wise mapping over Arrow record batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

#: Rows of a record batch that are turned into Python objects at a time.
SLICE_ROWS = 256

#: Keys of a side of a join that is broadcast, 16 bytes or so each; a larger side is shuffled.
BROADCAST_KEYS = 1_000_000

#: Up to so many rows steps of one job stay together; beyond, what is joined is written first.
LIGHT_ROWS = 100_000

_ROW_BITS = 33  # monotonically_increasing_id: partition index above, row of the partition below


#: Temporary folders of local applications without a setting, by application.
_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir. Where it is unset, a temporary
    folder of the application if driver and executors are one process; on a cluster, which shares
    no such folder, an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        context = spark.sparkContext
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if context.applicationId not in _own_folders:
            _own_folders[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='bibloom-')}"
        folder = _own_folders[context.applicationId]
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The table cuts the lineage, survives the loss of executors and fixes the rows of anything
    that is not deterministic. Its number of files follows the partitions, which adaptive
    execution sizes by the data. ``options`` go to the writer.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session that hold within this; underscores stand for dots."""
    keys = {key.replace("_", "."): value for key, value in values.items()}
    before = {key: spark.conf.get(key) for key in keys}
    try:
        for key, value in keys.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def shuffles_removed(spark: SparkSession):
    """Within this, the shuffle files of a job go when it ends: for writes of large tables, which
    nothing computes again."""
    return settings(spark, spark_sql_classic_shuffleDependency_fileCleanup_enabled="true")


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``materialize`` that nothing reads any more."""
    for df in tables:
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, parent)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder, if it is within the one for intermediate tables."""
    if shared_folder(spark).removeprefix("file://") in folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(rows: int) -> Callable[[DataFrame, str], DataFrame]:
    """How the result of an aggregation is held for a join with what it was made of: written, so
    that the join has exchanges of its own and Spark can split a hot key there; of few rows, where
    one key is a small task in any case, left within one job."""
    return materialize if rows > LIGHT_ROWS else lambda df, name: df


def bounded(side: DataFrame, weight: Column | None = None) -> DataFrame:
    """The side of a join, as a broadcast if it has few enough keys, else as it is; for written
    tables. ``weight``: keys in a row, where they aren't one."""
    if not side.inputFiles():
        return side  # not a written table: adaptive execution decides by what comes out
    size = side.count() if weight is None else side.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(side) if size <= BROADCAST_KEYS else side


def with_positions(df: DataFrame, groups: list[str], order: list[Column], position: str, size: str) -> DataFrame:
    """Add the 0-based position of each row within its group, in the given order, and the
    number of rows of the group.

    Rows are range partitioned by group and order, so a hot group spreads over many tasks; a
    position is the row's place in its partition plus the rows of the group in the partitions
    before. Only the counts by group and partition go through a window. Group columns must not
    be null. The result reads a written table, so that positions don't change between reads.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g).asc() for g in groups] + order
    placed = materialize(
        df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id()),
        "positions",
    )
    placed = placed.withColumn("_part", F.shiftright("_row", _ROW_BITS))
    counts = placed.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    group = Window.partitionBy(*groups)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *groups,
        "_part",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(group).alias(size),
    )
    joined = placed.join(offsets, [*groups, "_part"])
    return joined.withColumn(position, F.col("_row") + F.col("_shift")).drop("_row", "_part", "_shift")


def map_batches(
    df: DataFrame,
    start: Callable[[], Callable[..., list[list]]],
    schema: str,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Map columns to columns, a few hundred rows at a time.

    ``start()`` is called once for each task and returns a function from lists of the column
    values to lists of the output columns. Memory is bounded by the slice, not the partition.
    """
    out = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = start()
        for batch in batches:
            for lo in range(0, batch.num_rows, slice_rows):
                part = batch.slice(lo, slice_rows)
                columns = fn(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
                )

    return df.mapInArrow(run, out)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores before those that a column has already, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def once(x: Column, never: int = 0) -> Column:
    """The same values, computed in one place: Catalyst doesn't put an expression that isn't
    deterministic in the place of its mentions. ``never`` doesn't occur; it tells that nulls don't."""
    return F.when(F.spark_partition_id() >= 0, x).otherwise(F.lit(never))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
