"""Stored versions: differences from the buckets that differ alone."""

import os
import shutil

from pyspark.sql import functions as F

from bibloom.model import control
from bibloom.operators import versions
from bibloom.operators.tables import record_changes
from bibloom.plans.adapters import bibs

FOLDER = "/root/testdata/sf0.001"


def edited(df, *indexes):
    return df.withColumn("fields", F.when(F.col("record_index").isin(*indexes), F.concat("fields", F.array(control("009", F.lit("new"))))).otherwise(F.col("fields")))


def test_differences(spark, tmp_path):
    path = f"{tmp_path}/v"
    first = bibs(spark, FOLDER)
    later = edited(first, 20, 21).where("record_index <> 40")
    assert [versions.save(df, path, 64) for df in (first, first.repartition(3), later)] == [1, 2, 3] == versions.numbers(spark, path)
    assert versions.differing(spark, path, 1, 2) == [] and versions.changes(spark, path, 1, 2).count() == 0
    trees = [spark.read.parquet(f"{path}/digests/version={n}") for n in (1, 2, 3)]
    assert versions.root(trees[0]) == versions.root(trees[1]) != versions.root(trees[2])
    want = sorted(map(tuple, record_changes(first, later).collect()))
    some = versions.differing(spark, path, 1, 3)
    assert 1 <= len(some) <= 3 and len(want) == 3
    # no other bucket is read: without them the differences are the same
    for n in (1, 3):
        folder = f"{path}/records/version={n}"
        for name in os.listdir(folder):
            if name.startswith("bucket=") and int(name.partition("=")[2]) not in some:
                shutil.rmtree(f"{folder}/{name}")
    assert sorted(map(tuple, versions.changes(spark, path, 1, 3).collect())) == want


def test_odd_records(spark, tmp_path):
    """The last of equal numbers counts, in whatever order they are stored; records without a number
    don't; empty versions differ from others."""
    path = f"{tmp_path}/v"
    first = bibs(spark, FOLDER)
    twice = first.unionByName(edited(first.where("record_index = 8"), 8).withColumn("record_index", F.lit(1000).cast("bigint")))
    none = edited(first, 5).withColumn("fields", F.when(F.col("record_index") == 5, F.filter("fields", lambda f: f["tag"] != "001")).otherwise(F.col("fields")))
    states = [first, twice, none, first.limit(0)]
    for df in states:
        versions.save(df, path, 8)
    for a, b in ((1, 2), (1, 3), (1, 4), (4, 2)):
        want = sorted(map(tuple, record_changes(states[a - 1], states[b - 1]).collect()))
        assert sorted(map(tuple, versions.changes(spark, path, a, b).collect())) == want and want
