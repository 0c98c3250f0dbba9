"""Profiles of columns: exact, with samples, and from stored sketches."""

from pyspark.sql import functions as F

from bibloom.operators import profile


def test_samples(spark):
    rows = [(k, f" v{k % 3} " if k % 2 else "NULL", "" if k < 95 else f"w{k}", None) for k in range(100)]
    df = spark.createDataFrame(rows, "n int, a string, b string, c string").repartition(5)
    found = {r["column"]: (r["populated"], r["distinct_values"], r["samples"]) for r in profile.column_samples(df, ["a", "b", "c"], ["n"], 4).collect()}
    assert found == {"a": (50, 3, ["v1", "v0", "v2", "v1"]), "b": (5, 5, ["w95", "w96", "w97", "w98"]), "c": (0, 0, [])}
    plan = profile.column_samples(df, ["a"], ["n"], 4)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # no task hands on more than the first values


def test_sketches(spark, tmp_path):
    """Files profiled one by one give what all of them together have, within the stated error."""
    df = spark.range(200_000).select((F.col("id") % 4).cast("string").alias("file_id"), (F.col("id") % 60_000).cast("string").alias("many"), (F.sqrt(F.col("id") % 100).cast("int")).cast("string").alias("few"), F.lit(" ").alias("none"))
    profile.column_sketches(df, ["many", "few", "none"]).write.parquet(f"{tmp_path}/s")
    found = {r["column"]: r for r in profile.merged_sketches(spark.read.parquet(f"{tmp_path}/s"), 3).collect()}
    assert set(found) == {"many", "few"}
    assert found["many"]["populated"] == 200_000 and abs(found["many"]["distinct_estimate"] - 60_000) < 3 * 0.017 * 60_000
    assert found["few"]["distinct_estimate"] == 10
    assert [(t["item"], t["count"]) for t in found["few"]["top"]] == [("9", 38_000), ("8", 34_000), ("7", 30_000)]
