"""What grows with the tables: tasks, rows that are shuffled, aggregations that sort."""

import pytest
from pyspark.sql import functions as F

from bibloom.model import BIB_SCHEMA
from bibloom.operators import builds, items, profile, reconcile
from bibloom.operators.fieldmaps import FieldMap, apply_maps
from bibloom.plans import adapters


@pytest.fixture(scope="module")
def many_parts(spark, tmp_path_factory):
    """50,000 parts in one row group."""
    folder = str(tmp_path_factory.mktemp("parts"))
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").limit(200)
    more = parts.crossJoin(spark.range(250).withColumnRenamed("id", "_n"))
    more.selectExpr("p_partkey + 1000 * _n as p_partkey", "* except (p_partkey, _n)").coalesce(1).write.parquet(f"{folder}/part.parquet")
    return folder


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_records_are_made_by_a_task_for_so_many(spark, many_parts):
    found = adapters.bibs(spark, many_parts)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 3 and max(sizes) < 20_000
    assert sum(sizes) == 50_000 == found.select("record_index").distinct().count()


def test_missing_tags_sorts_no_tags(spark):
    rows = [("x", 5, None, [("245", " ", " ", None, [])]), ("x", 2, None, [("100", " ", " ", None, [])]), ("y", 9, None, [])]
    found = builds.missing_tags(spark.createDataFrame(rows, BIB_SCHEMA), [FieldMap(t, "990", "a", "a") for t in ("100", "245")])
    assert "SortAggregate" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [("x", "245"), ("y", "100"), ("y", "245")]


def test_items_are_shuffled_as_plain_columns(spark):
    """The collected items go by record once, without fields made of them."""
    shuffled = [line for line in plan(items.attach_items(_bib(spark, 1), _items(spark), "key", ["b", "homebranch"])).splitlines() if "Exchange hashpartitioning" in line or "collect_list" in line]
    assert shuffled and not any("_item" in line for line in shuffled)


def _bib(spark, n):
    rows = [("x", k, None, [("001", None, None, f"b{k}", None), ("035", " ", " ", None, [("a", "b9")])]) for k in range(n)]
    return spark.createDataFrame(rows, BIB_SCHEMA)


def _items(spark):
    rows = [("b0", " S2 ", "2", 1), ("b0", "S1", "2", 2), ("b0", " S1", "1", 3), ("b0", " ", "0", 4), (" b0 ", None, "3", None), ("b1", "S9", "1", 1), (" ", "S8", "1", 1)]
    return spark.createDataFrame(rows, "key string, HomeBranch string, b string, ccode int")


def _shown(df):
    return {r["record_index"]: [[f"{s['code']}{s['value']}" for s in f["subfields"]] for f in r["fields"] if f["tag"] == "952"] for r in df.collect()}


def test_items_in_order_with_trimmed_values(spark):
    """Order by plain values, also of a column that isn't mapped or is named in another case."""
    found = _shown(items.attach_items(_bib(spark, 3), _items(spark), "key", ["b", "homebranch"]))
    assert found == {0: [["84"], ["aS1", "83"], ["aS2", "81"], ["aS1", "82"]], 1: [["aS9", "81"]], 2: []}
    found = _shown(items.attach_items(_bib(spark, 1), _items(spark), "key", ["b"], mapping={"HomeBranch": "a"}))
    assert found == {0: [["aS1"], ["aS1"], ["aS2"]]}  # ties by the fields
    found = _shown(items.attach_items(_bib(spark, 1), _items(spark), "key", ["b", "ccode"], mapping={"HomeBranch": "a"}, constants={"z": "x"}))
    assert found == {0: [["zx"], ["aS1", "zx"], ["aS2", "zx"], ["aS1", "zx"], ["zx"]]}


def test_fields_in_order_whatever_their_codes(spark):
    """Codes that are in order already, and others: capitals, none, several letters, signs."""
    some = ["19ab", "ba", "aBb", "a1", "aa", "", "é1", "_a", "z9"]
    rows = [("x", k, None, [("500", " ", " ", None, [(c, str(i)) for i, c in enumerate(codes)])]) for k, codes in enumerate(some)]
    rows.append(("x", 50, None, [("500", " ", " ", None, [(None, "0"), ("ab", "1"), ("", "2"), ("a", "3"), ("b", "4")])]))
    rows.append(("x", 51, None, [("500", " ", " ", None, [("a", "0"), ("", "1"), ("b", "2")]), ("001", None, None, "n", None)]))
    found = spark.createDataFrame(rows, BIB_SCHEMA).withColumn("fields", items.sorted_fields())
    got = {r["record_index"]: ["".join(s["value"] for s in f["subfields"] or []) for f in r["fields"]] for r in found.collect()}
    assert [got[k] for k in range(9)] == [["0123"], ["10"], ["012"], ["10"], ["01"], [""], ["10"], ["10"], ["10"]]
    assert got[50] == ["31402"]
    assert got[51] == ["", "021"]


def test_fields_with_thousands_of_subfields_in_order(spark):
    rows = [("x", 0, None, [("500", " ", " ", None, [("ba"[i % 2], str(i)) for i in range(6000)])])]
    found = spark.createDataFrame(rows, BIB_SCHEMA).select(items.sorted_fields().alias("fields")).first()["fields"][0]["subfields"]
    assert [s["value"] for s in found] == [str(i) for i in [*range(1, 6000, 2), *range(0, 6000, 2)]]


def test_a_filter_does_not_make_the_maps_again(spark):
    """A condition on mapped records is computed from them, not from all maps once more."""
    made = apply_maps(_bib(spark, 2), [FieldMap("001", "949", None, "a", "regex", "s/b/MAPPED/"), FieldMap("", "949", None, "z", "const", "moved")])
    found = made.where(F.exists("fields", lambda f: f["tag"] == "949")).select("fields")
    filters = [line for line in plan(found).splitlines() if "Filter" in line and "exists" in line]
    assert filters and not any("MAPPED" in line for line in filters)
    assert [[s["value"] for s in r["fields"][-1]["subfields"]] for r in found.collect()] == [["MAPPED0", "moved"], ["MAPPED1", "moved"]]


def test_rules_are_applied_once_and_looked_up_by_their_codes(spark):
    """A condition on reconciled records doesn't apply the rules again below; subfields that no rule is about have no checksum."""
    fields = [("952", " ", " ", None, [("y", "A"), ("c", "F"), ("p", "1"), (None, "x")]), ("952", " ", " ", None, None)]
    df = spark.createDataFrame([("x", 0, None, fields)], BIB_SCHEMA)
    rules = [reconcile.Rule("y", ("A",), "rename", "BK"), reconcile.Rule("c", ("F",), "delete")]
    some = reconcile.apply_rules(df, rules).where(F.exists("fields", lambda f: f["tag"] == "952"))
    found = profile.vocabulary_scan(some, {"itype": "y", "loc": "c", "barcode": "p"})
    optimized = found._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("crc32") == 1 and "code IN (c,y)" in optimized
    assert sorted(map(tuple, found.collect())) == [("barcode", "1", 1), ("itype", "BK", 1)]
