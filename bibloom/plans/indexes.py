"""Queries that go through stored indexes, which they write first."""

from __future__ import annotations

from pyspark.sql import functions as F

from bibloom.functions import extract
from bibloom.operators import profile, search, versions
from bibloom.plans import adapters
from bibloom.plans.adapters import PATRON_SQL, bibs, table
from bibloom.plans.catalog import ORACLES, _edited, register
from bibloom.sources import delimited, indexed, iso2709
from bibloom.storage import new_folder


@register("search_index_topk", ORACLES["search_topk"])
def search_index_topk(spark, sf):
    path = new_folder(spark, "search")
    search.write_index(search.documents(bibs(spark, sf)), path)
    return search.search_index(spark, path, ["green", "promo"], 20).select("record_index", "marc_001", "score")


@register("record_by_offset", "select r as record_index, f001 as id, coalesce(f245a, '') as title from (select *, row_number() over (order by k) - 1 as r from bib) where r in (0, 7, 41, 42, 150)")
def record_by_offset(spark, sf):
    path = new_folder(spark, "records")
    iso2709.write(bibs(spark, sf), f"{path}.mrc")
    indexed.write_offsets(spark, f"{path}.mrc", f"{path}.offsets")
    found = indexed.record_at(spark, f"{path}.offsets", 0, 7, 41, 42, 150)
    return found.select("record_index", extract.first("001").alias("id"), extract.joined("245$a").alias("title"))


_COLUMNS = ["categorycode", "branchcode", "sex", "dateofbirth"]


@register(
    "column_samples",
    f"with p as ({PATRON_SQL}), c as (select cardnumber, unnest(['categorycode', 'branchcode', 'sex', 'dateofbirth']) as \"column\", unnest([categorycode, branchcode, sex, dateofbirth]) as value from p), "
    "g as (select * from c where trim(value) not in ('', 'NULL')), f as (select \"column\", string_agg(value, '; ' order by cardnumber) as samples from (select *, row_number() over (partition by \"column\" order by cardnumber) as r from g) where r <= 20 group by 1) "
    "select \"column\", count(*) as populated, count(distinct value) as distinct_values, any_value(samples) as samples from g join f using (\"column\") group by 1",
)
def column_samples(spark, sf):
    found = profile.column_samples(adapters.patrons(spark, sf), _COLUMNS, ["cardnumber"])
    return found.withColumn("samples", F.array_join("samples", "; "))


@register(
    "column_sketches",
    f"with p as ({PATRON_SQL}), c as (select unnest(['categorycode', 'sex']) as \"column\", unnest([categorycode, sex]) as value from p), n as (select \"column\", value, count(*) as n from c group by 1, 2) "
    "select \"column\", cast(sum(n) as bigint) as populated, count(*) as distinct_estimate, string_agg(value || ' ' || n, '; ' order by n desc, value) as top from n group by 1",
)
def column_sketches(spark, sf):
    """Sketches of two halves, stored, then merged: exact for columns of few values."""
    path = new_folder(spark, "sketches")
    halves = adapters.patrons(spark, sf).withColumn("file_id", (F.crc32("cardnumber") % 2).cast("string"))
    profile.column_sketches(halves, ["categorycode", "sex"]).write.parquet(path)
    found = profile.merged_sketches(spark.read.parquet(path))
    order = F.array_sort("top", lambda a, b: F.when(a["count"] != b["count"], F.signum(b["count"] - a["count"])).when(a["item"] < b["item"], -1).when(a["item"] > b["item"], 1).otherwise(0).cast("int"))
    return found.withColumn("top", F.array_join(F.transform(order, lambda x: F.concat_ws(" ", x["item"], x["count"].cast("string"))), "; "))


@register("version_changes", ORACLES["diff_bib_changes"])
def version_changes(spark, sf):
    """Two stored versions, compared where their digests differ."""
    path = new_folder(spark, "versions")
    old, new = (versions.save(state, path, 32) for state in (bibs(spark, sf), _edited(spark, sf)))
    return versions.changes(spark, path, old, new)


@register("delimited_scan", "with c as (select * from customer) select cast(c_custkey as varchar) as id, c_name || chr(10) || 'c/o ' || c_mktsegment || ', \"x\"' as address, case when c_custkey % 3 = 0 then '' else c_mktsegment end as segment from c")
def delimited_scan(spark, sf):
    """Text with quoted line breaks, delimiters and quotes, written and found out again."""
    path = new_folder(spark, "delimited")
    cells = F.concat_ws(";", F.col("c_custkey").cast("string"), F.concat(F.lit('"'), "c_name", F.lit("\nc/o "), "c_mktsegment", F.lit(', ""x"""')), F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_mktsegment")))
    table(spark, sf, "customer").select(cells).write.text(path)
    return delimited.read(spark, path, header=False, delimiter=";").toDF("id", "address", "segment")
