"""Library data made of the test tables, by whole-number arithmetic and concatenation only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibloom.model import control, datafield, fields, once, subfield


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Parts that one task makes records of.
TASK_PARTS = 20_000


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by a key to a task for every TASK_PARTS of them. A table of narrow rows has few
    splits (a row group has one at most), and making a record of a row is far more work than reading it."""
    # by a hash of the key: a join by the key itself would move its other, larger side to these tasks
    n = -(-rows.count() // TASK_PARTS)
    return rows.repartition(n, F.xxhash64(key)) if n > 1 else rows


#: The flat columns that a record is made of, in SQL that Spark and DuckDB both read.
BIB_SQL = """
select p_partkey as k, p_size as s, p_name, p_type, p_brand,
  'b' || cast(p_partkey - case when p_partkey % 10 = 9 then 1 else 0 end as varchar(20)) as f001,
  repeat('|', 36 + p_size % 8) as f008,
  '978-0-' || lpad(cast(p_partkey - case when p_partkey % 7 = 6 then 1 else 0 end as varchar(20)), 7, '0') || ' (pbk.)' as f020a,
  case when p_partkey % 3 = 0 then '(OCoLC) ' else '(DLC)' end || cast(p_partkey as varchar(20)) as f035a,
  cast(p_size as varchar(20)) || '.' || cast(p_partkey % 100 as varchar(20)) as f082a,
  case when p_partkey % 11 = 0 then null else p_brand end as f100a,
  case when p_partkey % 97 = 0 then null else p_name end as f245a,
  case when p_partkey % 5 = 0 then 'x' else '1' end as i245,
  case when p_partkey % 13 = 0 then ' ' else cast(p_size as varchar(20)) || ' p.' end as f300a,
  case when p_partkey % 4 = 0 then 'cafe' || chr(769) || ' ' || cast(p_partkey as varchar(20))
       when p_partkey % 4 = 1 then chr(769) || 'lead' else null end as f500a,
  case when p_partkey % 17 = 0 then '00000' || substr('nacdpx', p_size % 6 + 1, 1) || substr('aegmz', p_size % 5 + 1, 1) || 'm a2200000 a 450'
       else '00000' || substr('nacdpx', p_size % 6 + 1, 1) || substr('aegmz', p_size % 5 + 1, 1) || 'm a2200000 a 4500' end as leader
from part
"""


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = BIB_SQL.replace("varchar(20)", "string").replace("chr(769)", "'́'")
    return spark.sql(sql.replace("from part", "from {part}"), part=spread(table(spark, sf_dir, "part"), "p_partkey"))


def bibs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each part, 942 with its type and 650 twice."""
    one = lambda tag, code, column, **ind: F.when(F.col(column).isNotNull(), datafield(tag, F.array(subfield(code, F.col(column))), **ind))
    title = datafield("245", F.array(subfield("a", F.col("f245a")), subfield("b", F.col("p_type"))), F.col("i245"), "0")
    made = fields(
        control("001", F.col("f001")),
        control("008", F.col("f008")),
        one("020", "a", "f020a"),
        one("035", "a", "f035a"),
        one("082", "a", "f082a"),
        one("100", "a", "f100a", ind1="1"),
        F.when(F.col("f245a").isNotNull(), title),
        one("300", "a", "f300a"),
        one("500", "a", "f500a"),
        one("650", "a", "p_brand"),
        one("650", "a", "p_type"),
        one("942", "c", "p_type"),
    )
    return flat(spark, sf_dir).select(once(F.lit("part")).alias("file_id"), F.col("k").alias("record_index"), "leader", once(made).alias("fields"))


#: Item rows; (l_orderkey, l_linenumber) isn't unique, so all of it orders them.
ITEM_SQL = """
select 'b' || cast(l_partkey as varchar(20)) as biblionumber, 'S' || cast(l_suppkey as varchar(20)) as homebranch,
  'S' || cast(l_suppkey as varchar(20)) as holdingbranch, l_linestatus as location, l_returnflag as itype,
  cast(l_orderkey as varchar(20)) || '-' || cast(l_linenumber as varchar(20)) || '-' || cast(l_suppkey as varchar(20)) as barcode
from lineitem
"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ITEM_SQL.replace("varchar(20)", "string").replace("from lineitem", "from {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


PATRON_SQL = """
select cast(c_custkey as varchar(20)) as cardnumber, c_name as surname, c_mktsegment as categorycode, n_name as branchcode,
  cast(1 + c_custkey % 12 as varchar(20)) || '/' || cast(1 + c_custkey % 28 as varchar(20)) || '/' || cast(1950 + c_custkey % 60 as varchar(20)) as dateofbirth,
  case when c_custkey % 3 = 0 then 'female' when c_custkey % 3 = 1 then 'M' else '?' end as sex
from customer join nation on c_nationkey = n_nationkey
"""


def patrons(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = PATRON_SQL.replace("varchar(20)", "string").replace("from customer", "from {customer}").replace("join nation", "join {nation}")
    return spark.sql(sql, customer=table(spark, sf_dir, "customer"), nation=table(spark, sf_dir, "nation"))


def holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holds with legacy ids, under one of the names that such columns have."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_custkey").cast("string").alias("patron_barcode"),
        F.concat(F.lit("b"), (F.col("o_orderkey") % 1000).cast("string")).alias("bib_001"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("hold_date"),
        F.col("o_orderkey").cast("string").alias("hold_id"),
    )


def id_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New ids of patrons, except for every thirteenth, and of parts."""
    customers = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 13 != 0)
    parts = table(spark, sf_dir, "part")
    return customers.select(F.lit("patron").alias("entity_type"), F.col("c_custkey").cast("string").alias("legacy_id"), (F.col("c_custkey") + 100000).alias("new_id")).unionByName(
        parts.select(F.lit("bib").alias("entity_type"), F.concat(F.lit("b"), F.col("p_partkey").cast("string")).alias("legacy_id"), (F.col("p_partkey") + 500000).alias("new_id"))
    )
