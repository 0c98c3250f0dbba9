"""Every query of the catalogue against its SQL oracle over the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__
from bibloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.sql(catalog.ORACLES[name])
    assert sorted(found.columns) == columns
    want = sorted((tuple(plain(dict(zip(found.columns, r, strict=True))[c]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() == 50
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_changes_of_records(spark):
    """Records gone, new, and changed in one field each."""
    found = {r["marc_001"]: (r["change"], r["tags"]) for r in catalog.QUERIES["diff_bib_changes"](spark, FOLDER).collect()}
    assert found["b57"][0] == "removed"
    assert found["nb1"][0] == "added"
    assert all(v == ("changed", "942") for v in found.values() if v[0] == "changed" and "," not in v[1])


def test_title_case_takes_whole_texts(spark, tmp_path):
    body = "ab " * 400_000 + "the end"
    spark.createDataFrame([(1, body)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    value = catalog.QUERIES["title_case"](spark, str(tmp_path)).first()["value"]
    assert len(value) == len(body) and value.endswith("Ab The End")
