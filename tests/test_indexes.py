"""Stored indexes read what they need and give what a scan gives."""

import os
import re
import shutil

from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringContains

from bibloom.operators import search
from bibloom.plans.adapters import bibs
from bibloom.sources import indexed, iso2709

FOLDER = "/root/testdata/sf0.001"


def test_search_index(spark, tmp_path):
    docs = search.documents(bibs(spark, FOLDER))
    path = f"{tmp_path}/index"
    search.write_index(docs.where("record_index % 2 = 0"), path, shards=16)
    search.write_index(docs.where("record_index % 2 = 1"), path, shards=16, mode="append")
    for terms in (["green", "promo"], ["GREEN"], ["b17", "nothing"], ["nothing"], [], ["ring", "ring", "economy"]):
        want = [tuple(r) for r in search.search(docs, terms, 15).collect()] if terms else []
        assert [tuple(r) for r in search.search_index(spark, path, terms, 15).collect()] == want
    # only the folders of the terms' shards are read: without all others the answer is the same
    want = [tuple(r) for r in search.search(docs, ["green"], 15).collect()]
    shard = spark.range(1).select(search._shard(F.lit("green"), 16).alias("s")).first()["s"]
    for name in os.listdir(f"{path}/postings"):
        if name.startswith("shard=") and name != f"shard={shard}":
            shutil.rmtree(f"{path}/postings/{name}")
    assert [tuple(r) for r in search.search_index(spark, path, ["green"], 15).collect()] == want
    stored = spark.read.parquet(f"{path}/postings").where((F.col("shard") == shard) & (F.col("term") == "green"))
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan and "EqualTo(term,green)" in plan


def test_search_of_no_records(spark, tmp_path):
    search.write_index(search.documents(bibs(spark, FOLDER)).limit(0), f"{tmp_path}/index")
    assert search.search_index(spark, f"{tmp_path}/index", ["green"]).count() == 0


def local(uri):
    return re.sub("^file:/+", "/", uri)


def _files(spark, folder):
    """Two files, one with line breaks between records and rubbish at its end."""
    for k in (0, 1):
        iso2709.write(bibs(spark, FOLDER).where(F.col("record_index") % 2 == k).coalesce(1), f"{folder}/part{k}")
    os.mkdir(f"{folder}/files")
    for k in (0, 1):
        raw = b"".join(open(f"{folder}/part{k}/{n}", "rb").read() for n in sorted(os.listdir(f"{folder}/part{k}")) if n.startswith("part-"))
        with open(f"{folder}/files/{k}.mrc", "wb") as f:
            f.write(raw.replace(b"\x1d", b"\x1d\r\n") + b"\x1a \n" if k else raw)
    return f"{folder}/files"


def test_offsets(spark, tmp_path):
    """Every record lies at its place, in files that are read in many splits too."""
    path = _files(spark, tmp_path)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = {r["record_index"]: (r["file_id"], r["raw"]) for r in iso2709.raw_records(spark, path).collect()}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        rows = indexed.offsets(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(rows) == len(want) == 200
    for r in rows:
        with open(local(r["file_id"]), "rb") as f:
            f.seek(r["start"])
            assert (r["file_id"], f.read(r["size"]).decode()) == want[r["record_index"]]


def test_reads_by_index(spark, tmp_path, monkeypatch):
    path = _files(spark, tmp_path)
    index = f"file://{tmp_path}/offsets"
    indexed.write_offsets(spark, path, index)
    want = {r["record_index"]: tuple(r) for r in iso2709.read(spark, path).collect()}
    assert {r["record_index"]: tuple(r) for r in iso2709.decode(indexed.read(spark, index)).collect()} == want
    for some in ([5], [3, 4, 150], [10_000], [5, 10_000]):
        assert {r["record_index"]: tuple(r) for r in indexed.record_at(spark, index, *some).collect()} == {i: want[i] for i in some if i in want}
    both = indexed.read(spark, index).where("record_index in (1, 2, 3) and record_index = 2 and raw like '%b%'")
    assert [r["record_index"] for r in both.collect()] == [2]

    # the bytes of the records asked for, and no others
    read = []

    class Counting:
        def __init__(self, path):
            self.file = real(path)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def read_at(self, size, start):
            read.append(size)
            return self.file.read_at(size, start)

    real = indexed.opened
    monkeypatch.setattr(indexed, "opened", Counting)
    reader = indexed.IndexedReader(index)
    left = list(reader.pushFilters([EqualTo(("record_index",), 7), StringContains(("raw",), "b")]))
    assert left == [StringContains(("raw",), "b")]
    parts = reader.partitions()
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [r["record_index"] for r in rows] == [7] and read == [len(rows[0]["raw"])] and len(parts) == 1
    read.clear()
    reader = indexed.IndexedReader(index)
    assert not list(reader.pushFilters([In(("record_index",), (2, 3, 120))]))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["record_index"] for r in rows) == [2, 3, 120] and sum(read) <= sum(len(r["raw"]) for r in rows) + 2


def test_only_the_records_bytes_matter(spark, tmp_path):
    """Lookups still work when all other bytes of the file are gone."""
    path = _files(spark, tmp_path)
    index = f"file://{tmp_path}/offsets"
    indexed.write_offsets(spark, path, index)
    want = tuple(iso2709.read(spark, path).where("record_index = 33").first())
    place = indexed.offsets(spark, path).where("record_index = 33").first()
    name = local(place["file_id"])
    size = os.path.getsize(name)
    with open(name, "rb") as f:
        f.seek(place["start"])
        own = f.read(place["size"])
    with open(name, "wb") as f:
        f.write(b"?" * place["start"] + own + b"?" * (size - place["start"] - place["size"]))
    assert tuple(indexed.record_at(spark, index, 33).first()) == want
