"""Files, versions and reviews that need no tables of the catalogue."""

import datetime

import pytest
from pyspark.sql import functions as F

from bibloom.functions import extract, text
from bibloom.model import BIB_SCHEMA
from bibloom.operators import review
from bibloom.operators.fieldmaps import FieldMap
from bibloom.operators.samples import strings_by_tag
from bibloom.sources import files, iso2709, tabular
from bibloom.streaming import audit


def records(spark, n=5):
    sub = lambda c, v: (c, v)
    rows = [
        ("f", k, "00000nam a2200000 a 4500", [("001", None, None, f"p{k}", None), ("100", "1", " ", None, [sub("a", f"Name {k} "), sub("b", "Ann" if k % 2 else "")]), ("270", " ", " ", None, [sub("k", f"{k}@x.org")])])
        for k in range(n)
    ]
    return spark.createDataFrame(rows, BIB_SCHEMA)


@pytest.fixture
def folder(spark, tmp_path):
    iso2709.write(records(spark), f"{tmp_path}/a.mrc")
    (tmp_path / "b.mrk").write_text("\n=001  x1\n=245  10$aA title\n\n=001  x2\n")
    (tmp_path / "c.csv").write_text("barcode;bib\n1; 7 \n2;\n3;8\n")
    (tmp_path / "d.json").write_text('{"items": [{"bib": "7", "barcode": "1"}, {"bib": " ", "barcode": "2"}]}')
    (tmp_path / "empty.mrc").write_text("")
    (tmp_path / "no.mrc").write_text("12345 is no record")
    return tmp_path


def test_formats_of_files(spark, folder):
    assert files.sniff(spark, f"{folder}/a.mrc") == "iso2709"
    assert files.sniff(spark, f"{folder}/b.mrk") == "mrk"
    assert files.sniff(spark, f"{folder}/empty.mrc") is None and files.sniff(spark, f"{folder}/no.mrc") is None
    assert files.count_records(spark, f"{folder}/a.mrc") == ("iso2709", 5)
    assert files.count_records(spark, f"{folder}/b.mrk") == ("mrk", 2)
    assert [files.category(n) for n in ("x/bibs.mrc", "my_items.mrc", "rows.CSV")] == ["marc", "items", "items_csv"]


def test_items_and_patrons_of_files(spark, folder):
    assert {(r["key"], r["barcode"]) for r in files.read_items(spark, f"{folder}/c.csv", "bib").collect()} == {("7", "1"), ("8", "3")}
    assert {(r["key"], r["barcode"]) for r in files.read_items(spark, f"{folder}/d.json", "bib").collect()} == {("7", "1")}
    rows = files.read_items(spark, f"{folder}/a.mrc", "001")
    assert {(r["key"], r["100$b"]) for r in rows.collect()} == {(f"p{k}", "Ann" if k % 2 else "") for k in range(5)}
    found = files.read_patrons(spark, f"{folder}/a.mrc").orderBy("patron_id").collect()
    assert [(r["patron_id"], r["surname"], r["firstname"], r["email"], r["city"]) for r in found[:2]] == [("p0", "Name 0", "", "0@x.org", ""), ("p1", "Name 1", "Ann", "1@x.org", "")]
    assert files.read_patrons(spark, f"{folder}/c.csv").columns == ["barcode", "bib"]


def test_split_files(spark, tmp_path):
    files.write_split(records(spark), files.bucket_of(F.when(F.col("record_index") > 0, extract.first("100$b"))), f"{tmp_path}/out")
    sizes = {b: iso2709.read(spark, f"{tmp_path}/out/bucket={b}").count() for b in ("Ann", "_no_value_")}
    assert sizes == {"Ann": 2, "_no_value_": 3}
    one = spark.createDataFrame([("a b/ç!" * 12,), ("",), (None,)], "v string").select(files.bucket_of(F.col("v")).alias("b"))
    assert [r["b"] for r in one.collect()] == [("a_b_ç_" * 12)[:50], "_empty_", "_no_value_"]


def test_versions(spark, tmp_path):
    assert [review.save_version(records(spark, n), f"{tmp_path}/v") for n in (1, 2)] == [1, 2]
    assert {r["version"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/v").groupBy("version").count().collect()} == {1: 1, 2: 2}
    none = spark.createDataFrame([], "version int")
    assert review.next_version(none).first()["version"] == 1


def test_sources_of_steps():
    found = ["p/merged.mrc", "p/output.mrc", "p/transformed/b_transformed.mrc", "p/transformed/a_transformed.mrc"]
    assert files.resolve_source(found, "push") == "p/output.mrc" == files.resolve_source(found, "explore")
    assert files.resolve_source(found, "items", "p/merged.mrc") == "p/merged.mrc"
    assert files.resolve_source(found[2:], "items", "gone.mrc") == "p/transformed/a_transformed.mrc"
    assert files.resolve_source([], "push") is None


def test_headers_and_columns(spark):
    assert review.holds_format([" BorrowerNumber", "biblio_id"]) == "format_a"
    assert review.holds_format(["patron_id", "bib_001"]) == "format_b"
    assert review.holds_format(["x"]) == "format_a"
    maps = spark.createDataFrame([("a", "o"), ("b", "p")], "source_column string, target string")
    headers, renamed = review.rename_column(maps, ["a", "b"], "a", "z")
    assert headers == ["z", "b"] and {r["source_column"] for r in renamed.collect()} == {"z", "b"}
    for old, new in (("q", "z"), ("a", "b")):
        with pytest.raises(ValueError):
            review.rename_column(maps, ["a", "b"], old, new)


def test_plugins():
    assert review.Plugin("my-plugin", "1.0", {"transform:upper": "pkg.mod:upper"}, ("read_records",)).problems() == []
    bad = review.Plugin("My_Plugin", " ", {"push:x": "no target"}, ("root",)).problems()
    assert len(bad) == 5
    assert FieldMap("9x2", "949", "c", "d").problems()


def test_values_of_scripts(spark):
    script = "INSERT INTO authorised_values (category, value, description) VALUES ('loc', 'A', 'Shelf'), ('', 'B', 'x'), ('SEAT', 'C', NULL);"
    got = {tuple(r) for r in tabular.control_values(spark.createDataFrame([(script,)], "value string")).collect()}
    assert got == {("shelving_locations", "A", "Shelf"), ("other", "B", "x"), ("av:seat", "C", "")}


def test_dates_and_long_values(spark):
    rows = spark.createDataFrame([("1987-03-15",), ("1987-03-15 x ",), ("19870315",), ("1987",)], "v string")
    assert [r[0] for r in rows.select(text.date_marc_to_iso(F.col("v"))).collect()] == ["1987-03-15", "1987-03-15 x ", "1987-03-15", "1987-01-01"]
    long = "'" + "x" * ((1 << 20) + 9) + "'"
    script = spark.createDataFrame([(f"INSERT INTO branches (branchcode, branchname) VALUES ('A', {long});",)], "value string")
    assert len(tabular.control_values(script).first()["description"]) == (1 << 20) + 9


def test_strings_by_tag(spark):
    rows = {r["tag"]: r["texts"] for r in strings_by_tag(records(spark, 1)).collect()}
    assert rows == {"001": ["p0"], "100": ["1 $aName 0 $b"], "270": ["  $k0@x.org"]}


def test_bad_bytes(spark):
    raw = iso2709.encode(records(spark)).select("file_id", "record_index", F.col("raw").cast("binary").alias("raw"))
    damaged = raw.withColumn("raw", F.when(F.col("record_index") == 2, F.concat("raw", F.unhex(F.lit("C3")))).otherwise(F.col("raw")))
    assert files.utf8_statistics(damaged).first().asDict() == {"total_records": 5, "bad_record_count": 1, "nonascii_record_count": 1, "bad_indices": "2"}
    assert [files.repaired(damaged, m).count() for m in ("skip", "replace", "transliterate")] == [4, 5, 5]
    with pytest.raises(ValueError):
        files.repaired(damaged, "other")


def test_mended_records_are_whole(spark):
    """Leader, directory and fields of what was mended, and others byte for byte."""
    broken = spark.createDataFrame([("f", 0, bytearray(b"00030nam a22000xxx a 4500 \xff rest")), ("f", 1, bytearray(b"\xff"))], "file_id string, record_index long, raw binary")
    assert [files.repaired(broken, m).count() for m in files.MODES] == [0, 0, 0]
    bibs = records(spark).withColumn("fields", F.transform("fields", lambda f: F.when(f["tag"] == "001", f.withField("data", F.concat(f["data"], F.lit("~")))).otherwise(f)))
    raw = iso2709.encode(bibs).select("file_id", "record_index", F.encode(F.translate("raw", "~", "é"), "ISO-8859-1").alias("raw"))
    for mode, end in (("replace", "\ufffd"), ("transliterate", "")):
        fixed = files.repaired(raw, mode)
        for r in fixed.collect():
            data = r["raw"].encode()
            assert r["mended"] and int(data[:5]) == len(data) + 1 and data[int(data[12:17]) - 1 : int(data[12:17])] == b"\x1e"
        assert {(r["record_index"], r["fields"][0]["data"], r["fields"][1]["subfields"][0]["value"]) for r in iso2709.decode(fixed).collect()} == {(k, f"p{k}{end}", f"Name {k} ") for k in range(5)}
    assert files.repaired(raw, "skip").count() == 0
    good = iso2709.encode(records(spark)).select("file_id", "record_index", "raw")
    assert {tuple(r) for r in files.repaired(good, "replace").select("record_index", "raw").collect()} == {tuple(r) for r in good.select("record_index", "raw").collect()}


def test_stalled_tasks_of_a_stream(spark, tmp_path):
    """A task that goes quiet is reported once the log has gone on; ended and lively ones aren't."""
    schema = "task_id string, kind string, at timestamp, status string"
    at = lambda h, m=0: datetime.datetime(2024, 5, 1, h, m)
    days = [
        [("quiet", "push", at(8), "running"), ("ended", "push", at(8), "running"), ("lively", "scan", at(8), "running"), ("failed", "scan", at(8), "running")],
        [("ended", "push", at(8, 30), "done"), ("failed", "scan", at(8, 20), "failed"), ("lively", "scan", at(9), "running"), ("quiet", "late", at(7, 59), "running")],
        [("lively", "scan", at(9, 50), "running"), ("other", "x", at(9, 55), "running")],
        [("lively", "scan", at(10, 40), "done"), ("other", "x", at(10, 45), "running")],
        [("quiet", "push", at(10, 50), "running")],
    ]
    for k, rows in enumerate(days):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log/day={k}")
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/log")
    found = audit.watch_stalled(log, 3600)
    q = found.writeStream.format("memory").queryName("stalled").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck").start()
    q.awaitTermination(240)
    assert [(r["task_id"], r["kind"], r["last_at"]) for r in spark.table("stalled").collect()] == [("quiet", "push", at(8))]
    whole = spark.read.option("recursiveFileLookup", "true").schema(schema).parquet(f"{tmp_path}/log")
    now = F.lit("2024-05-01 11:48:00").cast("timestamp")
    assert {(r["task_id"], r["quiet_sec"]) for r in audit.stalled_tasks(whole, now).collect()} == {("other", 3780)}


def test_alerts_and_history(spark):
    none = spark.createDataFrame([], "queue string, depth int")
    tasks = spark.createDataFrame([("a", 4000)], "task_id string, duration_sec int")
    assert [tuple(r) for r in review.alerts(none, tasks, none).orderBy("kind").collect()] == [("critical", "hung_task", "a", 4000), ("critical", "no_workers", None, 0)]
    assert review.alerts(none, tasks, tasks).count() == 1
