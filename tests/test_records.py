"""Reading, writing and rewriting of records."""

from pyspark.sql import functions as F

from bibloom.functions import extract
from bibloom.model import BIB_SCHEMA, to_long
from bibloom.operators import dedup, edits, fieldmaps, quality, reconcile, tables
from bibloom.sources import formats, iso2709, tabular
from bibloom.streaming import audit


def record(spark, *rows):
    return spark.createDataFrame([("f", k, leader, fields) for k, (leader, fields) in enumerate(rows)], BIB_SCHEMA)


def c(tag, data):
    return (tag, None, None, data, None)


def d(tag, *subs, ind=" 0"):
    return (tag, ind[0], ind[1], None, list(subs))


LEADER = "00000nam a2200000 a 4500"


def test_iso2709_files(spark, tmp_path):
    many = [(LEADER, [c("001", f"r{k}"), d("245", ("a", "Títle $ é"), ("b", str(k))), d("500", ("a", ""), ("a", "x" * (k % 50)))]) for k in range(300)]
    too_long = (LEADER, [c("001", "big"), d("500", ("a", "y" * 10_000))])
    iso2709.write(record(spark, *many, too_long), str(tmp_path / "out"))
    back = iso2709.read(spark, str(tmp_path / "out")).orderBy("record_index").collect()
    assert [r["record_index"] for r in back] == list(range(300))
    assert [r["fields"][0]["data"] for r in back] == [f"r{k}" for k in range(300)]
    assert back[7]["fields"][1]["subfields"][0]["value"] == "Títle $ é"
    assert back[60]["fields"][2]["subfields"][1]["value"] == "x" * 10


def test_iso2709_damage(spark, tmp_path):
    good = iso2709.encode(record(spark, (LEADER, [c("001", "ok"), d("245", ("a", "T"))]))).first()["raw"].encode()
    bad_byte = good.replace(b"T", b"\xff")
    (tmp_path / "f.mrc").write_bytes(good + b"\x1d" + b"short\x1d" + bad_byte + b"\x1d" + b"x" * 40 + b"\x1d\n" + good[:30])
    rows = iso2709.read(spark, str(tmp_path / "f.mrc")).orderBy("record_index").collect()
    assert [r["fields"][0]["data"] for r in rows] == ["ok", "ok"]
    assert rows[1]["fields"][1]["subfields"][0]["value"] == "�"


def test_formats(spark):
    df = record(spark, (LEADER, [c("001", "1"), c("008", "a b"), d("245", ("a", 'A "<&$'), ("b", "B"), ind="1 ")]))
    assert formats.mnemonic(df).first()["text"] == "=LDR  00000nam a2200000 a 4500\n=001  1\n=008  a\\b\n=245  1\\$aA \"<&{dollar}$bB"
    for back in (formats.parse_mnemonic(formats.mnemonic(df)), formats.from_json(formats.to_json(df))):
        row = back.first()
        assert row["leader"] == LEADER and [f["tag"] for f in row["fields"]] == ["001", "008", "245"]
        assert row["fields"][1]["data"] == "a b" and row["fields"][2]["ind1"] == "1"
        assert [tuple(s) for s in row["fields"][2]["subfields"]] == [("a", 'A "<&$'), ("b", "B")]
    assert '<subfield code="a">A &quot;&lt;&amp;$</subfield>' in formats.marcxml(df).first()["xml"]


def test_tables_from_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('biblionumber;homebranch;barcode\n1001;MAIN;"1;2"\n1001; X ;3\n;;\n')
    df = tabular.read_delimited(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in df.collect()] == [("1001", "MAIN", "1;2"), ("1001", "X", "3")]
    (tmp_path / "b.csv").write_text("1,2\n3,4\n")
    assert tabular.read_delimited(spark, str(tmp_path / "b.csv")).columns == ["col_1", "col_2"]
    (tmp_path / "c.json").write_text('{"items": [{"a": 1}, {"a": "x"}]}')
    assert [r["a"] for r in tabular.read_json_rows(spark, str(tmp_path / "c.json")).collect()] == ["1", "x"]
    (tmp_path / "d.xml").write_text("<r><row><a>1</a></row><row><a>2</a></row></r>")
    assert [r["a"] for r in tabular.read_xml_rows(spark, str(tmp_path / "d.xml"), "row").collect()] == ["1", "2"]


def test_insert_scripts(spark):
    script = "INSERT INTO `branches` (`branchcode`, `branchname`) VALUES ('A', 'O\\'Hare (1)'), ('B', 'b''s');\nINSERT IGNORE INTO authorised_values (category, authorised_value, lib) VALUES ('LOC','X','Desk');\nINSERT INTO itemtypes (itemtype, description) VALUES ('only');"
    rows = tabular.control_values(spark.createDataFrame([(script,)], "value string")).collect()
    assert [tuple(r) for r in rows] == [("branches", "A", "O'Hare (1)"), ("branches", "B", "b's"), ("shelving_locations", "X", "Desk")]


def test_field_maps(spark):
    df = record(spark, (LEADER, [c("001", "1"), d("852", ("b", "MAIN"), ("h", "QA 1")), d("852", ("b", "X"))]))
    maps = [fieldmaps.FieldMap("852", "952", "h", "o"), fieldmaps.FieldMap("852", "952", "b", "a", "lookup", {"main": "M"}, True), fieldmaps.FieldMap("", "942", None, "c", "const", "BK")]
    long = to_long(fieldmaps.apply_maps(df, maps)).orderBy("field_pos", "sub_pos").collect()
    assert [(r["tag"], r["code"], r["value"]) for r in long] == [("001", None, "1"), ("952", "o", "QA 1"), ("952", "a", "M"), ("952", "a", "X"), ("942", "c", "BK")]
    assert fieldmaps.FieldMap("1", "2", kind="odd").problems()


def test_dedup_rules(spark):
    rows = [("t1", "The Title!"), ("t2", "the  títle"), ("t3", None), ("t4", "Other")]
    df = record(spark, *((LEADER, [c("001", i), *([d("245", ("a", t)), d("100", ("a", "A"))] if t else []), *([d("952", ("p", i))] * (2 if i == "t2" else 1))]) for i, t in rows))
    rule = dedup.PRESETS["title_author"]
    ids = lambda out: sorted(r[0] for r in out.select(extract.first("001")).collect())
    assert ids(dedup.deduplicate(df, rule)) == ["t1", "t3", "t4"]
    assert ids(dedup.deduplicate(df, rule, "most_items")) == ["t2", "t3", "t4"]
    merged = dedup.deduplicate(df, rule, merge_items=True).where(extract.first("001") == "t1").first()
    assert [f["subfields"][0]["value"] for f in merged["fields"] if f["tag"] == "952"] == ["t1", "t2", "t2"]


def test_reconcile_deletes_whole_field(spark):
    df = record(spark, (LEADER, [d("952", ("y", "OLD"), ("a", "1")), d("952", ("y", "GONE")), d("952", ("y", " keep "))]))
    rules = [reconcile.Rule("y", ("OLD",), "merge", "NEW"), reconcile.Rule("y", ("GONE",), "delete", mode="field")]
    assert [r[0] for r in to_long(reconcile.apply_rules(df, rules)).select("value").collect()] == ["NEW", "1", " keep "]


def test_edits_keep_other_fields(spark):
    df = record(spark, (LEADER, [c("001", "1"), d("650", ("a", "Cats")), d("700", ("a", "Z"))]))
    edit = edits.macro(edits.add_field("655", [("a", "x")]), edits.delete_field("650", containing="CAT"), edits.find_replace("z", "$1", "700", case_sensitive=False), edits.type_fields())
    row = edit(df).first()
    assert [f["tag"] for f in row["fields"]] == ["001", "336", "337", "338", "655", "700"]
    assert row["fields"][-1]["subfields"][0]["value"] == "$1"


def test_quality_of_raw_bytes(spark):
    raw = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"\xff"),)], "raw binary")
    assert [r[0] for r in raw.select(F.size(quality.encoding())).collect()] == [0, 1]


def test_empty_tables(spark):
    none = record(spark, (LEADER, [])).limit(0)
    assert dedup.deduplicate(none, dedup.PRESETS["isbn"]).count() == 0
    assert quality.scan(none).count() == 0
    assert tables.record_changes(none, none).count() == 0


def test_stream_follows_and_counts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.limit(500).write.parquet(str(tmp_path / "log"))
    stream = audit.counts_by_window(audit.follow(spark, str(tmp_path / "log"), events.schema), width="1 day")
    q = stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    assert spark.table("counted").agg(F.sum("n")).first()[0] == 500
    assert audit.sessions(events).agg(F.sum("n")).first()[0] == events.count()
