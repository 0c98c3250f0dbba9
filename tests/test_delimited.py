"""Delimited text: encodings, quoted line breaks in many splits, lines before the header; XML rows."""

import csv
import io
import random

import pytest

from bibloom.sources import delimited, files, tabular


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp1252", "latin-1", "utf-16", "utf-16-le", "utf-16-be"])
def test_encodings(spark, tmp_path, encoding):
    text = "name;city;note\r\nAndré;Zürich;\"two\r\nlines; quoted \"\"here\"\"\"\r\n  Ægir ;Århus;plain\r\n"
    if encoding == "cp1252":
        text = text.replace("plain", "5 €")
    if encoding == "latin-1":
        text = text.replace("plain", "\x81")
    (tmp_path / "a.csv").write_bytes(text.encode(encoding))
    found = delimited.read(spark, f"{tmp_path}/a.csv")
    assert found.columns == ["name", "city", "note"]
    last = text.rsplit(";", 1)[1].strip("\r\n")
    assert rows_of(found) == [("André", "Zürich", 'two\nlines; quoted "here"' if not encoding.startswith("utf-16") else 'two\r\nlines; quoted "here"'), ("Ægir", "Århus", last if last != "\x81" else "\x81")]


def test_detection():
    assert delimited.detect_encoding("é".encode()[:1] + b"") == "UTF-8"  # cut inside a character
    assert delimited.detect_encoding(b"") == "UTF-8"
    assert delimited.detect_encoding(b"caf\xe9, 5 \x80") == "windows-1252"
    assert delimited.detect_encoding(b"caf\xe9 \x90") == "ISO-8859-1"
    assert delimited.detect_encoding("abc,d".encode("utf-16-be")) == "UTF-16BE"


def test_lines_before_the_header(spark, tmp_path):
    text = 'Report of "all\nPrinted 2024-01-01,x\n\nid,name,branch\n1,A,B\n,,\n2,"C, D",E\n'
    (tmp_path / "p.csv").write_text(text)
    found = files.read_patrons(spark, f"{tmp_path}/p.csv")
    assert found.columns == ["id", "name", "branch"] and rows_of(found) == [("1", "A", "B"), ("2", "C, D", "E")]
    for settings in ({"skip_rows": 3}, {"header_row": 3}, {"skip_rows": 1, "header_row": 2}, {"delimiter": ",", "skip_rows": 2}):
        assert rows_of(files.read_patrons(spark, f"{tmp_path}/p.csv", **settings)) == rows_of(found)
    assert files.read_patrons(spark, f"{tmp_path}/p.csv", skip_rows=4).columns == ["1", "A", "B"]
    assert rows_of(files.read_patrons(spark, f"{tmp_path}/p.csv", skip_rows=4, header=False)) == [("1", "A", "B"), ("2", "C, D", "E")]


def test_headers(spark, tmp_path):
    (tmp_path / "h.tsv").write_text('id\t\t"long\nname"\tid\n1\tx\t2\t3\n4\n')
    found = delimited.read(spark, f"{tmp_path}/h.tsv", header=True)
    assert found.columns == ["id", "long\nname"] and rows_of(found) == [("3", "2")]
    (tmp_path / "empty.csv").write_text("")
    assert delimited.read(spark, f"{tmp_path}/empty.csv").count() == 0


@pytest.mark.parametrize("size", ["64b", "300b", "10k"])
@pytest.mark.parametrize("splits", [delimited.BROADCAST_SPLITS, 0])
def test_quotes_over_splits(spark, tmp_path, monkeypatch, size, splits):
    """What the csv module reads from each file as a whole, however the files are split; quotes in
    the middle of a cell are plain, and one is never closed."""
    monkeypatch.setattr(delimited, "BROADCAST_SPLITS", splits)
    random.seed(9)
    (tmp_path / "f").mkdir()
    want = []
    for k in range(3):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(["id", "note", "end"])
        for j in range(120):
            note = "".join(random.choice(['"', "\n", ",", "a", "é", " b", "\n\n"]) for _ in range(random.choice([0, 1, 3, 12, 150])))
            writer.writerow([f"{k}-{j}", note, "x"])
        text = out.getvalue() + 'q,5" disk,"x" y\n' + ('z,"open\nto, the\nend' if k == 1 else "")
        (tmp_path / "f" / f"{k}.csv").write_text(text, newline="")
        for row in list(csv.reader(io.StringIO(text, newline="")))[1:]:
            want.append(tuple(c.strip() for c in [*row, "", ""][:3]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found = rows_of(delimited.read(spark, f"{tmp_path}/f", delimiter=",", header=True))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == sorted(want)


def test_xml_rows(spark, tmp_path):
    text = '<r xmlns="urn:x"><head><id>0</id></head>' + "".join(f"<patron><id>{k}</id><name>N{k}</name></patron>" for k in range(4)) + "<foot/></r>"
    (tmp_path / "p.xml").write_text(text)
    found = files.read_patrons(spark, f"{tmp_path}/p.xml")
    assert sorted(r["id"] for r in found.collect()) == ["0", "1", "2", "3"]
    assert tabular.frequent_child(text[:70]) in ("head", "patron") and tabular.frequent_child("") is None and tabular.frequent_child("<a>text</a>") is None
    assert tabular.frequent_child("<a><b/><c/><c/><b/>") == "b"
    (tmp_path / "none.xml").write_text("<a/>")
    with pytest.raises(ValueError):
        tabular.read_xml_rows(spark, f"{tmp_path}/none.xml")
