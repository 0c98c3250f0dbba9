"""Conversions of single values against literal expectations."""

import pytest
from pyspark.sql import functions as F

from bibloom.functions import text

CASES = [
    ("date_mdy_to_dmy", " 3/15/1987 x", "15/3/1987"),
    ("date_dmy_to_iso", "5/3/1987", "1987-03-05"),
    ("date_dmy_to_iso", "no date", "no date"),
    ("date_ymd_to_iso", "19870315", "1987-03-15"),
    ("date_marc_to_iso", "1987", "1987-01-01"),
    ("date_marc_to_iso", "1987-03-15", "1987-03-15"),
    ("case_title", "don't o'neil", "Don'T O'Neil"),
    ("case_sentence", "the Title", "The Title"),
    ("text_trim", "\t a \n", "a"),
    ("text_normalize_spaces", "  a \n b ", "a b"),
    ("text_strip_punctuation", "Title:;/ ", "Title"),
    ("clean_isbn", "978-0-13-468599-1 (hardcover)", "9780134685991"),
    ("clean_lccn", "n 78-890351 /r", "n78-890351"),
    ("clean_html", "<p>a &amp; <b>b</b></p>", "a & b"),
    ("extract_year", "c1999, repr. 2001", "c1999, repr. 2001".split()[-1]),
    ("extract_isbn13", "0-13-468599-7", "9780134685991"),
    ("extract_isbn13", "x", "x"),
    ("nothing_of_the_kind", "as it was", "as it was"),
]


@pytest.mark.parametrize(("name", "value", "expected"), CASES)
def test_presets(spark, name, value, expected):
    row = spark.createDataFrame([(value,)], "v string").select(text.preset(name)(F.col("v"))).first()
    assert row[0] == expected


@pytest.mark.parametrize(
    ("spec", "value", "expected"),
    [("s/a/b/", "aaa", "baa"), ("s/a/b/g", "aaa", "bbb"), ("s/A/b/i", "aaa", "baa"), ("s|(a)(c)|\\2\\1|", "acac", "caac"), ("s/(/x/", "(", "("), ("s", "a", "a"), ("s/sirsi-//", "sirsi-12", "12")],
)
def test_substitute(spark, spec, value, expected):
    assert spark.createDataFrame([(value,)], "v string").select(text.substitute(spec)(F.col("v"))).first()[0] == expected


@pytest.mark.parametrize(
    ("name", "surname", "first", "middle"),
    [("Doe, Jane Q. R.", "Doe", "Jane", "Q. R."), ("Jane Q. Doe", "Doe", "Jane", "Q."), ("Doe", "Doe", "", ""), ("", "", "", "")],
)
def test_names(spark, name, surname, first, middle):
    df = spark.createDataFrame([(name,)], "v string")
    got = df.select(*(text.name_split(F.col("v"), p) for p in ("surname", "firstname", "middlename"))).first()
    assert tuple(got) == (surname, first, middle)


def test_lookup_normalise_and_escape(spark):
    df = spark.createDataFrame([("Ab", "  The Títle : a Súbtitle /  ", "O'H\\"), (None, None, None)], "a string, b string, c string")
    rows = df.select(text.lookup({"ab": "1", "AB": "2"})(F.col("a")), text.normalize_text(F.col("b")), text.sql_escape(F.col("c"))).collect()
    assert tuple(rows[0]) == ("1", "the title a subtitle", "O\\'H\\\\") and tuple(rows[1]) == (None, None, None)
