"""Replies of a language model: fences, shapes and types."""

import pytest

from bibloom.operators import suggestions


def values(spark, *replies):
    rows = spark.createDataFrame(list(enumerate(replies)), "n int, reply string")
    found = suggestions.value_suggestions(rows).orderBy("n", "position").collect()
    return [(r["source_value"], r["target_value"], r["confidence"], r["reasoning"]) for r in found]


ONE = '[{"source_value": "A", "koha_value": "B", "confidence": 0.9, "reasoning": "x"}]'


@pytest.mark.parametrize("reply", [ONE, f"```json\n{ONE}\n```", f"  ```\n{ONE}\n``` and more", f"```json{ONE}", f"\n{ONE}\n"])
def test_fences(spark, reply):
    assert values(spark, reply) == [("A", "B", 0.9, "x")]


@pytest.mark.parametrize("reply", [None, "", "  ", "```", "not json {{", ONE[1:-1], "42", "null", '"text"', "[]", ONE[:-3]])
def test_no_rows(spark, reply):
    assert values(spark, reply) == []


@pytest.mark.parametrize(
    "told, want",
    [("1.5", 1.0), ("-0.2", 0.0), ('"0.75"', 0.75), ('" 0.5 "', 0.5), ('"high"', 0.0), ("null", 0.0), ("[1]", 0.0), ("true", 1.0), ('"NaN"', 0.0), ("1e-1", 0.1), ("1", 1.0)],
)
def test_confidence(spark, told, want):
    assert values(spark, ONE.replace("0.9", told)) == [("A", "B", want, "x")]


def test_entries(spark):
    """Wrong types cost an entry, not the reply; null and empty targets stand for no match."""
    entries = ['"text"', "42", "null", "[]", "{}", '{"koha_value": "X"}', '{"source_value": ""}', '{"source_value": 7}', '{"source_value": "A", "koha_value": 42}']
    entries += ['{"source_value": "B", "koha_value": null}', '{"source_value": "C", "koha_value": ""}', '{"source_value": "D"}', '{"source_value": "E", "koha_value": "F", "reasoning": 42}']
    entries += ['{"source_value": "G", "koha_value": "é \\u00e9", "reasoning": ["a", 1]}']
    assert values(spark, f"[{', '.join(entries)}]") == [("B", None, 0.0, None), ("C", None, 0.0, None), ("D", None, 0.0, None), ("E", "F", 0.0, "42"), ("G", "é é", 0.0, '["a",1]')]


def test_maps(spark):
    reply = """[{"source_tag": "949", "source_sub": "a", "target_tag": "952", "target_sub": "p", "confidence": "0.5", "delete_source": true},
      {"source_tag": "94", "target_tag": "952"}, {"source_tag": 949, "target_tag": "952"}, {"target_tag": "952"}, {"source_tag": "0011", "target_tag": "952"},
      {"source_tag": "001", "target_tag": "035", "transform_type": "preset", "preset_key": "case_lower", "reasoning": "why", "confidence": 3}]"""
    found = suggestions.map_suggestions(spark.createDataFrame([(reply, 5), ("{}", 6), (None, 7)], "reply string, project int")).orderBy("position")
    assert [tuple(r) for r in found.collect()] == [
        (5, 0, "949", "a", "952", "p", "copy", None, None, True, 0.5, None),
        (5, 5, "001", None, "035", None, "preset", None, "case_lower", False, 1.0, "why"),
    ]


def test_columns(spark):
    reply = """{"bib_key_column": "bib", "bib_match_tag": "001", "mappings": [{"source_column": " BARCODE ", "target_subfield": "p", "confidence": 0.8},
      {"source_column": "note", "target_subfield": null}, {"target_subfield": "x"}, {"source_column": "  "}, 3]}"""
    rows = spark.createDataFrame([(reply,), ("[]",), ('{"mappings": 3}',), ('{"bib_key_column": "x"}',), (None,)], "reply string")
    found = suggestions.column_suggestions(rows).orderBy("position")
    assert [tuple(r) for r in found.collect()] == [(0, "BARCODE", "p", False, "copy", 0.8, None, "bib", "001"), (1, "note", None, True, "copy", 0.5, None, "bib", "001")]


def test_findings(spark):
    reply = """Here it is: {"summary": "s", "findings": [{"severity": "info", "title": "t1", "record_count_estimate": 7}, 5,
      {"severity": "other", "title": ""}, {"severity": "action_required", "category": "dates", "detail": "d", "tag_hint": "008"}, {"record_count_estimate": "many"}]} Bye."""
    rows = spark.createDataFrame([(1, reply), (2, "no object"), (3, "{broken}"), (4, '{"findings": {}}'), (5, None), (6, '{"a": 1}')], "n int, reply string")
    got = [tuple(r) for r in suggestions.findings(rows).orderBy("n", "rank").collect()]
    assert got == [
        (1, 1, "action_required", "dates", "(untitled)", "d", None, "008"),
        (1, 2, "info", "other", "t1", "", 7, None),
        (1, 3, "info", "other", "(untitled)", "", None, None),
        (1, 4, "other", "other", "(untitled)", "", None, None),
    ]
