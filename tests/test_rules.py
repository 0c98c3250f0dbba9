"""Reconciling by rules that are data."""

import random
import time

from bibloom.model import BIB_SCHEMA
from bibloom.operators.reconcile import Case, Rule, apply_rules


def record(k, *items):
    return ("f", k, "x" * 24, [("001", None, None, f"n{k}", None), *(("952", " ", " ", None, list(i)) for i in items), ("942", " ", " ", None, [("y", "v1")])])


def items_of(df):
    return {r["record_index"]: [[tuple(s) for s in f["subfields"]] for f in r["fields"] if f["tag"] == "952"] for r in df.collect()}


def test_operations(spark):
    rules = [
        Rule("y", ("A", "B"), "merge", "BK"),
        Rule("y", ("B",), "rename", "last"),
        Rule("c", ("x",), "delete"),
        Rule("c", ("y",), "delete", mode="field"),
        Rule("8", ("S",), "split", cases=(Case("regex", "R", value="^ S$"), Case("other_field", "O", tag="001", value="n2"), Case("default", "D"))),
        Rule("8", ("é x",), "rename", None),
    ]
    rows = [record(1, [("y", " A "), ("c", "x"), ("c", "z")], [("y", "B"), ("c", "y")], [("y", "B"), ("8", "S")]), record(2, [("8", "S"), ("8", " S"), ("8", "é x"), ("y", None)], [])]
    df = spark.createDataFrame(rows, BIB_SCHEMA)
    found = apply_rules(df, rules)
    assert found.schema == df.schema
    assert items_of(found) == {1: [[("y", "BK"), ("c", "z")], [("y", "last"), ("8", "D")]], 2: [[("8", "O"), ("8", "R"), ("8", None), ("y", None)], []]}
    assert [f["tag"] for f in found.where("record_index = 1").first()["fields"]] == ["001", "952", "952", "942"]
    assert items_of(apply_rules(df, [])) == items_of(df)


def test_many_rules(spark):
    """5,000 rules are planned and run within seconds, and give what a dictionary does."""
    random.seed(3)
    codes = "yc8ab"
    rules = [Rule(random.choice(codes), tuple(f"v{random.randrange(20_000)}" for _ in range(2)), random.choice(["rename", "delete"]), f"t{k}") for k in range(5_000)]
    last = {(r.code, v): r for r in rules for v in r.sources}
    rows = [record(k, *([(random.choice(codes), f"v{random.randrange(20_000)}") for _ in range(5)] for _ in range(4))) for k in range(500)]
    want = {}
    for _, k, _, fields in rows:
        want[k] = [[(c, last[c, v].target if (c, v) in last else v) for c, v in f[4] if (c, v) not in last or last[c, v].operation != "delete"] for f in fields if f[0] == "952"]
    began = time.time()
    assert items_of(apply_rules(spark.createDataFrame(rows, BIB_SCHEMA), rules)) == want
    assert time.time() - began < 20
