"""Removal of repeated byte strings against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from bibloom.llm import queries, suffixes

FOLDER = "/root/testdata/sf0.001"


def brute(docs, length=50):
    """docs: (doc_id, text); rows (doc_id, n_bytes, n_removed, n_spans, kept)."""
    first = {}
    raws = [(i, (t or "").encode()) for i, t in docs]
    for i, raw in raws:
        if i is not None:
            for p in range(len(raw) - length + 1):
                s = raw[p : p + length]
                first[s] = min(i, first.get(s, i))
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        if i is not None:
            reach = 0
            for p in range(len(raw) - length + 1):
                if first[raw[p : p + length]] < i:
                    lo = max(p, reach)
                    reach = p + length
                    gone[lo:reach] = b"\1" * (reach - lo)
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(raw), sum(gone), runs, bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def in_order(rows):
    return sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_suffix_query(spark):
    docs = [tuple(r) for r in queries.table(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    got = queries.op13_suffix_dedup(spark, FOLDER)
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    want = [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute(docs)]
    assert in_order(got.collect()) == in_order(want)
    assert sum(r[2] > 0 for r in want) > 20


@pytest.mark.parametrize("batches, chunk, broadcast", [(1, 1 << 20, 10**6), (5, 1 << 20, 10**6), (3, 300, 0)])
def test_odd_rows(spark, monkeypatch, batches, chunk, broadcast):
    """Nulls, empty and short texts, copies, an id on several texts, periodic and long texts, shared
    stretches of 49 to 60 bytes at all places, characters of several bytes, further columns; one and
    several batches, cells cut anywhere, sides that are not broadcast."""
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    monkeypatch.setattr(suffixes, "BROADCAST_ROWS", broadcast)
    random.seed(6)
    make = lambda n, letters="abcdé ": "".join(random.choices(letters, k=n))
    base = make(400)
    docs = [(1, None), (2, ""), (3, base[:49]), (4, base[:50]), (5, base), (6, base), (6, base), (6, base[100:200]), (7, "x" * 30 + base[100:160]), (None, base), (8, "ab" * 700), (9, "ab" * 300 + "c"), (10, "long " * 2_000 + "end"), (11, "long " * 800)]
    for k in range(60):
        other = random.choice(docs)[1] or base
        at, n = random.randrange(max(1, len(other) - 60)), random.choice([20, 48, 49, 50, 51, 60, 120])
        docs.append((random.randrange(12, 60), make(random.randrange(80)) + other[at : at + n] + make(random.randrange(80))))
    docs += [(100 + k, make(random.randrange(40, 90), "ab")) for k in range(40)]
    df = spark.createDataFrame([(*d, 1, 2, "x", 3) for d in docs], "doc_id long, text string, doc int, version int, key string, spans int")
    got = suffixes.dedup(df, batches=batches)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    assert in_order(got.collect()) == in_order(brute(docs))
    assert suffixes.dedup(df.limit(0)).count() == 0


def test_levels(spark):
    """Levels merge as a binary counter does, and hold what their batches held."""
    docs = spark.createDataFrame([(k, f"text number {k} " * 9) for k in range(50)], "doc_id long, text string")
    family = suffixes.Family(docs)
    sizes, places = [], 0
    for k in range(5):
        places += family.add(family.documents.where(F.col("doc").between(10 * k, 10 * k + 9))).count()
        sizes.append([level.batches for level in family.levels])
    assert sizes == [[1], [1, 1], [2, 1], [2, 1, 1], [4, 1]] and places == 0
    whole = suffixes.Family(docs)
    whole.add(whole.documents)
    assert sum(level.rows().count() for level in family.levels) == whole.levels[0].rows().count()
    merged = family.levels[0].rows()
    plan = merged._jdf.queryExecution().toString()
    assert "Bucketed: true" in merged.groupBy("key").count()._jdf.queryExecution().executedPlan().toString(), plan
    assert "Exchange" not in merged.groupBy("key").count()._jdf.queryExecution().executedPlan().toString()
    family.drop()
    whole.drop()


def test_sides_that_fill_the_driver_are_not_broadcast(spark):
    """Two maps of 4 million rows of three numbers, up to 140 bytes each, are more than a driver of 750 MB holds."""
    hinted = lambda rows: "ResolvedHint" in suffixes._bounded(spark.range(rows))._jdf.queryExecution().analyzed().toString()
    assert hinted(1_000) and not hinted(2_000_000)


def test_levels_go_before_the_last_windows_are_compared(spark, monkeypatch):
    family = suffixes.Family(spark.createDataFrame([(k, f"text number {k % 7} " * 9 + str(k)) for k in range(20)], "doc_id long, text string"))
    left, windows = [], family._windows
    monkeypatch.setattr(family, "_windows", lambda known: left.append(len(family.levels)) or windows(known))
    first = family.add(family.documents.where("doc < 10"))
    found = family.add(family.documents.where("doc >= 10"), last=True)
    assert left == [1, 0] and first.count() and found.count()


def test_texts_stay_where_they_are(spark):
    """Texts are shuffled and broadcast at no size, a level has a row for each range of keys, and what is found by chunk
    is right where a chunk has few texts and an id stands in several chunks."""
    docs = [(k, f"a passage that many of these documents have in common, number {k % 5} of all " * 3 + f"and words of {k} " * 4) for k in range(40)]
    docs += [(7, docs[3][1][10:90]), (None, docs[0][1]), (50, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = suffixes.dedup(df)
    assert in_order(got.collect()) == in_order(brute(docs))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Bucketed: true" in plan
    assert all("text" not in line for line in plan.splitlines() if "Exchange" in line), plan
    family = suffixes.Family(df)
    family.add(family.documents)
    assert family.levels[0].packed().count() <= family.ranges < family.levels[0].rows().count()
    family.drop()
