"""Resampling towards a target against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from bibloom.llm import queries, resampling

FOLDER = "/root/testdata/sf0.001"


def runs_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=5, min_words=20):
    """docs: (doc_id, text); rows (doc_id, n_features, weight, score, rank) without nulls in ids."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s = Counter(bucket(f) for _, t in docs for f in runs_of(t)[1])
    t = Counter(bucket(f) for x in target for f in runs_of(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10_000.0) / ((s[b] + 1.0) * (all_t + 10_000.0)))) for b in range(10_000)]
    rows = []
    for i, text in docs:
        words, found = runs_of(text)
        weight = sum(gain[bucket(f)] for f in found)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(found), weight, score, None, len(words)])
    able = sorted((r for r in rows if r[5] >= min_words and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in rows]


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x or 0) for x in r))


def test_buckets_of_all_runs():
    """Checksums of runs from those of their words, for words of all lengths, texts apart."""
    random.seed(1)
    texts = [[bytes(random.choices(b"abcdefgh\xc3\xa9", k=random.choice([1, 2, 5, 62, 63, 64, 65, 300]))) for _ in range(random.choice([0, 1, 2, 3, 9]))] for _ in range(60)]
    made = resampling.Features()
    buckets, rows = made.of([w for x in texts for w in x], np.cumsum([len(x) for x in texts]))
    want = Counter((i, zlib.crc32(b" ".join(x[a : a + n])) % 10_000) for i, x in enumerate(texts) for n in (1, 2, 3) for a in range(len(x) - n + 1))
    assert Counter(zip(rows.tolist(), buckets.tolist())) == want


def test_words_forgotten(monkeypatch):
    monkeypatch.setattr(resampling, "_KNOWN", 8)
    made = resampling.Features()
    for k in range(6):
        words = [f"{'x' * k}{j}".encode() for j in range(5 + 7 * k)]
        buckets, _ = made.of(words, np.array([len(words)]))
        assert buckets[: len(words)].tolist() == [zlib.crc32(w) % 10_000 for w in words]


def test_resampling_query(spark):
    docs = [tuple(r) for r in queries.table(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    target = [r["text"] for r in queries.table(spark, FOLDER, "benchmark").collect()]
    got = queries.op12_target_resampling(spark, FOLDER)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert in_order(got.collect()) == in_order(brute(docs, target))


def test_odd_rows(spark):
    """Nulls, empty and wordless texts, upper case beyond A-Z, copies, an id on several rows, ties,
    a long text, columns of names used inside; empty tables on both sides."""
    random.seed(2)
    some = [" ".join(random.choices("ab cd ef gh Éé ß 12 x_y QQ".split(), k=30)) for _ in range(6)]
    docs = [(1, None), (2, ""), (3, "... \n"), (4, some[0]), (5, some[0]), (5, some[0]), (5, some[1]), (None, some[2]), (6, "ÉCOLE École école A_B"), (7, "long " * 30_000 + "end")]
    docs += [(100 + k, random.choice(some)) for k in range(80)]
    schema = "doc_id long, text string, tid int, id string, weight double, copies string, `group` int"
    df = spark.createDataFrame([(*d, k, "x", 0.5, "y", k) for k, d in enumerate(docs)], schema)
    target = spark.createDataFrame([(some[3], 1), (None, 2), ("", 3)], "text string, tid int")
    got = resampling.resample(df, target, percent=30)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert in_order(got.collect()) == in_order(brute(docs, [some[3]], percent=30))
    nothing = resampling.resample(df, target.limit(0), percent=30)
    assert in_order(nothing.collect()) == in_order(brute(docs, [], percent=30))
    assert resampling.resample(df.limit(0), target).count() == 0


def test_draws_follow_the_target(spark):
    """Documents of the target's words are drawn before others."""
    random.seed(3)
    kinds = {k: [f"{k}{j}" for j in range(40)] for k in "ab"}
    docs = [(j, " ".join(random.choices(kinds["ab"[j % 2]], k=60))) for j in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    target = spark.createDataFrame([(" ".join(random.choices(kinds["b"], k=60)),) for _ in range(50)], "text string")
    drawn = resampling.resample(df, target, percent=20).where(F.col("rank").isNotNull()).collect()
    assert sorted(r["rank"] for r in drawn) == list(range(1, 81)) and all(r["doc_id"] % 2 for r in drawn)
