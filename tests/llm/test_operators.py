"""The corpus operators against brute force over small fixtures, with nulls, empty and long
texts, ties, repeated rows, empty tables and extra columns."""

import functools
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bibloom.llm import bpe, decontaminate, editprints, langid, lines, paragraphs, queries, quotes, sharding, simhash
from bibloom.llm.components import connected_components

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, bucket int, line string, id string"


def docs_of(spark, rows, schema=DOCS):
    """Rows (doc_id, text) with other columns, some of which clash with names used inside."""
    return spark.createDataFrame([(i, t, "en", f"s{k % 2}" if k % 5 else None, k, "x", "y") for k, (i, t) in enumerate(rows)], schema)


ODD = [(1, "Some words of a text."), (2, None), (3, ""), (4, "..."), (5, "Some words of a text."), (5, "Some words of a text."), (None, "No id here."), (6, "long " * 20_000 + "end")]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


class Union:
    def __init__(self, n):
        self.up = list(range(n))

    def root(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    random.seed(2)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)]
    want = Union(600)
    for a, b in links:
        want.join(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links + [(None, 3)], "a long, b long"), "a", "b").collect()}
    assert got == {x: want.root(x) for a, b in links if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# ---- SimHash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def test_simhash_query(spark):
    docs = queries.table(spark, FOLDER, "documents").collect()
    ids = sorted(r["doc_id"] for r in docs)
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs}
    array = np.array([prints[i] for i in ids], np.uint64)
    want = Union(len(ids))
    for a, b in np.argwhere(np.bitwise_count(array[:, None] ^ array[None, :]) <= 4).tolist():
        want.join(a, b)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op2_simhash(spark, FOLDER).collect()}
    assert got == {i: (f"{prints[i]:016x}", ids[want.root(k)]) for k, i in enumerate(ids)}


@pytest.mark.parametrize("leaf_rows", [4096, 60])
def test_trie_keeps_all_connections(spark, leaf_rows):
    rng = np.random.default_rng(1)
    seen = set()
    for base in rng.integers(0, 2**63, 12, dtype=np.uint64).tolist() + [7] * 20:
        for _ in range(20):
            x = base
            for k in rng.choice(30, rng.integers(0, 5), replace=False).tolist():
                x ^= 1 << k
            seen.add(x)
    array = np.array(sorted(seen), np.uint64)
    signed = array.view(np.int64).tolist()
    near = np.bitwise_count(array[:, None] ^ array[None, :]) <= 4
    want, got = Union(len(array)), Union(len(array))
    place = {x: k for k, x in enumerate(signed)}
    for a, b in np.argwhere(near).tolist():
        want.join(a, b)
    for r in simhash.hamming_links(spark.createDataFrame([(x,) for x in signed], "fp long"), leaf_rows=leaf_rows).collect():
        assert near[place[r["a"]], place[r["b"]]]
        got.join(place[r["a"]], place[r["b"]])
    assert [got.root(k) for k in range(len(array))] == [want.root(k) for k in range(len(array))]


def test_simhash_odd_rows(spark):
    rows = simhash.near_duplicates(docs_of(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    got = {(r["doc_id"], r["component_id"]) for r in rows}
    assert {(1, 1), (5, 1), (2, 2), (3, 2), (6, 6)} <= got and {c for i, c in got if i is None} == {None}
    assert simhash.near_duplicates(docs_of(spark, ODD).limit(0)).count() == 0


# ---- sharding


def test_sharding_query(spark):
    docs = queries.table(spark, FOLDER, "documents").collect()
    strata = defaultdict(list)
    for r in docs:
        strata[r["source"]].append((hashlib.md5(f"0:{r['doc_id']}".encode()).hexdigest(), r))
    placed = sorted(((k + 0.5) / len(rows), f"s{s}", k, r) for s, rows in strata.items() for k, (_, r) in enumerate(sorted(rows, key=lambda x: x[0])))
    slots, want = Counter(), {}
    for p, (_, _, _, r) in enumerate(placed):
        shard = p * 40 // len(placed)
        want[r["doc_id"]] = (len(r["text"].encode()) + 16, zlib.crc32(r["text"].encode()), "rows", shard, slots[shard], None)
        slots[shard] += 1
    got = {r["doc_id"]: tuple(r)[1:7] for r in queries.op3_sharding(spark, FOLDER).collect()}
    assert got == want


def test_sharding_odd_rows(spark):
    rows = sharding.interleave(docs_of(spark, ODD), shards=3).collect()
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == len(ODD) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in counts.items())
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (2, 3)} == {(16, 0)}
    assert sharding.interleave(docs_of(spark, ODD).limit(0)).count() == 0
    mixture = spark.createDataFrame([(k, "t", "ab"[k % 3 == 0]) for k in range(3000)], "doc_id long, text string, source string")
    shares = sharding.interleave(mixture, 10).groupBy("shard").agg(F.count_if(F.col("source") == "b").alias("b")).collect()
    assert all(98 <= r["b"] <= 102 for r in shares)


# ---- fingerprints


def test_fingerprint_query(spark):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in queries.table(spark, FOLDER, "documents").collect()), reverse=True)
    prints = dict(zip((i for i, _ in rows), editprints.embed([t for _, t in rows]), strict=True))
    got = {r["doc_id"]: tuple(r) for r in queries.op4_fingerprints(spark, FOLDER).collect()}
    for k, (i, t) in enumerate(rows):
        following, other = rows[(k + 1) % len(rows)]
        edited = t[: len(t) - len(t) // 3] + other[: len(t) // 3]
        e = editprints.embed([edited])[0]
        assert got[i] == (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), prints[i], e, editprints.likeness(prints[i], e), editprints.likeness(prints[i], prints[following]))
    assert np.mean([r[5] for r in got.values()]) > 0.6 > 0.4 > np.mean([r[6] for r in got.values()])


def test_fingerprint_walks(spark):
    def slow(text):
        classes, level, bits = editprints._classes(text), editprints._level(len(text)), editprints._bits()
        at = step = 0
        out = []
        while at < len(classes):
            if editprints._ranks(step + 1)[step] >= level:
                out.append(classes[at])
            at += int(bits[step % len(bits)][classes[at]])
            step += 1
        return f"{level:02x}" + bytes(out).hex()[1::2]

    random.seed(4)
    texts = ["", "a", "é😀"] + ["".join(random.choice("abcde fg") for _ in range(random.randrange(1, 2000))) for _ in range(40)]
    assert editprints.embed(texts) == [slow(t) for t in texts] == [editprints.embed([t])[0] for t in texts]


def test_fingerprint_odd_rows(spark):
    rows = editprints.against_edited(docs_of(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    assert all(r["fingerprint"] == "00" and r["n_chars"] == 0 for r in rows if r["doc_id"] in (2, 3))
    assert editprints.against_edited(docs_of(spark, ODD).limit(0)).count() == 0
    assert editprints.against_edited(docs_of(spark, [(1, "abc")])).first()["near_next"] == 1.0


def test_near_copies(spark):
    texts = [r["text"] for r in queries.table(spark, FOLDER, "documents").where("n_chars > 1500").orderBy("doc_id").limit(3).collect()]
    near = texts[0][:700] + "xy" + texts[0][703:]
    got = {r["doc_id"]: r["component_id"] for r in editprints.near_copies(docs_of(spark, [(1, texts[0]), (2, near), (3, texts[1]), (4, texts[0]), (5, texts[2])])).collect()}
    assert got == {1: 1, 2: 1, 4: 1}


def test_near_copies_with_changed_parts(spark):
    """Copies at a likeness of 0.8 or somewhat more, changed at the beginning, in the middle or at the end."""
    random.seed(4)

    def words(n):
        return "".join(random.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(n))

    rows, pairs = [], []
    for k in range(60):
        n = random.randrange(1000, 4000)
        base, part = words(n), n * 17 // 100
        at = (0, n // 2, n - part)[k % 3]
        rows += [(2 * k, base), (2 * k + 1, base[:at] + words(part) + base[at + part :])]
        a, b = editprints.embed([rows[-2][1], rows[-1][1]])
        if editprints.likeness(a, b) >= 0.8:
            pairs.append(k)
    got = {r["doc_id"]: r["component_id"] for r in editprints.near_copies(docs_of(spark, rows)).collect()}
    assert len(pairs) > 25 and sum(got.get(2 * k) == got.get(2 * k + 1) == 2 * k for k in pairs) >= 0.95 * len(pairs)


# ---- tokenizers


@pytest.fixture(scope="module")
def odd_texts():
    random.seed(3)
    alphabet = "aAbé ÉΣßσ'' \t\n  \u0085　\x1c\x1f reveдll12٣!?,.<|>İñ😀中"
    special = ["<|endoftext|>", "<|startoftext|>", "'re", "<|endof"]
    out = ["", " ", "<|endoftext|>", "don't  <|endoftext|>  we're\n\n"]
    for _ in range(1500):
        s = "".join(random.choice(alphabet) for _ in range(random.randrange(14)))
        out.append(s + random.choice(special) + random.choice(["", " ", "x"]) if random.random() < 0.3 else s)
    return out


def test_encoding_is_the_library_s(odd_texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = bpe.Vocabulary(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    for t in odd_texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_counts_at_every_prefix(odd_texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = bpe.Vocabulary(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    for t in odd_texts[:700]:
        want = [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        assert own.prefix_counts(t) == want
        pieces, totals = own.piece_totals(t)
        assert sum(totals) == want[-1]
        for limit in (0, 1, 3):
            assert own.fitting(t, pieces, totals, limit) == max(i for i, c in enumerate(want) if c <= limit)


def test_fitting_looks_at_the_end_only(monkeypatch):
    """The prefix that fits, without a count of each prefix before; spaces and special strings at the limit."""
    own = bpe.Vocabulary(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    looked = []
    plain = own.prefix_counts
    for text in ("many words of a long text " * 400, "a  b\n\n c <|endoftext|><|endoftext|>  d don't " * 150):
        pieces, totals = own.piece_totals(text)
        counts = plain(text)
        for limit in (700, 701, 702, 703, 704, 705, 706):
            monkeypatch.setattr(own, "prefix_counts", lambda t: looked.append(len(t)) or plain(t))
            assert own.fitting(text, pieces, totals, limit) == max(i for i, c in enumerate(counts) if c <= limit)
            monkeypatch.undo()
    assert len(looked) == 14 and max(looked) < 100


def test_token_queries(spark):
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, FOLDER, "documents").collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in queries.op7_bpe_encoding(spark, FOLDER).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert tuple(r)[1:] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in queries.op9_token_counts(spark, FOLDER).collect():
        n = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert tuple(r)[1:4] == (len(texts[r["doc_id"]].encode()), n, n > 1024)


def test_token_odd_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = bpe.token_counts(docs_of(spark, ODD), path, limit=3).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in ODD)
    assert {(r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows if r["doc_id"] in (2, 3)} == {(0, 0, False)}
    assert bpe.prefix_counts(docs_of(spark, ODD[:3]), path).first()["counts"][0] == 0
    word = public_tokenizers.path("word_bpe_49k.json")
    assert [r["ids"] for r in bpe.encode(docs_of(spark, ODD[1:3]), word).collect()] == [[], []]
    assert bpe.encode_digest(docs_of(spark, ODD).limit(0), word).count() == 0


# ---- languages


def test_language_accuracy_on_what_was_held_out(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd_rows(spark):
    found = langid.identify(docs_of(spark, ODD)).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, _ in ODD)
    assert {(r["lang_pred"], r["score"]) for r in found if r["doc_id"] in (2, 3, 4)} == {("und", 0.0)}
    assert langid.identify(docs_of(spark, ODD).limit(0)).count() == 0
    rows = langid.predict_rows(docs_of(spark, ODD).withColumn("score", F.lit("x")), {})
    assert {r["lang_pred"] for r in rows.collect()} == {"und"}


def slow_ngrams(text):
    """Packed n-grams of one to three letters by plain loops; a border is the greatest code."""
    out = Counter()
    word = []
    for c in [*text, " "]:
        if c.isalpha():
            low = c.lower()
            word.append(ord(low) if len(low) == 1 else ord(c))
            continue
        if word:
            edged = [langid.BORDER, *word, langid.BORDER]
            out.update(word)
            out.update(x << 21 | y for x, y in zip(edged, edged[1:]))
            out.update(x << 42 | y << 21 | z for x, y, z in zip(edged, edged[1:], edged[2:]))
        word = []
    return out


def test_language_by_slow_rankings(spark):
    """Every prediction and score against profiles and out-of-place distances by plain loops."""
    rows = queries.table(spark, FOLDER, "documents").collect()
    totals = defaultdict(Counter)
    for r in rows:
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            totals[r["lang"]].update(slow_ngrams(r["text"] or ""))
    size = langid.PROFILE_SIZE
    ranking = lambda counts: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][:size]
    profiles = {name: {g: k for k, g in enumerate(ranking(c))} for name, c in totals.items() if c}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries.op8_language_id(spark, FOLDER).collect()}
    for r in rows:
        own = ranking(slow_ngrams(r["text"] or ""))
        if not own:
            assert got[r["doc_id"]] == ("und", 0.0)
            continue
        distance = {name: sum(min(abs(ranks[g] - k), size) if g in ranks else size for k, g in enumerate(own)) for name, ranks in profiles.items()}
        best = min(sorted(distance), key=distance.get)
        assert got[r["doc_id"]] == (best, pytest.approx(1 - distance[best] / (size * len(own))))


# ---- decontamination


def test_decontamination(spark):
    docs = queries.table(spark, FOLDER, "documents")
    items = queries.table(spark, FOLDER, "benchmark")
    some = [(9001, "THE and"), (9002, None), (9003, "..."), (9004, "OF the"), (9005, items.first()["text"])]
    items = items.unionByName(spark.createDataFrame(some, "item_id long, text string"))
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000, None), (10_001, "É x"), (10_002, "")], "doc_id long, text string"))
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = defaultdict(set)
    for r in items.collect():
        w = word.findall(low(r["text"]))
        k = min(10, len(w))
        for i in range(len(w) - k + 1) if w else ():
            windows[tuple(w[i : i + k])].add(str(r["item_id"]))
    want = {}
    for r in docs.collect():
        w, hit, found = word.findall(low(r["text"])), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (t := tuple(w[i : i + k])) in windows:
                    hit |= {*range(i, i + k)}
                    found |= windows[t]
        want[r["doc_id"]] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    got = {r["doc_id"]: tuple(r)[1:6] for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == want


def test_decontamination_shuffled_and_odd(spark, monkeypatch):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    rows = [*ODD, (7, "zero One two three four five six seven eight nine TEN eleven twelve")]
    small = {(r["doc_id"], r["n_hit"]) for r in decontaminate.decontaminate(docs_of(spark, rows), items).collect()}
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    large = decontaminate.decontaminate(docs_of(spark, rows), items).collect()
    assert {(r["doc_id"], r["n_hit"]) for r in large} == small and (7, 11) in small and len(large) == len(rows)
    assert not any(r["contaminated"] for r in decontaminate.decontaminate(docs_of(spark, rows), items.limit(0)).collect())
    assert decontaminate.decontaminate(docs_of(spark, rows).limit(0), items).count() == 0


def test_decontamination_of_rows_that_share_an_id(spark):
    """Each row by its own text; clashing and repeated item columns change nothing."""
    item = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(1, item, "x", 1), (1, item, "y", 2), (2, item, "z", 3)], "item_id long, text string, w string, version long")
    rows = [(7, f"zero {item} eleven"), (7, "nothing of it here"), (7, "nothing of it here")]
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.decontaminate(docs_of(spark, rows), items).collect())
    assert got == Counter({(7, 12, 10, 2): 1, (7, 4, 0, 0): 2})


# ---- lines and paragraphs


def jaccard_groups(texts, shingles):
    """Components of distinct texts at a similarity of 0.8."""
    sets = [shingles(t) for t in texts]
    union = Union(len(texts))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and (k := len(a & b)) >= 0.8 * (len(a) + len(b) - k) - 1e-9:
                union.join(i, j)
    return {t: union.root(k) for k, t in enumerate(texts)}


def test_line_dedup_query_against_five_characters(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in queries.table(spark, FOLDER, "documents").collect())
    distinct = list(dict.fromkeys(x for _, t in docs for x in t.split("\n") if x.strip(" ")))
    group = jaccard_groups(distinct, lambda x: {x[i : i + 5] for i in range(len(x) - 4)})
    seen, want = set(), {}
    for i, t in docs:
        kept = []
        for x in t.split("\n"):
            if not x.strip(" ") or group[x] not in seen:
                kept.append(x)
            seen.add(group.get(x))
        want[i] = "\n".join(kept)
    assert {r["doc_id"]: r["text"] for r in queries.op6_line_dedup(spark, FOLDER).collect()} == want


def test_line_dedup_odd_rows(spark):
    line = "a line of some length that comes again and again, nearly the same"
    rows = [*ODD, (7, f"{line}\n\nshort\n{line}!"), (8, f"short\n{line.upper()}\n\n{line}")]
    out = lines.dedup(docs_of(spark, rows))
    assert out.columns == [*docs_of(spark, rows).columns, "n_lines", "n_removed"]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()}
    assert got[7] == (f"{line}\n\nshort", 3, 1) and got[8] == (f"{line.upper()}\n", 3, 2)
    assert got[2] == (None, 0, 0) and got[3] == ("", 0, 0) and got[5] == ("", 1, 1) and got[None] == ("No id here.", 1, 0)
    assert lines.dedup(docs_of(spark, rows).limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    """An id on two different texts: a repeated line of one takes nothing from the other."""
    line = "a line of some length that comes again and again"
    rows = [(1, f"{line}\nfirst of its own"), (2, f"{line}\nsecond text of the id"), (2, f"another beginning altogether\n{line}")]
    got = Counter((r["doc_id"], r["text"]) for r in lines.dedup(docs_of(spark, rows)).collect())
    assert got == Counter([rows[0], (2, "second text of the id"), (2, "another beginning altogether")])


def test_settled_and_written_ways_agree(spark, monkeypatch):
    """The ways for few and for many rows give the same components."""
    from bibloom.llm import common

    random.seed(11)
    base = ["".join(random.choice("abcdefgh ") for _ in range(90)) for _ in range(6)]
    rows = []
    for k in range(120):
        x = list(base[k % 6])
        x[random.randrange(90)] = random.choice("xyz")
        rows.append((k, "".join(x)))
    few = Counter(r["text"] for r in lines.dedup(docs_of(spark, rows)).collect())
    monkeypatch.setattr(common, "LIGHT_ROWS", 0)
    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    assert Counter(r["text"] for r in lines.dedup(docs_of(spark, rows)).collect()) == few
    group = jaccard_groups([t for _, t in rows], lambda x: {x[i : i + 5] for i in range(len(x) - 4)})
    assert sum(1 for t in few.elements() if t) == len(set(group.values()))


def test_many_near_lines_are_one_component(spark):
    """A group of copies larger than a block, each with an edit of its own."""
    random.seed(5)
    base = ["".join(random.choice("abcdefgh ") for _ in range(12)) for _ in range(24)]
    rows = []
    for k in range(150):
        parts = list(base)
        parts[random.randrange(24)] = f"{k:06d}"
        rows.append((k, " ".join(parts)))
    texts = [t for _, t in rows]
    want = jaccard_groups(texts, lambda x: {x[i : i + 5] for i in range(len(x) - 4)})
    removed = sum(r["n_removed"] for r in lines.dedup(docs_of(spark, rows)).collect())
    assert removed == len(texts) - len(set(want.values()))


def test_lines_with_one_changed_character_are_similar(spark):
    random.seed(6)
    rows = []
    for k in range(60):
        line = "".join(random.choice("abcdefghijklmnop ") for _ in range(random.randrange(52, 80))).strip().ljust(52, "x")
        rows += [(2 * k, line), (2 * k + 1, f"{line[:25]}#{line[26:]}")]
    removed = {r["doc_id"]: r["n_removed"] for r in lines.dedup(docs_of(spark, rows)).collect()}
    assert sum(removed[2 * k + 1] for k in range(60)) >= 58 and not any(removed[2 * k] for k in range(60))


def test_recall_of_short_lines(spark):
    """Lines of 20 to 40 characters and longer copies at a similarity of 0.8 to 0.85."""
    random.seed(7)
    rows = []
    for k in range(200):
        line = "".join(random.choice("abcdefghijklmnopqrstuvw") for _ in range(random.randrange(20, 41)))
        n = len(line) - 4
        rows += [(2 * k, line), (2 * k + 1, line + "".join(random.choice("xyz0123456789") for _ in range(n // 4)))]
    removed = {r["doc_id"]: r["n_removed"] for r in lines.dedup(docs_of(spark, rows)).collect()}
    found = sum(removed[2 * k + 1] for k in range(200))
    print("recall", found / 200)
    assert found >= 190


def spans_of(rows):
    """For each (document, text): the words that its rows cover."""
    out = defaultdict(set)
    for r in rows:
        out[r["doc_id"]].update(range(r["word"], r["word"] + r["n_words"]))
    return out


def test_passage_query(spark):
    """Every run of 51 words that two texts share is covered in both, and nothing is reported but
    such runs, passages that are similar to another, and whole texts of fewer words that another
    document has too."""
    docs = {r["doc_id"]: (r["text"] or "").lower().split() for r in queries.table(spark, FOLDER, "documents").collect()}
    windows = defaultdict(set)
    for i, words in docs.items():
        for k in range(len(words) - 50):
            windows[tuple(words[k : k + 51])].add(i)
    rows = queries.op1_substring_dedup(spark, FOLDER).collect()
    covered = spans_of(rows)
    shared = {i: {k for k in range(len(w) - 50) if len(windows[tuple(w[k : k + 51])]) > 1} for i, w in docs.items()}
    assert sum(map(len, shared.values())) > 1000
    for i, starts in shared.items():
        assert all(set(range(k, k + 51)) <= covered[i] for k in starts)
    sets = {w: {w[k : k + 5] for k in range(47)} for w in windows}
    by_shingle = defaultdict(set)
    for w, s in sets.items():
        for x in s:
            by_shingle[x].add(w)
    wholes = Counter(tuple(w) for w in docs.values())

    @functools.cache
    def like_another(i, m):
        common = Counter(w for x in sets[m] for w in by_shingle[x])
        return any(n >= 0.8 * (len(sets[m]) + len(sets[w]) - n) and windows[w] != {i} for w, n in common.items())

    for i, places in covered.items():
        exact = {p for k in shared[i] for p in range(k, k + 51)}
        if len(docs[i]) < 51:
            assert wholes[tuple(docs[i])] > 1 and places == set(range(len(docs[i])))
            continue
        for p in sorted(places - exact):
            assert any(like_another(i, tuple(docs[i][k : k + 51])) for k in range(max(0, p - 50), min(p, len(docs[i]) - 51) + 1))
    for r in rows:
        assert r["removed"] == (r["first_doc"] != r["doc_id"])


def test_passages_that_are_similar(spark):
    """Passages of 300 words with a word changed in every 45, planted in texts of their own, share
    no 51 words; each text has several paragraphs that are similar to the other's."""
    random.seed(8)
    own = lambda n: [f"w{random.randrange(10**9)}" for _ in range(n)]
    rows = []
    for k in range(100):
        passage = own(300)
        near = [w if n % 45 != 20 else f"x{n}" for n, w in enumerate(passage)]
        rows += [(2 * k, " ".join(own(random.randrange(80)) + passage + own(40))), (2 * k + 1, " ".join(own(random.randrange(80)) + near + own(40)))]
    found = {r["doc_id"] for r in paragraphs.repeated_passages(docs_of(spark, rows)).collect()}
    recall = sum({2 * k, 2 * k + 1} <= found for k in range(100)) / 100
    print("recall", recall)
    assert recall >= 0.9


@pytest.mark.parametrize("inserted", [False, True])
def test_recall_of_similar_passages(spark, inserted):
    """Pairs of passages planted in texts of their own, a word changed (or put in) in every 51 of
    them: all those whose 51-word paragraphs brute force finds similar, of any length, and the
    spans lie where the passage is."""
    random.seed(10)
    own = lambda n: [f"w{random.randrange(10**9)}" for _ in range(n)]
    sets = lambda w: [{tuple(w[k + j : k + j + 5]) for j in range(47)} for k in range(len(w) - 50)]
    rows, lengths, bounds = [], {}, {}
    for k in range(200):
        size = (51, 60, 80, 100, 150)[k % 5]
        passage, near = own(size), []
        changed = {random.randrange(51) + 51 * j for j in range(size // 51)} if size % 51 else {random.randrange(51)}
        changed = {c for c in changed if c < size}
        for n, w in enumerate(passage):
            near += [f"x{n}"] if n in changed and not inserted else [f"x{n}", w] if n in changed else [w]
        before, after = own(random.randrange(1, 80)), own(random.randrange(1, 80))
        other = own(random.randrange(1, 80))
        a, b = before + passage + after, other + near + own(30)
        one, two = sets(passage), sets(near)
        if any(len(x & y) >= 0.8 * len(x | y) for x in one for y in two):
            lengths[k] = size
            bounds |= {2 * k: (len(before), len(before) + len(passage)), 2 * k + 1: (len(other), len(other) + len(near))}
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    assert set(lengths.values()) == {51, 60, 80, 100, 150}
    found = spans_of(paragraphs.repeated_passages(docs_of(spark, rows)).collect())
    for size in (51, 60, 80, 100, 150):
        mine = [k for k in lengths if lengths[k] == size]
        recall = sum({2 * k, 2 * k + 1} <= set(found) for k in mine) / len(mine)
        print("words", size, "pairs", len(mine), "recall", recall)
        assert recall >= (0.9 if not inserted or size > 60 else 0.4)
    for i, (lo, end) in bounds.items():
        assert found.get(i, set()) <= set(range(lo - 6, end + 6))


def test_passages_across_short_lines_and_inside_long_ones(spark):
    """Passages of 51 words, in lines of seven words and within a line of 300; 50 words are none."""
    random.seed(9)

    def own(n):
        return [f"w{random.randrange(10**9)}" for _ in range(n)]

    def short(words):
        return "\n".join(" ".join(words[k : k + 7]) for k in range(0, len(words), 7))

    a, b = own(51), own(51)
    rows = [*ODD, (7, short(own(30) + a + own(20))), (8, short(own(11) + a + own(9))), (9, " ".join(own(120) + b + own(129))), (10, short(own(3) + b)), (11, " ".join(own(300)))]
    rows.append((12, " ".join(own(40) + b[:50] + own(40))))
    found = paragraphs.repeated_passages(docs_of(spark, rows)).collect()
    got = {(r["doc_id"], r["word"], r["n_words"], r["first_doc"], r["first_word"], r["removed"]) for r in found if r["doc_id"] > 6}
    exact = {(7, 30, 51, 7, 30, False), (8, 11, 51, 7, 30, True), (9, 120, 51, 9, 120, False), (10, 3, 51, 9, 120, True)}
    assert exact <= got and {i for i, *_ in got - exact} <= {12, 9, 10}
    left = {r["doc_id"]: r["text"].split() for r in paragraphs.dedup(docs_of(spark, rows)).where("doc_id >= 7").collect()}
    assert left[8] == rows[9][1].split()[:11] + rows[9][1].split()[62:] and left[10] == rows[11][1].split()[:3]
    assert all(left[i] == dict(rows)[i].split() for i in (7, 9, 11))


def test_passage_odd_rows(spark):
    passage = " ".join(f"word{k}" for k in range(60))
    other = " ".join(f"other{k}" for k in range(60))
    rows = [*ODD, (7, f"x\n{passage}"), (8, passage.upper().replace(" ", "  ")), (9, passage + " more"), (9, passage + " more"), (9, other), (10, other), (None, passage)]
    found = paragraphs.repeated_passages(docs_of(spark, rows)).where("doc_id > 6").collect()
    got = Counter((r["doc_id"], r["word"], r["n_words"], r["first_doc"], r["first_word"], r["removed"]) for r in found)
    assert got == Counter([(7, 1, 60, 7, 1, False), (8, 0, 60, 7, 1, True), (9, 0, 60, 7, 1, True), (9, 0, 60, 9, 0, False), (10, 0, 60, 9, 0, True)])
    left = Counter((r["doc_id"], r["text"].strip()) for r in paragraphs.dedup(docs_of(spark, rows)).where("doc_id >= 7").collect())
    assert left == Counter([(7, f"x\n{passage}"), (8, ""), (9, "more"), (9, "more"), (9, other), (10, "")])
    assert paragraphs.repeated_passages(docs_of(spark, rows).limit(0)).count() == 0


# ---- quotes


def test_quotes(spark):
    rows = [
        (1, 0, "u", "Hello there.\nHow are you?"), (1, 1, "a", "A second topic."), (1, 2, "b", "> hello  there.\n> How are you?\nFine!"),
        (1, 3, "c", ">> Hello there.\n> Fine!\n\nGood."), (1, 4, "d", "> A second topic.\nyes"), (1, 5, "e", "> unknown\nhm"),
        (2, 0, "u", None), (2, 0, "u", None), (2, None, "u", "z"), (None, 0, "x", "> q"), (3, 0, "a", ""), (3, 1, "b", "word " * 20_000),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, hash string, level int")
    got = [tuple(r) for r in quotes.link(df).where("conv_id = 1").orderBy("position").collect()]
    assert got == [
        (1, 0, 0, "u", "Hello there.\nHow are you?", None, 0, 0, 0, 0),
        (1, 1, 2, "b", "Fine!", 0, 1, 0, 2, 2),
        (1, 2, 3, "c", "Good.", 2, 2, 0, 2, 2),
        (1, 3, 1, "a", "A second topic.", None, 0, 1, 0, 0),
        (1, 4, 4, "d", "yes", 1, 1, 1, 1, 1),
        (1, 5, 5, "e", "hm", None, 0, 5, 1, 0),
    ]
    assert quotes.link(df).count() == len(rows)
    assert quotes.link(df.limit(0)).count() == 0


def test_conversations_keep_their_order(spark):
    rows = queries.op5_chat_formatting(spark, FOLDER).collect()
    assert len(rows) == queries.table(spark, FOLDER, "conversations").count()
    assert all(r["position"] == r["turn"] and r["reply_to"] is None for r in rows)


def test_quotes_by_slow_linking(spark):
    """Generated threads with nested quotes, some of them altered, against a linker of plain loops."""
    random.seed(12)
    phrase = lambda: " ".join(random.choice(["red", "green", "blue", "owl", "cat"]) for _ in range(random.randrange(2, 5)))
    rows = []
    for conv in range(30):
        said = []
        for turn in range(8):
            body = []
            if said and random.random() < 0.8:
                quoted = random.choice(said).split("\n")
                quoted = quoted[: random.randrange(1, len(quoted) + 1)]
                body += [("> " if random.random() < 0.5 else ">") + x for x in quoted]
                if random.random() < 0.2:
                    body[-1] += " changed"
            body += [phrase() for _ in range(random.randrange(1, 4))]
            said.append("\n".join(body))
            rows.append((conv, turn, "u", said[-1]))
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    plain = lambda x: " ".join(x.lower().split())

    def parsed(text):
        out = []
        for line in text.split("\n"):
            mark = re.match(r"[ \t]*((?:>[ \t]?)+)", line)
            out.append((mark[1].count(">") if mark else 0, line[mark.end() :] if mark else line))
        runs = []
        for level, line in out:
            if runs and runs[-1][0] == level:
                runs[-1][1].append(line)
            else:
                runs.append((level, [line]))
        single = [(level, plain(line), False) for level, line in out if plain(line)]
        return out, single + [(level, plain(" ".join(x)), True) for level, x in runs if len(x) > 1 and plain(" ".join(x))]

    links = 0
    for conv in range(30):
        texts = [t for c, _, _, t in rows if c == conv]
        first = {}
        for turn, t in enumerate(texts):
            for level, x, _ in parsed(t)[1]:
                if level == 0:
                    first.setdefault(x, turn)
        parent = {}
        for turn, t in enumerate(texts):
            out, parts = parsed(t)
            hits = [(level, first[x], whole) for level, x, whole in parts if level and first.get(x, turn) < turn]
            votes = Counter(o for level, o, _ in hits if level == 1)
            parent[turn] = max(votes, key=lambda o: (votes[o], o)) if votes else None
            r = got[conv, turn]
            assert r["content"] == "\n".join(x for level, x in out if level == 0).strip()
            assert (r["n_quotes"], r["n_linked"]) == (sum(1 for level, _, whole in parts if level and not whole), sum(not whole for *_, whole in hits))
            depth, top = 0, turn
            while parent[top] is not None:
                depth, top = depth + 1, parent[top]
            # depth, root and reply_to are null or zero where nothing is quoted
            assert (r["reply_to"], r["depth"], r["root"]) == (parent[turn], depth, top)
            links += parent[turn] is not None
    assert links > 50


def test_short_copies_are_reported(spark):
    """Equal texts of fewer words than a paragraph are copies too; columns may have any names."""
    rows = [(1, "five words are too few"), (2, "five words are too few"), (3, "other words"), (4, ""), (5, " \n"), (6, " \n")]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, _doc int, _md5 int, _spans int, n_spans int")
    found = {(r["doc_id"], r["word"], r["n_words"], r["first_doc"], r["removed"]) for r in paragraphs.repeated_passages(df).collect()}
    assert found == {(1, 0, 5, 1, False), (2, 0, 5, 1, True)}
    left = {r["doc_id"]: (r["text"], r["n_spans"], r["_doc"], r["_md5"], r["_spans"]) for r in paragraphs.dedup(df).collect()}
    assert left == {1: (rows[0][1], 0, 1, 2, 3), 2: ("", 1, 1, 2, 3), **{i: (t, 0, 1, 2, 3) for i, t in rows[2:]}}


def test_lines_with_any_columns(spark):
    df = spark.createDataFrame([(1, "a line of some words\nanother one", 1, 2, 3), (2, "a line of some words\nthird", 4, 5, 6)], "doc_id long, text string, _gone int, _doc int, _VERSION int")
    found = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"], r["_gone"], r["_doc"], r["_VERSION"]) for r in lines.dedup(df).collect()}
    assert found == {1: (df.first()["text"], 2, 0, 1, 2, 3), 2: ("third", 2, 1, 4, 5, 6)}
