"""Alignment of two tokenizers against brute force with the libraries."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from bibloom.llm import alignment, queries

FOLDER = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    codes = {}
    spare = 0x100
    for x in range(256):
        if 0x21 <= x <= 0x7E or 0xA1 <= x <= 0xAC or x >= 0xAE:
            codes[chr(x)] = x
        else:
            codes[chr(spare)] = x
            spare += 1
    strings = {i: bytes(codes[c] for c in s) for s, i in json.load(open(A))["model"]["vocab"].items() if i != 50256}
    return a, b, strings


def tokens_of(text, libraries):
    a, b, strings = libraries
    if not text:
        return [], []
    left = [(i, strings[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    return (left, right) if all(b"".join(x[1] for x in side) == raw for side in (left, right)) else ([], [])


def brute(docs, libraries):
    links, rows = {}, []
    for k, (i, text) in enumerate(docs):
        left, right = tokens_of(text, libraries)
        spans = []
        for side in (left, right):
            at, out = 0, []
            for n, raw in side:
                out.append((at, at + len(raw), n))
                at += len(raw)
            spans.append(out)
        both = {e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}
        groups, start = [], 0
        for end in sorted(both):
            groups.append("|".join(",".join(str(n) for s, e, n in side if start <= s and e <= end) for side in spans))
            start = end
        found, low = [], 0
        for s, e, n in spans[0]:
            while low < len(spans[1]) and spans[1][low][1] <= s:
                low += 1
            j = low
            while j < len(spans[1]) and spans[1][j][0] < e:
                found.append((n, spans[1][j][2]))
                j += 1
        links[k] = found
        rows.append([i, len(left), len(right), len(groups), len(found), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""])
    counts = Counter(p for f in links.values() for p in f)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(*r[:5], sum(counts[p] == most[p[1]] for p in links[k]), sum(counts[p] for p in links[k]), r[5]) for k, r in enumerate(rows)]


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_alignment_query(spark, libraries):
    docs = [tuple(r) for r in queries.table(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    got = queries.op11_token_alignment(spark, FOLDER)
    assert got.dtypes == [("doc_id", "bigint"), *[(c, "bigint") for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", "string")]
    want = brute(docs, libraries)
    assert in_order(got.collect()) == in_order(want) and sum(r[3] > 0 for r in want) > 150


@pytest.mark.parametrize("block", [alignment.BLOCK, 3])
@pytest.mark.parametrize("pairs", [alignment.BROADCAST_PAIRS, 0])
def test_odd_rows(spark, libraries, monkeypatch, block, pairs):
    """Nulls, empty texts, bytes and spaces that one side spells otherwise, special strings, copies,
    an id on several texts, a long text, further columns; small blocks, and pairs not broadcast."""
    monkeypatch.setattr(alignment, "BLOCK", block)
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", pairs)
    random.seed(5)
    letters = "aAbé ÉΣßσ'' \t\n  \u0085▁ellreveed12٣!?,.<|>İñ😀中"
    docs = [(1, None), (2, ""), (3, " "), (4, "two words"), (5, "two words"), (5, "two words"), (5, "other"), (None, "two words"), (None, "two words"), (6, "a  b\tc"), (7, "<|endoftext|></s> <0x41>"), (8, "long texts " * 4_000 + "end"), (9, "ﬁn"), (10, "😀中 x"), (11, "▁")]
    docs += [(100 + k, "".join(random.choice(letters) for _ in range(random.randrange(1, 30)))) for k in range(120)]
    docs += [(300 + k, " ".join(random.choices("deutsche Wörter übersetzen unbelievable tokenization naïve 12345 3.14".split(), k=12))) for k in range(60)]
    df = spark.createDataFrame([(*d, "x", "y", 1, 2, 3) for d in docs], "doc_id long, text string, id string, digest string, part int, n long, codes int").repartition(3, "digest")
    got = alignment.align(df, A, B)
    want = brute(docs, libraries)
    assert in_order(got.collect()) == in_order(want) and sum(r[3] > 0 for r in want) > 60
    assert alignment.align(df.limit(0), A, B).count() == 0
