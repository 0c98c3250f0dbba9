"""Alignment of two tokenizers over the same bytes, by a sweep over the ends of their tokens.

Both tokenizers cut the bytes of a text. Where tokens of both end at one offset, a group ends: the
least stretch that both spell with whole tokens. Two tokens are linked where their bytes overlap;
each such pair is one stretch between two neighbouring ends, of whichever tokenizer.

An event is the end of a token. Events are packed by side and block of the text: the ids of some
thousand tokens in order, with the offset at which the first begins; the ends follow from the
tokens' lengths, which belong to the vocabulary. The events of both sides are dealt out by
document and sorted by offset, and a machine goes through them once. What it keeps of a document
is the open group, the tokens since the last offset where both sides ended.

Links of one id pair are counted over the whole corpus; a link is best where no other pair of its
B id has a higher count.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibloom.llm.bpe import BYTE_LEVEL_SPLIT, byte_symbols
from bibloom.llm.common import SLICE_ROWS, materialize, shuffles_removed

#: Tokens of a block of events.
BLOCK = 1 << 14
#: Bits of a pair's code that the B id takes.
B_BITS = 16
#: Pairs with their counts that are broadcast, 40 bytes or so each; more are joined by a shuffle.
BROADCAST_PAIRS = 1_000_000
#: Texts that are encoded at a time.
_TEXTS = 64


class ByteLevel:
    """A byte-level BPE file of the tokenizers library; special strings are plain text."""

    def __init__(self, path: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        codes = {s: b for b, s in enumerate(byte_symbols())}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(codes[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        self.encoding = tiktoken.Encoding(path, pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.bytes[i] = raw

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(t) for t in texts]


class Pieces:
    """A sentencepiece model; its own prefix space is part of what it spells."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            self.model = sentencepiece.SentencePieceProcessor(model_proto=f.read())
        size = self.model.get_piece_size()
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.model.id_to_piece, range(size)))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def tokenizer(path: str) -> ByteLevel | Pieces:
    return Pieces(path) if path.endswith(".model") else ByteLevel(path)


_loaded: dict[str, ByteLevel | Pieces] = {}


def _own(path: str) -> ByteLevel | Pieces:
    """The tokenizer of this path, loaded once in each Python process."""
    if path not in _loaded:
        _loaded[path] = tokenizer(path)
    return _loaded[path]


def _lengths(vocabulary: list[bytes]) -> np.ndarray:
    return np.array([len(b) for b in vocabulary], np.int64)


# ---- events


def events(docs: DataFrame, path_a: str, path_b: str, id_col: str, text: str) -> DataFrame:
    """(id, digest, part, side, start, ids): the packed ends of the tokens of every text, side 0
    for A and 1 for B, by their first token's offset; of a text without tokens one row without ids.

    A document is told by its id, a digest of its text and the task that read it; equal rows of
    one task have equal events.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    side = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("digest"), F.spark_partition_id().alias("part"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = (_own(path_a), _own(path_b))
        lengths = [_lengths(s.bytes) for s in sides]
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for lo in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(lo, _TEXTS)
                texts = part.column(3).to_pylist()
                coded = (sides[0].encode([" " + (t or "") for t in texts]), sides[1].encode([t or "" for t in texts]))
                rows, which, starts, packed = [], [], [], []
                for k, t in enumerate(texts):
                    raw = (" " + t).encode() if t else b""
                    sound = raw and all(b"".join(map(s.bytes.__getitem__, ids[k])) == raw for s, ids in zip(sides, coded, strict=True))
                    for n in (0, 1) if sound else (0,):
                        ids = np.array(coded[n][k] if sound else [], np.uint32)
                        start = 0
                        for at in range(0, max(len(ids), 1), BLOCK):
                            block = ids[at : at + BLOCK]
                            rows.append(k)
                            which.append(n)
                            starts.append(start)
                            packed.append(packer.compress(block.astype("<u2" if len(sides[n].bytes) <= 1 << 16 else "<u4").tobytes()) if len(block) else b"")
                            start += int(lengths[n][block].sum())
                keys = [part.column(c).take(pa.array(rows)) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(which, pa.int32()), pa.array(starts, pa.int64()), pa.array(packed, pa.binary())], names=["id", "digest", "part", "side", "start", "ids"])

    return side.mapInArrow(run, f"id {kind}, digest binary, part int, side int, start bigint, ids binary")


# ---- the sweep


class _Sweep:
    """Groups and links of one document, from the events of both sides in order of their offsets.

    Kept are the open group, as the ids of both sides from the last common end on, and sums over
    what is closed: the hash of the groups, and how often each id pair was linked.
    """

    def __init__(self, shared: _Shared):
        self.shared = shared
        self.open = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.n = [0, 0]
        self.n_groups = self.n_links = 0
        self.hash = hashlib.sha256()
        self.codes: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.kept = 0

    def add(self, side: int, ids: np.ndarray) -> None:
        """More tokens of one side; both sides go on from the same offset."""
        self.open[side] = np.concatenate([self.open[side], ids.astype(np.int64)]) if len(self.open[side]) else ids.astype(np.int64)
        self.n[side] += len(ids)
        a, b = self.open
        if not len(a) or not len(b):
            return
        ends_a, ends_b = np.cumsum(self.shared.lengths[0][a]), np.cumsum(self.shared.lengths[1][b])
        at_a = np.searchsorted(ends_a, ends_b)  # for each B end the A token that spans it
        common = np.flatnonzero(ends_a[np.minimum(at_a, len(a) - 1)] == ends_b)
        if not len(common):
            return
        last_b, last_a = common[-1] + 1, at_a[common[-1]] + 1
        closing_a, closing_b = at_a[common], common
        self._groups(a[:last_a], b[:last_b], closing_a, closing_b)
        ends = np.union1d(ends_a[:last_a], ends_b[:last_b])
        pairs = a[np.searchsorted(ends_a, ends)] << B_BITS | b[np.searchsorted(ends_b, ends)]
        self.n_links += len(pairs)
        self.n_groups += len(common)
        codes, times = np.unique(pairs, return_counts=True)
        self.codes.append(codes)
        self.times.append(times)
        self.kept += len(codes)
        if self.kept > 1 << 20:
            self._fold()
        self.open = [a[last_a:], b[last_b:]]

    def _groups(self, a: np.ndarray, b: np.ndarray, closing_a: np.ndarray, closing_b: np.ndarray) -> None:
        """Write closed groups into the hash: ids, after each a comma or what ends its side."""
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[closing_a] = mark_b[closing_b] = 1
        group_a, group_b = np.cumsum(mark_a) - mark_a, np.cumsum(mark_b) - mark_b
        # a token's place: its own side's tokens before it, and the other's of the groups before
        out = np.empty(len(a) + len(b), object)
        before_b = np.concatenate([[0], closing_b + 1])
        out[np.arange(len(a)) + before_b[group_a]] = self.shared.strings[0][mark_a, a]
        out[np.arange(len(b)) + closing_a[group_b] + 1] = self.shared.strings[1][mark_b, b]
        text = b"".join(out.tolist())
        self.hash.update((b";" if self.n_groups else b"") + text[:-1])

    def _fold(self) -> None:
        codes, place = np.unique(np.concatenate(self.codes), return_inverse=True)
        self.times = [np.bincount(place, np.concatenate(self.times)).astype(np.int64)]
        self.codes, self.kept = [codes], len(codes)

    def result(self) -> tuple:
        if len(self.codes) > 1:
            self._fold()
        none = np.zeros(0, np.int64)
        codes, times = (self.codes[0], self.times[0]) if self.codes else (none, none)
        return (*self.n, self.n_groups, self.n_links, self.hash.hexdigest() if self.n_groups else "", codes, times)


class _Shared:
    """What all documents' sweeps read: lengths of the tokens, and their decimal ids with what
    follows inside a group (a comma) and at a group's end of the side."""

    def __init__(self, vocabularies: list[list[bytes]]):
        self.lengths = [_lengths(v) for v in vocabularies]
        self.strings = []
        for v, end in zip(vocabularies, (b"|", b";"), strict=True):
            table = np.empty((2, len(v)), object)
            for i in range(len(v)):
                table[0, i], table[1, i] = b"%d," % i, b"%d" % i + end
            self.strings.append(table)


def sweep(packed: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row for each document of ``events``: id, copies (equal rows of one task), n_a, n_b,
    n_groups, n_links, groups_sha256, codes and times (its id pairs, and how often each is linked)."""
    kind = packed.schema["id"].dataType.simpleString()
    document = ["id", "digest", "part"]
    dealt = packed.repartition(*document).sortWithinPartitions(*document, "start", "side")
    names = ["id", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = (_own(path_a), _own(path_b))
        shared = _Shared([s.bytes for s in sides])
        width = ["<u2" if len(s.bytes) <= 1 << 16 else "<u4" for s in sides]
        unpacker = zstandard.ZstdDecompressor()
        kinds = [None, *[pa.int64()] * 5, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        now, state, copies, seen, done = None, None, 0, None, []

        def rows() -> pa.RecordBatch:
            kinds[0] = id_kind
            columns = [pa.array(c, t) for c, t in zip(zip(*done), kinds, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            id_kind = batch.schema.field(0).type
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                for i, digest, part, side, start, ids in zip(*(c.to_pylist() for c in batch.slice(lo, SLICE_ROWS).columns), strict=True):
                    if (i, digest, part) != now:
                        if now is not None:
                            done.append((now[0], copies, *state.result()))
                        now, state, copies, seen = (i, digest, part), _Sweep(shared), 0, None
                    copies += side == 0 and start == 0
                    if (start, side) == seen:  # of a copy
                        continue
                    seen = (start, side)
                    if ids:
                        state.add(side, np.frombuffer(unpacker.decompress(ids), width[side]))
                if done:
                    yield rows()
        if now is not None:
            done.append((now[0], copies, *state.result()))
            yield rows()

    figures = ", ".join(f"{c} bigint" for c in names[1:6])
    return dealt.mapInArrow(run, f"id {kind}, {figures}, groups_sha256 string, codes array<bigint>, times array<int>")


def pair_counts(documents: DataFrame) -> DataFrame:
    """(code, n, best) of all linked id pairs of the corpus: their links, and whether no pair of the
    same B id has more."""
    each = documents.select("copies", F.explode(F.arrays_zip("codes", "times")).alias("p"))
    counts = each.groupBy(F.col("p.codes").alias("code")).agg(F.sum(F.col("p.times") * F.col("copies")).alias("n"))
    counts = materialize(counts, "pair-counts")
    b = F.col("code").bitwiseAND((1 << B_BITS) - 1)
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return materialize(counts.withColumn("b", b).join(most, "b").select("code", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """How two tokenizers' tokens of each text line up: id_col, n_a, n_b (tokens), n_groups, n_links,
    n_best (links whose pair has the highest count of its B id in the corpus, ties included),
    count_sum (over the links, their pair's count), groups_sha256 of ``a1,a2|b1;a3|b2,b3``.

    ``path_a`` is a byte-level BPE file, which encodes the text after a space, ``path_b`` a
    sentencepiece model, which adds the space itself. Texts that are null or empty, and those that
    either side doesn't spell byte for byte, have no tokens: zeros and an empty groups_sha256. Every
    row counts, repeated ones too; a null id is an id. Further columns, of whatever name, are dropped,
    an empty table gives an empty result, and a text of any length is taken whole.
    """
    spark = docs.sparkSession
    with shuffles_removed(spark):
        found = sweep(events(docs, path_a, path_b, id_col, text), path_a, path_b).withColumn("row", F.monotonically_increasing_id())
        found = materialize(found, "alignments", compression="zstd")
        pairs = pair_counts(found)
    if pairs.count() <= BROADCAST_PAIRS:
        pairs = F.broadcast(pairs)
    each = found.select("row", F.explode(F.arrays_zip("codes", "times")).alias("p")).select("row", F.col("p.codes").alias("code"), F.col("p.times").cast("bigint").alias("times"))
    sums = each.join(pairs, "code").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    every = found.drop("codes", "times").join(sums, "row", "left")
    every = every.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return every.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
