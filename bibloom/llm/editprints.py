"""Document fingerprints by a randomised embedding of edit distance into Hamming distance.

Every text is walked by the same random walk: at step j the walk stands at a character, writes
it down, and goes on to the next one or stays, by a random bit shared by all texts for (j,
character). Texts with few edits between them soon write the same characters at the same steps
again, so their edit distance shows as a Hamming distance of what they write.

The fingerprint keeps a sample of the steps: those whose shared random rank is at least the
text's level, which is chosen by its length so that 128 to 256 steps are kept. Samples of
different levels are nested, so fingerprints of texts of any lengths can be compared. It is
written as the level (two hex digits) and one hex digit for each kept step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from bibloom.llm.common import map_batches, materialize
from bibloom.llm.components import connected_components
from bibloom.llm.linking import Match, colliding, linked_components

#: Steps that a fingerprint keeps at most, about.
SAMPLE = 256
#: Steps after which the walk's random bits repeat, for each of 256 classes of characters.
_PERIOD = 4096
#: Characters of the texts that are walked side by side.
_CHARS = 1 << 23
#: With fewer texts left, each is walked by itself.
_FEW = 16

_shared: dict[str, np.ndarray] = {}


def _bits() -> np.ndarray:
    if "bits" not in _shared:
        _shared["bits"] = np.random.default_rng(20240229).integers(0, 2, (_PERIOD, 256), dtype=np.uint8)
    return _shared["bits"]


def _ranks(steps: int) -> np.ndarray:
    """The random rank of each step: r or more with probability 2**-r."""
    have = _shared.get("ranks")
    if have is None or len(have) < steps:
        z = np.arange(1 << max(16, int(steps - 1).bit_length()), dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ z >> np.uint64(shift)) * np.uint64(factor)
        z ^= z >> np.uint64(31)
        low = z & (~z + np.uint64(1))
        have = _shared["ranks"] = np.bitwise_count(low - np.uint64(1)).astype(np.uint8)
    return have


def _level(n: int) -> int:
    return max(0, (2 * n - 1) // SAMPLE).bit_length() if n else 0


def _classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return (codes * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)


def _walk_one(classes: bytes, at: int, step: int, level: int) -> bytes:
    """What one walk writes at the kept steps from here to the end of its text."""
    end, bits = len(classes), _bits().tobytes()
    out = bytearray()
    while at < end:
        block = 1 << 14
        kept = np.flatnonzero(_ranks(step + block)[step : step + block] >= level) + step
        for write, stop in [*((True, k) for k in kept.tolist()), (False, step + block)]:
            for j in range(step, stop):
                at += bits[(j % _PERIOD) << 8 | classes[at]]
                if at == end:
                    return bytes(out)
            step = stop
            if write:
                out.append(classes[at])
    return bytes(out)


def embed(texts: list[str]) -> list[str]:
    """The fingerprints of texts, walked side by side."""
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    codes = np.concatenate([_classes(texts[k]) for k in order] or [np.zeros(0, np.uint8)])
    end = np.cumsum(lengths[order])
    at = end - lengths[order]
    levels = np.array([_level(int(n)) for n in lengths[order]], np.int64)
    written = [bytearray() for _ in order]
    sample = np.zeros((len(order), 4 * SAMPLE), np.uint8)
    filled = np.zeros(len(order), np.int64)
    who, bits, j = np.arange(len(order)), _bits(), 0
    while len(who) > _FEW:
        ranks = _ranks(j + 64)[j : j + 64].tolist()
        # levels fall along the texts, so those that keep a step of some rank are the last ones
        first = {r: int(np.searchsorted(-levels, -r)) for r in set(ranks)}
        for r in ranks:
            c = codes[np.minimum(at, end - 1)]
            if (lo := first[r]) < len(who):
                mine = np.flatnonzero(at[lo:] < end[lo:]) + lo
                k = who[mine]
                sample[k, filled[k]] = c[mine]
                filled[k] += 1
            at += bits[j % _PERIOD][c]
            j += 1
        going = at < end
        if not going.all():
            who, at, end, levels = who[going], at[going], end[going], levels[going]
        full = who[filled[who] > 4 * SAMPLE - 65]
        for k in full.tolist():  # hardly ever: a walk that stays much more often than it goes
            written[k] += sample[k, : filled[k]].tobytes()
            filled[k] = 0
    for k in range(len(order)):
        written[k] += sample[k, : filled[k]].tobytes()
    starts = np.cumsum(lengths[order]) - lengths[order]
    for k, place, stop, level in zip(who.tolist(), at.tolist(), end.tolist(), levels.tolist(), strict=True):
        begin = int(starts[k])
        written[k] += _walk_one(codes[begin:stop].tobytes(), place - begin, j, level)
    out = ["00"] * len(texts)
    for k, w in zip(order.tolist(), written, strict=True):
        out[k] = f"{_level(int(lengths[k])):02x}" + bytes(w).hex()[1::2]
    return out


def likeness(a: str, b: str) -> float:
    """The share of equal characters among the steps that both fingerprints keep, of the longer
    one's; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    level = max(int(a[:2], 16), int(b[:2], 16))
    x, y = _thinned(a, level), _thinned(b, level)
    n = max(len(x), len(y))
    m = min(len(x), len(y))
    return float((x[:m] == y[:m]).sum() / n) if n else 0.0


def _thinned(fingerprint: str, level: int) -> np.ndarray:
    own = int(fingerprint[:2], 16)
    symbols = np.frombuffer(fingerprint[2:].encode(), np.uint8)
    if own == level:
        return symbols
    key = f"kept{own}"
    kept = _shared.get(key)
    if kept is None or len(kept) < len(symbols):
        steps = max(1 << 12, 4 * len(symbols) << own)
        ranks = _ranks(steps)
        kept = _shared[key] = ranks[ranks >= own]
        if len(kept) < len(symbols):
            raise ValueError("a fingerprint keeps more steps than there are")
    return symbols[kept[: len(symbols)] >= level]


def fingerprints(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_chars, fingerprint) of every row. Null texts count as empty; an empty text has
    the fingerprint 00. Rows are taken one by one, repeated ones repeat, other columns are
    dropped, and a text of any length is walked whole."""

    def start():
        def rows(ids, texts):
            texts = [t or "" for t in texts]
            return [ids, [len(t) for t in texts], embed(texts)]

        return rows

    kind = dict(df.dtypes)[id_col]
    return map_batches(df.select(id_col, text), start, f"`{id_col}` {kind}, n_chars bigint, fingerprint string")


# ---- each text against its edited self and its neighbour


def _edited(text: str, following: str) -> str:
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


class _Pairs:
    """Rows with the row that follows; each text is embedded once, some million characters at a
    time."""

    def __init__(self):
        self.ids, self.texts, self.chars = [], [], 0
        self.first_print: str | None = None  # of self.texts[0], where it is known already

    def results(self, ids: list, texts: list[str], done: bool) -> Iterator[list[list]]:
        for i, t in zip(ids, texts, strict=True):
            self.ids.append(i)
            self.texts.append(t)
            self.chars += len(t)
            if self.chars >= _CHARS:
                yield self._take()
        if done:
            yield self._take()

    def _take(self) -> list[list]:
        """All rows but the last, which waits for the one that follows it."""
        ids, texts = self.ids, self.texts
        skip = self.first_print is not None
        edited = [_edited(a, b) for a, b in zip(texts, texts[1:])]
        prints = [self.first_print] * skip + embed(texts[skip:])
        edited_prints = embed(edited)
        self.ids, self.texts, self.chars = ids[-1:], texts[-1:], sum(map(len, texts[-1:]))
        self.first_print = prints[-1] if prints else None
        return [
            ids[:-1],
            [len(t) for t in texts[:-1]],
            [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
            prints[:-1],
            edited_prints,
            [likeness(a, b) for a, b in zip(prints, edited_prints)],
            [likeness(a, b) for a, b in zip(prints, prints[1:])],
        ]


def against_edited(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Every text's fingerprint against those of its edited self and of the next document.

    The next document is the one with the next lower id; the last one's is the first. The
    edited text has its last third (rounded down, in code points) replaced by as many code
    points, or all, from the beginning of the next document. Returns id_col, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts count as empty. Rows with the same id follow each other in the order of their
    texts; null ids come last. A single row is its own next one. Other columns are dropped and
    an empty table gives an empty result.

    Texts are shuffled once, by ranges of the id. Within a range a row's next one is the one
    below; the first and the last row of each range are set aside and joined afterwards.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = df.schema[id_col].dataType.simpleString()
    order = [F.col("id").desc_nulls_last(), F.col("text").asc()]
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranges = rows.repartitionByRange(parts, F.col("id").desc_nulls_last()).sortWithinPartitions(*order)
    ranges = ranges.withColumn("part", F.spark_partition_id())
    figures = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    schema = T._parse_datatype_string(f"id {kind}, {figures}, part int, edge string, text string")
    arrow = to_arrow_schema(schema)

    def batch_of(columns: list[list], part: int | None = None, edges: list[str] | None = None, texts: list[str] | None = None):
        n = len(columns[0])
        columns = columns + [[None] * n] * (7 - len(columns)) + [[part] * n, edges or [None] * n, texts or [None] * n]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, part = _Pairs(), None
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                ids, texts, places = (c.to_pylist() for c in batch.slice(lo, 64).columns)
                if part is None:
                    part = places[0]
                    yield batch_of([ids[:1]], part, ["first"], texts[:1])
                for found in pairs.results(ids, texts, False):
                    yield batch_of(found)
        if part is not None:
            for found in pairs.results([], [], True):
                yield batch_of(found)
            yield batch_of([pairs.ids], part, ["last"], pairs.texts)

    found = materialize(ranges.mapInArrow(within, schema), "edit-prints")
    inner = found.where(F.col("edge").isNull())
    edges = found.where(F.col("edge").isNotNull()).select("id", "part", "edge", "text")
    # one first and one last row for each range: the texts of a bounded number of rows
    by_part = Window.orderBy("part")
    places = edges.select("part").distinct().withColumn("next_part", F.coalesce(F.lead("part").over(by_part), F.min("part").over(Window.partitionBy())))
    firsts = edges.where(F.col("edge") == "first").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    lasts = edges.where(F.col("edge") == "last").drop("edge").join(places, "part").join(firsts, "next_part").select("id", "text", "following")

    def start():
        def across(ids, texts, following):
            edited = [_edited(a, b) for a, b in zip(texts, following, strict=True)]
            prints, edited_prints, next_prints = embed(texts), embed(edited), embed(following)
            return [
                ids,
                [len(t) for t in texts],
                [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
                prints,
                edited_prints,
                [likeness(a, b) for a, b in zip(prints, edited_prints, strict=True)],
                [likeness(a, b) for a, b in zip(prints, next_prints, strict=True)],
            ]

        return across

    outer = map_batches(lasts, start, f"id {kind}, {figures}", slice_rows=64)
    return inner.select(outer.columns).unionByName(outer).withColumnRenamed("id", id_col)


# ---- near copies


#: Of two texts at a likeness of 0.8 the longer keeps at most so many times the steps of the other.
_STRETCH = 1.25


def band_keys(symbols: bytes, level: int, bands: int, width: int) -> list[int]:
    """Hashes of ``bands`` samples of ``width`` of the steps kept at a level, drawn over all steps
    of the text's length class, and as many over those of the next class."""
    out = []
    own = int(np.log(max(len(symbols), 1)) / np.log(_STRETCH))
    for size in (own, own + 1):
        drawn = np.random.default_rng((level, size)).integers(0, int(np.ceil(_STRETCH ** (size + 1))), (bands, width))
        for b, places in enumerate(drawn.tolist()):
            values = bytes(symbols[p] if p < len(symbols) else 0 for p in places)
            digest = hashlib.blake2b(bytes([level, size, b]) + values, digest_size=8).digest()
            out.append(int.from_bytes(digest, "little", signed=True))
    return out


def near_copies(df: DataFrame, text: str = "text", id_col: str = "doc_id", least: float = 0.8, bands: int = 24, width: int = 8) -> DataFrame:
    """(id_col, component_id) of the rows whose text is near another's: bit-sampled bands of the
    fingerprints give candidates, and those of at least this likeness are linked.

    component_id is the least id of the component. Every text takes part at its own level and at
    the next, where one of up to twice its length has its own. A pair at likeness 0.8 shares a
    band with probability 0.99. Equal fingerprints are one item; rows with a null id are left
    out, repeated rows repeat, an empty table gives no rows.
    """
    prints = fingerprints(df.where(F.col(id_col).isNotNull()), text, id_col)
    prints = materialize(prints.withColumn("item", F.xxhash64("fingerprint", "n_chars")), "fingerprints")
    items = prints.groupBy("item").agg(F.first("fingerprint").alias("fingerprint"))

    def start():
        def entries(ids, codes):
            out = [[], [], [], []]
            for i, code in zip(ids, codes, strict=True):
                own = int(code[:2], 16)
                for level in (own, own + 1):
                    symbols = _thinned(code, level).tobytes()
                    for column, value in zip(out, (i, level, band_keys(symbols, level, bands, width), symbols.decode()), strict=True):
                        column.append(value)
            return out

        return entries

    entries = map_batches(items, start, "item bigint, level int, keys array<bigint>, symbols string")
    entries = materialize(entries.withColumn("id", F.xxhash64("item", "level")), "entries")
    # of n kept steps, l with the same symbol are a Jaccard similarity of l / (2 n - l)
    steps = F.transform(F.split("symbols", ""), lambda c, i: F.xxhash64(i, c))
    shared = colliding(entries.select("id", "keys"))
    linked = linked_components(shared, entries.select("id", steps.alias("content")), Match(lambda c: c, least / (2 - least)))
    edges = linked.join(entries.select("id", "item"), F.col("node") == F.col("id")).select(F.col("item").alias("a"), F.col("component").alias("b"))
    reached = connected_components(edges, "a", "b")
    members = prints.join(reached.withColumnRenamed("node", "item"), "item")
    least_id = members.groupBy("component").agg(F.min(id_col).alias("component_id"))
    again = prints.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("own"))
    named = prints.join(again, "item").join(reached.withColumnRenamed("node", "item"), "item", "left").join(least_id, "component", "left")
    named = named.where((F.col("n") > 1) | F.col("component_id").isNotNull())
    return named.select(id_col, F.coalesce("component_id", "own").alias("component_id"))
