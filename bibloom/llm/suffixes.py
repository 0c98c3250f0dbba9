"""Removal of byte strings that an earlier document has, by a logarithmic family of suffix indexes.

Documents come in batches. A batch's suffixes are sorted into an index of its own, which is scanned
against the existing ones, the levels, for matches of at least ``length`` bytes; then it becomes a
level itself, and levels of equal size are merged, so that n batches leave at most log2(n) levels.

Not every suffix needs a place. Of the hashes of the ``GRAM``-byte strings within a window of
``length`` bytes the least one is the window's key, and neighbouring windows mostly share it: the
suffix that begins there stands for all of them. A cell is a run of neighbouring windows with one
key. Equal windows have equal keys, so all matches are found among cells of one key:

* cells that are equal as a whole match in all their windows, which the index tells by their hash;
* of cells of one key that differ, and only of those, the bytes are fetched and their windows compared.

A level is a table in buckets, with a row for each of many ranges of keys that holds its suffixes as sorted
arrays. The levels' buckets correspond, so a scan and a merge join them row by row without a shuffle,
and only a new batch is shuffled, once. The texts lie in chunks, which stay where they were read:
suffixes carry their chunk, and what the scan finds goes to the chunks, not the texts to what was
found. So what is shuffled grows with the input at every size, and no side of a join is broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibloom.llm.common import discard, materialize, remove, settings, shared_folder
from bibloom.llm.packed import changes, lists, numbers, repeated, split
from bibloom.llm.paragraphs import _among, least_of

#: Bytes of the shortest match.
LENGTH = 50
#: Bytes that choose the place of a suffix: at fewer, unlike windows share keys by chance; at more,
#: there are more suffixes.
GRAM = 20
BATCHES = 3
#: Rows of a side of a join that is broadcast; a larger side is shuffled.
BROADCAST_ROWS = 1_000_000
#: Bytes of text that are hashed at a time; longer texts are cut, which cuts cells but no window.
CHUNK = 1 << 16
#: Bytes of text of a chunk of texts; a longer text is a chunk of its own.
TEXTS = 1 << 21
#: Ranges of keys, rows of a level, for each bucket.
RANGES = 4
#: Suffixes that a task gathers before it hands them on, dealt out to all ranges: a row has more of them, the more it gathers.
GATHERED = 1 << 19

_FACTOR = 0xD6E8FEB86659FD93
_STIR = 0xA0761D6478BD642F
_BYTES = np.random.default_rng(20240311).integers(0, 1 << 64, 256, np.uint64)


def _bounded(side: DataFrame, weight=None) -> DataFrame:
    """A written side of a join, as a broadcast if it is small enough; ``weight``: rows in a row."""
    size = side.count() if weight is None else side.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(side) if size <= BROADCAST_ROWS else side


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2**64, kept for as many as were needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            factors = np.full(n, _FACTOR, np.uint64), np.full(n, pow(_FACTOR, -1, 1 << 64), np.uint64)
            for f in factors:
                f[0] = 1
            cls.up, cls.down = map(np.multiply.accumulate, factors)
        return cls.up[:n], cls.down[:n]


def _stirred(h: np.ndarray) -> np.ndarray:
    return (h ^ h >> np.uint64(32)) * np.uint64(_STIR)


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the hashes of all strings of these bytes are made of: sums, and powers to divide by."""
    up, down = _Powers.of(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:-1], out=sums[1:])
    return sums, down


class Cells:
    """The cells of some texts, one after another: text (its number), at (byte of the text where the
    first window begins), n (windows), key, cell (hash of all its bytes), and begin, its place among
    the bytes of these texts."""

    def __init__(self, texts: list[bytes], length: int, gram: int, chunk: int):
        pieces = [(k, lo, t[lo : lo + chunk + length - 1]) for k, t in enumerate(texts) for lo in range(0, max(1, len(t) - length + 1), chunk)]
        self.length = length
        self.data = data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        self.sums, self.down = _sums(data)
        sizes = np.array([len(p[2]) for p in pieces], np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        n = max(0, len(data) - length + 1)
        least = least_of(self._every(gram), length - gram + 1) if n else np.zeros(0, np.uint64)
        # no window goes over the end of its text
        sound = np.ones(len(data), bool)
        sound[np.maximum(ends[:, None] - np.arange(1, length), begins[:, None])[sizes > 0].ravel()] = False
        sound = sound[:n]
        new = np.ones(n, bool)
        new[1:] = least[1:] != least[:-1]
        new[begins[begins < n]] = True
        self.begin = np.flatnonzero(new & sound)
        # a cell ends where the next begins, or before the first window that is none
        stops = np.append(np.flatnonzero(new | ~sound), n)
        self.n = stops[np.searchsorted(stops, self.begin, "right")] - self.begin if len(self.begin) else self.begin
        self.key = least[self.begin].view(np.int64)
        size = self.n + length - 1
        whole = (self.sums[self.begin + size] - self.sums[self.begin]) * self.down[self.begin]
        self.cell = _stirred(whole + size.astype(np.uint64)).view(np.int64)
        owner = np.searchsorted(begins + (sizes == 0), self.begin, "right") - 1
        self.text = np.array([p[0] for p in pieces], np.int64)[owner]
        self.at = self.begin - begins[owner] + np.array([p[1] for p in pieces], np.int64)[owner]

    def _every(self, size: int) -> np.ndarray:
        """The hash of every ``size`` bytes."""
        n = len(self.sums) - size
        return _stirred((self.sums[size:] - self.sums[:n]) * self.down[:n])

    def bytes_of(self, some: np.ndarray) -> pa.Array:
        """All the bytes of some cells."""
        sizes = self.n[some] + self.length - 1
        ends = np.concatenate([[0], np.cumsum(sizes)])
        places = np.repeat(self.begin[some] - ends[:-1], sizes) + np.arange(ends[-1])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(self.data[places])]).cast(pa.binary())


def _parts(texts: list[bytes], chunk: int) -> Iterator[tuple[int, int]]:
    """Some texts at a time, about a chunk of bytes or one text: where they begin and end."""
    lo = total = 0
    for k, text in enumerate(texts):
        total += len(text)
        if total >= chunk:
            yield lo, k + 1
            lo, total = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _ranged(key: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The range of each key, and 32 bits that tell keys of a range apart; should keys fall together, more
    windows are compared."""
    mixed = _stirred(key.view(np.uint64))
    return (mixed >> np.uint64(32)).astype(np.int64) % ranges, mixed.astype(np.uint32).view(np.int32)


def _paired(doc: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """A number for a document and a cell in it."""
    return _stirred(doc.astype(np.int64).view(np.uint64) * np.uint64(_FACTOR) + cell.view(np.uint64))


def _merged_spans(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end): the maximal stretches of each row that some stretches cover, in order."""
    # all rows on one line, each after the farthest end of those before
    far = int(end.max(initial=0)) + 1
    order = np.lexsort((begin, row))
    row, begin, end = row[order], begin[order] + row[order] * far, end[order] + row[order] * far
    reach = np.maximum.accumulate(end)
    new = np.ones(len(begin) + 1, bool)
    new[1:-1] = (begin[1:] > reach[:-1]) | (row[1:] != row[:-1])
    first, last = np.flatnonzero(new[:-1]), np.flatnonzero(new[1:])
    own = row[first]
    return own, begin[first] - own * far, reach[last] - own * far


_LEVEL = "key int, hash array<int>, cell array<bigint>, first array<bigint>, spread array<bigint>, chunk array<bigint>"
_COLUMNS = ["hash", "cell", "first", "spread", "chunk"]


class Level:
    """A sorted index in buckets, and the number of batches in it. Of each range of keys, ``packed`` has the
    suffixes in order as arrays: hash (of the key), cell, the first document that has it, how far the
    last one is from it, and the chunk of the first."""

    def __init__(self, spark: SparkSession, packed: DataFrame, buckets: int, batches: int):
        self.spark, self.batches, self.name = spark, batches, f"suffixes_{uuid.uuid4().hex}"
        self.path = f"{shared_folder(spark)}/{self.name}"
        packed.write.bucketBy(buckets, "key").sortBy("key").option("path", self.path).saveAsTable(self.name)

    def packed(self) -> DataFrame:
        return self.spark.table(self.name)

    def rows(self) -> DataFrame:
        """The suffixes one by one."""
        return self.packed().select("key", F.inline(F.arrays_zip(*_COLUMNS)))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        remove(self.spark, self.path)


class Family:
    """The levels, and what they were made of.

    ``documents`` has all documents that batches will be taken of, with an integer ``id_col`` and a
    ``text``. They are written once, in chunks by the ``borders`` of their batches; ``rows`` has all of
    them, ``documents`` those that can match, from which batches are taken.
    """

    def __init__(self, documents: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, borders: list[int] = ()):
        self.spark = documents.sparkSession
        self.length, self.gram = length, gram
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.ranges = RANGES * self.buckets
        self.levels: list[Level] = []
        self.name = f"texts_{uuid.uuid4().hex}"
        with self._settings():
            # the rows of a chunk stay in order, in one file
            written = self._chunks(documents, id_col, text, borders).write.partitionBy("batch").bucketBy(self.buckets, "chunk").sortBy("chunk")
            written.option("path", f"{shared_folder(self.spark)}/{self.name}").saveAsTable(self.name)
        self.rows = self.spark.table(self.name)
        own = self.rows.where(F.col("doc").isNotNull() & (F.octet_length("text") >= length))
        self.documents = own.select("batch", "chunk", "row", "doc", "text")

    def _settings(self, rows: int = 64):
        # so many rows at a time go to Python: of texts some, of the arrays of levels one
        return settings(self.spark, spark_sql_classic_shuffleDependency_fileCleanup_enabled="true", spark_sql_execution_arrow_maxRecordsPerBatch=str(rows))

    def _chunks(self, documents: DataFrame, id_col: str, text: str, borders: list[int]) -> DataFrame:
        """(id, doc, text, batch, chunk, row): the rows of each task and batch in chunks."""
        size = TEXTS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task, chunks, made = TaskContext.get().partitionId(), {}, 0
            for batch in batches:
                chunk, row = [], []
                for part, n in zip(batch.column(3).to_pylist(), pc.binary_length(batch.column(2)).to_pylist(), strict=True):
                    if part not in chunks or chunks[part][2] >= size:
                        chunks[part] = [task << 32 | made, 0, 0]
                        made += 1
                    own = chunks[part]
                    chunk.append(own[0])
                    row.append(own[1])
                    own[1] += 1
                    own[2] += n or 0
                columns = [*batch.columns, pa.array(chunk, pa.int64()), pa.array(row, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "doc", "text", "batch", "chunk", "row"])

        doc = F.col(id_col).cast("bigint")
        batch = reduce(lambda x, border: x + F.coalesce((doc > border).cast("int"), F.lit(0)), borders, F.lit(0))
        own = documents.select(F.col(id_col).alias("id"), doc.alias("doc"), F.col(text).alias("text"), batch.alias("batch"))
        kind = own.schema["id"].dataType.simpleString()
        return own.mapInArrow(run, f"id {kind}, doc bigint, text string, batch int, chunk bigint, row bigint")

    # ---- the index

    def _index(self, batch: DataFrame) -> DataFrame:
        """The batch's suffixes as a level has them, but equal ones of several chunks apart."""
        length, gram, ranges, chunk_size, most = self.length, self.gram, self.ranges, CHUNK, GATHERED

        def distinct(gathered: list[tuple]) -> pa.RecordBatch:
            key, cell, doc, chunk = map(np.concatenate, zip(*gathered, strict=True))
            gathered.clear()
            part, hashed = _ranged(key, ranges)
            place = part << 32 | hashed.view(np.uint32).astype(np.int64)
            order = np.lexsort((doc, chunk, cell, place))
            place, cell, doc, chunk = place[order], cell[order], doc[order], chunk[order]
            new = np.append(changes(place, cell, chunk), True)
            first, last = np.flatnonzero(new[:-1]), np.flatnonzero(new[1:])
            parts, offsets = split(place[first] >> 32)
            hashed = place[first].astype(np.uint32).view(np.int32)
            columns = [lists(offsets, x) for x in (hashed, cell[first], doc[first], doc[last] - doc[first], chunk[first])]
            return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), *columns], names=["key", *_COLUMNS])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gathered, rows = [], 0
            for batch in batches:
                chunks, docs, texts = np.asarray(batch.column(0)), np.asarray(batch.column(1)), _texts(batch.column(2))
                for lo, hi in _parts(texts, chunk_size):
                    c = Cells(texts[lo:hi], length, gram, chunk_size)
                    gathered.append((c.key, c.cell, docs[lo:hi][c.text], chunks[lo:hi][c.text]))
                    rows += len(c.key)
                    if rows > most:
                        yield distinct(gathered)
                        rows = 0
            if gathered:
                yield distinct(gathered)

        def merged(rows: pa.Table) -> pa.Table:
            columns = [numbers(rows, name) for name in _COLUMNS]
            order = np.lexsort((columns[1], columns[0]))
            offsets = pa.array([0, len(order)], pa.int32())
            return pa.Table.from_arrays([rows.column("key")[:1], *(lists(offsets, x[order]) for x in columns)], names=["key", *_COLUMNS])

        cells = batch.select("chunk", "doc", "text").mapInArrow(run, _LEVEL)
        return cells.groupBy("key").applyInArrow(merged, _LEVEL)

    def _beside(self, levels: list[Level], how: str) -> DataFrame:
        """The levels' rows of each range of keys in one row, their columns numbered."""
        numbered = [level.packed().toDF("key", *(f"{c}{k}" for c in _COLUMNS)) for k, level in enumerate(levels)]
        return reduce(lambda a, b: a.join(b, "key", how), numbered)

    def _merge(self) -> None:
        """Merge the last two levels for as long as they hold equally many batches."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = pa.Table.from_batches([batch.slice(k, 1)])
                    hashed, cell, first, spread, chunk = (np.concatenate([numbers(row, f"{c}0"), numbers(row, f"{c}1")]) for c in _COLUMNS)
                    order = np.lexsort((first, cell, hashed))
                    hashed, cell, first, chunk, last = hashed[order], cell[order], first[order], chunk[order], (first + spread)[order]
                    new = np.flatnonzero(changes(hashed, cell))
                    spread = (np.maximum.reduceat(last, new) if len(new) else last) - first[new]
                    offsets = pa.array([0, len(new)], pa.int32())
                    columns = [lists(offsets, x) for x in (hashed[new], cell[new], first[new], spread, chunk[new])]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *columns], names=["key", *_COLUMNS])

        while len(self.levels) > 1 and self.levels[-1].batches == self.levels[-2].batches:
            b, a = self.levels.pop(), self.levels.pop()
            with self._settings(1):
                self.levels.append(Level(self.spark, self._beside([a, b], "full").mapInArrow(run, _LEVEL), self.buckets, a.batches + b.batches))
            a.drop()
            b.drop()

    def add(self, batch: DataFrame, last: bool = False) -> DataFrame:
        """Index a batch, taken of ``documents``, and scan it: (chunk, row, doc, version, spans), a written
        table, of its texts with bytes that a document of a smaller id has, in the batch or a level, the
        maximal stretches of such bytes, (begin, end) in order. ``version`` is a hash of the text.
        Documents of earlier batches aren't looked at again: batches come in order of ids. After the
        ``last`` batch is scanned no level is read again; they go before windows are compared."""
        self._merge()
        with self._settings():
            own = Level(self.spark, self._index(batch), self.buckets, 1)
            known = self._scan(own)
            self.levels.append(own)
            if last:
                self.drop()
            covered = self._windows(known)
            found = self._places(batch, known, covered)
        discard(known, covered)
        return found

    # ---- the scan

    def _scan(self, own: Level) -> DataFrame:
        """(kind, chunk, cell, doc) by the batch and all levels. Of kind ``told``: cells of a chunk of the
        batch that documents share, with the first of these. Of kind ``wanted``: cells of a key that has
        others, where a document of the batch is the first to have one, with the first document of each
        and its chunk: of these windows are to be compared."""
        count = 1 + len(self.levels)

        def asked(row: pa.Table) -> tuple[tuple, tuple]:
            sides = [[numbers(row, f"{c}{k}") for c in _COLUMNS] for k in range(count)]
            hashed, cell, first, spread, chunk = map(np.concatenate, zip(*sides, strict=True))
            mine = np.arange(len(hashed)) < len(sides[0][0])
            # without keys that the batch doesn't have or that one document has, which are most
            order = np.argsort(hashed, kind="stable")
            new = np.append(changes(hashed[order]), True)
            size = np.diff(np.flatnonzero(new))
            there = np.add.reduceat(mine[order], np.flatnonzero(new[:-1]), dtype=np.int64) if len(order) else size
            order = order[np.repeat((size > 1) & (there > 0), size) | (mine & (spread > 0))[order]]
            order = order[np.lexsort((first[order], cell[order], hashed[order]))]
            hashed, cell, first, chunk, mine, last = hashed[order], cell[order], first[order], chunk[order], mine[order], (first + spread)[order]
            if not len(order):
                return (chunk, cell, first), (chunk, cell, first)
            cells = changes(hashed, cell)
            begins = np.flatnonzero(cells)
            at = np.cumsum(cells) - 1
            least = first[begins][at]
            told = mine & (last > least)
            keys = np.flatnonzero(changes(hashed[begins]))
            size = np.diff(np.append(keys, len(begins)))
            low = np.repeat(np.minimum.reduceat(first[begins], keys), size)
            fresh = mine[begins] & (first[begins] > low)
            wanted = begins[np.repeat(np.logical_or.reduceat(fresh, keys), size)]
            return (chunk[told], cell[told], least[told]), (chunk[wanted], cell[wanted], first[wanted])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                both = [asked(pa.Table.from_batches([batch.slice(k, 1)])) for k in range(batch.num_rows)]
                for kind, some in zip(("told", "wanted"), zip(*both, strict=True), strict=False):
                    chunk, cell, doc = map(np.concatenate, zip(*some, strict=True))
                    order = np.argsort(chunk, kind="stable")
                    chunks, offsets = split(chunk[order])
                    columns = [pa.array([kind] * len(chunks), pa.string()), pa.array(chunks), lists(offsets, cell[order]), lists(offsets, doc[order])]
                    yield pa.RecordBatch.from_arrays(columns, names=["kind", "chunk", "cell", "doc"])

        with self._settings(1):
            beside = self._beside([own, *self.levels], "left")
            return materialize(beside.mapInArrow(run, "kind string, chunk bigint, cell array<bigint>, doc array<bigint>"), "known-cells")

    def _windows(self, known: DataFrame) -> DataFrame:
        """(chunk, cell, doc, begin, n): of the wanted cells, the runs of windows that a document before the
        cell's first one has, with that first one."""
        length, gram, ranges, chunk_size = self.length, self.gram, self.ranges, CHUNK

        def fetch(texts: pa.Table, wanted: pa.Table) -> pa.Table:
            docs, asked = numbers(texts, "doc"), repeated(wanted, "chunk", "cell")
            pairs = np.sort(_paired(numbers(wanted, "doc"), numbers(wanted, "cell")))
            some = np.flatnonzero(np.isin(docs, numbers(wanted, "doc"))) if len(asked) else np.zeros(0, np.int64)
            raws, docs, found = _texts(texts.column("text").take(pa.array(some))), docs[some], []
            for lo, hi in _parts(raws, chunk_size):
                c = Cells(raws[lo:hi], length, gram, chunk_size)
                own, at = np.unique(_paired(docs[lo:hi][c.text], c.cell), return_index=True)
                at = at[_among(own, pairs)]
                found.append((*_ranged(c.key[at], ranges), c.cell[at], docs[lo:hi][c.text[at]], c.bytes_of(at)))
            if not found:
                return pa.Table.from_pylist([], fetched)
            part, hashed, cell, doc = (np.concatenate(x) for x in list(zip(*found, strict=True))[:4])
            order = np.argsort(part, kind="stable")
            parts, offsets = split(part[order])
            raw = pa.chunked_array([x[4] for x in found]).take(pa.array(order)).combine_chunks()
            raw = pa.concat_arrays(raw.chunks) if isinstance(raw, pa.ChunkedArray) else raw
            columns = [pa.array(parts.astype(np.int32)), pa.array(np.full(len(parts), asked[0])), *(lists(offsets, x) for x in (cell[order], doc[order], raw))]
            return pa.Table.from_arrays(columns, names=fetched.names)

        def compare(rows: pa.Table) -> pa.Table:
            chunk, cell, doc = repeated(rows, "chunk", "cell"), numbers(rows, "cell"), numbers(rows, "doc")
            raw = pa.concat_arrays([x.flatten() for x in rows.column("raw").chunks])
            sizes = pc.binary_length(raw).to_numpy().astype(np.int64)
            begins = np.cumsum(sizes) - sizes
            sums, down = _sums(np.frombuffer(b"".join(raw.to_pylist()), np.uint8))
            n = sizes - length + 1
            before = np.cumsum(n) - n
            owner = np.repeat(np.arange(len(n)), n)
            offset = np.arange(len(owner)) - before[owner]
            places = begins[owner] + offset
            hashes = (sums[places + length] - sums[places]) * down[places]
            order = np.argsort(hashes)
            new = changes(hashes[order])
            least = np.minimum.reduceat(doc[owner[order]], np.flatnonzero(new))
            hit = np.zeros(len(owner), bool)
            hit[order] = doc[owner[order]] > least[np.cumsum(new) - 1]
            hits = np.flatnonzero(hit)
            runs = np.append(changes(hits - np.arange(len(hits)), owner[hits]), True) if len(hits) else np.zeros(1, bool)
            first, last = hits[runs[:-1]], hits[runs[1:]]
            order = np.argsort(chunk[owner[first]], kind="stable")
            first, last = first[order], last[order]
            own = owner[first]
            chunks, offsets = split(chunk[own])
            columns = [pa.array(chunks), *(lists(offsets, x) for x in (cell[own], doc[own], offset[first].astype(np.int32), (last - first + 1).astype(np.int32)))]
            return pa.Table.from_arrays(columns, names=["chunk", "cell", "doc", "begin", "n"])

        fetched = pa.schema([("key", pa.int32()), ("chunk", pa.int64()), ("cell", pa.list_(pa.int64())), ("doc", pa.list_(pa.int64())), ("raw", pa.list_(pa.binary()))])
        texts, wanted = self.documents.select("chunk", "doc", "text"), known.where("kind = 'wanted'").drop("kind")
        read = texts.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(fetch, "key int, chunk bigint, cell array<bigint>, doc array<bigint>, raw array<binary>")
        found = read.groupBy("key").applyInArrow(compare, "chunk bigint, cell array<bigint>, doc array<bigint>, begin array<int>, n array<int>")
        return materialize(found, "covered-windows")

    def _places(self, batch: DataFrame, known: DataFrame, covered: DataFrame) -> DataFrame:
        """The stretches of the batch's texts that are covered."""
        length, gram, chunk_size = self.length, self.gram, CHUNK

        def run(texts: pa.Table, asked: pa.Table) -> pa.Table:
            told, part = (asked.filter(pc.equal(asked.column("kind"), kind)) for kind in ("told", "covered"))
            cells, at = np.unique(numbers(told, "cell"), return_index=True)
            firsts = numbers(told, "doc")[at]
            pairs = _paired(numbers(part, "doc"), numbers(part, "cell"))
            order = np.argsort(pairs)
            pairs, begins, counts = pairs[order], numbers(part, "begin")[order], numbers(part, "n")[order]
            raws, docs, found = _texts(texts.column("text")) if asked.num_rows else [], numbers(texts, "doc"), []
            for lo, hi in _parts(raws, chunk_size):
                c = Cells(raws[lo:hi], length, gram, chunk_size)
                doc = docs[lo:hi][c.text]
                whole = np.zeros(len(doc), bool)
                if len(cells):
                    k = np.minimum(np.searchsorted(cells, c.cell), len(cells) - 1)
                    whole = (cells[k] == c.cell) & (doc > firsts[k])
                rest = np.flatnonzero(~whole)
                pair = _paired(doc[rest], c.cell[rest])
                left, right = np.searchsorted(pairs, pair, "left"), np.searchsorted(pairs, pair, "right")
                n = right - left
                own = np.repeat(rest, n)
                run = np.repeat(left - (np.cumsum(n) - n), n) + np.arange(len(own))
                begin = np.concatenate([c.at[whole], c.at[own] + begins[run]])
                end = begin + np.concatenate([c.n[whole], counts[run]]) + length - 1
                found.append(_merged_spans(np.concatenate([c.text[whole], c.text[own]]) + lo, begin, end))
            row, begin, end = map(np.concatenate, zip(*found, strict=True)) if found else 3 * [np.zeros(0, np.int64)]
            rows, offsets = split(row)
            pairs = pa.StructArray.from_arrays([pa.array(begin), pa.array(end)], names=["begin", "end"])
            names = ["chunk", "row", "doc", "version"]
            return pa.Table.from_arrays([*(pa.array(numbers(texts, x)[rows]) for x in names), lists(offsets, pairs)], names=[*names, "spans"])

        none = [F.lit(None).cast("array<int>").alias(x) for x in ("begin", "n")]
        asked = known.where("kind = 'told'").select("*", *none).unionByName(covered.withColumn("kind", F.lit("covered")))
        texts = batch.select("chunk", "row", "doc", F.xxhash64("text").alias("version"), "text")
        found = texts.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(run, "chunk bigint, row bigint, doc bigint, version bigint, spans array<struct<begin: bigint, end: bigint>>")
        return materialize(found, "spans")

    def drop(self) -> None:
        """Remove the levels."""
        while self.levels:
            self.levels.pop().drop()


def _family_spans(df: DataFrame, id_col: str, text: str, length: int, gram: int, batches: int) -> tuple[Family, DataFrame]:
    """A family that has had all documents of ``df``, without levels, and what it found of them."""
    share = F.percentile_approx(F.col(id_col).cast("bigint"), [k / batches for k in range(1, batches)]) if batches > 1 else F.array()
    borders = sorted(set(df.agg(share.alias("at")).first()["at"] or []))
    family = Family(df, id_col, text, length, gram, borders)
    parts = [family.add(family.documents.where(F.col("batch") == k), last=k == len(borders)) for k in range(len(borders) + 1)]
    return family, reduce(DataFrame.unionByName, parts)


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """(doc, version, spans): of every text with bytes covered by a ``length``-byte string that also starts
    in a document with a smaller id, the maximal stretches of such bytes.

    ``id_col`` is of an integer type; rows that share an id are texts of one document, told apart by
    version, a hash of the text. Rows with a null id or text take no part.
    """
    _, found = _family_spans(df, id_col, text, length, gram, batches)
    return found.groupBy("doc", "version").agg(F.first("spans").alias("spans"))


def dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """Every row of ``df`` as id_col, n_bytes (UTF-8), n_removed, n_spans and kept, the bytes that are
    left: without those covered by a ``length``-byte string that also starts in a document with a
    smaller id.

    A null text counts as empty. Texts are judged as they came in; matches don't cross documents, and
    a document doesn't match itself, nor do rows of one id each other. Rows with a null id keep all
    and cover nothing; repeated rows repeat. Further columns, of whatever name, are dropped, an empty
    table gives an empty result, and a text of any length is taken whole.
    """
    family, found = _family_spans(df, id_col, text, length, gram, batches)

    def run(texts: pa.Table, spans: pa.Table) -> pa.Table:
        cuts = dict(zip(spans.column("row").to_pylist(), spans.column("spans").to_pylist(), strict=True))
        raws, removed, count, kept = _texts(texts.column("text")), [], [], []
        for row, raw in zip(texts.column("row").to_pylist(), raws, strict=True):
            out, at = [], 0
            for cut in cuts.get(row, ()):
                out.append(raw[at : cut["begin"]])
                at = cut["end"]
            kept.append(b"".join([*out, raw[at:]]))
            removed.append(len(raw) - len(kept[-1]))
            count.append(len(cuts.get(row, ())))
        columns = [texts.column("id"), pa.array([len(t) for t in raws], pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())]
        return pa.Table.from_arrays(columns, names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = family.rows.schema["id"].dataType.simpleString()
    both = family.rows.select("chunk", "row", "id", "text").groupBy("chunk").cogroup(found.select("chunk", "row", "spans").groupBy("chunk"))
    return both.applyInArrow(run, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary").withColumnRenamed("id", id_col)
