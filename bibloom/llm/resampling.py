"""Importance resampling towards a target distribution, on hashed n-grams.

The features of a text are all runs of one to three consecutive words, hashed into buckets. A
bucket's gain is the logarithm of its smoothed share among the target's features over its share
among the corpus's; the gains of a text's features add up to its weight. Adding Gumbel noise that
belongs to the document and keeping the highest scores draws documents without replacement in
proportion to their weights.

Equal texts are grouped by the full text, so their features are made once; what they count for is
multiplied by their number, and their weight is joined back to the documents, each of which has a
noise of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibloom.llm.common import materialize, shuffles_removed, with_positions

BUCKETS = 10_000
#: Words of the longest feature.
LONGEST = 3
#: Gains are whole thousandths, so that sums don't depend on their order.
UNIT = 1000
PERCENT = 5
MIN_WORDS = 20
SEED = "42"

#: Words that a task remembers.
_KNOWN = 1 << 16
#: Bytes of a word for which the step of the checksum over it is tabled; the rest is rare.
_TABLED = 64
#: Rows of a record batch that are signed at a time.
_ROWS = 64
_WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text, lower-cased in A-Z, in UTF-8."""
    return text.encode().translate(_WORD_BYTES).split()  # no white space but spaces is left


class Features:
    """Buckets of the features of texts: unsigned CRC-32 of their bytes modulo the buckets.

    CRC-32 is linear over bits: the checksum of a run of words comes from those of its first words
    and its last one by the steps that the last one's bytes make on the register, which are tabled
    by their number. So each word is hashed once, whatever the features that it is part of.
    """

    def __init__(self, buckets: int = BUCKETS, longest: int = LONGEST):
        self.buckets, self.longest = buckets, longest
        self.known: dict[bytes, int] = {}  # the row of a word in sums
        self.sums = np.zeros((_KNOWN, 3), np.uint32)
        byte = [zlib.crc32(bytes([b])) for b in range(256)]
        start = zlib.crc32(b"\0")
        one = np.array([x ^ start for x in byte], np.uint32)  # a register's low byte after one zero byte
        self.steps = np.zeros((_TABLED + 1, 4, 256), np.uint32)
        for k in range(4):
            self.steps[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for n in range(1, _TABLED + 1):
            before = self.steps[n - 1]
            self.steps[n] = one[before & 0xFF] ^ before >> np.uint32(8)

    def _sums(self, words: list[bytes]) -> np.ndarray:
        """For each word its checksum, that of it after a space, and its length."""
        known = self.known
        missing = set(words).difference(known)
        if missing:
            if len(known) + len(missing) > len(self.sums):
                known.clear()
                missing = set(words)
                self.sums = np.zeros((max(_KNOWN, len(missing)), 3), np.uint32)
            first = len(known)
            self.sums[first : first + len(missing)] = [(zlib.crc32(w), zlib.crc32(b" " + w), len(w)) for w in missing]
            known.update(zip(missing, range(first, first + len(missing))))
        return self.sums[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]

    def of(self, words: list[bytes], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all features of some texts, and the number of the text of each. ``words``
        are those of all texts one after another, ``ends`` where each text's end."""
        n = len(words)
        text = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
        if not n:
            return np.zeros(0, np.uint32), text
        sums = self._sums(words)
        own, spaced, length = sums.T
        long = np.flatnonzero(length >= _TABLED)
        found, texts, run = [own % self.buckets], [text], own
        for more in range(1, self.longest):
            if n <= more:
                break
            last = slice(more, None)
            # the register after the run's bytes, moved over a space and the next word
            steps = np.minimum(length[last] + 1, _TABLED)
            before = run[: n - more]
            moved = spaced[last].copy()
            for k in range(4):
                moved ^= self.steps[steps, k, before >> np.uint32(8 * k) & np.uint32(0xFF)]
            for i in long[long >= more] - more:
                moved[i] = zlib.crc32(b" " + words[i + more], int(before[i]))
            inside = text[: n - more] == text[last]
            found.append(moved[inside] % self.buckets)
            texts.append(text[last][inside])
            run = moved
        return np.concatenate(found), np.concatenate(texts)


def features(texts: DataFrame, text: str, keep: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The columns ``keep`` with n_words, n_features and gaps: the buckets of the text's features in
    rising order, each as the step from the one before (the first from 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features(buckets)
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                part = batch.slice(lo, _ROWS)
                split = [words_of(t or "") for t in part.column(0).to_pylist()]
                n_words = np.array([len(s) for s in split], np.int64)
                found, row = made.of([w for s in split for w in s], np.cumsum(n_words))
                values = np.sort(row.astype(np.int64) * buckets + found) % buckets
                n_features = np.bincount(row, minlength=part.num_rows).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(n_features)]).astype(np.int32)
                gaps = np.diff(values, prepend=0)
                first = offsets[:-1][n_features > 0]
                gaps[first] = values[first]
                lists = pa.ListArray.from_arrays(offsets, pa.array(gaps.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(n_words), pa.array(n_features), lists], names=[*keep, "n_words", "n_features", "gaps"])

    kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep)
    return texts.select(text, *keep).mapInArrow(run, f"{kinds}, n_words bigint, n_features bigint, gaps array<int>")


def _flat(batch: pa.RecordBatch, gaps: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some rows of a batch at a time, with the row and the bucket of each of their features."""
    for lo in range(0, batch.num_rows, _ROWS):
        part = batch.slice(lo, _ROWS)
        ends = np.asarray(part.column(gaps).offsets).astype(np.int64)
        starts = ends[:-1] - ends[0]
        rows = np.repeat(np.arange(part.num_rows), np.diff(ends))
        sums = np.cumsum(np.asarray(part.column(gaps).flatten()), dtype=np.int64)
        yield part, rows, sums - np.concatenate([[0], sums])[starts][rows]


def bucket_counts(made: DataFrame, multiplicity: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features by bucket, each text's times its multiplicity. Every task adds up its
    own texts, so that no more than a row for each bucket and task is shuffled."""
    side = made.select("gaps", (F.lit(1) if multiplicity is None else F.col(multiplicity)).cast("bigint").alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part, rows, bucket in _flat(batch, 0):
                np.add.at(total, bucket, np.asarray(part.column(1))[rows])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return side.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of every bucket, in order; as many numbers as there are buckets, by parameter."""
    spark = corpus.sparkSession
    s, t = corpus.withColumnRenamed("n", "s"), target.withColumnRenamed("n", "t")
    every = spark.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left")
    every = every.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    all_s, all_t = map(float, every.agg(F.sum("s"), F.sum("t")).first())
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    gain = F.floor(UNIT * F.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))))
    return [r["gain"] for r in every.select("bucket", gain.alias("gain")).orderBy("bucket").collect()]


def weights(made: DataFrame, gain: list[int], keep: list[str]) -> DataFrame:
    """``keep`` and n_words, n_features, weight: the sum of the gains of a text's features."""
    shared = made.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows, bucket in _flat(batch, n + 2):
                weight = np.zeros(part.num_rows, np.int64)
                np.add.at(weight, rows, shared.value[bucket])
                yield pa.RecordBatch.from_arrays([*part.columns[: n + 2], pa.array(weight)], names=[*keep, "n_words", "n_features", "weight"])

    kinds = ", ".join(f"`{c}` {made.schema[c].dataType.simpleString()}" for c in keep)
    return made.select(*keep, "n_words", "n_features", "gaps").mapInArrow(run, f"{kinds}, n_words bigint, n_features bigint, weight bigint")


def noise(id_column: Column, seed: str = SEED) -> Column:
    """Gumbel noise of a document in whole thousandths, rounded down; null without an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_column.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-UNIT * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: str = SEED,
    buckets: int = BUCKETS,
    id_col: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """Documents drawn towards the distribution of ``target``: every row of ``docs`` with id_col,
    n_features, weight, score and rank (1, 2, ... of the drawn ones, null of the others).

    Of the rows with an id and at least ``min_words`` words, floor(percent * rows / 100) are drawn,
    those of the highest scores, ties to the smaller id. Null, empty and wordless texts have no
    features and weight 0; a null id has no noise, so its score and rank are null; rows that repeat
    an id are drawn each by their own text; an empty table, on either side, counts no features. Texts
    of any length are taken whole, further columns, of whatever name, are dropped.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = own.groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    texts = texts.withColumn("tid", F.unhex(F.md5("text")))
    with shuffles_removed(spark):
        made = materialize(features(texts, "text", ["tid", "copies"], buckets), "features", compression="zstd")
    wanted = features(target.select(F.col(target_text).alias("text"), F.lit(1).alias("one")), "text", ["one"], buckets)
    gain = gains(bucket_counts(made, "copies", buckets), bucket_counts(wanted, None, buckets), buckets)
    weighed = materialize(weights(made, gain, ["tid"]), "weights")
    # the ids of equal texts, however many, meet their weight in a join that Spark splits
    keyed = own.select("id", F.unhex(F.md5("text")).alias("tid"))
    scored = keyed.join(weighed, "tid").select("id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("id"), seed)).alias("score"))
    with shuffles_removed(spark):
        scored = materialize(scored, "scores")
    eligible = scored.where((F.col("n_words") >= min_words) & F.col("id").isNotNull())
    drawn = eligible.count() * percent // 100
    order = [F.col("score").desc(), F.col("id").asc()]
    ranked = with_positions(eligible.withColumn("group", F.lit(0)), ["group"], order, "position", "rows")
    ranked = ranked.select("id", "n_features", "weight", "score", F.when(F.col("position") < drawn, F.col("position") + 1).alias("rank"))
    rest = scored.where((F.col("n_words") < min_words) | F.col("id").isNull())
    every = ranked.unionByName(rest.select("id", "n_features", "weight", "score", F.lit(None).cast("bigint").alias("rank")))
    return every.withColumnRenamed("id", id_col)
