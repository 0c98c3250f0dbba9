"""Delimited text of unknown encoding, with line breaks inside quotes and lines before the header.

Large files stay splittable: whether a split begins inside quotes depends on all splits before it, so
a first pass says of each split how it ends when it begins outside, and inside, and from these few
rows the true beginnings follow. A second pass cuts records; the one or two ends of a record that goes
over splits are put together afterwards.
"""

from __future__ import annotations

import codecs
import csv
import io
import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibloom.functions.text import strip
from bibloom.sources import tabular

#: Bytes and lines of a file that its encoding, delimiter and header are told by.
HEAD_BYTES, HEAD_LINES = 100_000, 2_000
#: Splits whose beginnings are broadcast, some 150 bytes each; of more, lines are shuffled to them.
BROADCAST_SPLITS = 200_000
#: Bytes that have no character in the usual single-byte encoding of Western text.
_UNASSIGNED = {0x81, 0x8D, 0x8F, 0x90, 0x9D}


def head_bytes(spark: SparkSession, path: str) -> bytes:
    lines = spark.read.option("lineSep", "\n").text(path).limit(HEAD_LINES)
    rows = lines.select(F.substring(F.col("value").cast("binary"), 1, HEAD_BYTES).alias("b")).collect()
    return b"\n".join(bytes(r["b"]) for r in rows)[:HEAD_BYTES]


def detect_encoding(head: bytes) -> str:
    """By marks of byte order, zero bytes at every other place, and whether the bytes are UTF-8;
    else a single-byte encoding."""
    for mark, name in ((codecs.BOM_UTF8, "UTF-8"), (codecs.BOM_UTF16_LE, "UTF-16LE"), (codecs.BOM_UTF16_BE, "UTF-16BE")):
        if head.startswith(mark):
            return name
    for first, name in ((0, "UTF-16BE"), (1, "UTF-16LE")):
        half = head[first::2]
        if half and half.count(0) > 0.3 * len(half) > head[1 - first :: 2].count(0):
            return name
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head)  # a character may be cut at the end
        return "UTF-8"
    except UnicodeDecodeError:
        return "ISO-8859-1" if _UNASSIGNED & set(head) else "windows-1252"


def header_line(lines: Sequence[str], delimiter: str, min_columns: int) -> int:
    """The first line with so many cells that aren't empty, else 0."""
    return next((k for k, x in enumerate(lines) if sum(1 for c in x.strip().split(delimiter) if c.strip()) >= min_columns), 0)


class Quotes:
    """Whether a line ends inside quotes, by how it begins. A quote opens only at the beginning of a
    cell; two quotes inside stand for one; what follows a closing quote belongs to the cell."""

    def __init__(self, delimiter: str):
        d = re.escape(delimiter)
        cell = rf'(?:"(?:[^"]++|"")*+"(?!")[^{d}]*+|[^"{d}][^{d}]*+|)'
        self.closed = re.compile(rf"(?s)(?:{cell}{d})*+{cell}\Z")
        self.rest = re.compile(rf'(?s)(?:[^"]++|"")*+"(?!")[^{d}]*+')
        self.delimiter = delimiter

    def open_after(self, line: str, inside: bool) -> bool:
        if '"' not in line:
            return inside
        if inside:
            m = self.rest.match(line)
            if m is None:
                return True
            if m.end() == len(line):
                return False
            line = line[m.end() + 1 :]
        return self.closed.match(line) is None


def _cells(record: str, delimiter: str) -> list[str]:
    return next(csv.reader(io.StringIO(record, newline=""), delimiter=delimiter), [])


def _runs(batches: Iterator[pa.RecordBatch], encoding: str, skip: int, extra: int) -> Iterator[tuple]:
    """(file, split, further values, line) one by one, without the first lines of each file."""
    now, n = None, 0
    for batch in batches:
        for file, split, value, *more in zip(*(c.to_pylist() for c in batch.columns[: 3 + extra]), strict=True):
            n = n + 1 if now == (file, split) else 1
            now = (file, split)
            yield file, split, more, None if split == 0 and n <= skip else value.decode(encoding, "replace").removesuffix("\r")


def _records(lines: DataFrame, delimiter: str, encoding: str, skip: int) -> DataFrame:
    """(cells) of all records of lines (file, split, value)."""
    spark = lines.sparkSession

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes, found = Quotes(delimiter), {}
        for file, split, _, line in _runs(batches, encoding, skip, 0):
            outside, inside, closed = found.get((file, split), (False, True, False))
            if line is not None:
                outside, inside = quotes.open_after(line, outside), quotes.open_after(line, inside)
                closed = closed or not inside
            found[file, split] = (outside, inside, closed)
        rows = [(*k, *v) for k, v in found.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["file", "split", "outside", "inside", "closed"])

    def begins(splits: pd.DataFrame) -> pd.DataFrame:
        out, inside, owner = [], False, 0
        for r in splits.sort_values("split").itertuples():
            out.append((r.file, r.split, inside, owner if inside else r.split))
            if not inside or r.closed:  # a record that is open at the end began in this split
                owner = r.split
            inside = r.inside if inside else r.outside
        return pd.DataFrame(out, columns=["file", "split", "inside", "owner"])

    passed = lines.mapInArrow(ends, "file string, split bigint, outside boolean, inside boolean, closed boolean")
    starts = passed.groupBy("file").applyInPandas(begins, "file string, split bigint, inside boolean, owner bigint").persist()
    if starts.count() <= BROADCAST_SPLITS:
        known = lines.join(F.broadcast(starts), ["file", "split"])  # the lines stay in order
    else:
        numbered = lines.withColumn("_id", F.monotonically_increasing_id()).join(starts, ["file", "split"])
        known = numbered.repartition("file", "split").sortWithinPartitions("file", "split", "_id")
    known = known.select("file", "split", "value", "inside", "owner")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes = Quotes(delimiter)
        now, owner, inside, pending, rows = None, 0, False, [], []

        def fragment() -> None:
            if pending:
                rows.append((now[0], owner, now[1], "\n".join(pending), None))
                pending.clear()

        def made() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string())]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=["file", "owner", "split", "text", "cells"])

        for file, split, (begins_inside, begun_in), line in _runs(batches, encoding, skip, 2):
            if now != (file, split):
                fragment()
                now, inside, owner = (file, split), begins_inside, begun_in
                from_before = begins_inside
            if line is None:
                continue
            inside = quotes.open_after(line, inside)
            pending.append(line)
            if not inside:
                if from_before:
                    fragment()
                    owner, from_before = split, False
                else:
                    rows.append((None, None, None, None, _cells("\n".join(pending), delimiter)))
                    pending.clear()
            if len(rows) >= 4096:
                yield made()
        fragment()
        if rows:
            yield made()

    pieces = known.mapInArrow(cut, "file string, owner bigint, split bigint, text string, cells array<string>")
    whole = pieces.where(F.col("text").isNull()).select("cells")
    parts = pieces.where(F.col("text").isNotNull()).groupBy("file", "owner").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("split", "text"))), lambda p: p["text"]), "\n").alias("record"))

    @F.pandas_udf("array<string>")
    def cells(records: pd.Series) -> pd.Series:
        return records.map(lambda r: _cells(r, delimiter))

    return whole.unionByName(parts.select(cells("record").alias("cells")))


def _whole_files(spark: SparkSession, path: str, delimiter: str, encoding: str, skip: int) -> DataFrame:
    """(cells) of files in an encoding of two bytes, which is read by one task a file."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                text = io.TextIOWrapper(io.BytesIO(content), encoding, "replace", newline="")
                for _ in range(skip):
                    text.readline()
                found = csv.reader(text, delimiter=delimiter)
                while some := [cells for _, cells in zip(range(4096), found)]:
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.list_(pa.string()))], names=["cells"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "cells array<string>")


def read(
    spark: SparkSession,
    path: str,
    delimiter: str | None = None,
    header: bool | None = None,
    encoding: str | None = None,
    skip_rows: int = 0,
    header_row: int | None = None,
    min_columns: int = 1,
) -> DataFrame:
    """Trimmed strings of delimited files; rows without a value are left out.

    What isn't given is found from the beginning of the files: the encoding, the delimiter, and the
    header line after ``skip_rows`` lines: number ``header_row`` of these (from 0), or the first with
    ``min_columns`` cells that aren't empty; lines before it are left out. ``header`` tells whether it
    names the columns (else they are col_1 to col_n, and it is the first row). Columns without a name
    are left out, of columns of one name the last counts. All files of a path look alike.
    """
    head = head_bytes(spark, path)
    encoding = encoding or detect_encoding(head)
    wide = encoding.upper().replace("_", "-").startswith("UTF-16")
    head = head[: len(head) // 2 * 2] if wide else head  # a line end at the end of the file is lost
    lines = [x.removesuffix("\r") for x in head.decode(encoding, "replace").lstrip("﻿").split("\n")][skip_rows:]
    # counts rest on whole lines; the last one of a long head may be cut
    lines = lines[:-1] if len(lines) > 1 and len(head) >= HEAD_BYTES else lines
    delimiter = delimiter or tabular.sniff_delimiter(lines)
    start = header_row if header_row is not None else header_line(lines, delimiter, min_columns)
    reader = csv.reader((f"{x}\n" for x in lines[start:]), delimiter=delimiter)
    first = [c.strip() for c in next(reader, [])]
    if not first:
        return spark.createDataFrame([], "col_1 string")
    header = tabular.has_header(first) if header is None else header
    skip = skip_rows + start + (reader.line_num if header else 0)
    names = {name: k for k, name in enumerate(first if header else [f"col_{k + 1}" for k in range(len(first))]) if name}
    if wide:
        rows = _whole_files(spark, path, delimiter, encoding, skip)
    else:
        text = spark.read.option("lineSep", "\n").text(path)
        text = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))
        rows = _records(text, delimiter, encoding, skip)
    cell = lambda k: F.translate(F.coalesce(F.get("cells", F.lit(k)), F.lit("")), "﻿", "")
    table = rows.select(*(strip(cell(k)).alias(name) for name, k in names.items()))
    return table.where(F.concat_ws("", *(F.col(f"`{c.replace('`', '``')}`") for c in names)) != "")
