"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

Equal lines are one item. An item's character shingles are all hashed once; under each of a
number of seeds the least hash, compared after an exclusive or with the seed, is one MinHash
value (the seeds differ in their top bits, so each looks at another part of the range). Values
are banded for high recall, items that share a band are verified by exact Jaccard similarity of
their character shingles, components are found by a distributed union-find, and of each component
one line is kept: the first in order of document and place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibloom.llm.common import bounded, discard, fresh, materialize, once
from bibloom.llm.linking import Match, colliding, linked_components

#: Characters of a shingle: one changed character breaks so many of a line's.
SHINGLE = 5
THRESHOLD = 0.8
#: MinHash values, and bands of so many of them. Each value is in two bands. Unrelated lines share
#: one or two of a hundred shingles of five characters, so with fewer rows they would collide in
#: masses that grow with the square of the lines. By simulation a pair at 0.8 meets in some band with
#: probability 0.98, at 0.85 with 0.997.
VALUES = 48
BANDS = 16
ROWS = 6
#: Shingles of a row while they are hashed.
_STEP = 4


def seeds(count: int, bits: int = 64) -> list[int]:
    """Signed numbers with evenly spaced top bits and mixed lower ones (a multiplicative
    sequence)."""
    out = []
    for k in range(count):
        mixed = (k + 1) * 0x9E3779B97F4A7C15 * (2 * k + 3) & (1 << 64) - 1
        low = (1 << bits - 6) - 1
        out.append(((k << bits) // count & ~low | mixed >> 64 - bits & low) - (1 << bits - 1))
    return out


def band_places(values: int, bands: int, rows: int) -> list[list[int]]:
    """The values of each band: first runs of neighbours, then one value of every run."""
    runs = values // rows
    straight = [[b * rows + r for r in range(rows)] for b in range(runs)]
    across = [[r * runs + b for r in range(rows)] for b in range(runs)]
    if bands > 2 * runs:
        raise ValueError(f"{values} values make no more than {2 * runs} bands of {rows}")
    return [*straight, *across][:bands]


def lines_of(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc, version, place, line, line_id) of every line that isn't blank; place counts from 0.

    ``version``, a hash of the text, tells rows that share an id apart where their texts differ.
    Lines are equal if their 128-bit line_id is.
    """
    lines = df.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("version"), F.posexplode(F.split(text, "\n")).alias("place", "line"))
    return lines.where(F.trim("line") != "").withColumn("line_id", F.unhex(F.md5("line")))


def _wide(line: Column) -> Column:
    """The characters at two bytes each, so that a shingle is cut in constant time."""
    return F.encode(line, "UTF-16BE")


def _shingle_hash(wide: Column, at: Column, shingle: int) -> Column:
    return F.xxhash64(F.substring(wide, 2 * at + 1, F.lit(2 * shingle)))


def signatures(lines: DataFrame, shingle: int = SHINGLE, values: int = VALUES, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(line_id, keys): the buckets of each distinct line of at least ``shingle`` characters.

    Explosion, hashing and the minima run as one generated loop that combines before the
    shuffle, a few shingles at a time; minima are taken over 32 bits to halve what is shuffled.
    """
    wide = lines.select("line_id", _wide(F.col("line")).alias("wide")).where(F.octet_length("wide") >= 2 * shingle)
    wide = wide.withColumn("last", (F.octet_length("wide") / 2).cast("int") - shingle)
    placed = wide.select("line_id", "wide", "last", F.explode_outer(F.sequence(F.lit(0), F.col("last"), F.lit(_STEP))).alias("at"))

    def hashed(step: int) -> Column:
        # past the end the last shingle comes again, which changes no minimum
        at = F.least(F.col("at") + step, F.col("last")) if step else F.col("at")
        h = F.shiftright(_shingle_hash(F.col("wide"), at, shingle), 32).cast("int")
        return once(h, 0).alias(f"h{step}")

    hashes = placed.select("line_id", *(hashed(k) for k in range(_STEP)))
    least = [F.min(F.least(*(F.col(f"h{k}").bitwiseXOR(F.lit(s)) for k in range(_STEP)))).alias(f"m{n}") for n, s in enumerate(seeds(values, 32))]
    mins = hashes.groupBy("line_id").agg(*least)
    keys = [F.xxhash64(F.lit(b), *(f"m{n}" for n in places)) for b, places in enumerate(band_places(values, bands, rows))]
    return mins.select("line_id", F.array(*keys).alias("keys"))


def shingle_set(line: Column, shingle: int) -> Column:
    """Distinct hashes of the character shingles of a line of at least ``shingle`` characters."""

    def hashes(wide: Column) -> Column:
        last = (F.octet_length(wide) / 2).cast("int") - shingle
        return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: _shingle_hash(wide, i, shingle)))

    return F.flatten(F.transform(F.array(_wide(line)), hashes))


def line_components(
    lines: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, values: int = VALUES, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """(line_id, component) of the lines that have a similar, not equal, one; component is the
    line_id of one of them."""
    signed = signatures(lines, shingle, values, bands, rows).withColumn("id", F.monotonically_increasing_id())
    signed = materialize(signed, "signatures")
    shared = colliding(signed)
    names = signed.select("id", "line_id")
    wanted = names.join(bounded(materialize(shared.select("id").distinct(), "colliding-ids")), "id", "left_semi")
    wanted = materialize(wanted, "colliding-lines")
    discard(signed)
    texts = lines.select("line_id", "line").join(bounded(wanted), "line_id").groupBy("id").agg(F.first("line").alias("content"))
    content = materialize(texts, "line-texts")
    match = Match(lambda c: shingle_set(c, shingle), threshold)
    found = linked_components(shared, content, match)
    discard(shared, content)
    heads = wanted.select(F.col("id").alias("component"), F.col("line_id").alias("head"))
    named = found.join(bounded(wanted), F.col("node") == F.col("id")).join(heads, "component")
    return named.select("line_id", F.col("head").alias("component"))


def dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    values: int = VALUES,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """Every row with its lines that were first of their component, and what was removed:
    all columns of ``df`` with the new text, n_lines, n_removed.

    A line is removed if an earlier one (by id, then text for rows that share an id, then place)
    is equal to it or in its component. Blank lines stay. Lines shorter than a shingle are
    compared for equality alone. A null text stays null, an empty one empty, with no lines. Rows
    that repeat an id and the text count as one document and are treated alike; rows that share
    an id and differ in text are documents of their own. In rows with a null id every line stays.
    Columns of any names are kept, but for n_lines and n_removed, which are replaced. Texts of
    any length are taken whole; an empty table gives an empty result.
    """
    lines = lines_of(df.where(F.col(id_col).isNotNull()), id_col, text)
    components = materialize(line_components(lines, shingle, threshold, values, bands, rows), "line-components")
    places = materialize(lines.select("doc", "version", "place", "line_id"), "lines")
    return without_lines(df, repeats(places, components), id_col, text)


def repeats(lines: DataFrame, components: DataFrame) -> DataFrame:
    """(doc, version, place) of every place but the first of lines that occur again or are
    similar to another; ``lines``, a written table, has doc, version, place and line_id."""
    counts = lines.groupBy("line_id").agg(F.count(F.lit(1)).alias("n"))
    groups = counts.join(bounded(components), "line_id", "left").where((F.col("n") > 1) | F.col("component").isNotNull())
    groups = materialize(groups.select("line_id", F.coalesce("component", "line_id").alias("component")), "repeated-lines")
    places = materialize(lines.join(bounded(groups), "line_id").select("component", "doc", "version", "place"), "places")
    first = materialize(places.groupBy("component").agg(F.min(F.struct("doc", "version", "place")).alias("first")), "first-places")
    found = places.join(bounded(first), "component").where(F.struct("doc", "version", "place") != F.col("first"))
    return found.select("doc", "version", "place")


def without_lines(df: DataFrame, gone: DataFrame, id_col: str, text: str) -> DataFrame:
    """The rows of ``df`` without the lines at (doc, version, place), with n_lines and n_removed."""
    keep = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    doc, version, places = fresh(df, "_doc", "_version", "_gone")
    by_doc = gone.groupBy(F.col("doc").alias(doc), F.col("version").alias(version)).agg(F.collect_set("place").alias(places))
    by_doc = materialize(by_doc, "removed-places")
    own = (F.col(id_col) == F.col(doc)) & (F.xxhash64(text) == F.col(version))
    joined = df.select(*keep).join(bounded(by_doc, F.size(places) + 2), own, "left").drop(doc, version)

    def left(parts: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(places))
        return F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")

    # the lines are bound by a lambda, so that a text is split once
    split = F.split(text, "\n")
    new = F.when(F.col(places).isNull(), F.col(text)).otherwise(F.get(F.transform(F.array(split), left), 0))
    blank = F.size(F.filter(split, lambda line: F.trim(line) == ""))
    return joined.select(
        *(new.alias(c) if c == text else F.col(c) for c in keep),
        F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(split) - blank).cast("long").alias("n_lines"),
        F.coalesce(F.size(places), F.lit(0)).cast("long").alias("n_removed"),
    )
