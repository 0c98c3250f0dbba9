"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is ``window`` consecutive words. Of the hashes of its word ``gram``-grams the least one
is its fingerprint; since equal windows have equal fingerprints, joining the fingerprints of
documents and items finds every shared window, and neighbouring windows mostly share theirs.
A hit is then extended over the words themselves: the windows of the item that have the
fingerprint are compared with the document's words at that place. Spans shared over more than
one window come out as the union of their windows.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. An item of fewer words
than a window, but not none, is one window by itself, found by the hash of as many words.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibloom.llm.common import materialize

WINDOW = 10
GRAM = 6
#: Windows of the items are broadcast up to this number (some 200 bytes each), else shuffled.
BROADCAST_WINDOWS = 100_000

_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z; of null: none."""
    plain = F.length(text) == F.octet_length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.coalesce(F.array_remove(F.split(low, _NO_WORD), ""), F.array().cast("array<string>"))


def _hashes(of: str) -> Column:
    return F.transform(F.col(of), lambda w: F.xxhash64(w))


def _places(n: Column, length: int) -> Column:
    """0-based starts of the runs of ``length`` in n."""
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def _runs(hashes: str, length: int) -> Column:
    """The hash of each run of ``length`` words, from the hashes of the words."""
    h = F.col(hashes)
    return F.transform(_places(F.size(h), length), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(length))))


def _wholes(hashes: str, length: int) -> Column:
    """The hash of each run of ``length`` words, as for an item that is one window."""
    h = F.col(hashes)
    return F.transform(_places(F.size(h), length), lambda i: F.xxhash64(F.slice(h, i + 1, length)))


def _least(values: str, length: int) -> Column:
    """The least value of each run of ``length``."""
    v = F.col(values)
    return F.transform(_places(F.size(v), length), lambda i: F.least(*(F.get(v, i + k) for k in range(length))))


def item_windows(items: DataFrame, item_id: str, text: str, window: int, gram: int) -> DataFrame:
    """(length, fingerprint, window_words, item_id): distinct windows of each item."""
    base = items.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("w"))
    long = (
        base.where(F.size("w") >= window)
        .withColumn("h", _hashes("w"))
        .withColumn("g", _runs("h", gram))
        .withColumn("f", _least("g", window - gram + 1))
        .select("item_id", "w", F.posexplode_outer("f").alias("at", "fingerprint"))
        .select(F.lit(window).alias("length"), "fingerprint", F.expr(f"slice(w, at + 1, {window})").alias("window_words"), "item_id")
    )
    short = base.where(F.size("w").between(1, window - 1)).withColumn("h", _hashes("w"))
    short = short.select(F.size("w").alias("length"), F.xxhash64("h").alias("fingerprint"), F.col("w").alias("window_words"), "item_id")
    return long.unionByName(short).distinct()


def hits(docs: DataFrame, windows: DataFrame, window: int, gram: int, id_col: str, text: str) -> DataFrame:
    """(id_col, version, at, length, window_id) for every window that occurs at word ``at`` of a
    document; ``version``, a hash of the text, tells rows of one id apart."""
    base = docs.select(id_col, F.xxhash64(text).alias("version"), words(F.col(text)).alias("w")).withColumn("h", _hashes("w"))
    small = windows.count() <= BROADCAST_WINDOWS
    side = F.broadcast if small else lambda df: df
    out = None
    for (length,) in windows.select("length").distinct().orderBy("length").collect():  # at most ``window`` rows
        own = windows.where(F.col("length") == length).select("fingerprint", "window_words", "window_id")
        if length == window:
            prints = base.withColumn("g", _runs("h", gram)).withColumn("f", _least("g", window - gram + 1))
        else:
            prints = base.withColumn("f", _wholes("h", length))
        # outer: for an inner one Catalyst adds a filter on the array and computes it in there
        # anew, lambda within lambda; rows without a fingerprint don't survive the join
        rows = prints.select(id_col, "version", "w", F.posexplode_outer("f").alias("at", "fingerprint"))
        if not small:  # leave the document's other words behind before the shuffle
            rows = rows.select(id_col, "version", "at", "fingerprint", F.expr(f"slice(w, at + 1, {length})").alias("here"))
            found = rows.join(own, "fingerprint").where(F.col("here") == F.col("window_words"))
        else:
            found = rows.join(side(own), "fingerprint").where(F.expr(f"slice(w, at + 1, {length})") == F.col("window_words"))
        found = found.select(id_col, "version", "at", F.lit(length).alias("length"), "window_id")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    id_col: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """What each document shares with the items: id_col, n_words, n_hit (words inside an
    occurrence of a window), n_items, items_sha256 (of the ids of the items with occurring
    windows, sorted as strings and comma-joined), contaminated, version (a hash of the text).

    A null or wordless text has no words and no hits; items without words match nothing; equal
    items are all reported, an item that repeats its id counts once. Rows that share an id are
    reported each with the hits of its own text; rows with a null id have no hits. Empty tables, on either side, give no hits. Other
    columns are dropped. Texts of any length are taken whole.
    """
    windows = item_windows(items, item_id, item_text, window, gram)
    windows = materialize(windows.withColumn("window_id", F.md5(F.concat_ws(" ", F.col("length"), F.array_join("window_words", " ")))), "windows")
    texts = windows.select("length", "fingerprint", "window_words", "window_id").distinct()
    owners = windows.select("window_id", "item_id").distinct()
    counts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_version"), F.size(words(F.col(text))).cast("long").alias("n_words"))
    found = hits(docs, texts, window, gram, id_col, text)
    if found is None:
        none = counts.withColumns({"n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "ids": F.array().cast("array<string>")})
    else:
        found = materialize(found, "hits")
        places = found.select(id_col, "version", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("length") - 1)).alias("word")).distinct()
        hit = places.groupBy(id_col, "version").agg(F.count(F.lit(1)).alias("n_hit"))
        pairs = found.select(id_col, "version", "window_id").distinct().join(owners, "window_id").select(id_col, "version", F.col("item_id").cast("string").alias("item_id")).distinct()
        by_doc = pairs.groupBy(id_col, "version").agg(F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list("item_id")).alias("ids"))
        sums = hit.join(by_doc, [id_col, "version"]).withColumnsRenamed({id_col: "_hit_id", "version": "_hit_version"})
        none = counts.join(sums, (F.col("_id") == F.col("_hit_id")) & (F.col("_version") == F.col("_hit_version")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return none.select(
        F.col("_id").alias(id_col),
        "n_words",
        zero("n_hit").alias("n_hit"),
        zero("n_items").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (zero("n_hit") > 0).alias("contaminated"),
        F.col("_version").alias("version"),
    )
