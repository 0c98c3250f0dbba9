"""Full-text search over records: index rows and weighted matches of terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bibloom.functions import extract

#: Weights of the fields of a match (fixed values).
BOOSTS = {"title": 3, "author": 2, "isbn": 1, "all_text": 1}


def documents(bibs: DataFrame) -> DataFrame:
    """(file_id, record_index, marc_001, title, author, isbn, all_text)."""
    title = F.concat_ws(" ", extract.first("245$a"), extract.first("245$b"))
    values = F.transform("fields", lambda f: F.coalesce(f["data"], F.array_join(F.transform(f["subfields"], lambda s: s["value"]), " ")))
    author = F.coalesce(extract.first("100$a"), extract.first("110$a"), F.lit(""))
    return bibs.select("file_id", "record_index", extract.first("001", default="").alias("marc_001"), title.alias("title"), author.alias("author"), extract.first("020$a", default="").alias("isbn"), F.array_join(values, " ").alias("all_text"))


def tokens(v: Column) -> Column:
    return F.filter(F.split(F.lower(v), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def search(docs: DataFrame, terms: Sequence[str], most: int = 20) -> DataFrame:
    """(record_index, marc_001, title, score): records with a term, the best first; the score
    adds a field's weight for every term that occurs in it."""
    wanted = F.array(*(F.lit(t.lower()) for t in terms))
    score = sum((F.lit(b) * F.size(F.array_intersect(wanted, tokens(F.col(c)))) for c, b in BOOSTS.items()), F.lit(0))
    found = docs.select("record_index", "marc_001", "title", score.alias("score")).where(F.col("score") > 0)
    return found.orderBy(F.col("score").desc(), "record_index").limit(most)


# ---- an inverted index

#: Parts of an index, by the hash of the term.
SHARDS = 64


def _shard(term: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(shards)).cast("int")


def postings(docs: DataFrame) -> DataFrame:
    """(term, field, record_index): each term once for every field of a record that it occurs in."""
    each = F.array(*(F.struct(F.lit(c).alias("field"), F.array_distinct(tokens(F.col(c))).alias("terms")) for c in BOOSTS))
    by_field = docs.select("record_index", F.explode(each).alias("e"))
    return by_field.select(F.explode("e.terms").alias("term"), "e.field", "record_index")


def write_index(docs: DataFrame, path: str, shards: int = SHARDS, mode: str = "error") -> None:
    """Write an index of ``documents``: postings, in a folder for each shard and sorted by term in
    there, and the records with what is shown of them, sorted by record_index.

    A common term spreads over several files, since ranges of the postings go on by record. With mode
    append, further records are added.
    """
    spread = postings(docs).withColumn("shard", _shard(F.col("term"), shards))
    order = ["shard", "term", "record_index"]
    spread.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("shard").parquet(f"{path}/postings")
    shown = docs.select("record_index", "marc_001", "title", F.lit(shards).alias("shards"))
    shown.repartitionByRange("record_index").sortWithinPartitions("record_index").write.mode(mode).parquet(f"{path}/records")


def search_index(spark: SparkSession, path: str, terms: Sequence[str], most: int = 20) -> DataFrame:
    """``search`` from a written index: the same rows, from the folders of the terms' shards, and of
    these the row groups that have a term.

    The indexes of the best records, ``most`` at most, go through the driver, so that the records
    are read by a filter on them.
    """
    records = spark.read.parquet(f"{path}/records")
    shards = records.select("shards").first()
    empty = records.select("record_index", "marc_001", "title").withColumn("score", F.lit(0)).limit(0)
    wanted = sorted({t.lower() for t in terms})
    if shards is None or not wanted:
        return empty
    places = spark.range(1).select(F.explode(F.array(*(_shard(F.lit(t), shards["shards"]) for t in wanted))).alias("s")).distinct()
    stored = spark.read.schema("term string, field string, record_index bigint, shard int").parquet(f"{path}/postings")
    hits = stored.where(F.col("shard").isin(*(r["s"] for r in places.collect())) & F.col("term").isin(*wanted))
    weight = F.coalesce(*(F.when(F.col("field") == c, b) for c, b in BOOSTS.items()))
    best = hits.groupBy("record_index").agg(F.sum(weight).cast("int").alias("score")).orderBy(F.col("score").desc(), "record_index").limit(most)
    found = {r["record_index"]: r["score"] for r in best.collect()}
    if not found:
        return empty
    score = F.coalesce(*(F.when(F.col("record_index") == i, s) for i, s in found.items()))
    shown = records.where(F.col("record_index").isin(*found)).select("record_index", "marc_001", "title", score.alias("score"))
    return shown.orderBy(F.col("score").desc(), "record_index")
