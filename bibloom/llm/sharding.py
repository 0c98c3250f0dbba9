"""Shards that all have the mixture of the whole: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibloom.llm.common import with_positions

#: Bytes that count for a document besides its text.
DOCUMENT_OVERHEAD = 16


def interleave(df: DataFrame, shards: int = 40, seed: int = 0, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Deal the rows to ``shards`` shards of equal counts, each with every source's share.

    Rows of a source are ranked in a seeded random order; rank r of n stands at the fraction
    (r + 1/2) / n. All rows are sorted by this fraction and cut into runs whose lengths differ
    by one at most, so a shard has of each source its share of rows, give or take two.

    Returns id_col, size (UTF-8 bytes of the text, none if null, plus 16), text_crc32
    (unsigned; of the empty text if null), law, shard, slot (gapless from 0 in a shard, in the
    interleaved order), grown_shard (null: this law moves rows when shards are added), source.
    Null sources are a source of their own. Repeated rows each get a place of their own. With
    fewer rows than shards some shards stay empty; an empty table gives an empty result. Other
    columns are dropped. Both sorts are by range, so a hot source spreads over many tasks, and
    texts are left behind in the first scan.
    """
    rows = df.select(
        F.col(id_col).alias("_id"),
        F.col(source).alias("_source"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + DOCUMENT_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    ).withColumns(
        {
            "_stratum": F.coalesce(F.concat(F.lit("s"), F.col("_source").cast("string")), F.lit("")),
            "_shuffled": F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_id").cast("string"))),
        }
    )
    order = [F.col("_shuffled").asc(), F.col("_id").asc_nulls_first(), F.col("text_crc32").asc()]
    ranked = with_positions(rows, ["_stratum"], order, "_rank", "_n")
    placed = ranked.withColumn("_at", (F.col("_rank") + 0.5) / F.col("_n")).drop("_n")
    order = [F.col("_at").asc(), F.col("_stratum").asc(), F.col("_rank").asc()]
    placed = with_positions(placed, [], order, "_position", "_total")
    # in whole numbers: shard s has the positions from ceil(s * total / shards) on
    placed = placed.withColumn("shard", F.expr(f"cast(_position * {shards} div _total as int)"))
    position, first = F.col("_position"), F.expr(f"(cast(shard as bigint) * _total + {shards - 1}) div {shards}")
    return placed.select(
        F.col("_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (position - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("_source").alias(source),
    )
