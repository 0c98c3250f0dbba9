"""A corpus pipeline of five stages over ``documents``.

Each stage takes the rows its predecessor wrote and returns rows with the same columns, except
for the last, which returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibloom.llm import bpe, decontaminate, langid, lines, simhash
from bibloom.llm.common import fresh, materialize, table
from bibloom.llm.queries import tokenizer_path


def _renamed(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """The rows with the columns of these names under others, which no column has, and by what names
    to find all columns: a caller's own values stay, whatever they are called."""
    now = {}
    for name in docs.columns:
        other = name if name not in names else fresh(docs, f"own_{name}")[0]
        now[name] = other
    return docs.select(*(F.col(f"`{c}`").alias(other) for c, other in now.items())), now


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told: without text or without a letter.

    ``lang`` becomes the predicted language, so that what follows and what is published doesn't
    depend on labels that may be missing. Other columns stay, of whatever name; an empty table stays
    empty.
    """
    profiles = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    rows, now = _renamed(docs, "lang_pred", "score")
    found = langid.predict_rows(rows, profiles).where(F.col("lang_pred") != langid.UNDETERMINED)
    return found.select(*(F.col("lang_pred" if c == "lang" else f"`{other}`").alias(c) for c, other in now.items()))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that are equal or similar to an earlier one; documents of which nothing but
    blank lines is left go. Null and empty texts and rows without an id stay as they are, other
    columns too, of whatever name; an empty table stays empty."""
    rows, now = _renamed(docs, "n_lines", "n_removed")
    found = lines.dedup(rows)
    left = found.where((F.col("n_removed") == 0) | (F.col("n_lines") > F.col("n_removed")))
    n_chars = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text"))
    left = left.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return left.select(*(F.col(f"`{other}`").alias(c) for c, other in now.items()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates keep the document with the least id, then hash of the
    text; rows that repeat both are repeats of it and go too, rows that share an id alone are
    documents of their own. Rows without an id can't be told apart and stay. Null and empty
    texts are near-duplicates of each other; an empty table stays empty. Columns may have any
    names."""
    key, id_, version = fresh(docs, "_key", "_id", "_version")
    text_hash = F.coalesce(F.xxhash64("text"), F.lit(0))
    named = docs.where(F.col("doc_id").isNotNull()).withColumn(key, F.struct(F.col("doc_id").alias("id"), text_hash.alias("version")))
    found = simhash.near_duplicates(named.select(key, "text"), id_col=key)
    kept = found.where(F.col(key) == F.col("component_id")).select(F.col(f"{key}.id").alias(id_), F.col(f"{key}.version").alias(version)).distinct()
    left = named.join(kept, (F.col(f"{key}.id") == F.col(id_)) & (F.col(f"{key}.version") == F.col(version)), "left_semi")
    left = left.dropDuplicates([key]).select(docs.columns)
    return left.unionByName(docs.where(F.col("doc_id").isNull()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that share ten consecutive words with a benchmark item (or a whole
    shorter item), each row by its own text. Rows without an id or text stay; empty tables, on
    either side, drop nothing. Columns may have any names."""
    id_, version = fresh(docs, "_id", "_version")
    found = decontaminate.decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = found.where("contaminated").select(F.col("doc_id").alias(id_), F.col("version").alias(version)).distinct()
    return docs.join(hit, (F.col("doc_id") == F.col(id_)) & (F.xxhash64("text") == F.col(version)), "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, ids, n_tokens; decoding them gives ``decoded``. Null and
    empty texts have none; rows without an id or that repeat one are encoded each."""
    found = bpe.encode(docs, tokenizer_path("word_bpe_49k.json"))
    return found.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

#: Trained profiles, hashed fingerprints and byte-pair merges have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
