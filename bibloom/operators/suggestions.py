"""Suggestions out of the replies of a language model, which are JSON as a rule.

A reply is text, perhaps within a code fence. It is parsed into a VARIANT; what isn't JSON, or not of
the expected shape, gives no rows instead of an error, entry by entry. Types are those of the JSON
values: a number where a text is due is no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bibloom.functions.text import strip

FENCE = "```"
#: Confidence of an entry that tells none, for maps and columns.
UNTOLD = 0.5


def unfenced(reply: Column) -> Column:
    """The text inside a fence that the reply begins with, without the word json, or all of it."""
    whole = strip(reply)
    inside = F.get(F.split(whole, FENCE), F.lit(1))
    return strip(F.when(whole.startswith(FENCE), F.when(inside.startswith("json"), F.substring(inside, 5, 1 << 30)).otherwise(inside)).otherwise(whole))


def parsed(reply: Column) -> Column:
    """The reply as a VARIANT, null where it isn't JSON."""
    return F.try_parse_json(F.nullif(unfenced(reply), F.lit("")))


def kind(value: Column, path: str = "$") -> Column:
    """The JSON type at a path: STRING, BIGINT, VOID, ARRAY, OBJECT...; null where there is nothing."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(value, path, "variant")), r"^\w+", 0)


def text(value: Column, path: str) -> Column:
    """A text at a path; null for other types."""
    return F.when(kind(value, path) == "STRING", F.try_variant_get(value, path, "string"))


def _confidence(value: Column, untold: float) -> Column:
    """Between 0 and 1: a number, or a text that is one; what isn't a number is 0."""
    path = "$.confidence"
    number = F.coalesce(F.try_variant_get(value, path, "string").try_cast("double"), F.when(F.try_variant_get(value, path, "boolean"), 1.0))
    inside = F.least(F.greatest(F.when(~F.isnan(number), number), F.lit(0.0)), F.lit(1.0))
    told = kind(value, path)
    return F.when(told.isNull() | (told == "VOID"), F.lit(untold)).otherwise(F.when(number.isNull() | F.isnan(number), 0.0).otherwise(inside))


def _reasoning(value: Column) -> Column:
    """The reasoning as text; a value of another type as its JSON."""
    path = "$.reasoning"
    told = kind(value, path)
    return F.when(told.isNull() | (told == "VOID"), F.lit(None)).when(told == "STRING", F.try_variant_get(value, path, "string")).otherwise(F.to_json(F.try_variant_get(value, path, "variant")))


def _entries(replies: DataFrame, array: Column, *more: Column) -> DataFrame:
    """The columns of ``replies`` and ``more`` with the objects of an array: position (from 0) and
    entry."""
    each = replies.select("*", *more, F.posexplode(F.try_variant_get(array, "$", "array<variant>")).alias("position", "entry"))
    return each.where(kind(F.col("entry")) == "OBJECT")


def value_suggestions(replies: DataFrame, reply: str = "reply", source: str = "source_value", target: str = "koha_value") -> DataFrame:
    """Targets suggested for values, from replies that are arrays of objects: the other columns of
    ``replies`` with position, source_value, target_value, confidence, reasoning.

    An entry needs a text that isn't empty as its source, and as target a text, or null or nothing,
    which stand for no match, as an empty text does; others are left out. Null, empty and broken
    replies, and those that aren't arrays, give no rows.
    """
    others = [c for c in replies.columns if c != reply]
    found = _entries(replies.select(*others, parsed(F.col(reply)).alias("_reply")), F.col("_reply"))
    e = F.col("entry")
    aim = kind(e, f"$.{target}")
    sound = (text(e, f"$.{source}") != "") & (aim.isNull() | aim.isin("VOID", "STRING"))
    return found.where(sound).select(
        *others,
        "position",
        text(e, f"$.{source}").alias("source_value"),
        F.nullif(text(e, f"$.{target}"), F.lit("")).alias("target_value"),
        _confidence(e, 0.0).alias("confidence"),
        _reasoning(e).alias("reasoning"),
    )


def map_suggestions(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Suggested field maps, from replies that are arrays of objects: the other columns of
    ``replies`` with position, source_tag, source_sub, target_tag, target_sub, transform_type (copy
    where none is told), transform_fn, preset_key, delete_source, confidence, reasoning. Entries
    whose tags aren't texts of three digits are left out; other replies give no rows."""
    others = [c for c in replies.columns if c != reply]
    found = _entries(replies.select(*others, parsed(F.col(reply)).alias("_reply")), F.col("_reply"))
    e = F.col("entry")
    tag = lambda name: text(e, f"$.{name}").rlike(r"^\d{3}$")
    plain = [text(e, f"$.{name}").alias(name) for name in ("source_tag", "source_sub", "target_tag", "target_sub")]
    return found.where(tag("source_tag") & tag("target_tag")).select(
        *others,
        "position",
        *plain,
        F.coalesce(text(e, "$.transform_type"), F.lit("copy")).alias("transform_type"),
        text(e, "$.transform_fn").alias("transform_fn"),
        text(e, "$.preset_key").alias("preset_key"),
        F.coalesce(F.try_variant_get(e, "$.delete_source", "boolean"), F.lit(False)).alias("delete_source"),
        _confidence(e, UNTOLD).alias("confidence"),
        _reasoning(e).alias("reasoning"),
    )


def column_suggestions(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Suggested maps of item columns, from replies that are objects with an array ``mappings``: the
    other columns of ``replies`` with position, source_column (trimmed), target_subfield, ignored (no
    target), transform_type, confidence, reasoning, and of the whole reply key_column and match_tag.
    Entries without a source column are left out; other replies give no rows."""
    others = [c for c in replies.columns if c != reply]
    whole = replies.select(*others, parsed(F.col(reply)).alias("_reply")).where(kind(F.col("_reply")) == "OBJECT")
    v = F.col("_reply")
    found = _entries(whole, F.try_variant_get(v, "$.mappings", "variant"), text(v, "$.bib_key_column").alias("key_column"), text(v, "$.bib_match_tag").alias("match_tag"))
    e = F.col("entry")
    source = strip(text(e, "$.source_column"))
    return found.where(source != "").select(
        *others,
        "position",
        source.alias("source_column"),
        text(e, "$.target_subfield").alias("target_subfield"),
        text(e, "$.target_subfield").isNull().alias("ignored"),
        F.coalesce(text(e, "$.transform_type"), F.lit("copy")).alias("transform_type"),
        _confidence(e, UNTOLD).alias("confidence"),
        _reasoning(e).alias("reasoning"),
        "key_column",
        "match_tag",
    )


#: Severities of findings, the gravest first (fixed values).
SEVERITIES = ("action_required", "warning", "info")


def findings(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Findings of a health report, from replies with an object that has an array ``findings``, prose
    around it allowed: the other columns of ``replies`` with rank (from 1, the gravest first, then in
    the order of the reply), severity, category, title, detail, record_count_estimate, tag_hint. What
    an entry doesn't tell gets a word for it; unknown severities come last."""
    others = [c for c in replies.columns if c != reply]
    inner = F.regexp_extract(unfenced(F.col(reply)), r"(?s)\{.*\}", 0)
    whole = replies.select(*others, F.try_parse_json(F.nullif(inner, F.lit(""))).alias("_reply"))
    found = _entries(whole, F.try_variant_get("_reply", "$.findings", "variant"))
    e = F.col("entry")
    told = lambda name, other: F.coalesce(F.nullif(text(e, f"$.{name}"), F.lit("")), F.lit(other)).alias(name)
    order = F.create_map(*(F.lit(x) for k, name in enumerate(SEVERITIES) for x in (name, k)))
    rows = found.select(
        *others,
        "position",
        told("severity", "info"),
        told("category", "other"),
        told("title", "(untitled)"),
        told("detail", ""),
        F.try_variant_get(e, "$.record_count_estimate", "bigint").alias("record_count_estimate"),
        text(e, "$.tag_hint").alias("tag_hint"),
    )
    grave = F.coalesce(F.try_element_at(order, F.col("severity")), F.lit(len(SEVERITIES)))
    rank = F.row_number().over(Window.partitionBy(*others).orderBy(grave, "position"))  # one reply's
    return rows.withColumn("rank", rank).select(*others, "rank", *rows.columns[len(others) + 1 :])
