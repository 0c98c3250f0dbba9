"""Tables that a migration is steered by: field maps and their templates, suggestions, issues,
values with descriptions, versions, running tasks and alerts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bibloom.functions.text import strip

# ---- field maps

#: Columns of a template, in order (fixed values of the file).
TEMPLATE = ("source_tag", "source_sub", "target_tag", "target_sub", "transform_type", "transform_fn", "preset_key", "delete_source", "notes")
#: What is kept of a map in a template.
SAVED = TEMPLATE[:7]


def maps_of(maps: DataFrame, status: str | None = None) -> DataFrame:
    """approved ones; pending: suggested, not approved; manual: neither. None: all."""
    tests = {"approved": F.col("approved"), "pending": ~F.col("approved") & F.col("suggested"), "manual": ~F.col("approved") & ~F.col("suggested")}
    return maps.where(tests[status]) if status else maps


def approve(maps: DataFrame, confidence: float) -> DataFrame:
    """Approve what has no confidence, being made by hand, or at least this one."""
    return maps.withColumn("approved", F.col("approved") | F.col("confidence").isNull() | (F.col("confidence") >= confidence))


def read_template(rows: DataFrame, order: str) -> DataFrame:
    """Template rows of a table of strings: headers in any case, trimmed values, rows without
    source or target tag left out, of equal source and target the first by ``order``."""
    named = {c.strip().lower(): c for c in rows.columns}
    text = {c: strip(F.coalesce(F.col(f"`{named[c]}`").cast("string"), F.lit(""))) if c in named else F.lit("") for c in TEMPLATE}
    blank = lambda c: F.when(text[c] != "", text[c])
    made = {c: blank(c) for c in TEMPLATE}
    made["transform_type"] = F.coalesce(blank("transform_type"), F.lit("copy"))
    made["delete_source"] = F.lower(text["delete_source"]).isin("true", "1", "yes")
    found = rows.select(F.col(order).alias("_order"), *(made[c].alias(c) for c in TEMPLATE)).where(F.col("source_tag").isNotNull() & F.col("target_tag").isNotNull())
    key = [F.coalesce(c, F.lit("")) for c in TEMPLATE[:4]]
    first = Window.partitionBy(*key).orderBy("_order")
    return found.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).drop("_n", "_order")


def write_template(maps: DataFrame) -> DataFrame:
    """The columns of a template file as strings, nulls empty, delete_source true or false."""
    flag = F.when(F.coalesce(F.col("delete_source").cast("boolean"), F.lit(False)), "true").otherwise("false")
    return maps.select(*(flag.alias(c) if c == "delete_source" else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in TEMPLATE))


def save_template(maps: DataFrame, pending: bool = False) -> DataFrame:
    """The approved maps, and the pending ones where asked for, in the columns that are kept."""
    kept = maps_of(maps, "approved").unionByName(maps_of(maps, "pending")) if pending else maps_of(maps, "approved")
    return kept.select(*SAVED)


def _source(columns: Sequence[str] = ("source_tag", "source_sub")) -> list[Column]:
    return [F.coalesce(F.col(c), F.lit("")).alias(f"_{c}") for c in columns]


def merge_template(maps: DataFrame, template: DataFrame, replace: bool = False) -> DataFrame:
    """Maps after a template: ``replace`` takes the template alone; else a template row whose
    source has an approved map is left out, and other ones replace what isn't approved of their
    source. Template rows come in unapproved and unsuggested."""
    new = template.select(*SAVED).withColumns({"approved": F.lit(False), "suggested": F.lit(False), "confidence": F.lit(None).cast("double")})
    columns = [c for c in maps.columns if c in new.columns]
    if replace:
        return new.select(*columns)
    keys = ["_source_tag", "_source_sub"]
    own = maps.select(*columns, *_source())
    incoming = new.select(*columns, *_source()).join(own.where("approved").select(*keys).distinct(), keys, "left_anti")
    kept = own.join(incoming.select(*keys).distinct().withColumn("_hit", F.lit(True)), keys, "left").where(F.col("approved") | F.col("_hit").isNull())
    return kept.select(*columns).unionByName(incoming.select(*columns))


def upsert(existing: DataFrame, suggestions: DataFrame, locked_by: Sequence[str], same_by: Sequence[str]) -> DataFrame:
    """Rows after suggestions: one whose ``locked_by`` columns an approved row has is left out;
    one whose ``same_by`` columns an unapproved row has takes its place; others are added. They
    come in unapproved and suggested. Null columns count as empty."""
    columns = existing.columns
    new = suggestions.withColumns({"approved": F.lit(False), "suggested": F.lit(True)})
    new = new.select(*(F.col(c) if c in new.columns else F.lit(None).alias(c) for c in columns))
    lock, same = [f"_{c}" for c in locked_by], [f"_{c}" for c in same_by]
    approved = existing.where("approved").select(*_source(locked_by)).distinct()
    new = new.select(*columns, *_source(list(dict.fromkeys([*locked_by, *same_by])))).join(approved, lock, "left_anti")
    hit = new.select(*same).distinct().withColumn("_hit", F.lit(True))
    kept = existing.select(*columns, *_source(same_by)).join(hit, same, "left").where(F.col("approved") | F.col("_hit").isNull())
    return kept.select(*columns).unionByName(new.select(*columns))


def rename_column(maps: DataFrame, columns: Sequence[str], old: str, new: str) -> tuple[list[str], DataFrame]:
    """The headers and the maps after a column of the source got another name."""
    if old not in columns:
        raise ValueError(f"no column {old!r}")
    if new != old and new in columns:
        raise ValueError(f"there is a column {new!r}")
    renamed = maps.withColumn("source_column", F.when(F.col("source_column") == old, new).otherwise(F.col("source_column")))
    return [new if c == old else c for c in columns], renamed


# ---- values, files and formats


def ordered_values(counts: DataFrame, group: str) -> DataFrame:
    """Counts with their place, from 1, in the file of their group: most frequent first, equals
    by value. Groups are as large as they have different values."""
    return counts.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(F.col("n").desc(), F.col("value").asc())))


def write_values(counts: DataFrame, group: str, path: str) -> None:
    """One folder of CSV for each group, in order."""
    placed = ordered_values(counts, group)
    placed.repartitionByRange(F.col(group), F.col("position")).sortWithinPartitions(group, "position").drop("position").write.partitionBy(group).option("header", True).csv(path)


def described(counts: DataFrame, descriptions: DataFrame, keys: Sequence[str] = ("category", "value")) -> DataFrame:
    """Values with their description, empty where there is none."""
    return counts.join(descriptions.select(*keys, "description"), list(keys), "left").fillna("", ["description"])


#: Names of code and description by kind of authority (fixed values of the interface).
AUTHORITY = {
    "itype": (("itemtype", "item_type"), ("description",)),
    "homebranch": (("branchcode", "library_id"), ("branchname", "name")),
    "holdingbranch": (("branchcode", "library_id"), ("branchname", "name")),
    "": (("value", "authorised_value", "authorised_value_id"), ("description", "lib")),
}


def authority_values(cells: DataFrame, vocabulary: str, column: str = "cells") -> DataFrame:
    """(code, description) of records of an authority list, given as maps of strings."""

    def first(names: Sequence[str]) -> Column:
        found = [F.try_element_at(column, F.lit(n)) for n in names]
        return F.coalesce(*(F.when(v != "", v) for v in found), F.lit(""))

    code, label = AUTHORITY.get(vocabulary, AUTHORITY[""])
    return cells.select(first(code).alias("code"), first(label).alias("description"))


#: Parts of file names that patron files likely have (fixed values).
PATRON_WORDS = ("patron", "borrower", "user", "member", "reader", "cardholder")


def patron_files(files: DataFrame, name: str = "filename") -> DataFrame:
    """Files with is_patron_likely; such ones first, then by name in lower case."""
    likely = F.lower(name).rlike("|".join(PATRON_WORDS)).alias("is_patron_likely")
    return files.select("*", likely).orderBy(F.col("is_patron_likely").desc(), F.lower(name))


#: Headers that tell new ids from legacy ones (fixed values).
NEW_IDS = {"patron": {"patron_id", "borrowernumber"}, "bib": {"biblio_id", "biblionumber"}}
LEGACY_IDS = {
    "patron": {"patron_barcode", "patron_cardnumber", "cardnumber", "borrower_barcode"},
    "bib": {"legacy_bib_id", "bib_control_number", "bib_001", "control_number", "legacy_biblionumber"},
}


def holds_format(headers: Sequence[str]) -> str:
    """format_a: ids of the target; format_b: legacy ids that must be resolved."""
    have = {h.strip().lower() for h in headers}
    if all(have & NEW_IDS[k] for k in NEW_IDS):
        return "format_a"
    return "format_b" if any(have & LEGACY_IDS[k] for k in LEGACY_IDS) else "format_a"


# ---- issues


def issues_page(issues: DataFrame, offset: int, limit: int, **equal: str) -> DataFrame:
    """A page of the issues with the given column values, by record and category."""
    found = reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]), equal.items(), issues)
    return found.orderBy("record_index", "category").offset(offset).limit(limit)


def annotated(bibs: DataFrame, issues: DataFrame) -> DataFrame:
    """Records with their issues as an array, by category and tag; empty where there is none."""
    entry = F.struct(F.col("category"), F.coalesce("tag", F.lit("LDR")).alias("tag"), F.col("severity"), F.col("original_value"), F.col("suggested_fix"))
    found = issues.groupBy("file_id", "record_index").agg(F.sort_array(F.collect_list(entry)).alias("issues"))
    joined = bibs.join(found, ["file_id", "record_index"], "left")
    return joined.withColumn("issues", F.coalesce("issues", F.filter(F.array(F.lit(None).cast(found.schema["issues"].dataType.elementType)), lambda x: x.isNotNull())))


def set_status(issues: DataFrame, status: str, condition: Column) -> DataFrame:
    return issues.withColumn("status", F.when(condition, status).otherwise(F.col("status")))


def by_severity(findings: DataFrame) -> DataFrame:
    """Findings with action required first, then warnings, then information, then others."""
    rank = F.when(F.col("severity") == "action_required", 0).when(F.col("severity") == "warning", 1).when(F.col("severity") == "info", 2).otherwise(3)
    return findings.orderBy(rank, "title")


def preview(before: DataFrame, after: DataFrame, specs: Mapping[str, Column]) -> DataFrame:
    """(record_index, and for each name its value before and after) of records that both have."""
    side = lambda df, end: df.select("record_index", *(c.alias(f"{name}_{end}") for name, c in specs.items()))
    return side(before, "before").join(side(after, "after"), "record_index")


def first_changes(changes: DataFrame, most: int = 100, key: str = "marc_001") -> DataFrame:
    """The changed ones with the least ids; added and removed ones are not among them."""
    return changes.where(F.col("change") == "changed").orderBy(key).limit(most)


# ---- versions, tasks and alerts


def next_version(versions: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """The number after the greatest one, by group where there are groups; 1 if there is none."""
    n = (F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version")
    return versions.groupBy(*group).agg(n) if group else versions.agg(n)


def save_version(bibs: DataFrame, path: str) -> int:
    """Write the records as the next version below a path, and return its number."""
    spark = bibs.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    last = spark.read.parquet(path).agg(F.max("version")).first()[0] if there else None
    number = (last or 0) + 1
    bibs.write.parquet(f"{path}/version={number}")
    return number


def running_tasks(tables: Sequence[DataFrame], now: Column) -> DataFrame:
    """(task_id, kind, duration_sec) of what runs in any of several tables (task_id, kind, status,
    started_at), the longest first."""
    both = reduce(lambda a, b: a.unionByName(b), (t.select("task_id", "kind", "status", "started_at") for t in tables))
    lasted = (F.unix_timestamp(now) - F.unix_timestamp("started_at")).alias("duration_sec")
    return both.where(F.col("status") == "running").select("task_id", "kind", lasted).orderBy(F.col("duration_sec").desc_nulls_last(), "task_id")


def task_history(tables: Sequence[DataFrame], statuses: Sequence[str] = ("done", "failed"), offset: int = 0, limit: int = 50) -> DataFrame:
    """(task_id, kind, status, started_at, finished_at, duration_sec) of what has ended in any of
    several tables, the latest beginnings first, one page of it."""
    both = reduce(lambda a, b: a.unionByName(b), (t.select("task_id", "kind", "status", "started_at", "finished_at") for t in tables))
    lasted = (F.unix_timestamp("finished_at") - F.unix_timestamp("started_at")).alias("duration_sec")
    return both.where(F.col("status").isin(*statuses)).select("*", lasted).orderBy(F.col("started_at").desc_nulls_last(), "task_id").offset(offset).limit(limit)


#: Limits of the alerts (fixed values): tasks that wait, seconds of a long and of a hung task.
BACKLOG, LONG_SECONDS, HUNG_SECONDS = 50, 1800, 3600


def alerts(queues: DataFrame, tasks: DataFrame, workers: DataFrame | None = None) -> DataFrame:
    """(severity, kind, subject, amount): queues (queue, depth) that are too deep, running tasks
    (task_id, duration_sec) that are hung or long, and, where ``workers`` are given, that there are
    none."""
    deep = queues.where(F.col("depth") > BACKLOG).select(F.lit("warn").alias("severity"), F.lit("queue_backlog").alias("kind"), F.col("queue").cast("string").alias("subject"), F.col("depth").cast("long").alias("amount"))
    hung = F.col("duration_sec") > HUNG_SECONDS
    slow = tasks.where(F.col("duration_sec") > LONG_SECONDS).select(
        F.when(hung, "critical").otherwise("info").alias("severity"),
        F.when(hung, "hung_task").otherwise("long_running").alias("kind"),
        F.col("task_id").cast("string").alias("subject"),
        F.col("duration_sec").cast("long").alias("amount"),
    )
    found = deep.unionByName(slow)
    if workers is None:
        return found
    none = workers.agg(F.count(F.lit(1)).alias("amount")).where(F.col("amount") == 0)
    return found.unionByName(none.select(F.lit("critical").alias("severity"), F.lit("no_workers").alias("kind"), F.lit(None).cast("string").alias("subject"), "amount"))


# ---- plugins

_SLUG = re.compile(r"[a-z0-9][a-z0-9-]{1,62}[a-z0-9]")


@dataclass(frozen=True)
class Plugin:
    """What a plugin says of itself: its name, version and the callables it offers, by the name of
    the operation they take part in (transform: column function; check: column maker)."""

    slug: str
    version: str
    offers: dict[str, str] = field(default_factory=dict)
    permissions: tuple[str, ...] = ()

    KINDS = ("transform", "check")
    PERMISSIONS = ("read_records", "write_records")

    def problems(self) -> list[str]:
        out = []
        if not _SLUG.fullmatch(self.slug):
            out.append(f"{self.slug!r} is no name of small letters, digits and hyphens, 3 to 64 of them")
        if not self.version.strip() or len(self.version) > 50:
            out.append("a version of 1 to 50 characters is needed")
        out += [f"unknown permission {p!r}" for p in self.permissions if p not in self.PERMISSIONS]
        if not self.offers:
            out.append("nothing is offered")
        for name, target in self.offers.items():
            if name.partition(":")[0] not in self.KINDS:
                out.append(f"unknown kind {name!r}")
            if not re.fullmatch(r"[\w.]+:\w+", target):
                out.append(f"{target!r} is no module:function")
        return out
