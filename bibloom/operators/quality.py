"""Quality checks on records, as rows of issues, and their deterministic fixes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibloom.functions import extract
from bibloom.functions.text import clean_isbn, nfc, strip
from bibloom.model import is_control

ISSUE = "struct<category:string,severity:string,tag:string,subfield:string,description:string,original_value:string,suggested_fix:string,place:int>"

#: Allowed characters and the default of the leader's coded positions (fixed values of the format).
LEADER = {5: ("acdnp", "n"), 6: ("acdefgijkmnoprt", "a"), 7: ("abcdims", "m"), 8: (" a", " "), 9: (" a", " "), 17: (" 12345678uz", " "), 18: (" acinu", " "), 19: (" abc", " ")}
FIELD_LIMIT = 9999


def _issue(category: str, severity: str, description: str, tag=None, code=None, value=None, fix=None, place=None) -> Column:
    text = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("string")
    return F.struct(
        F.lit(category).alias("category"),
        F.lit(severity).alias("severity"),
        text(tag).alias("tag"),
        text(code).alias("subfield"),
        F.lit(description).alias("description"),
        text(value).alias("original_value"),
        text(fix).alias("suggested_fix"),
        (place if isinstance(place, Column) else F.lit(place)).cast("int").alias("place"),
    ).cast(ISSUE)


def _one(condition: Column, issue: Column) -> Column:
    return F.when(condition, F.array(issue)).otherwise(F.array().cast(f"array<{ISSUE}>"))


def _each_field(test: Callable[[Column], Column], issue: Callable[[Column, Column], Column]) -> Column:
    found = F.transform("fields", lambda f, i: F.when(F.coalesce(test(f), F.lit(False)), issue(f, i)))
    return F.array_compact(found)


def leader() -> Column:
    ldr = F.coalesce(F.col("leader"), F.lit(""))
    wrong = [
        _one((F.length(ldr) > p) & ~F.substring(ldr, p + 1, 1).isin(*allowed), _issue("leader_008", "warning", f"leader byte {p} is not allowed", "LDR", F.lit(str(p)), F.substring(ldr, p + 1, 1), default, p))
        for p, (allowed, default) in LEADER.items()
    ]
    return F.concat(_one(F.length(ldr) != 24, _issue("leader_008", "error", "leader is not 24 characters long", "LDR", None, F.length(ldr))), *wrong)


def fixed_length_008() -> Column:
    fix = lambda d: F.when(F.length(d) < 40, F.rpad(d, 40, "|")).otherwise(F.substring(d, 1, 40))
    return _each_field(lambda f: (f["tag"] == "008") & (F.length(f["data"]) != 40), lambda f, i: _issue("leader_008", "warning", "008 is not 40 characters long", "008", None, f["data"], fix(f["data"]), i))


def indicators() -> Column:
    def of(name: str) -> Column:
        return _each_field(lambda f: ~is_control(f) & ~f[name].rlike("^[ 0-9]$"), lambda f, i: _issue("indicators", "warning", f"{name} is neither blank nor a digit", f["tag"], F.lit(name), f[name], " ", i))

    return F.concat(of("ind1"), of("ind2"))


def _has_code(f: Column, code: str) -> Column:
    return F.exists(f["subfields"], lambda s: s["code"] == code)


def titles() -> Column:
    no_a = _each_field(lambda f: (f["tag"] == "245") & ~_has_code(f, "a"), lambda f, i: _issue("subfield_structure", "error", "245 has no $a", "245", "a", place=i))
    names = _each_field(lambda f: f["tag"].isin("100", "110", "111") & ~_has_code(f, "a"), lambda f, i: _issue("subfield_structure", "warning", "main entry has no $a", f["tag"], "a", place=i))
    return F.concat(no_a, names, _one(~extract.has_tag("245"), _issue("blank_fields", "error", "there is no 245", "245")))


def lengths() -> Column:
    size = lambda f: F.when(is_control(f), F.length(f["data"])).otherwise(F.aggregate(f["subfields"], F.lit(0), lambda n, s: n + F.coalesce(F.length(s["value"]), F.lit(0)) + 2))
    return _each_field(lambda f: size(f) > FIELD_LIMIT, lambda f, i: _issue("field_length", "error", "field is too long", f["tag"], None, size(f), None, i))


def blanks() -> Column:
    control = _each_field(lambda f: is_control(f) & (strip(F.coalesce(f["data"], F.lit(""))) == ""), lambda f, i: _issue("blank_fields", "warning", "control field is blank", f["tag"], place=i))
    data = _each_field(
        lambda f: ~is_control(f) & ~F.exists(f["subfields"], lambda s: strip(F.coalesce(s["value"], F.lit(""))) != ""),
        lambda f, i: _issue("blank_fields", "warning", "field has no value", f["tag"], place=i),
    )
    return F.concat(control, data)


def _subfields(test: Callable[[Column], Column], issue: Callable[[Column, Column, Column], Column]) -> Column:
    per = F.transform("fields", lambda f, i: F.array_compact(F.transform(F.coalesce(f["subfields"], F.array()), lambda s: F.when(F.coalesce(test(s["value"]), F.lit(False)), issue(f, s, i)))))
    return F.flatten(per)


def diacritics() -> Column:
    """Leading combining marks, and marks that have a composed form; the composed value of the
    latter is filled in by ``scan``, in batches, for these values only."""
    leading = _subfields(lambda v: v.rlike(r"^\p{M}"), lambda f, s, i: _issue("diacritics", "warning", "value begins with a combining mark", f["tag"], s["code"], s["value"], None, i))
    loose = _subfields(lambda v: v.rlike(r"\P{M}\p{M}"), lambda f, s, i: _issue("diacritics", "info", "value is not in composed form", f["tag"], s["code"], s["value"], None, i))
    return F.concat(leading, loose)


def encoding(raw: str = "raw") -> Column:
    """For records that still have their raw bytes: bytes that are not UTF-8."""
    return _one(~F.is_valid_utf8(F.col(raw).cast("string")), _issue("encoding", "error", "record is not valid UTF-8"))


CHECKS: dict[str, Callable[[], Column]] = {
    "leader": leader, "008": fixed_length_008, "indicators": indicators, "titles": titles, "lengths": lengths, "blanks": blanks, "diacritics": diacritics,
}


def scan(bibs: DataFrame, checks: list[str] | None = None, plugins: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """All issues: file_id, record_index and the columns of ``ISSUE``. One pass for all checks of
    single records; duplicates come from aggregations."""
    makers = [CHECKS[c]() for c in (checks or CHECKS)] + [make() for make in (plugins or {}).values()]
    found = bibs.select("file_id", "record_index", F.explode_outer(F.concat(*makers)).alias("issue")).where(F.col("issue").isNotNull()).select("file_id", "record_index", "issue.*")
    loose = (F.col("category") == "diacritics") & (F.col("severity") == "info")
    composed = found.where(loose).withColumn("suggested_fix", nfc("original_value"))
    composed = composed.where(F.length("suggested_fix") < F.length("original_value"))
    return found.where(~loose).unionByName(composed)


def repeated_numbers(bibs: DataFrame) -> DataFrame:
    """Issues of records that share a trimmed 001, or an ISBN (first token of the first 020$a of
    a field); a record that repeats its own doesn't count."""
    control = bibs.select("file_id", "record_index", F.explode_outer(F.array_distinct(F.transform(extract.values("001"), strip))).alias("value"), F.lit("duplicate_001").alias("category"), F.lit("warning").alias("severity"), F.lit("001").alias("tag"))
    isbn = F.transform(extract.values("020$a"), lambda v: F.get(F.split(strip(v), " "), 0))
    numbers = bibs.select("file_id", "record_index", F.explode_outer(F.array_distinct(F.transform(isbn, clean_isbn))).alias("value"), F.lit("duplicate_isbn").alias("category"), F.lit("info").alias("severity"), F.lit("020").alias("tag"))
    both = control.unionByName(numbers).where(F.col("value") != "")
    many = both.groupBy("category", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n")
    return both.join(many, ["category", "value"]).select("file_id", "record_index", "category", "severity", "tag", F.col("value").alias("original_value"))


def summary(issues: DataFrame) -> DataFrame:
    """(category, errors, warnings, infos, records, has_fix), the worst first."""
    count = lambda s: F.count_if(F.col("severity") == s)
    sums = issues.groupBy("category").agg(
        count("error").alias("errors"), count("warning").alias("warnings"), count("info").alias("infos"),
        F.count_distinct("record_index").alias("records"), F.bool_or(F.col("suggested_fix").isNotNull()).alias("has_fix"),
    )
    return sums.orderBy(F.col("errors").desc(), F.col("warnings").desc(), "category")


def gate(issues: DataFrame) -> DataFrame:
    """One row: whether there is no error."""
    return issues.agg((F.count_if(F.col("severity") == "error") == 0).alias("passed"))


def fix(bibs: DataFrame) -> DataFrame:
    """Records with what can be put right: leader bytes, the length of 008, indicators."""
    ldr = F.coalesce(F.col("leader"), F.lit(""))
    parts, at = [], 0
    for p, (allowed, default) in LEADER.items():
        byte = F.substring(ldr, p + 1, 1)
        parts += [F.substring(ldr, at + 1, p - at), F.when((byte == "") | byte.isin(*allowed), byte).otherwise(default)]
        at = p + 1
    ldr = F.concat(*parts, F.substring(ldr, at + 1, 1 << 10))
    digit = lambda x: F.when(x.rlike("^[ 0-9]$"), x).otherwise(" ")

    def one(f: Column) -> Column:
        data = F.when(f["tag"] == "008", F.when(F.length(f["data"]) < 40, F.rpad(f["data"], 40, "|")).otherwise(F.substring(f["data"], 1, 40))).otherwise(f["data"])
        return F.when(is_control(f), f.withField("data", data)).otherwise(f.withField("ind1", digit(f["ind1"])).withField("ind2", digit(f["ind2"])))

    return bibs.withColumn("leader", ldr).withColumn("fields", F.transform("fields", one))


def union_issues(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
