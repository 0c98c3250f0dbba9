"""Profiles: frequencies of tags, subfields and values, discovered columns, system detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bibloom.functions import extract
from bibloom.functions.text import strip, truncate
from bibloom.model import to_long

#: Item subfield of each controlled vocabulary (fixed values of the holdings format).
VOCABULARY = {"itype": "y", "loc": "c", "ccode": "8", "not_loan": "7", "withdrawn": "1", "damaged": "4", "homebranch": "a", "holdingbranch": "b"}


def tag_frequency(bibs: DataFrame) -> DataFrame:
    """(tag, n): how many fields there are of each tag."""
    return bibs.select(F.explode_outer("fields.tag").alias("tag")).where(F.col("tag").isNotNull()).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def subfield_frequency(bibs: DataFrame) -> DataFrame:
    """(tag, code, n)."""
    return to_long(bibs).where(~F.col("is_control")).groupBy("tag", "code").agg(F.count(F.lit(1)).alias("n"))


def discover(bibs: DataFrame, sample: int = 100) -> DataFrame:
    """(tag, codes, n) over the first records of a file."""
    some = to_long(bibs.orderBy("record_index").limit(sample))
    fields = F.count_distinct("record_index", "field_pos")
    return some.groupBy("tag").agg(F.array_join(F.sort_array(F.collect_set("code")), ",").alias("codes"), fields.alias("n"))


def clusters(bibs: DataFrame, spec: str) -> DataFrame:
    """(value, n, percent): values of a spec; records without one count under ``(empty)``.
    percent is of the records, so repeated values can bring it over 100."""
    total = bibs.agg(F.count(F.lit(1))).scalar()
    found = F.coalesce(F.filter(F.transform(extract.values(spec), strip), lambda v: v != ""), F.array())
    each = bibs.select(F.explode_outer(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("(empty)")))).alias("value"))
    counts = each.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("value", "n", F.round(100 * F.col("n") / total, 1).alias("percent"))


def column_profile(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, populated, distinct_values) of string columns; empty strings and NULL don't count."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
    flat = rows.select(pairs.alias("p")).select("p.*")
    good = F.when(~F.coalesce(F.col("value"), F.lit("")).isin("", "NULL"), F.col("value"))
    return flat.groupBy("column").agg(F.count(good).alias("populated"), F.count_distinct(good).alias("distinct_values"))


def sample_values(rows: DataFrame, column: str, order: str, most: int = 10) -> DataFrame:
    """The first distinct non-empty values in the order of a column."""
    v = strip(F.col(column).cast("string"))
    return rows.select(v.alias("value"), order).where(F.col("value") != "").groupBy("value").agg(F.min(order).alias("first")).orderBy("first").limit(most)


def value_index(bibs: DataFrame, top: int = 50) -> DataFrame:
    """(tag, code, value, n, rank): the most frequent values of each subfield, ties by first
    appearance; control fields under ``_``; long values are shortened."""
    long = to_long(bibs).select("tag", F.coalesce("code", F.lit("_")).alias("code"), strip(F.col("value")).alias("value"), F.struct("record_index", "field_pos", "sub_pos").alias("place"))
    counts = long.where(F.col("value") != "").groupBy("tag", "code", "value").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    best = Window.partitionBy("tag", "code").orderBy(F.col("n").desc(), "first")
    ranked = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("tag", "code", truncate(F.col("value")).alias("value"), "n", "rank")


def worth_showing(index: DataFrame) -> DataFrame:
    """(tag, code, shown, total) of subfields with several values or at least ten occurrences."""
    sums = index.groupBy("tag", "code").agg(F.count(F.lit(1)).alias("shown"), F.sum("n").alias("total"))
    return sums.where((F.col("shown") >= 2) | (F.col("total") >= 10))


def vocabulary_scan(bibs: DataFrame, vocabulary: dict[str, str] = VOCABULARY, tag: str = "952") -> DataFrame:
    """(category, value, n): values of the item subfields of each vocabulary."""
    categories = F.create_map(*(F.lit(x) for name, code in vocabulary.items() for x in (code, name)))
    long = to_long(bibs).where((F.col("tag") == tag) & F.col("code").isin(*vocabulary.values()))
    values = long.select(F.try_element_at(categories, F.col("code")).alias("category"), strip(F.col("value")).alias("value"))
    return values.where(F.col("value") != "").groupBy("category", "value").agg(F.count(F.lit(1)).alias("n"))


def column_scan(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(header, value, n) of the controlled columns of a table."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("header"), strip(F.col(c)).alias("value")) for c in columns)))
    return rows.select(pairs.alias("p")).select("p.*").where(F.col("value") != "").groupBy("header", "value").agg(F.count(F.lit(1)).alias("n"))


def duplicates(bibs: DataFrame, spec: str = "001") -> DataFrame:
    """(value, n) of values that several records have."""
    values = bibs.select("record_index", F.explode_outer(F.array_distinct(F.transform(extract.values(spec), strip))).alias("value"))
    return values.where(F.col("value").isNotNull()).groupBy("value").agg(F.count_distinct("record_index").alias("n")).where(F.col("n") > 1)


def detect_system(bibs: DataFrame, sample: int = 200) -> DataFrame:
    """(system, share, threshold, detected) over the first records: which system's habits they
    show (fixed heuristics). The highest share above its threshold is detected, the first of
    equals."""
    some = bibs.orderBy("record_index").limit(sample)
    has = extract.has_tag
    rules: list[tuple[str, Column, float]] = [
        ("Symphony", F.exists(extract.values("035$a"), lambda v: v.contains("Sirsi")) | has("999"), 0.3),
        ("III", has("907") | has("945"), 0.4),
        ("Polaris", F.exists("fields", lambda f: (f["tag"] == "949") & F.exists(F.coalesce(f["subfields"], F.array()), lambda s: s["code"] == "t")), 0.4),
        ("Koha", has("952") | has("942"), 0.5),
    ]
    shares = some.agg(*(F.avg(r.cast("int")).alias(n) for n, r, _ in rules))
    each = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(n).alias("system"), F.coalesce(F.col(n), F.lit(0.0)).alias("share"), F.lit(t).alias("threshold")) for k, (n, _, t) in enumerate(rules)))
    over = F.filter(F.col("each"), lambda e: e["share"] > e["threshold"])
    best = F.aggregate(over, F.lit(None).cast("struct<k:int,system:string,share:double,threshold:double>"), lambda a, e: F.when(a.isNull() | (e["share"] > a["share"]), e).otherwise(a))
    flat = shares.select(each.alias("each")).withColumn("best", best["system"]).select(F.explode("each").alias("e"), "best")
    return flat.select("e.system", F.round("e.share", 4).alias("share"), "e.threshold", F.coalesce(F.col("e.system") == F.col("best"), F.lit(False)).alias("detected"))


# ---- columns of item files


def _cells(rows: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """(keep..., column, value) of all cells, trimmed; value is null where it is empty or NULL."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), strip(F.col(c).cast("string")).alias("value")) for c in columns)))
    flat = rows.select(*keep, pairs.alias("p")).select(*keep, "p.column", "p.value")
    return flat.withColumn("value", F.when(~F.col("value").isin("", "NULL"), F.col("value")))


def column_samples(rows: DataFrame, columns: Sequence[str], order: Sequence[str], most: int = 20) -> DataFrame:
    """(column, populated, distinct_values, samples): what stands in each column, exactly, and its
    first ``most`` values in an order of the rows, which should be total. Values are trimmed, empty
    ones and NULL don't count. Every task hands on ``most`` values of a column at most."""
    cells = _cells(rows, columns, *order)
    counts = cells.groupBy("column").agg(F.count("value").alias("populated"), F.count_distinct("value").alias("distinct_values"))
    place = F.row_number().over(Window.partitionBy("column").orderBy(*order))
    first = cells.where(F.col("value").isNotNull()).withColumn("place", place).where(F.col("place") <= most)
    samples = first.groupBy("column").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("samples"))
    return counts.join(samples, "column", "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))


#: Logarithm of the registers of a distinct count: a standard error of 1.6 percent.
LG_REGISTERS = 12
#: Values that a list of the commonest keeps track of.
TRACKED = 1000


def column_sketches(rows: DataFrame, columns: Sequence[str], file_id: str = "file_id") -> DataFrame:
    """(file_id, column, populated, distinct_sketch, top_sketch) of each file, to be stored: profiles
    of any files come from these rows by ``merged_sketches``, without the files being read again."""
    cells = _cells(rows, columns, file_id).where(F.col("value").isNotNull())
    return cells.groupBy(file_id, "column").agg(
        F.count("value").alias("populated"),
        F.hll_sketch_agg("value", LG_REGISTERS).alias("distinct_sketch"),
        F.expr(f"approx_top_k_accumulate(value, {TRACKED})").alias("top_sketch"),
    )


def merged_sketches(sketches: DataFrame, top: int = 10) -> DataFrame:
    """(column, populated, distinct_estimate, top) over the files of stored sketches: the distinct
    values within some percent (three times 1.6 for nearly all), and the commonest values with their
    counts, which are exact while a column has fewer values than are tracked."""
    return sketches.groupBy("column").agg(
        F.sum("populated").alias("populated"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct_estimate"),
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(top_sketch, {TRACKED}), {top})").alias("top"),
    )
