"""Records as MARCMaker text, MARCXML and JSON, and from tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bibloom.functions.extract import joined
from bibloom.functions.text import strip
from bibloom.model import FIELD, FIELDS, SUBFIELD, control, datafield, is_control, subfield

# ---- MARCMaker: =TAG, two spaces, indicators with backslashes for blanks, $code value


def mnemonic(bibs: DataFrame) -> DataFrame:
    """(record_index, text): one block for each record."""
    blank = lambda x: F.replace(x, F.lit(" "), F.lit("\\"))

    def line(f: Column) -> Column:
        subs = F.array_join(F.transform(f["subfields"], lambda s: F.concat(F.lit("$"), s["code"], F.replace(s["value"], F.lit("$"), F.lit("{dollar}")))), "")
        rest = F.when(is_control(f), blank(f["data"])).otherwise(F.concat(blank(f["ind1"]), blank(f["ind2"]), subs))
        return F.concat(F.lit("="), f["tag"], F.lit("  "), rest)

    return bibs.select("record_index", F.concat_ws("\n", F.concat(F.lit("=LDR  "), F.coalesce("leader", F.lit(""))), F.transform("fields", line)).alias("text"))


def parse_mnemonic(blocks: DataFrame, text: str = "text") -> DataFrame:
    """Records of blocks; lines that aren't ``=ddd`` are left out. Other columns stay."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike("^=(LDR|[0-9]{3})"))
    unblank = lambda x: F.replace(x, F.lit("\\"), F.lit(" "))

    def field(x: Column) -> Column:
        tag, rest = F.substring(x, 2, 3), F.substring(x, F.lit(7), F.length(x))
        parts = F.filter(F.split(F.substring(rest, F.lit(3), F.length(rest)), r"\$"), lambda _, i: i > 0)
        subs = F.transform(parts, lambda p: F.struct(F.substring(p, 1, 1).alias("code"), F.replace(F.substring(p, F.lit(2), F.length(p)), F.lit("{dollar}"), F.lit("$")).alias("value")))
        ctl = tag < "010"
        ind = lambda k: F.when(~ctl, unblank(F.substring(rest, k, 1)))
        return F.struct(tag.alias("tag"), ind(1).alias("ind1"), ind(2).alias("ind2"), F.when(ctl, unblank(rest)).alias("data"), F.when(~ctl, subs).alias("subfields")).cast(FIELD)

    head = F.filter(lines, lambda x: x.startswith("=LDR"))
    others = F.filter(lines, lambda x: ~x.startswith("=LDR"))
    rest = [c for c in blocks.columns if c != text]
    return blocks.select(*rest, F.substring(F.get(head, 0), 7, 1 << 10).alias("leader"), F.transform(others, field).cast(FIELDS).alias("fields"))


def read_mnemonic(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, leader, fields) of files whose records are separated by an empty line."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).select(F.col("_metadata.file_path").alias("file_id"), F.col("value").alias("text"))
    return parse_mnemonic(blocks.where(strip(F.col("text")) != ""))


# ---- MARCXML


def _escaped(v: Column) -> Column:
    for c, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        v = F.replace(v, F.lit(c), F.lit(entity))
    return v


def marcxml(bibs: DataFrame) -> DataFrame:
    """(record_index, xml): one namespaced element for each record."""
    def field(f: Column) -> Column:
        ctl = F.concat(F.lit('<controlfield tag="'), f["tag"], F.lit('">'), _escaped(f["data"]), F.lit("</controlfield>"))
        subs = F.array_join(F.transform(f["subfields"], lambda s: F.concat(F.lit('<subfield code="'), _escaped(s["code"]), F.lit('">'), _escaped(s["value"]), F.lit("</subfield>"))), "")
        data = F.concat(F.lit('<datafield tag="'), f["tag"], F.lit('" ind1="'), f["ind1"], F.lit('" ind2="'), f["ind2"], F.lit('">'), subs, F.lit("</datafield>"))
        return F.when(is_control(f), ctl).otherwise(data)

    body = F.array_join(F.transform("fields", field), "")
    xml = F.concat(F.lit('<record xmlns="http://www.loc.gov/MARC21/slim"><leader>'), _escaped(F.coalesce("leader", F.lit(""))), F.lit("</leader>"), body, F.lit("</record>"))
    return bibs.select("record_index", xml.alias("xml"))


def page(bibs: DataFrame, offset: int, size: int = 100) -> DataFrame:
    """One page of records by index, for harvesting; a range filter, not an offset."""
    return bibs.where((F.col("record_index") >= offset) & (F.col("record_index") < offset + size))


# ---- JSON: {leader, fields: [{tag: data} or {tag: {ind1, ind2, subfields: [{code: value}]}}]}


def to_json(bibs: DataFrame) -> DataFrame:
    """(record_index, json)."""
    def field(f: Column) -> Column:
        subs = F.transform(f["subfields"], lambda s: F.to_json(F.create_map(s["code"], s["value"])))
        data = F.concat(F.lit('{"ind1":"'), f["ind1"], F.lit('","ind2":"'), f["ind2"], F.lit('","subfields":['), F.array_join(subs, ","), F.lit("]}"))
        return F.when(is_control(f), F.to_json(F.create_map(f["tag"], f["data"]))).otherwise(F.concat(F.lit('{"'), f["tag"], F.lit('":'), data, F.lit("}")))

    leader = F.to_json(F.struct(F.coalesce("leader", F.lit("")).alias("leader")))
    return bibs.select("record_index", F.concat(leader.substr(F.lit(1), F.length(leader) - 1), F.lit(',"fields":['), F.array_join(F.transform("fields", field), ","), F.lit("]}")).alias("json"))


def from_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """Records of JSON texts; those that aren't such objects are left out. Other columns stay."""
    one = F.from_json(column, "leader string, fields array<map<string,string>>")
    rest = [c for c in rows.columns if c != column]
    parsed = rows.select(*rest, one.alias("r")).where(F.col("r.fields").isNotNull())

    def field(m: Column) -> Column:
        tag = F.get(F.map_keys(m), 0)
        body = F.get(F.map_values(m), 0)
        ctl = tag < "010"
        inner = F.from_json(body, "ind1 string, ind2 string, subfields array<map<string,string>>")
        subs = F.transform(inner["subfields"], lambda s: F.struct(F.get(F.map_keys(s), 0).alias("code"), F.get(F.map_values(s), 0).alias("value")))
        ind = lambda name: F.when(~ctl, F.coalesce(inner[name], F.lit(" ")))
        return F.struct(tag.alias("tag"), ind("ind1").alias("ind1"), ind("ind2").alias("ind2"), F.when(ctl, body).alias("data"), F.when(~ctl, F.coalesce(subs, F.array().cast(f"array<{SUBFIELD}>"))).alias("subfields")).cast(FIELD)

    return parsed.select(*rest, F.col("r.leader").alias("leader"), F.transform("r.fields", field).cast(FIELDS).alias("fields"))


# ---- tables


def from_table(rows: DataFrame, mappings: Sequence[tuple[str, str, str | None, str]], keep: Sequence[str] = ()) -> DataFrame:
    """Records of rows: mappings (column, tag, code, two indicators). Mappings of one tag and
    indicators make one field; of a control tag the first counts; empty values are left out."""
    groups: dict[tuple[str, str], list[tuple[str, str | None]]] = {}
    for column, tag, code, ind in mappings:
        groups.setdefault((tag, (ind or "  ").ljust(2)[:2]), []).append((column, code))
    made = []
    for (tag, ind), parts in groups.items():
        value = lambda c: strip(F.coalesce(F.col(c).cast("string"), F.lit("")))
        if tag < "010":
            made.append(F.when(value(parts[0][0]) != "", control(tag, value(parts[0][0]))).cast(FIELD))
        else:
            subs = F.filter(F.array(*(subfield(code or "a", value(c)) for c, code in parts)), lambda s: s["value"] != "")
            made.append(F.when(F.size(subs) > 0, datafield(tag, subs, ind[0], ind[1])).cast(FIELD))
    return rows.select(*keep, F.lit("00000nam a2200000 a 4500").alias("leader"), F.array_compact(F.array(*made)).alias("fields"))


def spreadsheet(bibs: DataFrame, specs: Sequence[str], containing: tuple[str, str] | None = None, most: int | None = None) -> DataFrame:
    """record_index and the specs as columns, of records whose spec contains a text."""
    rows = bibs.where(F.lower(joined(containing[0])).contains(containing[1].lower())) if containing else bibs
    out = rows.select("record_index", *(joined(s).alias(s) for s in specs))
    return out.orderBy("record_index").limit(most) if most is not None else out
