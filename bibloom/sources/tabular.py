"""Tables of strings from delimited text, JSON and XML, and values from SQL scripts.

What a file looks like is found from its first lines, read by Spark, so any store will do.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Sequence
from xml.etree.ElementTree import ParseError, XMLPullParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bibloom.functions.text import strip

#: Lines that are looked at to find delimiter and header.
HEAD = 50
#: What is looked at of an XML file to find its rows.
XML_LINES, XML_BYTES = 20_000, 1 << 20


def head(spark: SparkSession, path: str, lines: int = HEAD) -> list[str]:
    return [r["value"].lstrip("﻿") for r in spark.read.text(path).limit(lines).collect()]


def sniff_delimiter(lines: Sequence[str], candidates: str = ",\t|;") -> str:
    """The candidate that cuts most lines into the same number of cells, more cells first."""
    rows = [x for x in lines if x.strip()]

    def score(d: str) -> tuple[int, int]:
        widths = [len(r) for r in csv.reader(rows, delimiter=d)]
        best = max(set(widths), key=lambda w: (widths.count(w), w), default=1)
        return (widths.count(best) if best > 1 else 0, best)

    return max(candidates, key=score)


def has_header(cells: Sequence[str]) -> bool:
    """Different cells, most of which look like names."""
    named = [c for c in cells if re.fullmatch(r"[A-Za-z_][\w .-]*", c.strip())]
    return len({c.strip().lower() for c in cells}) == len(cells) and len(named) > len(cells) / 2


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, header: bool | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Trimmed strings; columns named by the header or col_1 to col_n; rows without a value left
    out."""
    lines = head(spark, path)
    delimiter = delimiter or sniff_delimiter(lines)
    first = next(csv.reader(io.StringIO(lines[0]), delimiter=delimiter), []) if lines else []
    header = has_header(first) if header is None else header
    rows = spark.read.csv(path, sep=delimiter, header=header, encoding=encoding, quote='"', escape='"', maxCharsPerColumn=-1, enforceSchema=True, inferSchema=False)
    rows = rows.toDF(*(c.strip().lstrip("﻿") if header else f"col_{k + 1}" for k, c in enumerate(rows.columns)))
    rows = rows.select(*(strip(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in rows.columns))
    return rows.where(F.concat_ws("", *(F.col(f"`{c}`") for c in rows.columns)) != "")


def read_json_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an array, of an object with items, records, data or rows, or one object."""
    rows = spark.read.json(path, multiLine=True, primitivesAsString=True)
    for name in ("items", "records", "data", "rows"):
        if name in rows.columns and rows.schema[name].dataType.typeName() == "array":
            return rows.select(F.explode(name).alias("r")).select("r.*")
    return rows


def frequent_child(head: str) -> str | None:
    """The commonest name of the root's children in the beginning of a document, without its
    namespace; of equally common ones the first."""
    parser, depth, names = XMLPullParser(["start", "end"]), 0, []
    try:
        parser.feed(head)
        for event, element in parser.read_events():
            if event == "start":
                depth += 1
                if depth == 2:
                    names.append(element.tag.rpartition("}")[2])
            else:
                depth -= 1
                if depth == 1:
                    element.clear()
    except ParseError:  # what came before counts
        pass
    return max(dict.fromkeys(names), key=names.count, default=None)


def read_xml_rows(spark: SparkSession, path: str, row_tag: str | None = None) -> DataFrame:
    """The children of each element of a name as strings; where no name is given, of the commonest
    one below the root in the first million bytes or so."""
    if row_tag is None:
        lines = spark.read.option("lineSep", "\n").text(path).limit(XML_LINES).select(F.substring("value", 1, XML_BYTES).alias("value"))
        row_tag = frequent_child("\n".join(r["value"] for r in lines.collect())[:XML_BYTES])
        if row_tag is None:
            raise ValueError(f"no elements below the root of {path}")
    return spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", "false").option("ignoreNamespace", "true").load(path)


# possessive, so that a long value is taken in one step and never gone back into
_QUOTED = r"'(?:[^'\\]++|\\.|'')*+'"
_CELLS = rf"(?:{_QUOTED}|[^'()]++)*+"
_INSERT = rf"(?is)INSERT\s+(?:IGNORE\s+)?INTO\s+`?(\w+)`?\s*\(([^)]*)\)\s*VALUES\s*((?:\({_CELLS}\)\s*,?\s*)+)"
_TUPLE = rf"(?s)\(({_CELLS})\)"
_VALUE = rf"(?s)\s*({_QUOTED}|[^',]++)\s*"


def _unquoted(v: Column) -> Column:
    bare = strip(v)
    inner = F.regexp_replace(F.replace(F.substring(bare, F.lit(2), F.length(bare)), F.lit("''"), F.lit("'")), r"(?s)'$", "")
    return F.when(F.upper(bare) == "NULL", F.lit(None)).when(bare.startswith("'"), F.regexp_replace(inner, r"(?s)\\(.)", "$1")).otherwise(bare)


def insert_rows(scripts: DataFrame, column: str = "value") -> DataFrame:
    """(table_name, cells): each row of the INSERT statements of a script as a map of its columns;
    rows with another number of values than columns are left out."""
    statements = scripts.select(F.explode(F.regexp_extract_all(column, F.lit(_INSERT), 0)).alias("s"))
    part = lambda k: F.regexp_extract("s", _INSERT, k)
    rows = statements.select(F.lower(part(1)).alias("table_name"), part(2).alias("columns"), F.explode(F.regexp_extract_all(part(3), F.lit(_TUPLE), 1)).alias("row"))
    names = F.transform(F.split("columns", ","), lambda c: F.lower(F.regexp_replace(c, r"[`\s]", "")))
    values = F.transform(F.regexp_extract_all("row", F.lit(_VALUE), 1), _unquoted)
    both = rows.select("table_name", names.alias("n"), values.alias("v")).where(F.size("n") == F.size("v"))
    return both.select("table_name", F.map_from_arrays("n", "v").alias("cells"))


#: Kind, code and description of each table's rows (fixed values of the target's tables).
CONTROL_TABLES = {
    "branches": ("branches", "branchcode", "branchname"),
    "itemtypes": ("item_types", "itemtype", "description"),
    "categories": ("patron_categories", "categorycode", "description"),
}
AUTHORISED = {
    "LOC": "shelving_locations", "CCODE": "collection_codes", "ITYPE": "item_types", "NOT_LOAN": "item_types",
    "LOST": "other", "WITHDRAWN": "other", "DAMAGED": "other", "BOR_TITLES": "other",
}


def control_values(scripts: DataFrame, column: str = "value") -> DataFrame:
    """(kind, code, description) of the control values that scripts insert."""
    rows = insert_rows(scripts, column)
    cell = lambda name: F.try_element_at("cells", F.lit(name))
    av = F.create_map(*(F.lit(x) for kv in AUTHORISED.items() for x in kv))
    is_av = F.col("table_name") == "authorised_values"
    either = lambda *names: F.coalesce(*(F.when(cell(n) != "", cell(n)) for n in names))
    category = F.coalesce(cell("category"), F.lit(""))
    named = F.coalesce(F.try_element_at(av, F.upper(category)), F.when(category == "", "other").otherwise(F.concat(F.lit("av:"), F.lower(category))))
    kind = F.when(is_av, named)
    code, label = F.when(is_av, either("authorised_value", "value")), F.when(is_av, either("lib", "description"))
    for name, (k, c, d) in CONTROL_TABLES.items():
        here = F.col("table_name") == name
        kind, code, label = kind.when(here, F.lit(k)), code.when(here, cell(c)), label.when(here, cell(d))
    return rows.select(kind.alias("kind"), code.alias("code"), F.coalesce(label, F.lit("")).alias("description")).where(F.col("kind").isNotNull() & (F.col("code") != ""))


def best_file(found: Sequence[str], order: Sequence[str]) -> str | None:
    """The first file of the caller's order of names that is there."""
    return next((f for name in order for f in found if f.rsplit("/", 1)[-1].startswith(name)), None)


def buckets(bibs: DataFrame, size: int) -> Column:
    """Number, from 1, of the file of so many records that a record belongs to."""
    return (F.floor(F.col("record_index") / size) + 1).cast("long")
