"""The queries over the test tables and their SQL oracles.

Records are made of ``part``; an oracle works on the same flat columns. Every output is flat.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibloom.functions import extract, text
from bibloom.model import each_field, to_long
from bibloom.operators import dedup, edits, items, profile, quality, query, reconcile, search, tables
from bibloom.operators.fieldmaps import FieldMap, apply_maps, map_statistics
from bibloom.plans import adapters
from bibloom.plans.adapters import BIB_SQL, ITEM_SQL, PATRON_SQL, bibs, table
from bibloom.sources import formats, iso2709, tabular
from bibloom.streaming import audit

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_BIB = f"with bib as ({BIB_SQL}) "


def register(name: str, oracle: str | None = None):
    """Add a query, with SQL over the flat ``bib`` unless it begins with its own WITH."""

    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle if oracle.lstrip().lower().startswith("with ") else _BIB + oracle
        return f

    return add


# ---- selection by specs

_SPECS = ["001", "245$a", "942$c"]


def _select(*conditions, **more):
    return lambda spark, sf: query.select(bibs(spark, sf), _SPECS, [query.Condition(*c) for c in conditions], **more).toDF("record_index", "id", "title", "kind")


_COLUMNS = "select k as record_index, f001 as id, coalesce(f245a, '') as title, p_type as kind from bib where "
_TITLE = "lower(trim(coalesce(f245a, '')))"

register("sql_eq", _COLUMNS + "lower(p_type) = 'promo' or lower(p_type) = 'economy'")(_select(("942$c", "=", "PROMO"), ("942$c", "=", "economy", "or")))
register("sql_ne", _COLUMNS + "lower(p_type) <> 'promo'")(_select(("942$c", "!=", "PROMO")))
register("sql_contains", _COLUMNS + f"contains({_TITLE}, 'ring') and not contains({_TITLE}, 'green')")(_select(("245$a", "contains", "RING"), ("245$a", "not contains", "green")))
register("sql_like", _COLUMNS + f"{_TITLE} like '%a_e%'")(_select(("245$a", "like", "%a_e%")))
register("sql_starts", _COLUMNS + f"starts_with({_TITLE}, 's')")(_select(("245$a", "starts with", "S")))
register("sql_exists_missing", _COLUMNS + f"{_TITLE} = '' or (f100a is not null and {_TITLE} <> '')")(_select(("100$a", "exists"), ("245$a", "exists"), ("245$a", "missing", None, "or")))
register("sql_or_fold", _COLUMNS + f"((lower(p_type) = 'promo' or lower(p_type) = 'economy') and contains({_TITLE}, 'a'))")(_select(("942$c", "=", "promo"), ("942$c", "=", "economy", "or"), ("245$a", "contains", "a")))
register("sql_cmp", _COLUMNS + "cast(f082a as double) > 25.5 and lower(p_type) < 'm'")(_select(("082$a", ">", "25.5"), ("942$c", "<", "M")))
register("sql_topk", _COLUMNS + f"contains({_TITLE}, 'a') order by lower(coalesce(f245a, '')), k limit 50")(_select(("245$a", "contains", "a"), order_by="245$a", limit=50))
register("sql_scan_limit", "select * from (" + _COLUMNS + f"contains({_TITLE}, 'a') order by k limit 40) order by lower(title) desc, record_index")(_select(("245$a", "contains", "a"), order_by="245$a", descending=True, limit=40, limit_first=True))


@register("sql_view", "select lower(p_type) as kind, count(*) as n from bib where f245a is not null and contains(lower(f245a), 'e') group by 1")
def sql_view(spark, sf):
    """Spark SQL over a view of specs; its columns compare without regard to case."""
    flat = query.view(bibs(spark, sf), ["245$a", "942$c"])
    return spark.sql("select lower(cast(`942$c` as string collate UTF8_BINARY)) as kind, count(*) as n from {v} where contains(`245$a`, 'E') group by 1", v=flat)


@register("criteria_any", "select k as record_index from bib where regexp_matches(f082a, '^1') or f100a is null")
def criteria_any(spark, sf):
    rules = [{"tag": "082", "subfield": "a", "operator": "regex", "value": "^1"}, {"tag": "100", "subfield": "a", "operator": "missing"}]
    return bibs(spark, sf).where(query.criteria(rules, "any")).select("record_index")


# ---- profiles

_LONG = (
    f"with bib as ({BIB_SQL}), long as (select k, tag, code, value from bib, "
    "(values ('001'),('008'),('020'),('035'),('082'),('100'),('245'),('245b'),('300'),('500'),('650'),('650b'),('942')) t(raw), "
    "lateral (select left(raw, 3) as tag, case when raw < '010' then null when raw = '245b' then 'b' when raw = '942' then 'c' else 'a' end as code, "
    "case raw when '001' then f001 when '008' then f008 when '020' then f020a when '035' then f035a when '082' then f082a when '100' then f100a "
    "when '245' then f245a when '245b' then case when f245a is null then null else p_type end when '300' then f300a when '500' then f500a "
    "when '650' then p_brand when '650b' then p_type when '942' then p_type end as value) v where value is not null) "
)


@register("tag_freq", _LONG + "select tag, cast(count(*) as bigint) as n from long where not (tag = '245' and code = 'b') group by tag")
def tag_freq(spark, sf):
    return profile.tag_frequency(bibs(spark, sf))


@register("subfield_freq", _LONG + "select tag, code, cast(count(*) as bigint) as n from long where code is not null group by tag, code")
def subfield_freq(spark, sf):
    return profile.subfield_frequency(bibs(spark, sf))


@register(
    "schema_discovery",
    _LONG + "select tag, coalesce(string_agg(distinct code, ',' order by code), '') as codes, cast(count(*) - count(*) filter (where tag = '245' and code = 'b') as bigint) as n "
    "from long where k in (select k from bib order by k limit 100) group by tag",
)
def schema_discovery(spark, sf):
    return profile.discover(bibs(spark, sf))


@register("cluster_pct", "select coalesce(f100a, '(empty)') as value, count(*) as n, round(100.0 * count(*) / (select count(*) from bib), 1) as percent from bib group by 1")
def cluster_pct(spark, sf):
    return profile.clusters(bibs(spark, sf), "100$a")


@register(
    "column_profile",
    f"with p as ({PATRON_SQL}) select 'categorycode' as \"column\", count(*) as populated, count(distinct categorycode) as distinct_values from p "
    "union all select 'branchcode', count(*), count(distinct branchcode) from p union all select 'sex', count(*), count(distinct sex) from p",
)
def column_profile(spark, sf):
    return profile.column_profile(adapters.patrons(spark, sf), ["categorycode", "branchcode", "sex"])


@register("sample_values", "select p_type as value, min(k) as first from bib group by 1 order by 2 limit 10")
def sample_values(spark, sf):
    flat = adapters.flat(spark, sf)
    return profile.sample_values(flat, "p_type", "k")


@register(
    "value_index_topn",
    _LONG + ", c as (select tag, coalesce(code, '_') as code, trim(value) as value, count(*) as n, min(k) as f from long where trim(value) <> '' and tag in ('100', '942', '082') group by 1, 2, 3) "
    "select * from (select tag, code, value, n, cast(row_number() over (partition by tag, code order by n desc, f) as int) as rank from c) where rank <= 5",
)
def value_index_topn(spark, sf):
    found = profile.value_index(bibs(spark, sf), 5)
    return found.where(F.col("tag").isin("100", "942", "082"))


@register("ils_detect", "select 'Symphony' as system, 0.0::double as share, 0.3::double as threshold, false as detected union all select 'III', 0.0, 0.4, false union all select 'Polaris', 0.0, 0.4, false union all select 'Koha', 1.0, 0.5, true")
def ils_detect(spark, sf):
    return profile.detect_system(bibs(spark, sf))


@register(
    "recon_scan",
    f"with i as ({ITEM_SQL}), b as ({BIB_SQL}), m as (select i.* from i join b on i.biblionumber = b.f001) "
    "select * from (select 'itype' as category, itype as value, count(*) as n from m group by 2 union all select 'loc', location, count(*) from m group by 2 "
    "union all select 'homebranch', homebranch, count(*) from m group by 2 union all select 'holdingbranch', holdingbranch, count(*) from m group by 2)",
)
def recon_scan(spark, sf):
    return profile.vocabulary_scan(_with_items(spark, sf))


@register("patron_scan", f"with p as ({PATRON_SQL}) select 'categorycode' as header, categorycode as value, count(*) as n from p group by 2 union all select 'branchcode', branchcode, count(*) from p group by 2")
def patron_scan(spark, sf):
    return profile.column_scan(adapters.patrons(spark, sf), ["categorycode", "branchcode"])


@register(
    "needed_refs",
    f"with p as ({PATRON_SQL}), v as (select branchcode as value from p union all select branchcode from p where sex = 'M') "
    "select value, cast(count(*) as bigint) as n from v where value not in (select n_name from nation where n_regionkey = 0) group by 1",
)
def needed_refs(spark, sf):
    p = adapters.patrons(spark, sf)
    known = table(spark, sf, "nation").where("n_regionkey = 0").select(F.col("n_name").alias("value"))
    return reconcile.needed([profile.column_scan(p, ["branchcode"]), profile.column_scan(p.where("sex = 'M'"), ["branchcode"])], known)


@register("dup_001", "select f001 as value, count(*) as n from bib group by 1 having count(*) > 1")
def dup_001(spark, sf):
    return profile.duplicates(bibs(spark, sf), "001")


@register("rda_scan", "select count(*) as missing_336, count(*) as missing_337, count(*) as missing_338, cast(0 as bigint) as complete, count(*) as records from bib")
def rda_scan(spark, sf):
    return edits.type_scan(bibs(spark, sf))


@register("error_summary", "with e as (select event_type, ts from events where ts >= timestamp '1995-01-01') select event_type, count(*) as n, max(ts) as latest from e group by 1")
def error_summary(spark, sf):
    return audit.recent_summary(table(spark, sf, "events"), "1995-01-01 00:00:00")


@register("events_by_hour", "with e as (select date_trunc('hour', ts) as start, event_type from events) select start, event_type, count(*) as n from e group by 1, 2")
def events_by_hour(spark, sf):
    return audit.counts_by_window(table(spark, sf, "events"))


# ---- joins and sets


def _with_items(spark, sf):
    rows = adapters.items(spark, sf)
    order = ["homebranch", "location", "itype", "barcode"]
    return items.attach_items(bibs(spark, sf), rows, "biblionumber", order)


_ITEM_ROWS = f"with i as ({ITEM_SQL}), b as ({BIB_SQL}), m as (select b.k, i.* from i join b on i.biblionumber = b.f001) "


@register("items_join", _ITEM_ROWS + "select k as record_index, homebranch, holdingbranch, location, itype, barcode from m")
def items_join(spark, sf):
    found = each_field(_with_items(spark, sf), "952", "record_index")
    code = lambda c: F.get(F.transform(F.filter(F.col("f.subfields"), lambda s: s["code"] == c), lambda s: s["value"]), 0)
    return found.select("record_index", code("a").alias("homebranch"), code("b").alias("holdingbranch"), code("c").alias("location"), code("y").alias("itype"), code("p").alias("barcode"))


_HOLDS = (
    "with h as (select cast(o_custkey as varchar) as patron, 'b' || cast(o_orderkey % 1000 as varchar) as bib, cast(o_orderkey as varchar) as hold_id from orders), "
    "ids as (select 'patron' as t, cast(c_custkey as varchar) as l, c_custkey + 100000 as n from customer where c_custkey % 13 <> 0 "
    "union all select 'bib', 'b' || cast(p_partkey as varchar), p_partkey + 500000 from part) "
)


@register(
    "id_resolve",
    _HOLDS + "select h.hold_id, p.n as new_patron, b.n as new_bib, p.n is not null and b.n is not null as resolved from h left join ids p on p.t = 'patron' and p.l = h.patron left join ids b on b.t = 'bib' and b.l = h.bib",
)
def id_resolve(spark, sf):
    rows = tables.by_alias(adapters.holds(spark, sf))
    found = tables.resolve(rows, adapters.id_map(spark, sf), {"patron": "patron", "bib": "bib"})
    return found.select("hold_id", "new_patron", "new_bib", "resolved")


@register("unresolved_anti", _HOLDS + "select distinct patron from h where patron not in (select l from ids where t = 'patron')")
def unresolved_anti(spark, sf):
    return tables.unresolved(tables.by_alias(adapters.holds(spark, sf)), adapters.id_map(spark, sf), "patron", "patron")


@register("holds_validate", _HOLDS + "select count(*) as valid, cast(0 as bigint) as invalid, cast(0 as bigint) as no_patron, cast(0 as bigint) as no_bib from h")
def holds_validate(spark, sf):
    return tables.validate(tables.by_alias(adapters.holds(spark, sf)), ["patron", "bib"])


@register("id_counts", _HOLDS + "select t as entity_type, count(*) as n from ids group by 1")
def id_counts(spark, sf):
    return adapters.id_map(spark, sf).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


@register("rule_coverage", f"with p as ({PATRON_SQL}) select 'categorycode' as header, categorycode as value, count(*) as n, categorycode in ('BUILDING', 'MACHINERY') as covered from p group by 2")
def rule_coverage(spark, sf):
    rules = spark.createDataFrame([("categorycode", "BUILDING"), ("categorycode", "MACHINERY")], "header string, value string")
    return reconcile.coverage(profile.column_scan(adapters.patrons(spark, sf), ["categorycode"]), rules, ["header", "value"])


def _edited(spark, sf):
    """A later state: some records gone, one new, the titles of some changed."""
    old = bibs(spark, sf)
    fewer = old.where("record_index % 19 <> 0")
    changed = edits.find_replace("PROMO", "SALE", "942", "c")(fewer.where("record_index % 6 = 0"))
    added = old.where("record_index % 50 = 1").withColumn("fields", F.transform("fields", lambda f: F.when(f["tag"] == "001", f.withField("data", F.concat(F.lit("n"), f["data"]))).otherwise(f)))
    added = added.withColumn("record_index", F.col("record_index") + 10_000_000)
    return fewer.where("record_index % 6 <> 0").unionByName(changed).unionByName(added)


_STATES = (
    f"with b as ({BIB_SQL}), o as (select f001, max_by(struct_pack(l := leader, k := k, s := s, a := f245a, t := p_type, n := p_brand), k) as r from b group by 1), "
    "later as (select f001, k, case when k % 6 = 0 then replace(p_type, 'PROMO', 'SALE') else p_type end as c, * exclude (f001, k) from b where k % 19 <> 0 "
    "union all select 'n' || f001, k + 10000000, p_type, * exclude (f001, k) from b where k % 50 = 1) "
)


@register("diff_bib_counts", _STATES + "select count(*) filter (where o.f001 is null) as added, count(*) filter (where n.f001 is null) as removed, count(*) filter (where o.f001 is not null and n.f001 is not null) as kept from o full join (select distinct f001 from later) n on o.f001 = n.f001")
def diff_bib_counts(spark, sf):
    key = extract.first("001").alias("id")
    return tables.change_counts(bibs(spark, sf).select(key), _edited(spark, sf).select(key), "id")


_TAGS = "'001', '008', '020', '035', '082', case when {s}.f100a is not null then '100' end, case when {s}.f245a is not null then '245' end, '300', case when {s}.f500a is not null then '500' end, '650', '942'"
_DIFFERS = ", ".join(
    f"case when {' or '.join(f'o.{c} is distinct from n.{d}' for c, d in pairs)} then '{tag}' end"
    for tag, pairs in {
        "008": [("f008", "f008")], "020": [("f020a", "f020a")], "035": [("f035a", "f035a")], "082": [("f082a", "f082a")], "100": [("f100a", "f100a")],
        "245": [("f245a", "f245a"), ("case when o.f245a is not null then o.p_type end", "case when n.f245a is not null then n.p_type end"), ("case when o.f245a is not null then o.i245 end", "case when n.f245a is not null then n.i245 end")],
        "300": [("f300a", "f300a")], "500": [("f500a", "f500a")], "650": [("p_brand", "p_brand"), ("p_type", "p_type")], "942": [("p_type", "c")],
    }.items()
).replace("o.case", "case").replace("n.case", "case")


@register(
    "diff_bib_changes",
    _STATES + ", ob as (select * from b qualify row_number() over (partition by f001 order by k desc) = 1), nb as (select * from later qualify row_number() over (partition by f001 order by k desc) = 1), "
    f"d as (select coalesce(o.f001, n.f001) as marc_001, case when o.f001 is null then 'added' when n.f001 is null then 'removed' else 'changed' end as change, "
    f"case when o.f001 is null then concat_ws(',', {_TAGS.format(s='n')}) when n.f001 is null then concat_ws(',', {_TAGS.format(s='o')}) else concat_ws(',', {_DIFFERS}) end as tags from ob o full join nb n on o.f001 = n.f001) "
    "select * from d where change <> 'changed' or tags <> ''",
)
def diff_bib_changes(spark, sf):
    return tables.record_changes(bibs(spark, sf), _edited(spark, sf))


@register(
    "diff_patron_changes",
    f"with p as ({PATRON_SQL}), q as (select cardnumber, branchcode, case when cast(cardnumber as bigint) % 5 = 0 then 'X' else sex end as sex from p where cast(cardnumber as bigint) % 7 <> 0), "
    "a as (select cardnumber, 'branchcode' as \"column\", branchcode as v from p union all select cardnumber, 'sex', sex from p), "
    "b as (select cardnumber, 'branchcode' as \"column\", branchcode as v from q union all select cardnumber, 'sex', sex from q) "
    'select coalesce(a.cardnumber, b.cardnumber) as cardnumber, coalesce(a."column", b."column") as "column", coalesce(a.v, \'\') as before, coalesce(b.v, \'\') as after '
    'from a full join b on a.cardnumber = b.cardnumber and a."column" = b."column" where coalesce(a.v, \'\') <> coalesce(b.v, \'\')',
)
def diff_patron_changes(spark, sf):
    old = adapters.patrons(spark, sf).select("cardnumber", "branchcode", "sex")
    n = F.col("cardnumber").cast("long")
    new = old.where(n % 7 != 0).withColumn("sex", F.when(n % 5 == 0, "X").otherwise(F.col("sex")))
    return tables.row_changes(old, new, "cardnumber")


@register("lookup_transform", "select k as record_index, case when p_type = 'PROMO' then 'promotion' when lower(p_type) = 'economy' then 'cheap' else p_type end as kind from bib")
def lookup_transform(spark, sf):
    convert = text.lookup({"PROMO": "promotion", "economy": "cheap"})
    return bibs(spark, sf).select("record_index", convert(extract.first("942$c")).alias("kind"))


@register("union_columns", f"with p as ({PATRON_SQL}) select cardnumber, surname, '' as branchcode from p where sex = 'M' union all select cardnumber, '', branchcode from p where sex <> 'M'")
def union_columns(spark, sf):
    p = adapters.patrons(spark, sf)
    return tables.union([p.where("sex = 'M'").select("cardnumber", "surname"), p.where("sex <> 'M'").select("cardnumber", "branchcode")])


@register("keys_except", "with a as (select cast(c_custkey as varchar) as id from customer), b as (select cast(o_custkey as varchar) as id from orders) select id from a except select id from b")
def keys_except(spark, sf):
    return adapters.patrons(spark, sf).select(F.col("cardnumber").alias("id")).subtract(adapters.holds(spark, sf).select("patron_barcode"))


@register("keys_intersect", "with a as (select cast(c_custkey as varchar) as id from customer), b as (select cast(o_custkey as varchar) as id from orders) select id from a intersect select id from b")
def keys_intersect(spark, sf):
    return adapters.patrons(spark, sf).select(F.col("cardnumber").alias("id")).intersect(adapters.holds(spark, sf).select("patron_barcode"))


@register("join_first_001", "select min(k) as record_index from bib group by f001")
def join_first_001(spark, sf):
    return items.first_by(bibs(spark, sf)).select("record_index")


@register("union_files", "select k as record_index, f001 as id from bib union all select k + (select max(k) + 1 from bib), f001 from bib where k % 3 = 0")
def union_files(spark, sf):
    both = items.union_files([bibs(spark, sf), bibs(spark, sf).where("record_index % 3 = 0")])
    return both.select("record_index", extract.first("001").alias("id"))


# ---- rewriting


def _values(df: DataFrame, *tags: str) -> DataFrame:
    long = to_long(df).where(F.col("tag").isin(*tags))
    return long.select("record_index", "tag", F.coalesce("code", F.lit("_")).alias("code"), "value")


@register(
    "map_correlated",
    "select k as record_index, '949' as tag, 'c' as code, lower(p_type) as value from bib union all select k, '949', 'x', replace(p_type, 'O', '0') from bib "
    "union all select k, '949', 'z', 'moved' from bib union all select k, '990', 'a', f001 from bib",
)
def map_correlated(spark, sf):
    maps = [
        FieldMap("942", "949", "c", "c", "preset", "case_lower"),
        FieldMap("942", "949", "c", "x", "regex", "s/O/0/g"),
        FieldMap("001", "990", None, "a"),
        FieldMap("", "949", None, "z", "const", "moved"),
        FieldMap("942", "949", "q", "q", "copy", None, True),
    ]
    return _values(apply_maps(bibs(spark, sf), maps), "949", "990", "942")


@register("map_stats", "select cast(0 as int) as rule, count(f100a) as applied, count(*) - count(f100a) as skipped from bib union all select 1, 2 * count(*), cast(0 as bigint) from bib")
def map_stats(spark, sf):
    return map_statistics(bibs(spark, sf), [FieldMap("100", "700", "a", "a"), FieldMap("650", "653", "a", "a")])


_RULES = [
    reconcile.Rule("y", ("A",), "rename", "BK"),
    reconcile.Rule("y", ("N", "R"), "split", cases=(reconcile.Case("same_field", "OPEN", "c", None, "O"), reconcile.Case("default", "SHUT"))),
    reconcile.Rule("c", ("F",), "delete"),
]


@register(
    "recon_apply",
    _ITEM_ROWS + "select k as record_index, case when itype = 'A' then 'BK' when location = 'O' then 'OPEN' else 'SHUT' end as itype, case when location = 'F' then null else location end as location, count(*) as n from m group by 1, 2, 3",
)
def recon_apply(spark, sf):
    df = reconcile.apply_rules(_with_items(spark, sf), _RULES)
    found = each_field(df, "952", "record_index")
    code = lambda c: F.get(F.transform(F.filter(F.col("f.subfields"), lambda s: s["code"] == c), lambda s: s["value"]), 0)
    return found.groupBy("record_index", code("y").alias("itype"), code("c").alias("location")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "patron_apply",
    f"with p as ({PATRON_SQL}) select cardnumber, upper(surname) as surname, case when categorycode = 'BUILDING' then 'BLD' else categorycode end as categorycode, "
    "split_part(dateofbirth, '/', 3) || '-' || lpad(split_part(dateofbirth, '/', 1), 2, '0') || '-' || lpad(split_part(dateofbirth, '/', 2), 2, '0') as dateofbirth, "
    "case when sex = 'female' then 'F' when sex = 'M' then 'M' else '' end as sex, '' as email from p where categorycode <> 'MACHINERY'",
)
def patron_apply(spark, sf):
    maps = [
        tables.ColumnMap("cardnumber", "cardnumber"),
        tables.ColumnMap("surname", "surname", "upper"),
        tables.ColumnMap("categorycode", "categorycode"),
        tables.ColumnMap("dateofbirth", "dateofbirth", "date", "M/d/yyyy"),
        tables.ColumnMap("sex", "sex", "gender"),
    ]
    rules = [tables.ValueRule("categorycode", ("BUILDING",), "rename", "BLD"), tables.ValueRule("categorycode", ("MACHINERY",), "delete", mode="exclude_row")]
    return tables.convert(adapters.patrons(spark, sf), maps, rules, ["cardnumber", "surname", "categorycode", "dateofbirth", "sex", "email"])


@register("name_split", "with c as (select c_custkey, c_name from customer) select c_custkey as id, split_part(c_name, '#', 1) as surname, 'No' as firstname, split_part(c_name, '#', 2) as middlename from c")
def name_split(spark, sf):
    v = F.regexp_replace("c_name", r"^(.*)#(.*)$", "$1, No $2")
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), *(text.name_split(v, p).alias(p) for p in ("surname", "firstname", "middlename")))


def _edit(make, *tags):
    """The values of some tags after an edit, which is made with the session there."""
    return lambda spark, sf: _values(make()(bibs(spark, sf)), *tags)


_T245 = "select k as record_index, '245' as tag, code, value from (select k, 'a' as code, {a} as value from bib where f245a is not null union all select k, 'b', p_type from bib where f245a is not null)"
register("find_replace", _T245.format(a="replace(f245a, 'e', 'EE')"))(_edit(lambda: edits.find_replace("e", "EE", "245", "a"), "245"))
register("find_replace_nocase", _T245.format(a="regexp_replace(f245a, 'A', '$', 'gi')"))(_edit(lambda: edits.find_replace("A", "$", "245", "a", case_sensitive=False), "245"))
register("regex_replace", _T245.format(a=r"regexp_replace(f245a, '(\w)(\w)', '\2\1', 'g')"))(_edit(lambda: edits.regex_replace(r"([A-Za-z0-9_])([A-Za-z0-9_])", r"\2\1", "245", "a"), "245"))
register("add_field", "select k as record_index, '590' as tag, 'a' as code, 'checked' as value from bib where f100a is null")(_edit(lambda: edits.add_field("590", [("a", "checked")], if_missing="100"), "590"))
register("delete_field", "select k as record_index, '650' as tag, 'a' as code, value from (select k, p_brand as value from bib union all select k, p_type from bib) where not contains(lower(value), 'o')")(_edit(lambda: edits.delete_field("650", "a", "O"), "650"))
register("call_numbers", "select k as record_index, '852' as tag, 'h' as code, f082a || case when f100a is null then '' else ' ' || upper(left(f100a, 1)) end as value from bib")(_edit(lambda: edits.call_numbers(), "852"))
register(
    "macro_chain",
    "select k as record_index, '942' as tag, 'c' as code, replace(p_type, 'PROMO', 'SALE') || '!' as value from bib union all select k, '590', 'a', 'x' from bib",
)(_edit(lambda: edits.macro(edits.find_replace("PROMO", "SALE", "942", "c"), edits.regex_replace(r"^(.+)$", r"\1!", "942", "c"), edits.add_field("590", [("a", "x")]), edits.delete_field("650")), "942", "590", "650"))


@register(
    "rda_apply",
    "select k as record_index, '336' as tag, 'b' as code, case substr(leader, 7, 1) when 'e' then 'cri' when 'g' then 'tdi' when 'm' then 'cop' else 'txt' end as value from bib "
    "union all select k, '337', 'b', case substr(leader, 7, 1) when 'g' then 'v' when 'm' then 'c' else 'n' end from bib "
    "union all select k, '338', 'b', case substr(leader, 7, 1) when 'e' then 'nb' when 'g' then 'vd' when 'm' then 'cr' else 'nc' end from bib",
)
def rda_apply(spark, sf):
    return _values(edits.type_fields()(bibs(spark, sf)), "336", "337", "338").where("code = 'b'")


@register("sort_record", "select k as record_index, concat_ws(',', '001', '008', '020', '035', '082', case when f100a is not null then '100' end, case when f245a is not null then '245' end, '300', case when f500a is not null then '500' end, '590', '650', '650', '942') as tags, 'x1ba' as codes from bib where 1 = 1")
def sort_record(spark, sf):
    from bibloom.model import FIELD, datafield, subfield

    odd = datafield("590", F.array(subfield("b", "b"), subfield("a", "a"), subfield("1", "1"), subfield("9", "x"))).cast(FIELD)
    df = bibs(spark, sf).withColumn("fields", F.concat(F.array(odd), "fields")).withColumn("fields", items.sorted_fields())
    own = F.get(F.filter("fields", lambda f: f["tag"] == "590"), 0)
    codes = F.array_join(F.transform(own["subfields"], lambda s: s["value"]), "")
    return df.select("record_index", F.array_join("fields.tag", ",").alias("tags"), F.concat(F.substring(codes, 2, 1), F.substring(codes, 1, 1), F.substring(codes, 4, 1), F.substring(codes, 3, 1)).alias("codes"))


# ---- duplicates

_KEEP = "select k as record_index from (select k, row_number() over (partition by {key} order by {order}k) as r, {key} as key from {source}) where r = 1 or key is null"
_NORM = "case when {c} is null then null else trim(regexp_replace(regexp_replace(lower(strip_accents({c})), '[^a-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g')) end"


def _deduplicated(rule: str, **more):
    return lambda spark, sf: dedup.deduplicate(bibs(spark, sf), dedup.PRESETS[rule], **more).select("record_index")


register("dedup_isbn_keep_first", _KEEP.format(key="f020a", order="", source="bib"))(_deduplicated("isbn"))
register("dedup_title_author", _KEEP.format(key=f"case when f100a is null then null else {_NORM.format(c='f245a')} || '||' || {_NORM.format(c='f100a')} end", order="", source="bib"))(_deduplicated("title_author"))
register("dedup_oclc", "select k as record_index from bib")(_deduplicated("oclc"))
register("dedup_most_fields", _KEEP.format(key="f001", order="(12 - (f100a is null)::int - (f245a is null)::int - (f500a is null)::int) desc, ", source="bib"))(_deduplicated("001", keep="most_fields"))


@register("dedup_clusters", "select f001 as match_key, k as record_index, k = min(k) over (partition by f001) as survivor from bib qualify count(*) over (partition by f001) > 1")
def dedup_clusters(spark, sf):
    return dedup.clusters(bibs(spark, sf), dedup.PRESETS["001"]).select("match_key", "record_index", "survivor")


@register(
    "dedup_merge_holdings",
    _ITEM_ROWS + ", first as (select f020a, min(k) as owner from b group by 1) select owner as record_index, count(barcode) as n from first join b on b.f020a = first.f020a left join m on m.k = b.k group by 1",
)
def dedup_merge_holdings(spark, sf):
    merged = dedup.deduplicate(_with_items(spark, sf), dedup.PRESETS["isbn"], merge_items=True)
    return merged.select("record_index", F.size(F.filter("fields", lambda f: f["tag"] == "952")).cast("long").alias("n"))


# ---- quality


def _issues(*checks: str):
    def run(spark, sf):
        found = quality.scan(bibs(spark, sf), [*checks])
        return found.select("record_index", "severity", F.coalesce("tag", F.lit("")).alias("tag"), F.coalesce("original_value", F.lit("")).alias("original_value"), F.coalesce("suggested_fix", F.lit("")).alias("suggested_fix"))

    return run


_ISSUE = "select k as record_index, '{s}' as severity, '{t}' as tag, {v} as original_value, {f} as suggested_fix from bib where {w}"
register(
    "q_leader",
    " union all ".join([
        _ISSUE.format(s="error", t="LDR", v="'23'", f="''", w="k % 17 = 0"),
        _ISSUE.format(s="warning", t="LDR", v="'x'", f="'n'", w="s % 6 = 5"),
        _ISSUE.format(s="warning", t="LDR", v="'z'", f="'a'", w="s % 5 = 4"),
    ]),
)(_issues("leader"))
register("q_008", _ISSUE.format(s="warning", t="008", v="f008", f="repeat('|', 40)", w="s % 8 <> 4"))(_issues("008"))
register("q_indicators", _ISSUE.format(s="warning", t="245", v="'x'", f="' '", w="k % 5 = 0 and f245a is not null"))(_issues("indicators"))
register("q_blank", _ISSUE.format(s="warning", t="300", v="''", f="''", w="k % 13 = 0"))(_issues("blanks"))
register("q_missing_245", _ISSUE.format(s="error", t="245", v="''", f="''", w="f245a is null"))(_issues("titles"))
register("q_lengths", _ISSUE.format(s="error", t="", v="''", f="''", w="false"))(_issues("lengths"))
register(
    "q_diacritics",
    _ISSUE.format(s="warning", t="500", v="f500a", f="''", w="k % 4 = 1") + " union all " + _ISSUE.format(s="info", t="500", v="f500a", f="nfc_normalize(f500a)", w="k % 4 = 0"),
)(_issues("diacritics"))


@register(
    "q_dup_numbers",
    "select k as record_index, 'duplicate_001' as category, f001 as value from bib qualify count(*) over (partition by f001) > 1 "
    "union all select k, 'duplicate_isbn', replace(replace(split_part(f020a, ' ', 1), '-', ''), ' ', '') from bib qualify count(*) over (partition by f020a) > 1",
)
def q_dup_numbers(spark, sf):
    return quality.repeated_numbers(bibs(spark, sf)).select("record_index", "category", F.col("original_value").alias("value"))


@register(
    "quality_summary",
    "select 'leader_008' as category, count(*) filter (where k % 17 = 0) as errors, count(*) filter (where s % 6 = 5) + count(*) filter (where s % 5 = 4) + count(*) filter (where s % 8 <> 4) as warnings, cast(0 as bigint) as infos, "
    "count(*) filter (where k % 17 = 0 or s % 6 = 5 or s % 5 = 4 or s % 8 <> 4) as records, true as has_fix from bib",
)
def quality_summary(spark, sf):
    return quality.summary(quality.scan(bibs(spark, sf), ["leader", "008"]))


@register("fix_008", "select k as record_index, repeat('|', 40) as f008, case when s % 6 = 5 then 'n' else substr(leader, 6, 1) end as status from bib")
def fix_008(spark, sf):
    return quality.fix(bibs(spark, sf)).select("record_index", extract.first("008").alias("f008"), F.substring("leader", 6, 1).alias("status"))


# ---- single values


def _converted(column: str, convert, name: str = "value"):
    return lambda spark, sf: adapters.flat(spark, sf).select(F.col("k").alias("record_index"), convert(F.expr(column)).alias(name))


_VALUE = "select k as record_index, {v} as value from bib"
_MDY = "concat_ws('/', cast(1 + k % 12 as string), cast(1 + k % 28 as string), cast(1950 + k % 60 as string))"
_MDY_SQL = "concat_ws('/', 1 + k % 12, 1 + k % 28, 1950 + k % 60)"
register("dates_mdy_to_dmy", _VALUE.format(v="concat_ws('/', 1 + k % 28, 1 + k % 12, 1950 + k % 60)"))(_converted(_MDY, text.date_mdy_to_dmy))
register("dates_dmy_to_iso", _VALUE.format(v="concat_ws('-', 1950 + k % 60, lpad(cast(1 + k % 28 as varchar), 2, '0'), lpad(cast(1 + k % 12 as varchar), 2, '0'))"))(_converted(_MDY, text.date_dmy_to_iso))
register("dates_ymd_to_iso", _VALUE.format(v="cast(1950 + k % 60 as varchar) || '-01-02'"))(_converted("concat(cast(1950 + k % 60 as string), '0102rest')", text.date_ymd_to_iso))
register("dates_marc_to_iso", _VALUE.format(v="cast(1950 + k % 60 as varchar) || '-01-01'"))(_converted("cast(1950 + k % 60 as string)", text.date_marc_to_iso))
register("clean_isbn", _VALUE.format(v="'9780' || lpad(cast(k - case when k % 7 = 6 then 1 else 0 end as varchar), 7, '0')"))(_converted("f020a", text.clean_isbn))
register("year", _VALUE.format(v="cast(1950 + k % 60 as varchar)"))(_converted("concat('c', ' ', cast(1950 + k % 60 as string), ', x')", text.extract_year))
register("case_sentence", _VALUE.format(v="upper(left(p_name, 1)) || substr(p_name, 2)"))(_converted("p_name", text.case_sentence))
register("strip_punctuation", _VALUE.format(v="p_name"))(_converted("concat(p_name, ' .,:')", text.strip_punctuation))
register("truncate", _VALUE.format(v="repeat('ab', 60) || '…'"))(_converted("concat(repeat('ab', 60), p_name)", text.truncate))
register("file_safe", _VALUE.format(v="left(regexp_replace(p_name, '[^a-zA-Z0-9_-]', '_', 'g'), 50)"))(_converted("p_name", text.file_safe))
register("regex_first", _VALUE.format(v="regexp_replace(p_name, 'e', 'E')"))(_converted("p_name", lambda v: text.substitute("s/e/E/")(v)))
register("oclc", _VALUE.format(v="case when k % 3 = 0 then cast(k as varchar) end"))(_converted("f035a", text.oclc_number))
register(
    "isbn13",
    "select k as record_index, b || cast((10 - (select sum(cast(substr(b, i, 1) as int) * case when i % 2 = 1 then 1 else 3 end) from range(1, 13) t(i)) % 10) % 10 as varchar) as value "
    "from (select k, '978' || lpad(cast(k as varchar), 9, '0') as b from bib)",
)(_converted("concat(lpad(cast(k as string), 9, '0'), 'X')", text.isbn13))
register("normalize_text", _VALUE.format(v="'cafe ' || lower(regexp_replace(p_name, '[^a-zA-Z0-9_ ]', '', 'g'))"))(_converted("concat(' Café:  ', p_name)", text.normalize_text))


@register("title_case", r"with d as (select * from documents) select doc_id, array_to_string(list_transform(regexp_extract_all(text, '\p{L}+|[^\p{L}]+'), lambda x: case when substr(x, 1, 1) = 'ß' then 'Ss' else upper(substr(x, 1, 1)) end || lower(substr(x, 2))), '') as value from d")
def title_case(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", text.case_title(F.col("text")).alias("value"))


@register("strip_html")
def strip_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.clean_html(F.col("html")).alias("text"))


# ---- formats and scripts


@register("marc_roundtrip", "select k as record_index, rpad(leader, 24, ' ') as leader, f001 as id, coalesce(f245a, '') as title, coalesce(f500a, '') as note from bib")
def marc_roundtrip(spark, sf):
    """Records encoded as ISO 2709 and decoded again; the coded lengths of the leader left out."""
    raw = iso2709.encode(bibs(spark, sf).withColumn("leader", F.rpad("leader", 24, " ")))
    back = iso2709.decode(raw.select("file_id", "record_index", "raw"))
    leader = F.concat(F.lit("00000"), F.substring("leader", 6, 7), F.lit("00000"), F.substring("leader", 18, 7))
    return back.select("record_index", leader.alias("leader"), extract.first("001").alias("id"), extract.joined("245$a").alias("title"), extract.joined("500$a").alias("note"))


ORACLES["marc_roundtrip"] = ORACLES["marc_roundtrip"].replace("rpad(leader, 24, ' ')", "left(rpad(leader, 24, ' '), 12) || '00000' || substr(rpad(leader, 24, ' '), 18)")


@register("mnemonic_roundtrip", "select k as record_index, f001 as id, coalesce(f245a, '') as title from bib")
def mnemonic_roundtrip(spark, sf):
    back = formats.parse_mnemonic(formats.mnemonic(bibs(spark, sf)))
    return back.select("record_index", extract.first("001").alias("id"), extract.joined("245$a").alias("title"))


@register("json_roundtrip", "select k as record_index, leader, f001 as id, coalesce(f245a, '') as title from bib")
def json_roundtrip(spark, sf):
    back = formats.from_json(formats.to_json(bibs(spark, sf)))
    return back.select("record_index", "leader", extract.first("001").alias("id"), extract.joined("245$a").alias("title"))


@register("marcxml", "select k as record_index, '<record xmlns=\"http://www.loc.gov/MARC21/slim\"><leader>' || leader || '</leader><controlfield tag=\"001\">' || f001 || '</controlfield></record>' as xml from bib")
def marcxml(spark, sf):
    return formats.marcxml(bibs(spark, sf).withColumn("fields", F.filter("fields", lambda f: f["tag"] == "001")))


@register("spreadsheet", "select k as record_index, coalesce(f245a, '') as title, coalesce(f100a, '') as author from bib where contains(lower(p_type), 'o')")
def spreadsheet(spark, sf):
    return formats.spreadsheet(bibs(spark, sf), ["245$a", "100$a"], ("942$c", "O")).toDF("record_index", "title", "author")


@register("csv_to_marc", f"with p as ({PATRON_SQL}) select cardnumber as id, surname as name, categorycode || '; ' || branchcode as codes from p")
def csv_to_marc(spark, sf):
    mappings = [("cardnumber", "001", None, "  "), ("surname", "100", "a", "1 "), ("categorycode", "942", "c", "  "), ("branchcode", "943", "c", "  ")]
    made = formats.from_table(adapters.patrons(spark, sf), mappings)
    return made.select(extract.first("001").alias("id"), extract.joined("100$a").alias("name"), F.concat_ws("; ", extract.joined("942$c"), extract.joined("943$c")).alias("codes"))


@register("split_buckets", "select cast(floor(k / 100) + 1 as bigint) as bucket, count(*) as n from bib group by 1")
def split_buckets(spark, sf):
    return bibs(spark, sf).groupBy(tabular.buckets(bibs(spark, sf), 100).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "circ_sql",
    _HOLDS + "select case when p.n is null or b.n is null then '-- SKIPPED ' || h.patron || ' ' || h.bib else 'INSERT INTO old_issues (borrowernumber, itemnumber, issuedate, returndate, branchcode) VALUES (' "
    "|| p.n || ', ' || b.n || ', ''2001-01-02'', ''2001-01-02'', ''O''''Hare'');' end as line from h left join ids p on p.t = 'patron' and p.l = h.patron left join ids b on b.t = 'bib' and b.l = h.bib",
)
def circ_sql(spark, sf):
    rows = tables.by_alias(adapters.holds(spark, sf)).withColumnRenamed("bib", "item")
    ids = adapters.id_map(spark, sf)
    rows = rows.withColumns({"issuedate": F.lit("2001-01-02"), "returndate": F.lit(""), "branchcode": F.lit("O'Hare")})
    return tables.circulation_script(tables.resolve(rows, ids, {"patron": "patron", "item": "bib"}))


@register(
    "patron_values_sql",
    f"with p as ({PATRON_SQL}) select 'categorycode' as header, categorycode as value, 'INSERT IGNORE INTO categories (categorycode, description, category_type, enrolmentperiod) VALUES (''' || left(categorycode, 10) || ''', ''' || categorycode || ''', ''A'', 99); -- ' || count(*) as line from p group by 2",
)
def patron_values_sql(spark, sf):
    return tables.value_script(profile.column_scan(adapters.patrons(spark, sf), ["categorycode"]))


@register("sql_insert_parse", "with n as (select n_nationkey, n_name from nation) select 'branches' as kind, cast(n_nationkey as varchar) as code, 'The ' || n_name || ' (O''H)' as description from n")
def sql_insert_parse(spark, sf):
    n = table(spark, sf, "nation")
    line = F.format_string("INSERT INTO `branches` (`branchcode`, branchname) VALUES ('%s', 'The %s (O\\'H)');", F.col("n_nationkey").cast("string"), "n_name")
    return tabular.control_values(n.select(line.alias("value")))


@register(
    "search_topk",
    f"with bib as ({BIB_SQL}), t as (select k, f001, f245a is not null as titled, case when p_type = 'PROMO' then 1 else 0 end as p, case when f245a is not null and list_contains(string_split_regex(lower(f245a), '[^a-z0-9]+'), 'green') then 1 else 0 end as g from bib), "
    "s as (select k as record_index, f001 as marc_001, cast(3 * (g + case when titled then p else 0 end) + g + p as int) as score from t) select * from s where score > 0 order by score desc, record_index limit 20",
)
def search_topk(spark, sf):
    docs = search.documents(bibs(spark, sf))
    return search.search(docs, ["green", "promo"], 20).select("record_index", "marc_001", "score")
