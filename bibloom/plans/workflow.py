"""More queries over the test tables: builds, samples, files, reviews and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from bibloom.functions import extract
from bibloom.model import FIELD, datafield, subfield
from bibloom.operators import builds, dedup, edits, profile, quality, query, reconcile, review, samples, tables
from bibloom.operators.fieldmaps import FieldMap
from bibloom.plans import adapters
from bibloom.plans.adapters import BIB_SQL, ITEM_SQL, PATRON_SQL, bibs, table
from bibloom.plans.catalog import _ITEM_ROWS, _LONG, _RULES, _STATES, _edited, _values, _with_items, register
from bibloom.plans.catalog import ORACLES, QUERIES  # noqa: F401  of both modules
from bibloom.sources import files, formats, iso2709
from bibloom.streaming import audit

# ---- builds

_MAPS = [FieldMap("942", "949", "c", "c", "preset", "case_lower"), FieldMap("9x2", "949", "c", "d"), FieldMap("", "949", None, "z", "const", "moved"), FieldMap("100", "700", "a", "a", delete_source=True)]


def _parts(spark, sf):
    """Two files of a build, the second of records that the first has too."""
    all_of = bibs(spark, sf)
    return [all_of, all_of.where("record_index % 3 = 0")]


def _item_join(spark, sf):
    return builds.ItemJoin(adapters.items(spark, sf), "biblionumber", ["homebranch", "location", "itype", "barcode"])


_BUILT = (
    f"with b as ({BIB_SQL}), i as ({ITEM_SQL}), n as (select biblionumber, count(*) as n from i group by 1), top as (select max(k) + 1 as t from b), "
    "u as (select k as record_index, * from b union all select k + t as record_index, b.* from b, top where k % 3 = 0) "
)


@register(
    "build_output",
    _BUILT + "select record_index, f001 as id, lower(p_type) || '; moved' as mapped, coalesce(f100a, '') as author, cast(coalesce(n.n, 0) as bigint) as n_items, "
    "array_to_string(list_concat(['001', '008', '020', '035', '082'], case when f245a is not null then ['245'] else [] end, ['300'], case when f500a is not null then ['500'] else [] end, ['650', '650'], "
    "case when f100a is not null then ['700'] else [] end, ['942', '949']), ',') || repeat(',952', cast(coalesce(n.n, 0) as int)) as tags from u left join n on n.biblionumber = u.f001",
)
def build_output(spark, sf):
    """Two files, field maps (one of them unsound), items and field order in one plan."""
    built = builds.build(_parts(spark, sf), _MAPS, _item_join(spark, sf))
    own = F.get(F.filter("fields", lambda f: f["tag"] == "949"), 0)["subfields"]
    mapped = F.array_join(F.transform(F.filter(own, lambda s: s["code"].isin("c", "z")), lambda s: s["value"]), "; ")
    return built.select("record_index", extract.first("001").alias("id"), mapped.alias("mapped"), extract.joined("700$a").alias("author"), F.col("n_joined").cast("long").alias("n_items"), F.array_join("fields.tag", ",").alias("tags"))


@register("build_summary", _BUILT + "select count(*) as total_records, cast(sum(coalesce(n.n, 0)) as bigint) as items_joined, cast(0 as bigint) as without_001 from u left join n on n.biblionumber = u.f001")
def build_summary(spark, sf):
    return builds.summary(builds.build(_parts(spark, sf), _MAPS, _item_join(spark, sf)))


@register("build_duplicates", _BUILT + "select f001 as value, count(*) as n from u group by 1 having count(*) > 1")
def build_duplicates(spark, sf):
    return builds.duplicates(builds.build(_parts(spark, sf)))


@register("transform_files", "select 'part' || cast(k % 2 as varchar) as file_id, k as record_index, lower(p_type) as kind, coalesce(f100a, '') as author from bib")
def transform_files(spark, sf):
    """Each record of several files by itself; file and index stay."""
    named = bibs(spark, sf).withColumn("file_id", F.concat(F.lit("part"), (F.col("record_index") % 2).cast("string")))
    made = builds.transform(named, _MAPS)
    return made.select("file_id", "record_index", extract.joined("949$c").alias("kind"), extract.joined("700$a").alias("author"))


@register(
    "merge_files",
    _BUILT + "select record_index, cast(count(n.n) as bigint) as has_items, cast(coalesce(max(n.n), 0) as bigint) as n_items from u left join n on n.biblionumber = u.f001 group by 1",
)
def merge_files(spark, sf):
    merged = builds.merge(_parts(spark, sf), _item_join(spark, sf))
    n = F.size(F.filter("fields", lambda f: f["tag"] == "952")).cast("long")
    return merged.select("record_index", (n > 0).cast("long").alias("has_items"), n.alias("n_items"))


@register("missing_tags", "select 'part' as file_id, t.tag from (select * from bib order by k limit 1) b, (values ('100'), ('245'), ('856'), ('880')) t(tag) where t.tag in ('856', '880') or (t.tag = '100' and b.f100a is null) or (t.tag = '245' and b.f245a is null)")
def missing_tags(spark, sf):
    maps = [FieldMap(t, "990", "a", "a") for t in ("100", "245", "856", "880")]
    return builds.missing_tags(bibs(spark, sf), maps)


# ---- samples and single records


@register("sample_titled", "select k as record_index from bib where f245a is not null order by k limit 200")
def sample_titled(spark, sf):
    return samples.first_records(bibs(spark, sf), 200, titled=True).select("record_index")


@register("record_at", "select k as record_index, f001 as id, coalesce(f245a, '') as title from bib where k = 42")
def record_at(spark, sf):
    return samples.record_at(bibs(spark, sf), 42).select("record_index", extract.first("001").alias("id"), extract.joined("245$a").alias("title"))


@register(
    "stratified_sample",
    f"with bib as ({BIB_SQL}), pool as (select k, row_number() over (order by k) as r from bib where f245a is not null qualify r <= 500), "
    "drawn as (select k from pool where r > 20 order by md5('7:' || cast(k as varchar)), k limit 30) select k as record_index, 'first' as stratum from pool where r <= 20 union all select k, 'drawn' from drawn",
)
def stratified_sample(spark, sf):
    return samples.stratified_sample(bibs(spark, sf), 20, 30, 500, seed=7).select("record_index", "stratum")


@register("sample_by_item_value", _ITEM_ROWS + "select distinct k as record_index from m where itype = 'R' order by k limit 5")
def sample_by_item_value(spark, sf):
    return samples.with_item_value(_with_items(spark, sf), "itype", "R", 5).select("record_index")


@register("records_page", "select k as record_index, coalesce(f245a, '') as title from bib order by coalesce(f245a, ''), k limit 50 offset 100")
def records_page(spark, sf):
    flat = bibs(spark, sf).select("record_index", extract.joined("245$a").alias("title"))
    return samples.page(flat, ["title", "record_index"], 100, 50)


@register("harvest_page", "select k as record_index, f001 as identifier, case when (select count(*) from bib where k >= 100) > 100 then '200' end as resumption_token from bib where k >= 100 order by k limit 100")
def harvest_page(spark, sf):
    return samples.harvest_page(bibs(spark, sf), 100, 100)


@register("compact_text", "select k as record_index, '--- Record ' || k || ' ---' || chr(10) || '=LDR  ' || leader || chr(10) || '=001  ' || f001 || chr(10) || '=942    $c' || p_type as text from bib")
def compact_text(spark, sf):
    some = bibs(spark, sf).withColumn("fields", F.filter("fields", lambda f: f["tag"].isin("001", "942")))
    return samples.compact_text(some)


@register("strings_by_tag", "select k as record_index, '001' as tag, f001 as texts from bib union all select k, '650', '  $a' || p_brand || '|  $a' || p_type from bib union all select k, '100', '1 $a' || f100a from bib where f100a is not null")
def strings_by_tag(spark, sf):
    found = samples.strings_by_tag(bibs(spark, sf)).where(F.col("tag").isin("001", "650", "100"))
    return found.select("record_index", "tag", F.array_join("texts", "|").alias("texts"))


@register("items_from_records", "select f001 as key, coalesce(f245a, '') as title, p_type as topic from bib")
def items_from_records(spark, sf):
    return samples.items_of(bibs(spark, sf), "001", ["245$a", "650$a"]).toDF("key", "title", "topic")


@register("patrons_from_records", "select f001 as patron_id, coalesce(f100a, '') as surname, p_brand as city from bib")
def patrons_from_records(spark, sf):
    return samples.patrons_of(bibs(spark, sf), {"001": "patron_id", "100$a": "surname", "650$a": "city"})


@register("control_numbers", "select k as record_index, f001 as id from bib")
def control_numbers(spark, sf):
    return bibs(spark, sf).select("record_index", extract.first("001").alias("id"))


@register("select_all_specs", "select unnest(['001', '008', '020$a', '035$a', '082$a', '100$a', '245$a', '245$b', '300$a', '650$a', '942$c']) as spec from (select * from bib where p_type = 'PROMO' and f100a is not null and f245a is not null and f500a is null order by k limit 1)")
def select_all_specs(spark, sf):
    some = bibs(spark, sf).where(extract.has_tag("100") & extract.has_tag("245") & ~extract.has_tag("500"))
    specs = query.first_record_specs(some, [query.Condition("942$c", "=", "promo")])
    return spark.createDataFrame([(s,) for s in specs], "spec string")


# ---- files


@register("sniff_formats", "select k as record_index, case k % 3 when 0 then 'iso2709' when 1 then 'mrk' end as format from bib")
def sniff_formats(spark, sf):
    rows = bibs(spark, sf)
    iso = iso2709.encode(rows.where("record_index % 3 = 0").withColumn("leader", F.rpad("leader", 24, " "))).select("file_id", "record_index", "raw")
    text = formats.mnemonic(rows.where("record_index % 3 = 1")).select(F.lit("part").alias("file_id"), "record_index", F.concat(F.lit("\n  \n"), F.regexp_replace("text", "^=LDR.*\n", "")).alias("raw"))
    other = rows.where("record_index % 3 = 2").select("file_id", "record_index", F.concat(F.lit("12345 "), "leader").alias("raw"))
    return files.record_format(iso.unionByName(text).unionByName(other)).select("record_index", "format")


def _damaged(spark, sf):
    """Raw records as bytes, every tenth with a byte that isn't UTF-8."""
    raw = iso2709.encode(bibs(spark, sf)).select("file_id", "record_index", F.col("raw").cast("binary").alias("raw"))
    return raw.withColumn("raw", F.when(F.col("record_index") % 10 == 0, F.concat("raw", F.unhex(F.lit("FF")))).otherwise(F.col("raw")))


@register("utf8_statistics", "select count(*) as total_records, count(*) filter (where k % 10 = 0) as bad_record_count, count(*) filter (where k % 10 = 0 or k % 4 in (0, 1)) as nonascii_record_count, (select string_agg(cast(k as varchar), ',' order by k) from (select k from bib where k % 10 = 0 order by k limit 5)) as bad_indices from bib")
def utf8_statistics(spark, sf):
    return files.utf8_statistics(_damaged(spark, sf))


@register("utf8_repair", "select mode, count(*) as kept, count(*) filter (where mode <> 'skip' and k % 10 = 0) as repaired from bib, (values ('skip'), ('replace'), ('transliterate')) m(mode) where mode <> 'skip' or k % 10 <> 0 group by 1")
def utf8_repair(spark, sf):
    raw = _damaged(spark, sf)
    out = None
    for mode in ("skip", "replace", "transliterate"):
        fixed = files.repaired(raw, mode).select(F.lit(mode).alias("mode"), "record_index", F.is_valid_utf8(F.col("raw").cast("binary").cast("string")).alias("sound"))
        out = fixed if out is None else out.unionByName(fixed)
    repaired = F.count_if((F.col("mode") != "skip") & (F.col("record_index") % 10 == 0))
    return out.where("sound").groupBy("mode").agg(F.count(F.lit(1)).alias("kept"), repaired.alias("repaired"))


@register(
    "repair_fields",
    "select mode, k as record_index, case when k % 3 <> 0 or f245a is null then coalesce(f245a, '') when mode = 'replace' then f245a || chr(65533) || '+' else f245a || '+' end as title, coalesce(f300a, '') as extent "
    "from bib, (values ('skip'), ('replace'), ('transliterate')) m(mode) where mode <> 'skip' or k % 3 <> 0 or f245a is null",
)
def repair_fields(spark, sf):
    """Titles with a byte of another encoding; what is mended reads back field by field."""
    own = F.transform(F.filter("fields", lambda f: f["tag"] != "500"), lambda f: F.when((f["tag"] == "245") & (F.col("record_index") % 3 == 0), datafield("245", F.array(subfield("a", F.concat(f["subfields"][0]["value"], F.lit("~+")))))).otherwise(f))
    raw = iso2709.encode(bibs(spark, sf).withColumn("fields", own)).select("file_id", "record_index", F.encode(F.translate("raw", "~", "é"), "ISO-8859-1").alias("raw"))
    out = None
    for mode in files.MODES:
        fixed = iso2709.decode(files.repaired(raw, mode)).select(F.lit(mode).alias("mode"), "record_index", extract.joined("245$a").alias("title"), extract.joined("300$a").alias("extent"))
        out = fixed if out is None else out.unionByName(fixed)
    return out


@register("split_by_value", "select case when f100a is null then '_no_value_' else left(regexp_replace(f100a, '[^a-zA-Z0-9_-]', '_', 'g'), 50) end as bucket, count(*) as n from bib group by 1")
def split_by_value(spark, sf):
    return bibs(spark, sf).groupBy(files.bucket_of(extract.first("100$a")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@register("value_files", f"with p as ({PATRON_SQL}), c as (select 'categorycode' as header, categorycode as value, count(*) as n from p group by 2 union all select 'branchcode', branchcode, count(*) from p group by 2) select *, cast(row_number() over (partition by header order by n desc, value) as int) as position from c")
def value_files(spark, sf):
    return review.ordered_values(profile.column_scan(adapters.patrons(spark, sf), ["categorycode", "branchcode"]), "header")


@register("dedup_exceptions", "select f001 as match_key, k as record_index, f001 as marc_001, cast(12 - (f100a is null)::int - (f245a is null)::int - (f500a is null)::int as int) as field_count, cast(0 as int) as item_count from bib qualify count(*) over (partition by f001) > 1")
def dedup_exceptions(spark, sf):
    found = dedup.clusters(bibs(spark, sf), dedup.PRESETS["001"])
    return found.select("match_key", "record_index", "marc_001", "field_count", "item_count").orderBy("match_key", "record_index")


@register("dedup_chosen", "select max(k) as record_index from bib group by f001")
def dedup_chosen(spark, sf):
    """The survivor of each cluster chosen by hand: its last record."""
    rows = bibs(spark, sf)
    chosen = rows.groupBy(extract.first("001").alias("match_key")).agg(F.max("record_index").alias("primary_index"))
    return dedup.deduplicate(rows, dedup.PRESETS["001"], chosen=chosen).select("record_index")


@register("audit_lines", "with e as (select event_id, ts, event_type, user_id, props from events) select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '  ' || case when event_id % 3 = 0 then '[global]' else '[stage ' || (event_id % 3) || ']' end || '  ' || event_type || '  [INFO]  user ' || user_id as line from e")
def audit_lines(spark, sf):
    e = table(spark, sf, "events")
    events = e.select(F.col("ts").alias("created_at"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 3).alias("stage"), F.lit("info").alias("level"), F.col("event_type").alias("tag"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("message"), F.lit(None).cast("string").alias("record_001"), "event_id")
    lines = audit.export_lines(events.withColumn("message", F.concat("message", F.lit("#"), F.col("event_id").cast("string"))))
    return lines.select(F.regexp_extract("line", "#([0-9]+)$", 1).cast("long").alias("event_id"), F.regexp_replace("line", "#[0-9]+$", "").alias("line"))


# ---- reviews


def _rules(spark, sf):
    """Field maps as a table: a third approved, some suggested, with confidences."""
    n = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.lpad((n % 1000).cast("string"), 3, "0").alias("source_tag"),
        F.when(n % 2 == 0, "a").alias("source_sub"),
        F.lit("952").alias("target_tag"),
        F.col("p_size").cast("string").alias("target_sub"),
        F.lit("copy").alias("transform_type"),
        F.lit(None).cast("string").alias("transform_fn"),
        F.lit(None).cast("string").alias("preset_key"),
        (n % 3 == 0).alias("approved"),
        (n % 4 < 2).alias("suggested"),
        F.when(n % 4 < 2, (n % 100) / 100.0).cast("double").alias("confidence"),
        n.alias("id"),
    )


_RULES_SQL = (
    "with m as (select lpad(cast(p_partkey % 1000 as varchar), 3, '0') as source_tag, case when p_partkey % 2 = 0 then 'a' end as source_sub, cast(p_size as varchar) as target_sub, "
    "p_partkey % 3 = 0 as approved, p_partkey % 4 < 2 as suggested, case when p_partkey % 4 < 2 then cast((p_partkey % 100) / 100.0 as double) end as confidence, p_partkey as id from part) "
)


@register("maps_by_status", _RULES_SQL + "select case when approved then 'approved' when suggested then 'pending' else 'manual' end as status, count(*) as n from m group by 1")
def maps_by_status(spark, sf):
    rules, out = _rules(spark, sf), None
    for status in ("approved", "pending", "manual"):
        one = review.maps_of(rules, status).select(F.lit(status).alias("status"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register("maps_approve", _RULES_SQL + "select id, approved or confidence is null or confidence >= 0.85 as approved from m")
def maps_approve(spark, sf):
    return review.approve(_rules(spark, sf), 0.85).select("id", "approved")


@register("template_import", "with t as (select n_nationkey as pos, cast(n_regionkey as varchar) as r from nation) select '65' || r as source_tag, 'a' as source_sub, '69' || r as target_tag, case when min(pos) % 2 = 0 then 'copy' else 'regex' end as transform_type, min(pos) % 2 = 1 as delete_source from t where r <> '3' group by r")
def template_import(spark, sf):
    """A template with repeated rules and one region's without a source."""
    n, r = F.col("n_nationkey"), F.col("n_regionkey").cast("string")
    raw = table(spark, sf, "nation").select(
        n.alias("at"),
        F.when(r == "3", " ").otherwise(F.concat(F.lit(" 65"), r)).alias(" Source_Tag"),
        F.lit("a ").alias("source_sub"),
        F.concat(F.lit("69"), r).alias("TARGET_TAG"),
        F.when(n % 2 == 0, "").otherwise("regex").alias("transform_type"),
        F.when(n % 2 == 0, "no").otherwise("Yes").alias("delete_source"),
    )
    return review.read_template(raw, "at").select("source_tag", "source_sub", "target_tag", "transform_type", "delete_source")


@register("template_export", _RULES_SQL + "select source_tag, coalesce(source_sub, '') as source_sub, '952' as target_tag, target_sub, 'copy' as transform_type, '' as transform_fn, '' as preset_key, 'false' as delete_source, '' as notes from m where approved or suggested")
def template_export(spark, sf):
    saved = review.save_template(_rules(spark, sf), pending=True)
    return review.write_template(saved.withColumns({"delete_source": F.lit(False), "notes": F.lit(None).cast("string")}))


_TEMPLATE_SQL = "t as (select lpad(cast(n_nationkey * 7 as varchar), 3, '0') as source_tag, case when n_nationkey % 2 = 0 then 'a' end as source_sub from nation), "


@register(
    "template_merge",
    _RULES_SQL + ", " + _TEMPLATE_SQL + "i as (select t.* from t where not exists (select 1 from m where m.approved and m.source_tag = t.source_tag and coalesce(m.source_sub, '') = coalesce(t.source_sub, ''))) "
    "select source_tag, coalesce(source_sub, '') as source_sub, approved, suggested from m where approved or not exists (select 1 from i where i.source_tag = m.source_tag and coalesce(i.source_sub, '') = coalesce(m.source_sub, '')) "
    "union all select source_tag, coalesce(source_sub, ''), false, false from i",
)
def template_merge(spark, sf):
    n = F.col("n_nationkey")
    blank = F.lit(None).cast("string")
    t = table(spark, sf, "nation").select(F.lpad((n * 7).cast("string"), 3, "0").alias("source_tag"), F.when(n % 2 == 0, "a").alias("source_sub"), F.lit("990").alias("target_tag"), F.lit("x").alias("target_sub"), F.lit("copy").alias("transform_type"), blank.alias("transform_fn"), blank.alias("preset_key"))
    merged = review.merge_template(_rules(spark, sf), t)
    return merged.select("source_tag", F.coalesce("source_sub", F.lit("")).alias("source_sub"), "approved", "suggested")


@register(
    "suggestions_upsert",
    _RULES_SQL + ", s as (select source_tag, source_sub, target_sub from m where id % 5 = 0 union all select '999', null, 'q'), "
    "i as (select s.* from s where not exists (select 1 from m where m.approved and m.source_tag = s.source_tag and coalesce(m.source_sub, '') = coalesce(s.source_sub, ''))) "
    "select source_tag, target_sub, approved, suggested, count(*) as n from (select source_tag, target_sub, approved, suggested from m where approved or not exists (select 1 from i where i.source_tag = m.source_tag "
    "and coalesce(i.source_sub, '') = coalesce(m.source_sub, '') and i.target_sub = m.target_sub) union all select source_tag, target_sub, false, true from i) group by 1, 2, 3, 4",
)
def suggestions_upsert(spark, sf):
    rules = _rules(spark, sf)
    columns = ["source_tag", "source_sub", "target_tag", "target_sub", "transform_type"]
    new = spark.createDataFrame([("999", None, "952", "q", "copy")], ", ".join(f"{c} string" for c in columns))
    found = review.upsert(rules, rules.where("id % 5 = 0").select(*columns).unionByName(new), ["source_tag", "source_sub"], ["source_tag", "source_sub", "target_tag", "target_sub"])
    return found.groupBy("source_tag", "target_sub", "approved", "suggested").agg(F.count(F.lit(1)).alias("n"))


@register("transform_preview", "select k as record_index, p_type as kind_before, replace(p_type, 'PROMO', 'SALE') as kind_after from bib where k % 19 <> 0 and k % 6 = 0")
def transform_preview(spark, sf):
    old, new = bibs(spark, sf), _edited(spark, sf)
    return review.preview(old, new.where("record_index % 6 = 0 and record_index < 10000000"), {"kind": extract.joined("942$c")})


@register("issues_annotated", "select k as record_index, cast((k % 17 = 0)::int + (s % 6 = 5)::int + (s % 5 = 4)::int + (s % 8 <> 4)::int as int) as n from bib")
def issues_annotated(spark, sf):
    rows = bibs(spark, sf)
    return review.annotated(rows, quality.scan(rows, ["leader", "008"])).select("record_index", F.size("issues").alias("n"))


@register("issues_page", "select k as record_index, 'warning' as severity, f008 as original_value from bib where s % 8 <> 4 order by k limit 50 offset 50")
def issues_page(spark, sf):
    found = quality.scan(bibs(spark, sf), ["008", "blanks"])
    return review.issues_page(found, 50, 50, severity="warning", tag="008").select("record_index", "severity", "original_value")


@register("issue_status", "select case when s % 8 in (0, 1) then 'ignored' else 'open' end as status, count(*) as n from bib where s % 8 <> 4 group by 1")
def issue_status(spark, sf):
    found = quality.scan(bibs(spark, sf), ["008"]).withColumn("status", F.lit("open"))
    set_ = review.set_status(found, "ignored", F.length("original_value") < 38)
    return set_.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register("findings_order", "with f as (select event_type, value from events) select event_type as title, case when event_type = (select min(event_type) from f) then 'action_required' when event_type = (select max(event_type) from f) then 'info' else 'warning' end as severity, count(*) as n from f group by 1")
def findings_order(spark, sf):
    e = table(spark, sf, "events")
    ends = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi")).first()
    severity = F.when(F.col("event_type") == ends["lo"], "action_required").when(F.col("event_type") == ends["hi"], "info").otherwise("warning")
    counts = e.groupBy(F.col("event_type").alias("title"), severity.alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    return review.by_severity(counts)


@register("values_described", f"with p as ({PATRON_SQL}) select 'branchcode' as category, branchcode as value, count(*) as n, case when branchcode < 'G' then 'The ' || branchcode else '' end as description from p group by 2")
def values_described(spark, sf):
    counts = profile.column_scan(adapters.patrons(spark, sf), ["branchcode"]).withColumnRenamed("header", "category")
    known = table(spark, sf, "nation").where("n_name < 'G'").select(F.lit("branchcode").alias("category"), F.col("n_name").alias("value"), F.concat(F.lit("The "), "n_name").alias("description"))
    return review.described(counts, known)


@register("authority_values", "with n as (select * from nation) select case when n_nationkey % 2 = 0 then cast(n_nationkey as varchar) else 'L' || n_nationkey end as code, n_name as description from n")
def authority_values(spark, sf):
    n, key = table(spark, sf, "nation"), F.col("n_nationkey").cast("string")
    even = F.create_map(F.lit("branchcode"), key, F.lit("branchname"), F.col("n_name"))
    odd = F.create_map(F.lit("branchcode"), F.lit(""), F.lit("library_id"), F.concat(F.lit("L"), key), F.lit("name"), F.col("n_name"))
    return review.authority_values(n.select(F.when(F.col("n_nationkey") % 2 == 0, even).otherwise(odd).alias("cells")), "homebranch")


@register("patron_files", "with s as (select case s_suppkey % 4 when 0 then 'Borrowers_' when 1 then 'items_' when 2 then 'card' else 'USER-' end || s_suppkey || '.csv' as filename from supplier) select filename, regexp_matches(lower(filename), 'patron|borrower|user|member|reader|cardholder') as is_patron_likely from s")
def patron_files(spark, sf):
    k = F.col("s_suppkey")
    prefix = F.when(k % 4 == 0, "Borrowers_").when(k % 4 == 1, "items_").when(k % 4 == 2, "card").otherwise("USER-")
    return review.patron_files(table(spark, sf, "supplier").select(F.concat(prefix, k.cast("string"), F.lit(".csv")).alias("filename")))


@register("recon_rescan", _ITEM_ROWS + "select 'itype' as category, case when itype = 'A' then 'BK' when location = 'O' then 'OPEN' else 'SHUT' end as value, count(*) as n from m group by 2 union all select 'loc', location, count(*) from m where location <> 'F' group by 2")
def recon_rescan(spark, sf):
    """Value counts after the rules have been applied."""
    found = profile.vocabulary_scan(reconcile.apply_rules(_with_items(spark, sf), _RULES))
    return found.where(F.col("category").isin("itype", "loc"))


@register("control_counts", "with n as (select n_regionkey from nation) select case when n_regionkey < 2 then 'branches' else 'av:' || n_regionkey end as kind, count(*) as n from n group by 1")
def control_counts(spark, sf):
    r = F.col("n_regionkey")
    kinds = table(spark, sf, "nation").select(F.when(r < 2, "branches").otherwise(F.concat(F.lit("av:"), r.cast("string"))).alias("kind"))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@register("next_versions", "with v as (select o_orderstatus as project, o_custkey % 7 as version from orders) select project, cast(max(version) + 1 as bigint) as version from v group by 1")
def next_versions(spark, sf):
    v = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("project"), (F.col("o_custkey") % 7).alias("version"))
    return review.next_version(v, ["project"])


_TASKS_SQL = "with t as (select o_orderkey as id, o_orderstatus as kind, o_orderdate as at, (epoch(timestamp '1998-12-31') - epoch(o_orderdate)) % 7200 as late from orders), r as (select cast(id as varchar) as task_id, kind, cast(late as bigint) as duration_sec from t where id % 3 <> 0) "


def _tasks(spark, sf):
    o = table(spark, sf, "orders")
    now = F.lit("1998-12-31 00:00:00").cast("timestamp")
    late = (F.unix_timestamp(now) - F.unix_timestamp("o_orderdate")) % 7200
    rows = o.select(F.col("o_orderkey").cast("string").alias("task_id"), F.col("o_orderstatus").alias("kind"), F.when(F.col("o_orderkey") % 3 == 0, "done").otherwise("running").alias("status"), (F.unix_timestamp(now) - late).cast("timestamp").alias("started_at"))
    return review.running_tasks([rows.where("kind = 'O'"), rows.where("kind <> 'O'")], now)


@register("running_tasks", _TASKS_SQL + "select * from r")
def running_tasks(spark, sf):
    return _tasks(spark, sf)


@register("alerts", _TASKS_SQL + ", q as (select n_name as queue, n_nationkey * 5 as depth from nation) select 'warn' as severity, 'queue_backlog' as kind, queue as subject, cast(depth as bigint) as amount from q where depth > 50 union all select case when duration_sec > 3600 then 'critical' else 'info' end, case when duration_sec > 3600 then 'hung_task' else 'long_running' end, task_id, duration_sec from r where duration_sec > 1800")
def alerts(spark, sf):
    queues = table(spark, sf, "nation").select(F.col("n_name").alias("queue"), (F.col("n_nationkey") * 5).alias("depth"))
    return review.alerts(queues, _tasks(spark, sf))


@register("task_history", "with o as (select cast(o_orderkey as varchar) as task_id, o_orderstatus as kind, case o_orderkey % 3 when 0 then 'done' when 1 then 'failed' else 'running' end as status, o_orderdate as started_at, o_orderdate + interval 1 minute * (o_orderkey % 50) as finished_at from orders), h as (select * from o where status <> 'running') select task_id, kind, status, cast(epoch(finished_at) - epoch(started_at) as bigint) as duration_sec from h order by started_at desc, task_id limit 40 offset 10")
def task_history(spark, sf):
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderkey") % 3 == 0, "done").when(F.col("o_orderkey") % 3 == 1, "failed").otherwise("running")
    finished = F.timestamp_seconds(F.unix_timestamp("o_orderdate") + 60 * (F.col("o_orderkey") % 50))
    rows = o.select(F.col("o_orderkey").cast("string").alias("task_id"), F.col("o_orderstatus").alias("kind"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("started_at"), finished.alias("finished_at"))
    return review.task_history([rows.where("kind = 'O'"), rows.where("kind <> 'O'")], offset=10, limit=40).drop("started_at", "finished_at")


@register("error_count", "with e as (select * from events) select count(*) as errors from e where event_type = 'error' and ts >= timestamp '2024-01-29 12:00:00'")
def error_count(spark, sf):
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    return audit.error_count(table(spark, sf, "events"), now, 24, "ts", "event_type")


@register(
    "stalled_tasks",
    "with l as (select cast(user_id as varchar) as task_id, arg_max(event_type, ts) as kind, max(ts) as last_at from events group by 1) "
    "select task_id, kind, cast(epoch(timestamp '2024-01-31') - floor(epoch(last_at)) as bigint) as quiet_sec from l where kind <> 'purchase' and epoch(timestamp '2024-01-31') - floor(epoch(last_at)) > 86400",
)
def stalled_tasks(spark, sf):
    """Users as tasks that end with a purchase."""
    log = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("task_id"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") == "purchase", "done").otherwise("running").alias("status"))
    return audit.stalled_tasks(log, F.lit("2024-01-31").cast("timestamp"), 86400).drop("last_at")


@register("diff_first_changes", _STATES + ", l as (select f001, max_by(c, k) as c, max_by(struct_pack(l := leader, k := k, s := s, a := f245a, t := p_type, n := p_brand), k) as r from later group by 1) select o.f001 as marc_001 from o join l on o.f001 = l.f001 where l.c <> o.r.t or o.r.k <> l.r.k order by 1 limit 100")
def diff_first_changes(spark, sf):
    return review.first_changes(tables.record_changes(bibs(spark, sf), _edited(spark, sf))).select("marc_001")


@register("worth_showing", _LONG + ", c as (select tag, coalesce(code, '_') as code, trim(value) as value, count(*) as n, min(k) as f from long where trim(value) <> '' group by 1, 2, 3), r as (select *, row_number() over (partition by tag, code order by n desc, f) as r from c qualify r <= 5) select tag, code, count(*) as shown, cast(sum(n) as bigint) as total from r group by 1, 2 having count(*) >= 2 or sum(n) >= 10")
def worth_showing(spark, sf):
    return profile.worth_showing(profile.value_index(bibs(spark, sf), 5))


# ---- rules with data that has their fault


def _faulty(spark, sf):
    """Records with headings without $a, and a note that is too long."""
    head = lambda tag: datafield(tag, F.array(subfield("b", "x")))
    k = F.col("record_index")
    long = datafield("520", F.array(subfield("a", F.repeat(F.lit("word "), 2100))))
    extra = F.array_compact(F.array(F.when(k % 7 == 0, head("110").cast(FIELD)), F.when(k % 9 == 0, long.cast(FIELD))))
    bare = F.transform("fields", lambda f: F.when((f["tag"] == "245") & (k % 8 == 0), f.withField("subfields", F.filter(f["subfields"], lambda s: s["code"] != "a"))).otherwise(f))
    return bibs(spark, sf).withColumn("fields", F.concat(bare, extra))


@register("q_headings", "select k as record_index, '245' as tag from bib where f245a is null or k % 8 = 0 union all select k, '110' from bib where k % 7 = 0")
def q_headings(spark, sf):
    return quality.scan(_faulty(spark, sf), ["titles"]).select("record_index", "tag")


@register("q_long_fields", "select k as record_index, '520' as tag from bib where k % 9 = 0")
def q_long_fields(spark, sf):
    return quality.scan(_faulty(spark, sf), ["lengths"]).select("record_index", "tag")


@register("dedup_oclc_pairs", "select k as record_index from (select k, row_number() over (partition by case when k % 3 = 0 then k // 6 end order by k) as r, k % 3 = 0 as named from bib) where r = 1 or not named")
def dedup_oclc_pairs(spark, sf):
    """Two records share each OCLC number, where there is one."""
    k = F.col("record_index")
    number = F.concat(F.lit("(OCoLC)"), F.floor(k / 6).cast("string"))
    named = F.transform("fields", lambda f: F.when((f["tag"] == "035") & (k % 3 == 0), f.withField("subfields", F.array(subfield("a", number)))).otherwise(f))
    return dedup.deduplicate(bibs(spark, sf).withColumn("fields", named), dedup.PRESETS["oclc"]).select("record_index")


@register("holds_invalid", "with h as (select case when o_custkey % 10 = 0 then ' ' else 'p' end as p, case when o_orderkey % 4 = 0 then null else 'b' end as b from orders) select count(*) filter (where p = 'p' and b is not null) as valid, count(*) filter (where p <> 'p' or b is null) as invalid, count(*) filter (where p <> 'p') as no_patron, count(*) filter (where b is null) as no_bib from h")
def holds_invalid(spark, sf):
    rows = tables.by_alias(table(spark, sf, "orders").select(F.when(F.col("o_custkey") % 10 == 0, " ").otherwise("p").alias(" Patron_ID"), F.when(F.col("o_orderkey") % 4 != 0, "b").alias("BIBLIONUMBER"), F.col("o_custkey"), F.col("o_orderkey")))
    return tables.validate(rows, ["patron", "bib"])


@register("keys_except_some", "with a as (select cast(c_custkey as varchar) as id from customer), b as (select cast(o_custkey as varchar) as id from orders where o_orderkey % 50 = 0) select id from a except select id from b")
def keys_except_some(spark, sf):
    some = adapters.holds(spark, sf).where(F.col("hold_id").cast("long") % 50 == 0)
    return adapters.patrons(spark, sf).select(F.col("cardnumber").alias("id")).subtract(some.select("patron_barcode"))


@register("marcxml_whole", "select k as record_index, '<datafield tag=\"650\" ind1=\" \" ind2=\" \"><subfield code=\"a\">' || replace(p_brand, '#', '&amp;&lt;') || '</subfield></datafield><datafield tag=\"650\" ind1=\" \" ind2=\" \"><subfield code=\"a\">' || p_type || '</subfield></datafield></record>' as tail from bib")
def marcxml_whole(spark, sf):
    some = bibs(spark, sf).withColumn("fields", F.transform(F.filter("fields", lambda f: f["tag"] == "650"), lambda f: f.withField("subfields", F.transform(f["subfields"], lambda s: s.withField("value", F.replace(s["value"], F.lit("#"), F.lit("&<")))))))
    return formats.marcxml(some).select("record_index", F.regexp_replace("xml", "^.*</leader>", "").alias("tail"))


@register("delete_subfield", "select k as record_index, '245' as tag, 'b' as code, p_type as value from bib where f245a is not null")
def delete_subfield(spark, sf):
    return _values(edits.delete_field("245", "a")(bibs(spark, sf)), "245")
