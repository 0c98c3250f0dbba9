"""Queries over replies of a language model, which are made of the test tables."""

from __future__ import annotations

from bibloom.operators import suggestions
from bibloom.plans.adapters import table
from bibloom.plans.catalog import register

#: Replies by record, in SQL that Spark and DuckDB both read: arrays and objects, fenced or not, with
#: wrong types, broken ones, empty ones and none.
_REPLIES = """
case p_partkey % 9
  when 0 then '```json' || chr(10) || '[{"source_value": "' || p_type || '", "koha_value": "K' || cast(p_partkey as varchar(20)) || '", "confidence": 0.' || cast(p_partkey % 10 as varchar(20)) || '5, "reasoning": "by name"}]' || chr(10) || '```'
  when 1 then '[{"source_value": "' || p_type || '", "koha_value": null, "confidence": 1.5}, {"source_value": "", "koha_value": "x"}]'
  when 2 then '```' || chr(10) || '[{"source_value": "' || p_brand || '", "koha_value": "B", "confidence": "0.75", "reasoning": 42}]' || chr(10) || '``` as asked'
  when 3 then '{"source_value": "' || p_type || '"}'
  when 4 then '["text", 42, {"source_value": "a", "koha_value": 42}, {"koha_value": "x"}, {"source_value": 7}, {"source_value": "' || p_name || '", "koha_value": "y", "confidence": -0.2}]'
  when 5 then 'not json {{'
  when 6 then '  '
  when 7 then '[{"source_value": "' || p_type || '", "koha_value": "", "confidence": "high", "reasoning": null}, {"source_value": "' || p_brand || '"'  || case when p_partkey % 2 = 0 then '}]' else '' end
  end
"""


def _made(spark, sf, reply):
    return table(spark, sf, "part").selectExpr("p_partkey as k", reply.replace("varchar(20)", "string") + " as reply")


#: The entries of arrays, each a JSON value j with its place i.
_ENTRIES = (
    "u as (select k, trim(case when starts_with(trim(reply), '```') then regexp_replace(string_split(trim(reply), '```')[2], '^json', '') else reply end, ' ' || chr(10)) as t from r), "
    "v as (select k, case when t <> '' and json_valid(t) then t::json end as doc from u), "
    "e as (select k, i as position, json_extract(doc, '$[' || i || ']') as j from (select k, doc, unnest(range(json_array_length(doc)::bigint)) as i from v where json_type(doc) = 'ARRAY')) "
)


@register(
    "value_suggestions",
    f"with r as (select p_partkey as k, {_REPLIES} as reply from part), {_ENTRIES}, c as (select *, case json_type(j, '$.confidence') when 'VARCHAR' then coalesce(try_cast(json_extract_string(j, '$.confidence') as double), 0) else coalesce(json_extract(j, '$.confidence')::double, 0) end as told from e) "
    "select k as record_index, cast(position as int) as position, json_extract_string(j, '$.source_value') as source_value, nullif(json_extract_string(j, '$.koha_value'), '') as target_value, least(greatest(told, 0), 1) as confidence, json_extract_string(j, '$.reasoning') as reasoning from c "
    "where json_type(j) = 'OBJECT' and json_type(j, '$.source_value') = 'VARCHAR' and json_extract_string(j, '$.source_value') <> '' and coalesce(json_type(j, '$.koha_value'), 'NULL') in ('NULL', 'VARCHAR')",
)
def value_suggestions(spark, sf):
    made = _made(spark, sf, _REPLIES)
    return suggestions.value_suggestions(made).withColumnRenamed("k", "record_index")


_MAP_REPLIES = """
case p_partkey % 5
  when 0 then '[{"source_tag": "' || cast(900 + p_partkey % 100 as varchar(20)) || '", "source_sub": "a", "target_tag": "952", "target_sub": "p", "confidence": 0.' || cast(p_partkey % 10 as varchar(20)) || ', "delete_source": true}, {"source_tag": "' || cast(p_partkey as varchar(20)) || '", "target_tag": "245"}]'
  when 1 then '[{"source_tag": ' || cast(900 + p_partkey % 100 as varchar(20)) || ', "target_tag": "952"}, {"target_tag": "952"}, [], {"source_tag": "99x", "target_tag": "952"}]'
  when 2 then '```json [{"source_tag": "001", "target_tag": "035", "target_sub": "' || lower(substr(p_brand, 1, 1)) || '", "transform_type": "preset", "preset_key": "case_lower", "reasoning": "' || p_type || '", "confidence": 3}] ```'
  when 3 then '{"source_tag": "001", "target_tag": "035"}'
  else 'I would rather not' end
"""


@register(
    "map_suggestions",
    f"with r as (select p_partkey as k, {_MAP_REPLIES} as reply from part), {_ENTRIES} select k as record_index, cast(position as int) as position, j->>'$.source_tag' as source_tag, j->>'$.source_sub' as source_sub, j->>'$.target_tag' as target_tag, j->>'$.target_sub' as target_sub, "
    "coalesce(j->>'$.transform_type', 'copy') as transform_type, j->>'$.transform_fn' as transform_fn, j->>'$.preset_key' as preset_key, coalesce((j->'$.delete_source')::boolean, false) as delete_source, "
    "least(greatest(coalesce((j->'$.confidence')::double, 0.5), 0), 1) as confidence, j->>'$.reasoning' as reasoning from e where json_type(j) = 'OBJECT' and json_type(j, '$.source_tag') = 'VARCHAR' and json_type(j, '$.target_tag') = 'VARCHAR' "
    "and regexp_full_match(j->>'$.source_tag', '[0-9]{3}') and regexp_full_match(j->>'$.target_tag', '[0-9]{3}')",
)
def map_suggestions(spark, sf):
    made = _made(spark, sf, _MAP_REPLIES)
    return suggestions.map_suggestions(made).withColumnRenamed("k", "record_index")


_COLUMN_REPLIES = """
case p_partkey % 4
  when 0 then '```json' || chr(10) || '{"bib_key_column": "bib' || cast(p_size as varchar(20)) || '", "bib_match_tag": "001", "mappings": [{"source_column": " ' || p_brand || ' ", "target_subfield": "p", "confidence": 0.25}, {"source_column": "' || p_type || '", "target_subfield": null, "reasoning": "unused"}, {"target_subfield": "x"}, 3]}' || chr(10) || '```'
  when 1 then '[{"source_column": "a", "target_subfield": "p"}]'
  when 2 then '{"mappings": "none"}'
  else '{"mappings": [{"source_column": "a"}' end
"""


@register(
    "column_suggestions",
    f"with r as (select p_partkey as k, {_COLUMN_REPLIES} as reply from part), {_ENTRIES}, o as (select k, doc from v where json_type(doc) = 'OBJECT' and json_type(doc, '$.mappings') = 'ARRAY'), "
    "m as (select k, doc, i, json_extract(doc, '$.mappings[' || i || ']') as j from (select k, doc, unnest(range(json_array_length(doc, '$.mappings')::bigint)) as i from o)) "
    "select k as record_index, cast(i as int) as position, trim(j->>'$.source_column') as source_column, j->>'$.target_subfield' as target_subfield, j->>'$.target_subfield' is null as ignored, coalesce(j->>'$.transform_type', 'copy') as transform_type, "
    "coalesce((j->'$.confidence')::double, 0.5) as confidence, j->>'$.reasoning' as reasoning, doc->>'$.bib_key_column' as key_column, doc->>'$.bib_match_tag' as match_tag from m where json_type(j) = 'OBJECT' and trim(j->>'$.source_column') <> ''",
)
def column_suggestions(spark, sf):
    made = _made(spark, sf, _COLUMN_REPLIES)
    return suggestions.column_suggestions(made).withColumnRenamed("k", "record_index")


_HEALTH_REPLIES = """
case p_partkey % 4
  when 0 then 'The report: {"findings": [{"severity": "info", "title": "' || p_name || '", "record_count_estimate": ' || cast(p_size as varchar(20)) || '}, {"severity": "warning", "category": "dates", "detail": "' || p_type || '"}, {"severity": "action_required", "tag_hint": "008"}, 7]} That is all.'
  when 1 then '{"findings": []}'
  when 2 then '```json {"findings": [{}]} ```'
  else 'nothing found' end
"""


@register(
    "health_findings",
    f"with r as (select p_partkey as k, {_HEALTH_REPLIES} as reply from part), o as (select k, regexp_extract(reply, '(?s)\\{{.*\\}}') as t from r), v as (select k, case when t <> '' and json_valid(t) then t::json end as doc from o), "
    "m as (select k, i, json_extract(doc, '$.findings[' || i || ']') as j from (select k, doc, unnest(range(json_array_length(doc, '$.findings')::bigint)) as i from v)) "
    "select k as record_index, cast(row_number() over (partition by k order by case j->>'$.severity' when 'action_required' then 0 when 'warning' then 1 else 2 end, i) as int) as rank, coalesce(j->>'$.severity', 'info') as severity, coalesce(j->>'$.category', 'other') as category, "
    "coalesce(j->>'$.title', '(untitled)') as title, coalesce(j->>'$.detail', '') as detail, (j->'$.record_count_estimate')::bigint as record_count_estimate, j->>'$.tag_hint' as tag_hint from m where json_type(j) = 'OBJECT'",
)
def health_findings(spark, sf):
    made = _made(spark, sf, _HEALTH_REPLIES)
    return suggestions.findings(made).withColumnRenamed("k", "record_index")
