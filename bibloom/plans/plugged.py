"""Queries through a plugin."""

from __future__ import annotations

from pyspark.sql import functions as F

from bibloom.functions import extract
from bibloom.operators import plugins
from bibloom.plans.adapters import bibs
from bibloom.plans.catalog import register
from bibloom.plans.sample_plugin import MANIFEST


@register("plugin_transform", "select k as record_index, case when f245a like '%green%' or f245a like 'a%' then f245a else upper(f245a) || '!' end as title from bib")
def plugin_transform(spark, sf):
    """A conversion that fails for some titles and gives none for others."""
    shout = plugins.transform(plugins.Manifest.parse(MANIFEST), "shout", {"end": "!"})
    return bibs(spark, sf).select("record_index", shout(F.nullif(extract.joined("245$a"), F.lit(""))).alias("title"))


@register(
    "plugin_checks",
    "select 'part' as file_id, k as record_index, 'plugin:sample-plugin' as category, 'error' as severity, '245' as tag, cast(null as varchar) as subfield, 'No title' as description, cast(null as varchar) as original_value, cast(null as varchar) as suggested_fix from bib "
    "where f245a is null and substr(leader, 6, 1) <> 'x' union all select 'part', k, 'plugin:sample-plugin', 'warning', 'LDR', '5', 'deleted', 'd', 'c' from bib where substr(leader, 6, 1) = 'd'",
)
def plugin_checks(spark, sf):
    """Two checks, one of which fails for some records."""
    return plugins.scan(bibs(spark, sf), [plugins.Manifest.parse(MANIFEST)])
