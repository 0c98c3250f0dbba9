"""Manifests, and plugins that misbehave."""

import json

import pytest
from pyspark.sql import functions as F

from bibloom.model import BIB_SCHEMA
from bibloom.operators import plugins
from bibloom.plans.sample_plugin import MANIFEST

SHIPPED = '''
calls = []

def setup(context):
    calls.append(1)
    context.register_transform("count", lambda value, config: f"{value}{len(calls)}")
    context.register_transform("number", lambda value, config: int(value) + config.get("add", 0))
    context.register_quality_check("size", lambda raw, config: [{"description": str(len(raw)), "severity": ""}, {}])
    context.register_quality_check("broken", lambda raw, config: [{"tag": "1"}, {"tag": 1 / 0}])
'''
POINTS = [{"type": t, "key": k, "label": k.title()} for t, k in (("transform", "count"), ("transform", "number"), ("quality_check", "size"), ("quality_check", "broken"))]


def made(**changes):
    return {k: v for k, v in {**MANIFEST, **changes}.items() if v is not ...}


@pytest.mark.parametrize(
    "changes, words",
    [
        ({"manifest_version": 2}, "manifest_version 2"),
        ({"manifest_version": True}, "no int"),
        ({"slug": "ab"}, "slug"),
        ({"slug": "Upper-case"}, "slug"),
        ({"slug": "-abc"}, "slug"),
        ({"slug": "abc-"}, "slug"),
        ({"slug": "a" * 65}, "slug"),
        ({"slug": "abc\n"}, "slug"),
        ({"name": ...}, "name is missing"),
        ({"version": "  "}, "version"),
        ({"version": "1" * 51}, "version"),
        ({"runtime": "ruby"}, "unknown runtime"),
        ({"entry": "module"}, "module:function"),
        ({"entry": "http://x:y"}, "module:function"),
        ({"args": ["{input_path}"]}, "subprocess"),
        ({"runtime": "subprocess", "entry": "/bin/x"}, "absolute"),
        ({"runtime": "subprocess", "entry": "run", "args": ["{input_path}", "--{input}"]}, "['{input}']"),
        ({"timeout_sec": 0}, "timeout"),
        ({"timeout_sec": 3601}, "timeout"),
        ({"permissions": ["files:read", "all"]}, "'all'"),
        ({"colour": "red"}, "unknown key 'colour'"),
        ({"extension_points": [{"type": "other", "key": "a", "label": "A"}]}, "unknown extension point"),
        ({"extension_points": [{"type": "transform", "key": "", "label": "A"}]}, "1 to 100"),
        ({"extension_points": [{"type": "transform", "key": "a", "label": "A", "size": 1}]}, "unknown key 'size'"),
        ({"extension_points": POINTS[:1] * 2}, "twice"),
        ({"extension_points": ["x"]}, "mapping"),
        ({"runtime": "subprocess", "entry": "run", "extension_points": [{"type": "ui_tab", "key": "a", "label": "A"}]}, "needs the runtime python"),
    ],
)
def test_unsound_manifests(changes, words):
    with pytest.raises(plugins.ManifestError, match=r".") as e:
        plugins.Manifest.parse(made(**changes))
    assert words in str(e.value)


def test_sound_manifests():
    m = plugins.Manifest.parse(json.dumps(made(version=" 2 ", timeout_sec=3600, author=None)))
    assert (m.slug, m.version, m.timeout_sec, [p.key for p in m.extension_points]) == ("sample-plugin", "2", 3600, ["shout", "untitled", "status"])
    sub = plugins.Manifest.parse(made(runtime="subprocess", entry="bin/run", args=["{input_path}", "{output_path}", "x{config_json}"], extension_points=[{"type": "celery_task", "key": "a", "label": "A", "metadata": {"q": 1}}]))
    assert sub.extension_points[0].metadata == {"q": 1} and sub.args[2] == "x{config_json}"
    same = [{"type": t, "key": "a", "label": "A"} for t in ("transform", "quality_check")]
    assert len(plugins.Manifest.parse(made(extension_points=same)).extension_points) == 2
    for text in ("", "[1]", "{", "slug: a"):
        with pytest.raises(plugins.ManifestError):
            plugins.Manifest.parse(text)
    good, bad = plugins.accepted([MANIFEST, made(slug="other-one"), made(name="Again"), "{"])
    assert [m.slug for m in good] == ["sample-plugin", "other-one"] and sorted(bad) == [2, 3] and "taken" in bad[2][0]


@pytest.fixture(scope="module")
def shipped(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("plugin") / "shipped_plugin.py"
    path.write_text(SHIPPED)
    plugins.ship(spark, str(path))
    return plugins.Manifest.parse(made(slug="shipped", entry="shipped_plugin:setup", extension_points=POINTS))


def test_conversions(spark, shipped):
    rows = spark.createDataFrame([("1",), ("x",), (None,), ("",), ("é",)], "v string").repartition(3)
    number = plugins.transform(shipped, "number", {"add": 5})
    assert {(r["v"], r["n"]) for r in rows.select("v", number("v").alias("n")).collect()} == {("1", "6"), ("x", "x"), (None, None), ("", ""), ("é", "é")}
    many = spark.range(0, 50_000, 1, 4).select(plugins.transform(shipped, "count")(F.lit("a")).alias("v"))
    assert {r["v"] for r in many.distinct().collect()} == {"a1"}  # setup once for each worker
    with pytest.raises(Exception, match="KeyError"):
        rows.select(plugins.transform(shipped, "other")("v")).collect()


def test_checks(spark, shipped):
    leader = "00000nam a2200000 a 4500"
    rows = [("f", 1, leader, [("001", None, None, "x1", None)]), ("f", 2, leader, []), ("f", 3, leader, [("001", None, None, "y" * 20_000, None)])]
    bibs = spark.createDataFrame(rows, BIB_SCHEMA)
    found = {tuple(r) for r in plugins.scan(bibs, [shipped]).collect()}
    issue = lambda k, text: ("f", k, "plugin:shipped", "warning", None, None, text, None, None)
    assert found == {issue(1, str(24 + 12 + 1 + 3 + 1)), issue(1, "Size"), issue(2, "26"), issue(2, "Size")}
    assert plugins.scan(bibs, []).count() == 0 and plugins.scan(bibs.limit(0), [shipped]).count() == 0
    both = plugins.scan(bibs, [shipped, plugins.Manifest.parse(MANIFEST)])
    assert both.groupBy("category").count().where("category = 'plugin:sample-plugin'").first()["count"] == 2
