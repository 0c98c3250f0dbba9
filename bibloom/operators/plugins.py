"""Plugins: manifests, conversions of values and checks of records that come from other modules.

A plugin is a module with a setup function, which is called once in each Python worker with a
context and registers callables there: conversions ``(value, config) -> value`` and checks
``(record bytes, config) -> issues``. What a plugin does wrong costs its own results only: a
conversion that fails or returns None leaves the value, a check that fails reports nothing for that
record.
"""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bibloom.sources import iso2709

# Fixed values of manifests.
VERSIONS = (1,)
RUNTIMES = ("python", "subprocess")
EXTENSIONS = ("transform", "quality_check", "celery_task", "api_endpoint", "db_store", "ui_tab")
#: Kinds of extensions that only a Python plugin can have.
PYTHON_ONLY = ("api_endpoint", "db_store", "ui_tab")
PERMISSIONS = ("files:read", "files:write", "project:read")
PLACEHOLDERS = ("{input_path}", "{output_path}", "{config_json}")
SLUG = re.compile(r"[a-z0-9][a-z0-9-]{1,62}[a-z0-9]")
TIMEOUT = (1, 3600)

_REQUIRED = {"manifest_version": int, "slug": str, "name": str, "version": str, "runtime": str, "entry": str}
_OPTIONAL = {"author": str, "description": str, "args": list, "timeout_sec": int, "permissions": list, "extension_points": list}
_POINT = {"type": str, "key": str, "label": str, "description": str, "handler": str, "metadata": dict}


class ManifestError(ValueError):
    """A manifest that isn't sound, with all that is wrong about it."""

    def __init__(self, problems: Sequence[str]):
        super().__init__("; ".join(problems))
        self.problems = tuple(problems)


@dataclass(frozen=True)
class Point:
    """What a plugin offers: a kind, a key, a label."""

    type: str
    key: str
    label: str
    description: str | None = None
    handler: str | None = None
    metadata: Mapping[str, Any] = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Manifest:
    slug: str
    name: str
    version: str
    runtime: str
    entry: str
    manifest_version: int = 1
    author: str | None = None
    description: str | None = None
    args: tuple[str, ...] = ()
    timeout_sec: int = 300
    permissions: tuple[str, ...] = ()
    extension_points: tuple[Point, ...] = ()

    @classmethod
    def parse(cls, content: str | bytes | Mapping[str, Any]) -> Manifest:
        """A manifest from JSON text or a mapping; raises ManifestError with every problem."""
        if not isinstance(content, Mapping):
            try:
                content = json.loads(content)
            except ValueError as e:
                raise ManifestError([f"no JSON: {e}"]) from e
            if not isinstance(content, Mapping):
                raise ManifestError(["a manifest is a mapping"])
        found = problems(content)
        if found:
            raise ManifestError(found)
        values = {k: v for k, v in content.items() if v is not None}
        points = tuple(Point(**p) for p in values.pop("extension_points", ()))
        lists = {k: tuple(values.pop(k, ())) for k in ("args", "permissions")}
        return cls(**{**values, "version": values["version"].strip()}, **lists, extension_points=points)


def _shape(content: Mapping[str, Any], required: Mapping[str, type], optional: Mapping[str, type], what: str) -> list[str]:
    known = {**required, **optional}
    out = [f"{what}: unknown key {k!r}" for k in content if k not in known]
    out += [f"{what}: {k} is missing" for k in required if content.get(k) is None]
    wrong = [k for k, v in content.items() if k in known and v is not None and (not isinstance(v, known[k]) or isinstance(v, bool))]
    return out + [f"{what}: {k} is no {known[k].__name__}" for k in wrong]


def problems(content: Mapping[str, Any]) -> list[str]:
    """All that is wrong about a manifest, in words; nothing for a sound one."""
    out = _shape(content, _REQUIRED, _OPTIONAL, "manifest")
    if out:
        return out
    if content["manifest_version"] not in VERSIONS:
        out.append(f"manifest_version {content['manifest_version']} isn't among {VERSIONS}")
    if not SLUG.fullmatch(content["slug"]):
        out.append(f"slug {content['slug']!r}: 3 to 64 small letters, digits and hyphens, no hyphen at the ends")
    if not content["version"].strip() or len(content["version"]) > 50:
        out.append("version: 1 to 50 characters")
    if not TIMEOUT[0] <= content.get("timeout_sec", TIMEOUT[0]) <= TIMEOUT[1]:
        out.append(f"timeout_sec: {TIMEOUT[0]} to {TIMEOUT[1]}")
    out += [f"unknown permission {p!r}" for p in content.get("permissions") or () if p not in PERMISSIONS]
    return out + _runtime_problems(content) + _point_problems(content)


def _runtime_problems(content: Mapping[str, Any]) -> list[str]:
    runtime, entry, args = content["runtime"], content["entry"], content.get("args") or []
    if runtime not in RUNTIMES:
        return [f"unknown runtime {runtime!r}"]
    if runtime == "python":
        out = [] if re.fullmatch(r"[\w.]+:\w+", entry) else [f"entry {entry!r} is no module:function"]
        return out + (["args belong to the runtime subprocess"] if args else [])
    out = [f"entry {entry!r} is an absolute path"] if entry.startswith("/") else []
    unknown = sorted({p for a in args for p in re.findall(r"\{[^}]+\}", str(a))} - set(PLACEHOLDERS))
    return out + ([f"unknown placeholders {unknown}"] if unknown else [])


def _point_problems(content: Mapping[str, Any]) -> list[str]:
    out, seen = [], set()
    for p in content.get("extension_points") or ():
        if not isinstance(p, Mapping):
            out.append("an extension point is a mapping")
            continue
        wrong = _shape(p, {k: _POINT[k] for k in ("type", "key", "label")}, {k: _POINT[k] for k in ("description", "handler", "metadata")}, "extension point")
        if wrong:
            out += wrong
            continue
        name = f"{p['type']}:{p['key']}"
        if p["type"] not in EXTENSIONS:
            out.append(f"unknown extension point {name}")
        if not 1 <= len(p["key"]) <= 100 or not 1 <= len(p["label"]) <= 200:
            out.append(f"{name}: a key of 1 to 100 and a label of 1 to 200 characters")
        if name in seen:
            out.append(f"{name} stands twice")
        seen.add(name)
        if p["type"] in PYTHON_ONLY and content["runtime"] != "python":
            out.append(f"{name} needs the runtime python")
    return out


def accepted(contents: Sequence[str | bytes | Mapping[str, Any]]) -> tuple[list[Manifest], dict[int, tuple[str, ...]]]:
    """The sound manifests in order, and what is wrong about the others, by place; of those with one
    slug the first counts."""
    good: dict[str, Manifest] = {}
    bad: dict[int, tuple[str, ...]] = {}
    for k, content in enumerate(contents):
        try:
            m = Manifest.parse(content)
        except ManifestError as e:
            bad[k] = e.problems
            continue
        if m.slug in good:
            bad[k] = (f"slug {m.slug!r} is taken",)
        else:
            good[m.slug] = m
    return list(good.values()), bad


# ---- in the workers


class Context:
    """What a plugin's setup function gets: it registers callables under keys that its manifest has."""

    def __init__(self, manifest: Manifest):
        self.manifest = manifest
        self.transforms: dict[str, Callable[[str, dict], str | None]] = {}
        self.checks: dict[str, tuple[str, Callable[[bytes, dict], list[dict] | None]]] = {}

    def _point(self, kind: str, key: str) -> Point:
        for p in self.manifest.extension_points:
            if (p.type, p.key) == (kind, key):
                return p
        raise ValueError(f"the manifest of {self.manifest.slug} has no {kind}:{key}")

    def register_transform(self, key: str, function: Callable[[str, dict], str | None]) -> None:
        self._point("transform", key)
        self.transforms[key] = function

    def register_quality_check(self, key: str, function: Callable[[bytes, dict], list[dict] | None]) -> None:
        self.checks[key] = (self._point("quality_check", key).label, function)


_contexts: dict[Manifest, Context] = {}


def loaded(manifest: Manifest) -> Context:
    """The context of a plugin after its setup, which runs once in a process."""
    if manifest not in _contexts:
        if manifest.runtime != "python":
            raise ValueError(f"{manifest.slug} isn't a Python plugin")
        module, _, function = manifest.entry.partition(":")
        context = Context(manifest)
        getattr(importlib.import_module(module), function)(context)
        _contexts[manifest] = context
    return _contexts[manifest]


def ship(spark: SparkSession, *paths: str) -> None:
    """Make modules (.py, .zip) importable in the workers of this session."""
    spark.addArtifacts(*paths, pyfile=True)


# ---- conversions


def _converted(function: Callable[[str, dict], str | None], value: str | None, config: dict) -> str | None:
    if value is None:
        return None
    try:
        made = function(value, config)
    except Exception:  # of the plugin, whatever it is
        return value
    return value if made is None else str(made)


def transform(manifest: Manifest, key: str, config: Mapping[str, Any] | None = None) -> Callable[[Column], Column]:
    """A conversion of a plugin as a function of columns. A value stays where the conversion fails or
    returns None; null stays null. A plugin that can't be loaded, or has no such key, is an error of
    the query."""
    settings = dict(config or {})

    @F.arrow_udf("string")
    def convert(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        function = loaded(manifest).transforms[key]
        for values in batches:
            yield pa.array([_converted(function, v, settings) for v in values.to_pylist()], pa.string())

    return convert


# ---- checks

_ISSUE = "category string, severity string, tag string, subfield string, description string, original_value string, suggested_fix string"


def _issue(slug: str, label: str, issue: dict) -> tuple:
    said = lambda name: None if issue.get(name) is None else str(issue[name])
    return (f"plugin:{slug}", said("severity") or "warning", said("tag"), said("subfield"), said("description") or label, said("original_value"), said("suggested_fix"))


def _checks(manifests: Sequence[Manifest]):
    """A table function: a record's bytes to the issues of all plugins."""
    some = tuple(manifests)

    class Checks:
        def __init__(self):
            self.checks = [(m.slug, label, f) for m in some for label, f in loaded(m).checks.values()]

        def eval(self, raw: bytes):
            for slug, label, function in self.checks:
                try:
                    issues = [_issue(slug, label, i) for i in function(bytes(raw), {}) or () if isinstance(i, dict)]
                except Exception:  # of the plugin, whatever it is: this record, this check
                    continue
                yield from issues

    return F.udtf(Checks, returnType=_ISSUE, useArrow=True)


def scan(bibs: DataFrame, manifests: Sequence[Manifest]) -> DataFrame:
    """Issues that plugins find: file_id, record_index, category (``plugin:`` and the slug), severity
    (warning where none is told), tag, subfield, description (else the check's label),
    original_value, suggested_fix. Checks see the record as the bytes of an exchange file; records
    too long for one are left out."""
    if not manifests:
        return bibs.select("file_id", "record_index", *(F.lit(None).cast("string").alias(c.split(" ")[0]) for c in _ISSUE.split(", "))).limit(0)
    rows = iso2709.encode(bibs).where(~F.col("oversize"))
    rows = rows.select("file_id", "record_index", F.concat("raw", F.lit("\x1d")).cast("binary").alias("raw"))
    return rows.lateralJoin(_checks(manifests)(F.col("raw").outer())).drop("raw")
