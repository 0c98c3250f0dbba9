"""A plugin for the queries and tests: conversions and checks that fail on some input."""

from __future__ import annotations

MANIFEST = {
    "manifest_version": 1,
    "slug": "sample-plugin",
    "name": "Sample",
    "version": "1.0",
    "runtime": "python",
    "entry": "bibloom.plans.sample_plugin:setup",
    "permissions": ["files:read"],
    "extension_points": [
        {"type": "transform", "key": "shout", "label": "Capitals, with an end"},
        {"type": "quality_check", "key": "untitled", "label": "No title"},
        {"type": "quality_check", "key": "status", "label": "Status of the record"},
    ],
}


def shout(value: str, config: dict) -> str | None:
    if "green" in value:
        raise ValueError(value)
    return None if value.startswith("a") else value.upper() + config["end"]


def _tags(raw: bytes) -> list[bytes]:
    return [raw[k : k + 3] for k in range(24, int(raw[12:17]) - 1, 12)]


def untitled(raw: bytes, config: dict) -> list[dict]:
    """Records without a title; no answer but an error for those of one status."""
    if raw[5:6] == b"x":
        raise RuntimeError("unknown status")
    return [] if b"245" in _tags(raw) else [{"severity": "error", "tag": 245}]


def status(raw: bytes, config: dict) -> list:
    if raw[5:6] != b"d":
        return None  # type: ignore[return-value]
    return [{"tag": "LDR", "subfield": 5, "description": "deleted", "original_value": "d", "suggested_fix": "c"}, "no issue"]


def setup(context) -> None:
    context.register_transform("shout", shout)
    context.register_quality_check("untitled", untitled)
    context.register_quality_check("status", status)
