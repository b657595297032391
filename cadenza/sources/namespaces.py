"""Schemas of payloads: from a foreign namespace's definition, and from the type catalog."""

from __future__ import annotations

import json
from pathlib import Path

from cadenza import catalog
from cadenza.errors import BadFormat

DIALECT = "https://json-schema.org/draft/2020-12/schema"


def payload_schema(tag: str, title: str, lists: dict[str, dict], needed: list[str]) -> dict:
    return {"$schema": DIALECT, "$id": f"payload/{tag}.json", "title": title, "type": "object", "properties": {"payload_type": {"const": tag}, **lists}, "required": ["payload_type", *needed]}


def from_namespace(definition: dict) -> dict:
    """The payload schema of a definition {name: {"value": constraints, "description": ...}}.

    The list is called `values`, as such translations have it; the catalog's own
    payloads say `value`.
    """
    if not definition:
        raise BadFormat("an empty namespace definition")
    name, own = next(iter(definition.items()))
    title = f"{name.title()} Payload"
    return payload_schema(name, title, {"values": {"type": "array", "description": own.get("description", title), "items": own.get("value", {})}}, ["values"])


def translate(source: str, target: str) -> None:
    """`from_namespace` from file to file."""
    Path(target).write_text(json.dumps(from_namespace(json.loads(Path(source).read_text())), indent=2))


def schema_of(tag: str) -> dict:
    """The JSON schema of a payload of the catalog."""
    kinds = {"float": {"type": "number"}, "int": {"type": "integer"}, "str": {"type": "string"}, "dict": {"type": "object"}, "any": {}, "fraction": {"type": "array", "items": {"type": "integer"}, "minItems": 2, "maxItems": 2}}

    def one(f: catalog.Field) -> dict:
        limits = {"minimum": f.least, "maximum": f.most, "pattern": f.pattern, "enum": list(f.one_of) if f.one_of else None}
        return kinds[f.kind] | {k: v for k, v in limits.items() if v is not None}

    fields = catalog.fields("payload", tag)
    return payload_schema(tag, f"{tag} payload", {n: one(f) if f.scalar else {"type": "array", "items": one(f)} for n, f in fields.items()}, [n for n, f in fields.items() if not f.optional])


def from_schema(schema: dict) -> tuple[str, dict[str, catalog.Field]]:
    """A payload's tag and fields from its JSON schema: the reverse of `schema_of`.

    A field is a list if its type is array, but for pairs of integers, which are
    fractions; without a type it is free-form.
    """
    kinds = {"number": "float", "integer": "int", "string": "str", "object": "dict", None: "any"}
    pair = lambda x: x.get("type") == "array" and x.get("minItems") == x.get("maxItems") == 2
    properties = schema.get("properties", {})
    tag = properties.get("payload_type", {}).get("const")
    if not tag:
        raise BadFormat("a payload's schema names its tag")
    out = {}
    for name, own in properties.items():
        if name == "payload_type":
            continue
        scalar = own.get("type") != "array" or pair(own)
        one = own if scalar else own.get("items", {})
        if not pair(one) and one.get("type") not in kinds:
            raise BadFormat(f"{name}: type {one.get('type')!r} is not in the format")
        kind = "fraction" if pair(one) else kinds[one.get("type")]
        out[name] = catalog.Field(kind, one.get("minimum"), one.get("maximum"), one.get("pattern"), tuple(one["enum"]) if "enum" in one else None, scalar, name not in schema.get("required", ()))
    return tag, out
