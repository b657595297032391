"""The versioned type catalog: every tag, its fields, their Spark types and constraints.

A field is a list unless it is scalar; `lists` of an annotation run in parallel.
Free-form values are kept as JSON text, so that 1 and 1.0 stay different.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

from cadenza.errors import UnknownType

FACETS = ("payload", "extent", "confidence")
#: Names in the format, and the namespace of identifiers.
VERSION_FIELD = "bopp_version"
NAMESPACE = "a9b3e1c0-42f8-4e89-8d62-b9123456789a"
DEFAULT_VERSION = "1.0"
VERSION_LOOSE = r"^1(?:\.\d+)*$"

#: Patterns of the format.
MEDIA_ID = r"^[a-zA-Z0-9]+:.*$"
VERSION = r"^1\.\d+$"
ID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-5[0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"
CHORD = r"^((N|X)|(([A-G](b*|#*))((:(maj|min|dim|aug|1|5|sus2|sus4|maj6|min6|7|maj7|min7|dim7|hdim7|minmaj7|aug7|9|maj9|min9|11|maj11|min11|13|maj13|min13)(\(\*?((b*|#*)([1-9]|1[0-3]?))(,\*?((b*|#*)([1-9]|1[0-3]?)))*\))?)|(:\(\*?((b*|#*)([1-9]|1[0-3]?))(,\*?((b*|#*)([1-9]|1[0-3]?)))*\)))?((/((b*|#*)([1-9]|1[0-3]?)))?)?))$"
KEY_MODE = "^N|([A-G][b#]?)(:(major|minor|ionian|dorian|phrygian|lydian|mixolydian|aeolian|locrian))?$"
RELATIONS = ("cover", "quote", "medley_part", "sample", "interpolation", "remix", "live_performance")

FRACTION = T.StructType([T.StructField("num", T.LongType()), T.StructField("den", T.LongType())])
KINDS = {"float": T.DoubleType(), "int": T.LongType(), "str": T.StringType(), "any": T.StringType(), "dict": T.StringType(), "fraction": FRACTION}


@dataclass(frozen=True)
class Field:
    """kind: float, int, str, any, dict or fraction; least and most are inclusive."""

    kind: str
    least: float | None = None
    most: float | None = None
    pattern: str | None = None
    one_of: tuple[str, ...] | None = None
    scalar: bool = False
    optional: bool = False
    axis: str | None = None  # of an extent: the axis that the field lies on
    role: str | None = None  # on its axis: at, length, low or high

    @property
    def type(self) -> T.DataType:
        return KINDS[self.kind]

    @property
    def json(self) -> bool:
        """Whether Spark holds the value as JSON text."""
        return self.kind in ("any", "dict")


_f, _pos = Field("float"), Field("float", 0)


def _on(axis: str, role: str, kind: str = "float", least: float | None = None) -> Field:
    return Field(kind, least, axis=axis, role=role)


#: Tags, their fields and constraints, as the format has them.
CATALOG: dict[str, dict[str, dict[str, Field]]] = {
    "extent": {
        "time": {"time": _on("time", "at")},
        "time_interval": {"time": _on("time", "at"), "duration": _on("time", "length", least=0)},
        "time_frequency_box": {"time": _on("time", "at", least=0), "duration": _on("time", "length", least=0), "freq_min": _on("frequency", "low", least=0), "freq_max": _on("frequency", "high", least=0)},
        "pixel_box": {"x": _on("x", "at"), "y": _on("y", "at"), "width": _on("x", "length", least=0), "height": _on("y", "length", least=0)},
        "score_quarter": {"quarter": _on("quarter", "at", "fraction")},
        "score_interval": {"quarter": _on("quarter", "at", "fraction"), "duration": _on("quarter", "length", "fraction", 0)},
        "midi_tick": {"tick": _on("tick", "at")},
        "midi_interval": {"tick": _on("tick", "at"), "duration": _on("tick", "length", least=0)},
    },
    "payload": {
        "beat": {"value": Field("int", 1)},
        "chord": {"value": Field("str", pattern=CHORD)},
        "ext": {"ext_schema": Field("str", scalar=True), "value": Field("any")},
        "key_mode": {"value": Field("str", pattern=KEY_MODE)},
        "lyrics": {"value": Field("str")},
        "mood_thayer": {"valence": _f, "arousal": _f},
        "multi_segment": {"label": Field("str"), "level": Field("int", 0)},
        "note_hz": {"value": _pos},
        "note_midi": {"value": _f},
        "object": {"value": Field("dict")},
        "onset": {"value": Field("any")},
        "pitch_contour": {"value": Field("dict")},
        "relation": {"performance_id": Field("str", scalar=True), "value": Field("str"), "relation": Field("str", one_of=RELATIONS, optional=True)},
        "segment_open": {"value": Field("str")},
        "tag_open": {"value": Field("str")},
        "tempo": {"value": _pos},
    },
    "confidence": {
        "agreement": {"confidence": Field("float", 0, 1), "n_annotators_common": Field("int", 1, scalar=True, optional=True), "n_annotators": Field("int", 1, optional=True)},
        "likelihood": {"confidence": Field("float", 0, 1)},
        "variance": {"confidence": _pos},
    },
}

_s = Field("str", scalar=True)
#: Kinds of metadata and their fields.
METADATA: dict[str, dict[str, Field]] = {
    "algorithm": {"algorithm_id": _s, "version": _s, "parameters": Field("dict", scalar=True)},
    "crowd": {"platform": _s, "num_annotators": Field("int", 1, scalar=True), "consensus": _s},
    "derived": {"transform": _s, "parameters": Field("dict", scalar=True, optional=True), "software": Field("str", scalar=True, optional=True), "description": Field("str", scalar=True, optional=True)},
    "human": {"annotator_id": _s, "tool": _s},
    "other": {"notes": _s},
    "sensor": {"device": _s, "settings": Field("dict", scalar=True)},
}


def registry_version(version: str | None = None) -> str:
    """'v1' for any version of the first series."""
    if re.match(VERSION_LOOSE, version or DEFAULT_VERSION):
        return "v1"
    raise UnknownType(f"Unsupported schema version: {version!r}")


def current_version() -> str:
    return DEFAULT_VERSION


def fields(facet: str, tag: str) -> dict[str, Field]:
    try:
        return CATALOG[facet][tag]
    except KeyError:
        raise UnknownType(f"Unknown {facet} type: {tag!r}") from None


def lists(facet: str, tag: str | None) -> dict[str, Field]:
    """The list fields of a tag; none for no tag."""
    return {n: f for n, f in fields(facet, tag).items() if not f.scalar} if tag else {}


def scalars(facet: str, tag: str | None) -> dict[str, Field]:
    return {n: f for n, f in fields(facet, tag).items() if f.scalar} if tag else {}


def registry(version: str | None = None) -> dict:
    """Tags by facet and the fields that hold structured values."""
    registry_version(version)
    return {**CATALOG, "complex": {(facet, tag): [n for n, f in fs.items() if f.kind in ("any", "dict", "fraction")] for facet, tags in CATALOG.items() for tag, fs in tags.items()}}


def axes(extent: str) -> dict[str, dict[str, str]]:
    """The axes of an extent: the field of each role on them."""
    out: dict[str, dict[str, str]] = {}
    for name, f in fields("extent", extent).items():
        if f.axis:
            out.setdefault(f.axis, {})[f.role] = name
    return out


def main_axis(extent: str) -> str | None:
    """The time axis, or the only one; None where neither is."""
    own = axes(extent)
    return "time" if "time" in own else next(iter(own)) if len(own) == 1 else None


def struct_type(facet: str, tag: str) -> T.StructType:
    """A tag's struct of arrays (and scalars)."""
    return T.StructType([T.StructField(n, f.type if f.scalar else T.ArrayType(f.type)) for n, f in fields(facet, tag).items()])


def column(facet: str, field: str) -> str:
    """The name of a field's column in the long layout."""
    return f"{facet}_{field}"
