"""Canonical JSON and content identifiers (UUID version 5)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza import catalog
from cadenza.errors import InvalidAnnotation

SPACE = uuid.UUID(catalog.NAMESPACE)


def canonical(document: dict) -> str:
    """Keys in order at every level, no blanks, non-ASCII as it is."""
    return json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def compute_id(document: dict) -> str:
    """The identifier of a document's content without its own id."""
    return str(uuid.uuid5(SPACE, canonical({k: v for k, v in document.items() if k != "id"})))


def check_id(document: dict) -> bool:
    """False without an id, an error if it isn't the content's."""
    if not document.get("id"):
        return False
    if document["id"] != compute_id(document):
        raise InvalidAnnotation(f"id {document['id']} does not match the content's {compute_id(document)}")
    return True


def ensure_id(document: dict) -> str:
    """The document's id, set if missing, checked if present."""
    if not check_id(document):
        document["id"] = compute_id(document)
    return document["id"]


validate_and_set_id = ensure_id


def prepare_for_save(document: dict, validate_id: bool = True, generate_id: bool = True) -> dict:
    """A copy under the four policies: check or set; check only; overwrite; leave alone."""
    out = dict(document)
    if validate_id and generate_id:
        ensure_id(out)
    elif validate_id:
        check_id(out)
    elif generate_id:
        out["id"] = compute_id(out)
    return out


def uuid5(text: Column) -> Column:
    """compute_id in the JVM, over a column of canonical JSON."""
    h = F.sha1(F.concat(F.unhex(F.lit(SPACE.hex)), F.encode(text, "UTF-8")))
    variant = F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1
    digit = F.substr(F.lit("89ab"), variant, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(digit, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def id_state(text: Column, id_: Column) -> Column:
    """check_id in the JVM: missing, right or wrong, from the canonical JSON without the id."""
    return F.when(id_.isNull() | (id_ == ""), "missing").when(id_ == uuid5(text), "right").otherwise("wrong")
