"""Checks of a corpus against the type catalog, as columns; nothing is gathered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza import catalog
from cadenza.errors import BadArgument, UnequalLengths
from cadenza.functions import identity
from cadenza.functions.scalar import is_id, is_media_id, is_version
from cadenza.plans.corpus import Corpus


def breaks(value: Column, field: catalog.Field) -> Column:
    """Whether a value breaks its field's constraint; a missing one does."""
    bad = [value.isNull()]
    if field.kind == "fraction":
        bad += [value["den"] < 1, value["num"].isNull(), value["den"].isNull()]
        if field.least is not None:
            bad.append(value["num"] < field.least)
    else:
        if field.least is not None:
            bad.append(value < F.lit(field.least))
        if field.most is not None:
            bad.append(value > F.lit(field.most))
        if field.pattern:
            bad.append(~value.rlike(field.pattern))
        if field.one_of:
            bad.append(~value.isin(*field.one_of))
    return F.coalesce(reduce(lambda a, b: a | b, bad), F.lit(False))


def violations(corpus: Corpus) -> DataFrame:
    """(annotation, obs_index, field) of every value that breaks the catalog; obs_index is null for headers."""
    rules = [(catalog.column(f, n), breaks(F.col(catalog.column(f, n)), x)) for f in catalog.FACETS for n, x in corpus.fields(f).items()]
    found = F.filter(F.array(*[F.when(bad, F.lit(n)) for n, bad in rules]), lambda x: x.isNotNull())
    obs = corpus.observations.select("annotation", "obs_index", F.explode(found).alias("field"))
    rules = [("media_id", ~F.coalesce(is_media_id(F.col("media_id")), F.lit(False))), ("version", ~F.coalesce(is_version(F.col("version")), F.lit(False))), ("id", F.col("id").isNotNull() & ~is_id(F.col("id")))]
    rules += [(catalog.column(f, n), breaks(F.col(catalog.column(f, n)), x) & (F.lit(not x.optional) | F.col(catalog.column(f, n)).isNotNull())) for f in catalog.FACETS for n, x in catalog.scalars(f, corpus.tag(f)).items() if catalog.column(f, n) in corpus.headers.columns]
    found = F.filter(F.array(*[F.when(bad, F.lit(n)) for n, bad in rules]), lambda x: x.isNotNull())
    head = corpus.headers.select("annotation", F.lit(None).cast("long").alias("obs_index"), F.explode(found).alias("field"))
    return obs.unionByName(head)


def unequal_lengths(nested: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a nested table whose lists differ in length."""
    sizes = F.array_distinct(F.array(*[F.size(c) for c in columns]))
    return nested.where(F.size(sizes) > 1)


def validate(corpus: Corpus) -> bool:
    """True, or an error that names the first violation."""
    from cadenza.errors import InvalidAnnotation

    bad = violations(corpus).limit(1).collect()
    if bad:
        raise InvalidAnnotation(f"annotation {bad[0]['annotation']}, observation {bad[0]['obs_index']}: {bad[0]['field']}")
    return True


def create(*, media_id: str, payload_kind: str, extent_kind: str | None = None, confidence_kind: str | None = None, parents: list[str] | None = None, version: str | None = None, sandbox: dict | None = None, generate_id: bool = True, **values) -> dict:
    """A document from field values, given to payload, extent and confidence in this order."""
    catalog.registry_version(version)
    doc: dict = {"media_id": media_id, catalog.VERSION_FIELD: version or catalog.current_version()}
    if parents is not None:
        doc["parents"] = list(parents)
    if sandbox is not None:
        doc["sandbox"] = sandbox
    sizes = {}
    for facet, tag in (("payload", payload_kind), ("extent", extent_kind), ("confidence", confidence_kind)):
        if tag is None:
            continue
        doc[facet] = {f"{facet}_type": tag}
        for name, field in catalog.fields(facet, tag).items():
            if name in values:
                doc[facet][name] = values.pop(name)
                if not field.scalar:
                    sizes[name] = len(doc[facet][name])
            elif not field.optional:
                raise BadArgument(f"{facet} {tag!r} needs {name!r}")
    if values:
        raise BadArgument(f"left-over arguments: {sorted(values)}")
    if len(set(sizes.values())) > 1:
        raise UnequalLengths(f"lists of different lengths: {sizes}")
    if generate_id:
        identity.ensure_id(doc)
    return doc
