from cadenza import catalog
from cadenza.plans.corpus import Corpus


def corpus(spark, payload, extent=None, conf=None, /, **values):
    """One annotation, values by field as in the format."""
    cols, types = {}, {}
    for facet, tag in (("payload", payload), ("extent", extent), ("confidence", conf)):
        for n, f in catalog.lists(facet, tag).items():
            if n in values:
                cols[catalog.column(facet, n)] = [tuple(x) if f.kind == "fraction" else x for x in values.pop(n)]
                types[catalog.column(facet, n)] = f.type.simpleString()
    assert not values
    rows = [("a", i, *r) for i, r in enumerate(zip(*cols.values()))]
    schema = "annotation string, obs_index long, " + ", ".join(f"{n} {t}" for n, t in types.items())
    headers = spark.createDataFrame([("a", "track:1", "1.0", None, None, None, None)], "annotation string, media_id string, version string, id string, parents array<string>, metadata string, sandbox string")
    return Corpus(headers, spark.createDataFrame(rows, schema), payload, extent, conf)


def got(c, *names):
    """Columns in the order of observations."""
    rows = c.observations.orderBy("obs_index").collect()
    out = [[r[n] for r in rows] for n in names]
    return out if len(names) > 1 else out[0]
