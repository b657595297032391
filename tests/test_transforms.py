"""trim, filter_by and to_times against naive versions over generated observations."""

import itertools
import json
import random
import warnings
from fractions import Fraction

import pytest
from helpers import corpus, got
from pyspark.sql import functions as F

from cadenza import catalog
from cadenza.errors import BadArgument
from cadenza.functions import identity
from cadenza.operators import filter_by, to_times, trim

EXTENTS = sorted(catalog.CATALOG["extent"])


def generated(rng, extent, n=40):
    """Lists of quarters by field, each range's upper end not under its lower."""
    out = {}
    for name, f in catalog.lists("extent", extent).items():
        if f.kind == "fraction":
            out[name] = [(rng.randint(0, 60), rng.choice((1, 2, 3, 4))) for _ in range(n)]
        else:
            out[name] = [rng.randint(0, 120) / 4 for _ in range(n)]
    for roles in catalog.axes(extent).values():
        if "low" in roles:
            out[roles["high"]] = [a + rng.randint(0, 40) / 4 for a in out[roles["low"]]]
    return out


def exact(x):
    return Fraction(*x) if isinstance(x, tuple) else Fraction(x)


def naive_trim(values, roles, low, high, strict, reset):
    """(index, first, second) of what stays: second is a length or an upper end, None for points."""
    out = []
    for i, first in enumerate(map(exact, values[roles.get("at", roles.get("low"))])):
        if len(roles) == 1:
            end = first
        else:
            other = exact(values[roles.get("length", roles.get("high"))][i])
            end = first + other if "length" in roles else other
        if len(roles) == 1 or strict:
            if low is not None and first < low or high is not None and end > high:
                continue
        elif low is not None and end <= low or high is not None and first >= high:
            continue
        elif len(roles) > 1:
            first, end = max(first, low if low is not None else first), min(end, high if high is not None else end)
        shift = low if reset else 0
        second = None if len(roles) == 1 else end - first if "length" in roles else end - shift
        out.append((i, first - shift, second))
    return out


@pytest.mark.parametrize("extent", EXTENTS)
def test_trim(spark, extent):
    rng = random.Random(extent)
    values = generated(rng, extent)
    c = corpus(spark, "lyrics", extent, **values, value=[f"line {i}" for i in range(40)])
    for axis, roles in catalog.axes(extent).items():
        for (low, high), strict, reset in itertools.product(((7.5, 19.25), (None, 11.0), (13.0, None), (0.0, 500.0)), (False, True), (False, True)):
            if reset and low is None:
                continue
            out = trim(c, start=low, end=high, target_field=axis, strict=strict, reset=reset)
            want = naive_trim(values, roles, *(None if x is None else Fraction(x) for x in (low, high)), strict, reset)
            names = [n for n in (roles.get("at", roles.get("low")), roles.get("length", roles.get("high"))) if n]
            columns = got(out, "payload_value", *(f"extent_{n}" for n in names))
            assert columns[0] == [f"line {i}" for i, _, _ in want]
            for column, k in zip(columns[1:], (1, 2)):
                assert [exact(tuple(x) if isinstance(x, tuple) else x) for x in column] == [w[k] for w in want]
    if catalog.main_axis(extent):
        one, two = trim(c, start=9.0), trim(c, start=9.0, target_field=catalog.main_axis(extent))
        assert got(one, "payload_value") == got(two, "payload_value")
    else:
        with pytest.raises(BadArgument):
            trim(c, start=9.0)


def test_trim_what_touches_and_nan(spark):
    nan = float("nan")
    c = corpus(spark, "lyrics", "time_interval", time=[10.0, 14.0, 18.0], duration=[4.0, 4.0, 4.0], value=["before", "in", "after"])
    assert got(trim(c, start=14.0, end=18.0), "payload_value") == ["in"]
    p = corpus(spark, "lyrics", "time", time=[nan, 6.0, nan], value=["x", "y", "z"])
    assert got(trim(p, start=100.0), "payload_value") == got(trim(p, end=-100.0), "payload_value") == ["x", "z"]


def test_trim_arguments(spark):
    c = corpus(spark, "lyrics", "time", time=[2.5], value=["a"])
    for bad in ({}, {"start": 3.5, "end": 3.25}, {"end": 9, "reset": True}, {"start": 9, "target_field": "y"}):
        with pytest.raises(BadArgument):
            trim(c, **bad)
    whole = trim(corpus(spark, "lyrics", value=["a", "b"]), start=77, target_field="unknown")  # no extent: nothing to trim
    assert got(whole, "payload_value") == ["a", "b"]
    told = json.loads(whole.headers.first()["metadata"])
    assert told["transform"] == "trim" and told["parameters"]["start"] == 77 and told["parameters"]["end"] is None


LABELS = ["oak", "elm", "ash", "fir", "yew"]


def test_filters(spark):
    rng = random.Random(21)
    n = 60
    t, label, sure = [rng.randint(0, 99) / 2 for _ in range(n)], [rng.choice(LABELS) for _ in range(n)], [rng.randint(0, 20) / 20 for _ in range(n)]
    c = corpus(spark, "tag_open", "time", "likelihood", time=t, value=label, confidence=sure)
    cases = [
        (lambda v: v == "elm", {}, lambda i: label[i] == "elm"),
        (lambda x: x > 21, {"facet": "extent", "target": "time"}, lambda i: t[i] > 21),
        (lambda x: x > 21, {"facet": "extent"}, lambda i: t[i] > 21),
        (lambda x: x < 0.35, {"facet": "all", "target": "confidence"}, lambda i: sure[i] < 0.35),
        (lambda r: (r.time < 30) & (r["confidence"] > 0.5) & (r.value != "fir"), {"facet": "all"}, lambda i: t[i] < 30 and sure[i] > 0.5 and label[i] != "fir"),
    ]
    for predicate, options, keeps in cases:
        assert got(filter_by(c, predicate, **options), "obs_index") == [i for i in range(n) if keeps(i)]
    plain = filter_by(c, lambda r: r.time < 30 and r["confidence"] > 0.5, facet="all", python=True)
    assert got(plain, "obs_index") == [i for i in range(n) if t[i] < 30 and sure[i] > 0.5]
    assert got(filter_by(c, lambda v: v[1] == "l", python=True), "obs_index") == [i for i in range(n) if label[i][1] == "l"]
    for bad in ({"facet": "colour"}, {"target": "shape"}, {"target": "shape", "facet": "all"}):
        with pytest.raises(BadArgument):
            filter_by(c, lambda v: v == "", **bad)
    with pytest.raises(BadArgument):
        filter_by(c, lambda v: True)
    with pytest.raises(AttributeError):
        filter_by(c, lambda r: r.shape == 1, facet="all")
    moods = corpus(spark, "mood_thayer", valence=[x - 0.5 for x in sure], arousal=[x / 40 - 0.6 for x in t])
    assert got(filter_by(moods, lambda r: r.valence * r.arousal > 0), "obs_index") == [i for i in range(n) if (sure[i] - 0.5) * (t[i] / 40 - 0.6) > 0]
    with pytest.raises(BadArgument):
        filter_by(moods, lambda r: r.time > 0, facet="extent")


def test_lineage(spark):
    """Each transform's result names all before it, without a call between."""
    c = corpus(spark, "lyrics", "time", time=[2.0, 4.0, 6.0], value=["a", "b", "c"])
    c = c.with_(headers=c.headers.withColumn("id", F.lit("first")))
    chain = filter_by(trim(to_times(c, times=[2.0, 5.0, 7.0]), end=6.5), lambda v: v > "a")
    head = chain.headers.first()
    assert len(head["parents"]) == 3 and head["parents"][0] == "first" and head["id"] is None
    one = to_times(c, times=[2.0, 5.0, 7.0]).identified()
    two = trim(one, end=6.5).identified()
    assert head["parents"][1:] == [one.headers.first()["id"], two.headers.first()["id"]]
    doc = chain.documents().first()
    assert doc["parents"] == head["parents"] and doc["id"] == chain.identified().headers.first()["id"]
    whole = {"media_id": doc["media_id"], catalog.VERSION_FIELD: doc["version"], "parents": doc["parents"], **{k: json.loads(doc[k]) for k in ("metadata", "payload", "extent")}}
    assert identity.compute_id(whole) == doc["id"]
    short = filter_by(trim(c, end=5.0).without_lineage(), lambda v: v > "a")
    assert short.headers.first()["parents"] == ["first"]


def test_warning_without_ids(spark):
    from cadenza.plans.corpus import Corpus

    c = corpus(spark, "lyrics", "time", time=[2.0], value=["a"])
    made = Corpus.build(c.observations, "lyrics", "time")
    for transform in (lambda x: trim(x, start=0), lambda x: filter_by(x, lambda v: v == "a"), lambda x: to_times(x, times=[3.0])):
        with pytest.warns(UserWarning, match="no ids"):
            out = transform(made)
        assert out.headers.first()["parents"] is None
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            transform(c)
    with pytest.raises(BadArgument):  # the facet is checked before the warning
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            filter_by(made, lambda v: v == "a", facet="colour")


def test_gaps(spark):
    """A fill counts where nothing holds; a wrong one is an error only there."""
    c = corpus(spark, "chord", "time_interval", "likelihood", time=[4.0, 9.0], duration=[2.0, 1.0], value=["A:min", "E:7"], confidence=[0.75, 0.5])
    t = to_times(c, times=[9.5, 8, 5, 3], fill_value="N")
    assert got(t, "payload_value", "confidence_confidence") == [["E:7", "N", "A:min", "N"], [0.5, 0.0, 0.75, 0.0]]
    t = to_times(c, times=[8.0], fill_value={"value": "X", "confidence": 0.125})
    assert got(t, "payload_value", "confidence_confidence") == [["X"], [0.125]]
    for wrong in (None, 12, "H!!", {"value": "N", "confidence": 1.5}, {"value": "N", "confidence": "high"}):
        assert got(to_times(c, times=[4.0, 10.0], fill_value=wrong), "payload_value") == ["A:min", "E:7"]
        with pytest.raises(Exception, match="fill value"):
            got(to_times(c, times=[4.0, 7.0], fill_value=wrong), "payload_value")
    either = corpus(spark, "relation", "time", value=["a"], relation=["cover"], time=[3.0])
    assert got(to_times(either, times=[1.0], fill_value={"value": "none", "relation": "quote"}), "payload_relation") == ["quote"]
    with pytest.raises(Exception, match="fill value"):
        got(to_times(either, times=[1.0], fill_value={"value": "none", "relation": "copy"}), "payload_relation")
    free = corpus(spark, "onset", "time", time=[3.0], value=["1"])
    assert got(to_times(free, times=[2.0, 3.0]), "payload_value") == ["null", "1"]
    with pytest.raises(BadArgument):
        to_times(corpus(spark, "mood_thayer", "time", time=[3.0], valence=[0.5], arousal=[0.25]), times=[0], fill_value={"valence": 0})


def test_whole_and_empty(spark):
    c = corpus(spark, "lyrics", value=["la"])
    assert got(to_times(c, times=[5, 1, 5]), "extent_time", "payload_value") == [[5.0, 1.0, 5.0], ["la"] * 3]
    with pytest.raises(BadArgument):
        to_times(c, sample_rate=2)
    p = corpus(spark, "lyrics", "time", time=[2.0], value=["la"])
    nothing = p.with_(observations=p.observations.limit(0))
    assert got(to_times(nothing, times=[3, 8], fill_value="-"), "payload_value") == ["-", "-"]
    assert to_times(p, times=[]).observations.count() == 0 and to_times(p, times=[]).documents().count() == 1
    for bad in ({}, {"times": [1], "sample_rate": 1}, {"sample_rate": 0}, {"sample_rate": -2.0}, {"times": [1], "method": "linear"}, {"times": [1], "overlap": "last"}):
        with pytest.raises(BadArgument):
            to_times(p, **bad)
    with pytest.raises(BadArgument):
        to_times(corpus(spark, "lyrics", "midi_tick", tick=[2.0], value=["la"]), times=[1])


def test_bounds_reach_the_scan(spark, tmp_path):
    from cadenza.sources import load_corpus, save_corpus

    save_corpus(corpus(spark, "tag_open", "time", time=[1.0, 3.0], value=["a", "b"]), str(tmp_path))
    c = load_corpus(spark, str(tmp_path), "tag_open", "time")
    plan = lambda df: df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    text = plan(filter_by(trim(c, start=2), lambda v: v == "b").observations.select("extent_time"))
    assert "GreaterThanOrEqual(extent_time,2.0)" in text and "EqualTo(payload_value,b)" in text and "obs_index" not in text.split("ReadSchema")[1].split("\n")[0]
