"""Values at given times: as-of, nearest and interval-covering joins with gap fill.

Points go into the slots between grid points by a partial aggregate, so that no
task sorts a long annotation; a running window over the slots that hold something
then serves the grid. Intervals find the grid points they cover without a
join: each observation is exploded over them, and the pick among overlapping
ones is a partial aggregate. An explicit grid is an argument of the call, so its
size doesn't grow with the data; a uniform one is computed by annotation.
"""

from __future__ import annotations

import bisect
import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza import catalog
from cadenza.documents import check_value
from cadenza.errors import BadArgument, InvalidAnnotation
from cadenza.plans.corpus import Corpus, with_index

POINTS, SPANS = ("time",), ("time_interval", "time_frequency_box")
EDGE = 1e-9  # tolerance of a uniform grid's last point


def to_times(corpus: Corpus, *, times: list[float] | None = None, sample_rate: float | None = None, method: str = "previous", overlap: str = "latest", fill_value=None) -> Corpus:
    """The corpus on a grid: its extent becomes `time`.

    Points: 'previous' is the last observation (by index) not after the time,
    'nearest' the closest (ties: the lowest index). Intervals hold at both ends;
    of several, overlap takes the highest index ('latest'), the lowest ('first')
    or all ('multiple'). Without extent observation 0 holds everywhere. Gaps get
    fill_value: a value for a payload with one field, else a dict by field (its
    `confidence` too; 0.0 unless given). A value that the catalog doesn't allow (no
    value at all is one, but for free-form fields) is an error where a gap occurs.
    """
    if (times is None) == (sample_rate is None):
        raise BadArgument("give either times or sample_rate")
    if sample_rate is not None and not sample_rate > 0:
        raise BadArgument("sample_rate must be positive")
    if method not in ("previous", "nearest"):
        raise BadArgument(f"unknown method {method!r}")
    if overlap not in ("latest", "first", "multiple"):
        raise BadArgument(f"unknown overlap {overlap!r}")
    corpus = corpus.as_parent("to_times")
    if corpus.extent_type not in (None, *POINTS, *SPANS):
        raise BadArgument(f"extent {corpus.extent_type!r} can't be put on a time grid")
    if corpus.extent_type is None and sample_rate is not None:
        raise BadArgument("sample_rate needs an extent")
    fill = _fill(corpus, fill_value)
    names = corpus.columns("payload", "confidence")
    value = F.struct("obs_index", *names)
    obs = corpus.observations
    grid = _explicit(corpus, times) if times is not None else _uniform(corpus, sample_rate)
    key = ["annotation", "grid_index"]
    if corpus.extent_type is None:
        only = obs.where("obs_index = 0").select("annotation", value.alias("v"))
        found = grid.join(only, "annotation", "left")
    elif corpus.extent_type in POINTS:
        slots = _slotted(corpus, times, sample_rate)
        found = _as_of(slots, grid, names) if method == "previous" else _nearest(slots, grid, names)
    else:
        covered = _covers(corpus, times, sample_rate, value)
        if overlap != "multiple":
            pick = F.max("v") if overlap == "latest" else F.min("v")
            covered = covered.groupBy(*key).agg(pick.alias("v"))
        found = grid.join(covered, key, "left")
    hit = F.col("v").isNotNull()
    filled = [F.when(hit, F.col(f"v.{n}")).otherwise(fill[n]).alias(n) for n in names]
    rows = found.select("annotation", F.col("t").alias("extent_time"), "grid_index", F.col("v.obs_index").alias("__of"), *filled)
    if overlap == "multiple" and corpus.extent_type in SPANS:
        rows = with_index(rows, "annotation", "grid_index", "__of")
    else:
        rows = rows.withColumn("obs_index", F.col("grid_index").cast("long"))
    out = corpus.derived("to_times", {"sample_rate": sample_rate, "method": method, "overlap": overlap}, extent_type="time")
    return out.with_(observations=rows.select("annotation", "obs_index", "extent_time", *names))


def _fill(corpus: Corpus, fill_value) -> dict[str, Column]:
    """A literal for each column."""
    own = corpus.fields("payload")
    values: dict[str, object] = {}
    if isinstance(fill_value, dict):
        missing = [n for n in own if n not in fill_value]
        if missing:
            raise BadArgument(f"fill_value lacks {missing}")
        values = dict(fill_value)
    elif len(own) == 1:
        values[next(iter(own))] = fill_value
    elif "value" in own:
        values = {n: fill_value if n == "value" else None for n in own}
    elif fill_value is not None:
        raise BadArgument("a payload of several fields needs a dict as fill_value")
    out = {}
    for facet in ("payload", "confidence"):
        for n, field in corpus.fields(facet).items():
            x = values.get(n, 0.0 if facet == "confidence" and n == "confidence" else None)
            wrong = _wrong_fill(n, field, x)
            if wrong:
                out[catalog.column(facet, n)] = F.raise_error(F.lit(wrong)).cast(field.type)
            else:
                out[catalog.column(facet, n)] = F.lit(json.dumps(x, ensure_ascii=False) if field.json else x).cast(field.type)
    return out


def _wrong_fill(name: str, field: catalog.Field, x) -> str | None:
    """What is wrong with a fill value; optional fields may be left out."""
    if x is None and (field.optional or field.kind == "any"):
        return None
    try:
        check_value(name, field, x)
    except InvalidAnnotation as e:
        return f"fill value: {e}"
    return None


def _explicit(corpus: Corpus, times: list[float]) -> DataFrame:
    """The same times for every annotation, in the caller's order, repeats kept."""
    order = _ordered(times)
    # a point that is no number has nothing at or before it
    points = [F.struct(F.lit(float(t)).alias("t"), F.lit(-1 if math.isnan(t) else bisect.bisect_left(order, t)).alias("slot")) for t in times]
    points = F.array(*points) if times else F.array().cast("array<struct<t:double,slot:int>>")
    return corpus.headers.select("annotation", F.posexplode(points).alias("grid_index", "p")).select("annotation", "grid_index", "p.t", "p.slot")


def _bounds(corpus: Corpus, rate: float) -> DataFrame:
    """By annotation the first time, and the number of points."""
    start = F.col("extent_time")
    end = start + F.col("extent_duration") if corpus.extent_type in SPANS else start
    got = corpus.observations.groupBy("annotation").agg(F.min(start).alias("t0"), F.max(end).alias("t1"))
    step = 1.0 / rate
    n = (F.floor((F.col("t1") - F.col("t0")) / F.lit(step) + F.lit(EDGE)) + 1).cast("long")
    over = F.col("t0") + (n - 1) * F.lit(step) > F.col("t1") + F.lit(EDGE)
    return got.select("annotation", "t0", F.when(over, n - 1).otherwise(n).alias("n"))


def _uniform(corpus: Corpus, rate: float) -> DataFrame:
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    rows = _bounds(corpus, rate).where("n > 0").select("annotation", "t0", at.alias("grid_index"))
    index = F.col("grid_index").cast("int")
    return rows.select("annotation", index.alias("grid_index"), (F.col("t0") + F.col("grid_index") * F.lit(1.0 / rate)).alias("t"), index.alias("slot"))


def _slotted(corpus: Corpus, times: list[float] | None, rate: float | None) -> DataFrame:
    """Observations with their slot: the number of grid points before them. Grid points have one too, so t <= point where slot <= its slot."""
    obs = corpus.observations.where(~F.isnan("extent_time"))
    t = F.col("extent_time")
    if times is not None:
        points = F.array(*[F.lit(x) for x in _ordered(times)]).cast("array<double>")
        return obs.withColumn("slot", F.size(F.filter(points, lambda p: p < t)))
    t0, step = F.col("t0"), F.lit(1.0 / rate)
    least = F.greatest(F.floor((t - t0) / step) - 1, F.lit(0).cast("long"))
    before = [(t0 + (least + k) * step < t).cast("long") for k in range(3)]  # rounding moves it by one at most
    rows = obs.join(_bounds(corpus, rate), "annotation").withColumn("slot", F.least(least + before[0] + before[1] + before[2], F.col("n")).cast("int"))
    return rows.drop("t0", "n")


def _ordered(times: list[float]) -> list[float]:
    return sorted(float(t) for t in times if not math.isnan(t))


def _over_slots(held: DataFrame, grid: DataFrame, **picks: tuple[str, bool]) -> DataFrame:
    """Grid points with the largest of what the slots up to theirs hold, or behind it (True): columns name = (column, behind)."""
    rows = grid.unionByName(held, allowMissingColumns=True)
    own = F.col("grid_index").isNotNull().cast("int")  # up to a slot: what it holds comes first
    window = Window.partitionBy("annotation")
    order = {False: window.orderBy("slot", own), True: window.orderBy(F.desc("slot"), F.desc(own))}
    found = {n: F.max(c).over(order[behind].rowsBetween(Window.unboundedPreceding, 0)) for n, (c, behind) in picks.items()}
    return rows.withColumns(found).where("grid_index is not null")


def _as_of(slots: DataFrame, grid: DataFrame, names: list[str]) -> DataFrame:
    """The highest index so far, by time."""
    held = slots.groupBy("annotation", "slot").agg(F.max(F.struct("obs_index", *names)).alias("x"))
    return _over_slots(held, grid, v=("x", False)).select("annotation", "grid_index", "t", "v")


def _nearest(slots: DataFrame, grid: DataFrame, names: list[str]) -> DataFrame:
    """The last of those not after the point, the first of those after, and of the two the closer; of equal times the lowest index."""
    value, index = F.struct("obs_index", *names).alias("v"), (-F.col("obs_index")).alias("i")
    last = F.max(F.struct(F.col("extent_time").alias("k"), index, value)).alias("x")
    first = F.max(F.struct((-F.col("extent_time")).alias("k"), index, value)).alias("y")
    held = slots.groupBy("annotation", "slot").agg(last, first)
    return _over_slots(held, grid, b=("x", False), a=("y", True)).select("annotation", "grid_index", "t", _closer().alias("v"))


def _closer() -> Column:
    """Of b (the last before) and a (the first behind) the one closer to t, of two as close the lower index."""
    d_b, d_a = F.abs(F.col("b.k") - F.col("t")), F.abs(-F.col("a.k") - F.col("t"))
    closer = F.col("b").isNull() | (d_a < d_b) | ((d_a == d_b) & (F.col("a.i") > F.col("b.i")))
    return F.when(F.col("a").isNull(), F.col("b.v")).when(closer, F.col("a.v")).otherwise(F.col("b.v"))


def _covers(corpus: Corpus, times: list[float] | None, rate: float | None, value: Column) -> DataFrame:
    """A row for each grid point that an interval covers, ends included."""
    start, end = F.col("extent_time"), F.col("extent_time") + F.col("extent_duration")
    if times is not None:
        order = sorted(range(len(times)), key=lambda i: times[i])
        points = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(times[i])).alias("t")) for i in order if not math.isnan(times[i])])
        if not times:
            points = F.array().cast("array<struct<i:int,t:double>>")
        inside = F.filter(points, lambda p: (start <= p["t"]) & (p["t"] <= end))
        return corpus.observations.select("annotation", F.explode(inside).alias("p"), value.alias("v")).select("annotation", F.col("p.i").alias("grid_index"), "v")
    step = 1.0 / rate
    rows = corpus.observations.join(_bounds(corpus, rate), "annotation")
    first = F.greatest(F.floor((start - F.col("t0")) / F.lit(step)) - 1, F.lit(0).cast("long"))
    last = F.least(F.ceil((end - F.col("t0")) / F.lit(step)) + 1, F.col("n") - 1)
    rows = rows.where(last >= first).select("annotation", "t0", start.alias("s"), end.alias("e"), F.explode(F.sequence(first, last)).alias("g"), value.alias("v"))
    t = F.col("t0") + F.col("g") * F.lit(step)
    return rows.where((F.col("s") <= t) & (t <= F.col("e"))).select("annotation", F.col("g").cast("int").alias("grid_index"), "v")
