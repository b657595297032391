"""Scores of an estimated corpus against a reference corpus, pair by pair.

Both sides are nested, joined on media_id, and each pair goes through a metric
in Arrow batches; the result has a row for each pair and metric.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.errors import BadArgument
from cadenza.operators import metrics
from cadenza.plans.corpus import Corpus

#: The task that a reference payload stands for.
TASKS = {"onset": "onset", "beat": "beat", "tempo": "tempo", "chord": "chord", "segment_open": "segment", "tag_open": "segment", "note_hz": "transcription", "note_midi": "transcription", "pitch_contour": "melody", "multi_segment": "hierarchy"}
NEEDS = {"onset": "events", "beat": "events", "chord": "spans", "segment": "spans", "transcription": "spans", "melody": "time", "hierarchy": "time_interval", "tempo": None}


def evaluate(ref: Corpus, est: Corpus, task: str | None = None, **options) -> DataFrame:
    """(media_id, task, metric, value) for each media_id that both hold.

    The task follows from the reference's payload unless given. Options go to the
    metric (see `metrics`): window, ref_weight, onset_tolerance, frame_size, ...
    """
    task = task or TASKS.get(ref.payload_type)
    if task not in NEEDS:
        raise BadArgument(f"no task for payload {ref.payload_type!r}: give one of {sorted(NEEDS)}")
    for corpus in (ref, est):
        _check(corpus, task)
    left = _side(ref, "r")
    right = _side(est, "e")
    what = [(c.extent_type, c.payload_type) for c in (ref, est)]

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                sides = [{k[2:]: v for k, v in row.items() if k.startswith(s)} for s in ("r_", "e_")]
                got = score(task, *[(s, *w) for s, w in zip(sides, what)], options)
                out += [(row["media_id"], task, name, float(x)) for name, x in got.items()]
            yield pd.DataFrame(out, columns=["media_id", "task", "metric", "value"])

    return left.join(right, "media_id").mapInPandas(run, "media_id string, task string, metric string, value double")


def _check(corpus: Corpus, task: str) -> None:
    need, tag = NEEDS[task], corpus.extent_type
    allowed = {"events": ("time", "time_interval"), "spans": ("time", "time_interval"), "time": ("time",), "time_interval": ("time_interval",), None: (None, tag)}[need]
    if tag not in allowed:
        raise BadArgument(f"{task} needs an extent of {allowed}, not {tag!r}")
    if task == "transcription" and corpus.payload_type not in ("note_hz", "note_midi"):
        raise BadArgument(f"transcription needs note_hz or note_midi, not {corpus.payload_type!r}")
    own = corpus.fields("payload")
    needed = {"hierarchy": ("label", "level")}.get(task, () if task in ("onset", "beat") else ("value",))
    for n in needed:
        if n not in own:
            raise BadArgument(f"payload {corpus.payload_type!r} has no field {n!r}")


def _side(corpus: Corpus, prefix: str) -> DataFrame:
    rows = corpus.nested()
    return rows.select("media_id", *[F.col(c).alias(f"{prefix}_{c}") for c in corpus.columns("extent", "payload")])


def spans(side: dict, extent: str) -> np.ndarray:
    """Intervals; of points, those from each to the next."""
    t = np.asarray(side["extent_time"], dtype=float)
    if extent == "time_interval":
        return np.column_stack([t, t + np.asarray(side["extent_duration"], dtype=float)]) if len(t) else np.empty((0, 2))
    return np.column_stack([t[:-1], t[1:]]) if len(t) > 1 else np.empty((0, 2))


def labels(side: dict, extent: str, field: str = "payload_value") -> list:
    """Labels of `spans`: of points the last has none."""
    values = list(side[field])
    return values[:-1] if extent == "time" and len(values) > 1 else values


def hertz(side: dict, payload: str, extent: str) -> np.ndarray:
    x = np.asarray(labels(side, extent), dtype=float)
    return x if payload == "note_hz" else 440.0 * 2.0 ** ((x - 69.0) / 12.0)


def signed(values: list) -> np.ndarray:
    """Frequencies of a contour, negative where unvoiced; the first value tells whether they are dicts."""
    values = [json.loads(v) if isinstance(v, str) else v for v in values]
    if not values or not isinstance(values[0], dict):
        return np.asarray(values, dtype=float)
    f = np.array([float(v.get("frequency", 0.0)) for v in values])
    on = np.array([bool(v.get("voicing", True)) for v in values])
    return np.where(~on | (f <= 0), -np.abs(f), f)


def by_level(side: dict) -> list[tuple[np.ndarray, list]]:
    whole, level = spans(side, "time_interval"), np.asarray(side["payload_level"], dtype=int)
    return [(whole[level == k], [x for x, own in zip(side["payload_label"], level == k) if own]) for k in np.unique(level)]


def score(task: str, ref: tuple, est: tuple, options: dict) -> dict[str, float]:
    """ref, est: (arrays by column, extent type, payload type)."""
    (r, r_extent, r_payload), (e, e_extent, e_payload) = ref, est
    times = lambda s: np.asarray(s["extent_time"], dtype=float)
    if task in ("onset", "beat"):
        return getattr(metrics, task)(times(r), times(e), **options)
    if task == "tempo":
        return metrics.tempo(np.asarray(r["payload_value"], dtype=float), np.asarray(e["payload_value"], dtype=float), **options)
    if task in ("chord", "segment"):
        f = metrics.chords if task == "chord" else metrics.segments
        return f(spans(r, r_extent), labels(r, r_extent), spans(e, e_extent), labels(e, e_extent), **options)
    if task == "transcription":
        return metrics.transcription(spans(r, r_extent), hertz(r, r_payload, r_extent), spans(e, e_extent), hertz(e, e_payload, e_extent), **options)
    if task == "melody":
        return metrics.melody(times(r), signed(list(r["payload_value"])), times(e), signed(list(e["payload_value"])), **options)
    return metrics.hierarchy(by_level(r), by_level(e), **options)
