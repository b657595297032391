"""Metrics against slow versions of their definitions, and the evaluation of corpora."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from helpers import corpus

from cadenza.errors import BadArgument
from cadenza.operators import evaluate, metrics

rng = np.random.default_rng(17)


def scores(ref, est, **options):
    return {r["metric"]: r["value"] for r in evaluate(ref, est, **options).collect()}


def most_pairs(edges, n_right):
    """The size of a maximum matching, by trying all."""

    def best(i, free):
        if i == len(edges):
            return 0
        return max([best(i + 1, free), *(1 + best(i + 1, free - {j}) for j in edges[i] if j in free)])

    return best(0, frozenset(range(n_right)))


def test_matchings():
    for _ in range(150):
        a, b = rng.random(rng.integers(0, 7)), rng.random(rng.integers(0, 7))
        edges = [np.flatnonzero(np.abs(b - x) <= 0.12).tolist() for x in a]
        want = most_pairs(edges, len(b))
        assert len(metrics.matching(edges, len(b))) == want == metrics.event_hits(a, b, 0.12)


def test_onsets(spark):
    ref, est = [0.4, 0.9, 2.0, 3.5], [0.42, 0.86, 0.93, 2.2, 3.46]
    got = scores(*(corpus(spark, "onset", "time", time=t, value=["0"] * len(t)) for t in (ref, est)))
    assert got == pytest.approx({"Precision": 3 / 5, "Recall": 3 / 4, "F-measure": 2 / 3})
    spans = corpus(spark, "onset", "time_interval", time=est, duration=[0.1] * 5, value=["0"] * 5)
    assert scores(corpus(spark, "onset", "time", time=ref, value=["0"] * 4), spans) == pytest.approx(got)


def naive_goto(ref, est):
    error = [1.0] * len(ref)
    for k in range(1, len(ref) - 1):
        before, after = (ref[k] - ref[k - 1]) / 2, (ref[k + 1] - ref[k]) / 2
        inside = [t for t in est if ref[k] - before <= t < ref[k] + after]
        if len(inside) == 1:
            off = inside[0] - ref[k]
            error[k] = off / (before if off < 0 else after)
    best = []
    run = []
    for e in error:
        if abs(e) <= 0.35:
            run.append(e)
        else:
            best, run = (run if len(run) > len(best) else best), []
    if len(best) <= 0.25 * (len(ref) - 2):
        return 0.0
    spread = 0.0 if len(best) < 2 else math.sqrt(sum((x - sum(best) / len(best)) ** 2 for x in best) / (len(best) - 1))
    return float(sum(map(abs, best)) / len(best) < 0.2 and spread < 0.2)


def test_beats():
    tracked = 0
    for _ in range(200):
        ref = 5 + np.cumsum(rng.uniform(0.4, 0.6, rng.integers(3, 40)))
        est = np.sort(ref[rng.random(len(ref)) < rng.choice([0.6, 0.95, 1.0])] + rng.normal(0, rng.choice([0.01, 0.05, 0.12])))
        assert metrics.goto(ref, est) == naive_goto(ref.tolist(), est.tolist())
        tracked += metrics.goto(ref, est)
        got = metrics.beat(ref, est)
        if len(est) < 2:
            assert set(got.values()) <= {0.0, got["F-measure"]}
            continue
        assert got["Cemgil"] == pytest.approx(sum(math.exp(-(min(abs(est - t)) ** 2) / (2 * 0.04**2)) for t in ref) / ((len(ref) + len(est)) / 2))
        assert 0 <= got["Correct Metric Level Continuous"] <= got["Correct Metric Level Total"] <= got["Any Metric Level Total"] <= 1
    assert 20 < tracked < 180
    ref = np.arange(6.0, 30.0, 0.5)
    exact = metrics.beat(ref, ref)
    assert all(exact[k] == pytest.approx(1.0) for k in exact)
    half = metrics.beat(ref, ref[::2])  # half the tempo: another metric level
    assert half["Any Metric Level Total"] == 1.0 and half["Correct Metric Level Total"] < 0.1 and half["Goto"] == 0.0
    assert metrics.beat(np.arange(5.0), np.arange(5.0))["F-measure"] == 0.0  # all before the fifth second


def test_tempo(spark):
    ref = corpus(spark, "tempo", value=[64.0, 128.0])
    assert scores(ref, corpus(spark, "tempo", value=[130.0, 90.0]), ref_weight=0.25) == {"P-score": 0.75, "One-correct": 1.0, "Both-correct": 0.0}
    assert scores(ref, corpus(spark, "tempo", value=[69.0, 119.0])) == {"P-score": 1.0, "One-correct": 1.0, "Both-correct": 1.0}


def test_chords(spark):
    ref = corpus(spark, "chord", "time_interval", time=[0.0, 3.0, 4.0], duration=[3.0, 1.0, 6.0], value=["D:min7", "N", "E:maj/3"])
    est = corpus(spark, "chord", "time_interval", time=[0.0, 3.5], duration=[3.5, 4.5], value=["D:min", "E:maj"])
    got = scores(ref, est)
    # D:min7 against D:min for 3 s, N against D:min and E:maj, E:maj/3 against E:maj for 4 s and against nothing for 2 s
    want = {"root": 0.7, "thirds": 0.7, "triads": 0.7, "tetrads": 0.4, "majmin": 0.7, "sevenths": 0.4, "thirds_inv": 0.3, "majmin_inv": 0.3, "mirex": 0.7, "overseg": 1 - (0.5 + 2) / 10, "underseg": 1 - (0.5 + 0.5) / 8}
    assert {k: got[k] for k in want} == pytest.approx(want) and got["seg"] == pytest.approx(0.75)
    points = corpus(spark, "chord", "time", time=[0.0, 1.0, 5.0], value=["A:min", "C:maj", "X"])  # the last point ends the span before
    assert scores(points, points)["mirex"] == 1.0
    assert metrics.compare_chords("X", "C")["root"] is None and metrics.compare_chords("G:sus4", "G:maj")["majmin"] is None


def naive_labels(x, y):
    """Scores of two labellings by looking at all pairs of frames."""
    n = len(x)
    pairs = list(itertools.combinations(range(n), 2))
    a, b = [x[i] == x[j] for i, j in pairs], [y[i] == y[j] for i, j in pairs]
    both = sum(p and q for p, q in zip(a, b))
    p_xy = {(u, v): sum(s == u and t == v for s, t in zip(x, y)) / n for u in set(x) for v in set(y)}
    p_x, p_y = ({u: list(z).count(u) / n for u in set(z)} for z in (x, y))
    mi = sum(p * math.log(p / p_x[u] / p_y[v]) for (u, v), p in p_xy.items() if p)
    return both / sum(b), both / sum(a), sum(p == q for p, q in zip(a, b)) / len(pairs), mi


def test_labellings():
    for _ in range(40):
        n = int(rng.integers(4, 8))
        x, y = rng.integers(0, 3, n), rng.integers(-1, 3, n)
        pairs_x, pairs_y = (sum(z[i] == z[j] for i, j in itertools.combinations(range(n), 2)) for z in (x, y))
        got = metrics.pairwise(x, y)
        if pairs_x and pairs_y:
            assert [got[k] for k in ("Pairwise Precision", "Pairwise Recall", "Rand Index", "Mutual Information")] == pytest.approx(naive_labels(x.tolist(), y.tolist()))
        # chance is the mean over all orders of the frames
        orders = [metrics.pairwise(x, y[list(o)]) for o in itertools.permutations(range(n))] if n < 7 else []
        if orders:
            a, b = (np.unique(z, return_counts=True)[1] for z in (x, y))
            chance = np.mean([o["Mutual Information"] for o in orders])
            assert metrics.expected_information(a, b) == pytest.approx(chance)
            entropy = max(-sum(k / n * math.log(k / n) for k in c) for c in (a, b))
            if entropy - chance > 1e-9:
                assert got["Adjusted Mutual Information"] == pytest.approx((got["Mutual Information"] - chance) / (entropy - chance))
            if len(a) > 1 and len(b) > 1:
                assert np.mean([o["Adjusted Rand Index"] for o in orders]) == pytest.approx(0, abs=1e-9)


def test_segments(spark):
    ref = corpus(spark, "segment_open", "time_interval", time=[0.0, 6.0, 9.0], duration=[6.0, 3.0, 3.0], value=["a", "b", "a"])
    est = corpus(spark, "tag_open", "time_interval", time=[0.0, 6.4, 12.0], duration=[6.4, 5.6, 1.0], value=["x", "y", "z"])
    got = scores(ref, est, task="segment")
    assert got["Precision@0.5"] == 3 / 4 and got["Recall@0.5"] == 3 / 4 and got["Recall@3.0"] == 1.0
    assert got["Ref-to-est deviation"] == pytest.approx(0.2) and got["Est-to-ref deviation"] == pytest.approx(0.2)
    x, y = [0] * 60 + [1] * 30 + [0] * 30, [0] * 64 + [1] * 56
    assert [got[k] for k in ("Pairwise Precision", "Pairwise Recall", "Rand Index", "Mutual Information")] == pytest.approx(naive_labels(x, y))
    same = scores(ref, ref)
    assert all(same[k] == pytest.approx(1.0) for k in ("Pairwise F-measure", "Adjusted Rand Index", "Adjusted Mutual Information", "V-measure", "NCE F-measure"))


def naive_notes(ref, est, pitch, stop):
    edges = []
    for s, e, f in ref:
        own = []
        for j, (t, u, g) in enumerate(est):
            near = round(abs(t - s), 9) <= 0.05 and (not pitch or abs(1200 * math.log2(g / f)) <= 50)
            own += [j] if near and (not stop or round(abs(u - e), 9) <= max(0.05, 0.2 * (e - s))) else []
        edges.append(own)
    return most_pairs(edges, len(est))


def test_notes(spark):
    notes = lambda n: [(t := round(random.random(), 3), t + random.choice((0.1, 0.3, 0.34)), random.choice((220.0, 222.0, 440.0))) for _ in range(n)]
    random.seed(9)
    for _ in range(80):
        ref, est = notes(random.randint(1, 6)), notes(random.randint(1, 6))
        got = metrics.transcription(*(np.array(x) for r in (ref, est) for x in ([(s, e) for s, e, _ in r], [f for *_, f in r])))
        for names, pitch, stop in ((("Recall", "Precision"), True, True), (("Recall_no_offset", "Precision_no_offset"), True, False), (("Onset_Recall", "Onset_Precision"), False, False)):
            hits = naive_notes(ref, est, pitch, stop)
            assert [got[n] for n in names] == pytest.approx([hits / len(ref), hits / len(est)])
    midi = corpus(spark, "note_midi", "time_interval", time=[0.5, 0.5], duration=[0.2, 0.2], value=[57.0, 60.0])
    hz = corpus(spark, "note_hz", "time_interval", time=[0.52, 0.52], duration=[0.2, 0.2], value=[261.6, 300.0])
    got = scores(midi, hz)
    assert got["Precision"] == 0.5 and got["Onset_Recall"] == 1.0 and got["Average_Overlap_Ratio"] == pytest.approx(0.18 / 0.22)


def test_melody(spark):
    def contour(frequencies):
        values = [json.dumps({"frequency": abs(f), "voicing": f > 0}) for f in frequencies]
        return corpus(spark, "pitch_contour", "time", time=[k / 4 for k in range(len(values))], value=values)

    got = scores(contour([200.0, 200.0, 300.0, -300.0, 0.0]), contour([202.0, 400.0, -300.0, 300.0, 0.0]))
    assert got == pytest.approx({"Voicing Recall": 2 / 3, "Voicing False Alarm": 0.5, "Raw Pitch Accuracy": 2 / 3, "Raw Chroma Accuracy": 1.0, "Overall Accuracy": 0.4})


def naive_triplets(ref, est, window, transitive):
    """By all triples of frames: the share that the estimate ranks as the reference does, by query frame."""
    deepest = lambda levels, i, j: max([k + 1 for k, x in enumerate(levels) if x[i] >= 0 and x[i] == x[j]], default=0)
    out = []
    n = len(ref[0])
    for q in range(n):
        others = [i for i in range(n) if i != q and (not window or abs(i - q) <= window)]
        ranks = sorted({deepest(ref, q, i) for i in others})
        hit = every = 0
        for i, j in itertools.permutations(others, 2):
            a, b = ranks.index(deepest(ref, q, i)), ranks.index(deepest(ref, q, j))
            if b > a and (transitive or b == a + 1):
                every += 1
                hit += deepest(est, q, i) < deepest(est, q, j)
        out += [hit / every] if every else []
    return sum(out) / len(out) if out else 0.0


def test_hierarchies(spark):
    for _ in range(25):
        n = int(rng.integers(4, 12))
        ref, est = ([np.sort(rng.integers(-1, k + 1, n)) for k in range(1, 4)] for _ in range(2))
        for window, transitive in ((None, True), (3, False), (3, True)):
            assert metrics.triplets(ref, est, window, transitive) == pytest.approx(naive_triplets(ref, est, window, transitive))
    tree = lambda cut: corpus(spark, "multi_segment", "time_interval", time=[0.0, 0.0, cut], duration=[4.0, cut, 4.0 - cut], label=["song", "verse", "chorus"], level=[0, 1, 1])
    exact, off = scores(tree(2.0), tree(2.0)), scores(tree(2.0), tree(2.5))
    assert all(exact[f"T-{k} {w}"] == 1.0 for k in ("Precision", "Recall", "Measure") for w in ("reduced", "full")) and exact["L-Measure"] == 1.0
    assert 0.5 < off["T-Measure reduced"] < 1 and 0.5 < off["L-Measure"] < 1
    levels = lambda b: [(np.array([[0.0, 120.0]]), ["x"]), (np.array([[0.0, b], [b, 120.0]]), ["a", "b"])]
    got = metrics.hierarchy(levels(60.1), levels(60.2))  # the frames stay as given in a track of over a minute
    assert 0.9 < got["L-Measure"] < 1 and 0.9 < got["T-Measure full"] < 1


def test_tasks(spark):
    lyrics = corpus(spark, "lyrics", "time", time=[0.0], value=["la"])
    contour = corpus(spark, "pitch_contour", "time", time=[0.0], value=['{"frequency": 1.0}'])
    boxes = corpus(spark, "onset", "pixel_box", x=[0.0], y=[0.0], width=[1.0], height=[1.0], value=["0"])
    for ref, est, task in ((lyrics, lyrics, None), (contour, lyrics, "hierarchy"), (boxes, boxes, None), (contour, boxes, "melody"), (lyrics, lyrics, "transcription"), (lyrics, lyrics, "rhythm")):
        with pytest.raises(BadArgument):
            evaluate(ref, est, task=task)
