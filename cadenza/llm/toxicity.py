"""Toxicity by cumulative-link ordinal regression on sparse text features.

A text's features are its distinct words (lower case, by CRC-32). The model has
one weight for each feature, shared by all thresholds: P(grade >= k) is
sigmoid(x.w - t[k]) with t[1] <= t[2] <= ...; severity is the expected grade, the
sum of these. It is fitted by proximal gradient steps scaled by feature, with an
L1 penalty, so that few features keep a weight.

The fit is on a sample: labelled ids in the order of their hash, as many as
`sample` (20,000 unless told otherwise) and until their texts have `max_features`
distinct words together (8,000,000), which bounds the driver's memory whatever
the texts' lengths. Of several texts of an id the one with the smallest hash
counts, of several labels the largest grade.

Labels of more than two grades are fitted as they are. Where labels tell toxic
from clean only, `refined` grades the toxic texts 1 to 3 by evidence that doesn't
come from their own labels: the sample is cut in two by id, and a toxic text is
graded by how many of its words the other half knows from toxic texts alone (up to
2, up to 4, more; known are words that at least 3 toxic texts and no clean one
hold). The first threshold is thus that of the labels; the others order the toxic
texts by how much a stranger would find in them.

Rows: a null or empty text gets the severity of a text without features; a very
long text is held whole in its task, its features are its distinct words; a label
without a text or with a null grade is left out; repeated rows are each scored;
without two different grades all severities are 0; other columns are not read
(`severities`) or kept, whatever their names (`without_toxic`).
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import by_batch, kept_batches, text_or_empty, written

WORD = re.compile(r"\w+")


def features(text: str) -> list[int]:
    """The distinct words of a text, as 32-bit integers."""
    return [crc32(w.encode()) for w in set(WORD.findall(text.lower()))]


def sigmoid(x):
    return 0.5 * (1 + np.tanh(x / 2))


class OrdinalModel:
    """Weights by feature and ascending thresholds."""

    def __init__(self, weights: dict[int, float], thresholds: list[float]):
        self.weights, self.thresholds = weights, thresholds

    def score(self, text: str) -> float:
        if not self.weights:
            return 0.0
        get = self.weights.get
        return sum(x for x in map(get, features(text)) if x)

    def at_least(self, texts: list[str]) -> np.ndarray:
        """P(grade >= k) of each text, a column for each k from 1."""
        if not self.thresholds:
            return np.zeros((len(texts), 1))
        return sigmoid(np.array([self.score(t) for t in texts])[:, None] - np.array(self.thresholds)[None, :])

    def plain(self) -> tuple:
        """What the model is made of, for shipping: its class isn't known on executors."""
        return self.weights, self.thresholds

    @classmethod
    def fit(cls, grades: np.ndarray, rows: np.ndarray, cols: np.ndarray, ids: np.ndarray, l1: float = 3e-5, rounds: int = 400) -> "OrdinalModel":
        """rows, cols: which text holds which feature; ids: the feature of a column. l1: the penalty on the mean loss."""
        levels = np.unique(grades)
        if len(levels) < 2:
            return cls({}, [])
        y = np.searchsorted(levels, grades)  # 0 .. K
        n, top = len(y), len(levels) - 1
        held = np.bincount(cols, minlength=len(ids))
        # a feature of fewer than 3 texts, or as common in toxic as in clean texts, can't keep a weight
        bad = np.bincount(cols[y[rows] > 0], minlength=len(ids))
        share = (y > 0).mean()
        odd = np.abs(bad - share * held) / np.sqrt(share * (1 - share) * held + 1e-9)
        use = np.flatnonzero((held >= 3) & (odd >= 2))
        place = np.full(len(ids), -1, dtype=np.int32)
        place[use] = np.arange(len(use))
        cols = place[cols]
        rows, cols = rows[cols >= 0], cols[cols >= 0]
        m = len(use)
        above = np.array([(y >= k).mean() for k in range(1, top + 1)])
        # thresholds as the first and the logarithms of the gaps, so that they ascend
        first = -np.log(above / (1 - above))
        x = np.concatenate([np.zeros(m), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
        mean, square = np.zeros_like(x), np.zeros_like(x)
        for i in range(1, rounds + 1):
            gaps = np.exp(x[m + 1 :])
            theta = np.append(x[m] + np.append(0, np.cumsum(gaps)), 0)
            score = np.bincount(rows, weights=x[cols], minlength=n)
            p_low = np.where(y > 0, sigmoid(score - theta[y - 1]), 1.0)  # P(>= y)
            p_high = np.where(y < top, sigmoid(score - theta[np.minimum(y, top)]), 0.0)  # P(>= y + 1)
            p = np.maximum(p_low - p_high, 1e-9)
            d_low, d_high = p_low * (1 - p_low) / p / n, p_high * (1 - p_high) / p / n
            by_theta = np.bincount(y, weights=d_low, minlength=top + 1)[1:] - np.bincount(y, weights=d_high, minlength=top + 1)[:top]
            tail = np.cumsum(by_theta[::-1])[::-1]
            grad = np.concatenate([np.bincount(cols, weights=(d_high - d_low)[rows], minlength=m), tail[:1], tail[1:] * gaps])
            mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
            pace = 0.1 * min(1.0, 4 * (1 - i / (rounds + 1))) / (np.sqrt(square / (1 - 0.99**i)) + 1e-8)
            x -= pace * mean / (1 - 0.9**i)
            x[:m] = np.sign(x[:m]) * np.maximum(np.abs(x[:m]) - pace[:m] * l1, 0)
        w, theta = x[:m], x[m] + np.append(0, np.cumsum(np.exp(x[m + 1 :])))
        return cls({int(ids[use[j]]): float(w[j]) for j in np.flatnonzero(w)}, theta.tolist())


def refined(toxic: np.ndarray, half: np.ndarray, rows: np.ndarray, cols: np.ndarray, size: int) -> np.ndarray:
    """Grades 0 to 3 for labels that are 0 or 1: of the toxic texts, by how many of their words the other half knows from toxic texts alone.

    half: the half that a text is in; rows, cols: which text holds which of `size` words.
    """
    out = np.where(toxic > 0, 1, 0)
    for h in (0, 1):
        strange = half[rows] != h
        bad = np.bincount(cols[strange & (toxic[rows] > 0)], minlength=size)
        clean = np.bincount(cols[strange & (toxic[rows] == 0)], minlength=size)
        own = (bad >= 3) & (clean == 0)
        hits = np.bincount(rows[own[cols]], minlength=len(toxic))
        at = (toxic > 0) & (half == h)
        out[at] += (hits[at] > 2).astype(int) + (hits[at] > 4)
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 20_000, max_features: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "toxic") -> OrdinalModel:
    """The model of labels(id, grade) joined with docs; grades of two kinds only go through `refined`."""
    known = labels.select(F.col(id_col).alias("id"), F.col(grade_col).cast("double").alias("grade")).where("grade is not null and id is not null")
    chosen = known.groupBy("id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("id"), "id").limit(sample)
    # at most `sample` rows: a proven bound for the broadcast
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t")).join(F.broadcast(chosen), "id")

    def make():
        return lambda b: {"mark": b.column(0), "own": b.column(1), "grade": b.column(2), "words": [np.array(features(t), dtype=np.uint32).view(np.int32) for t in b.column(3).to_pylist()]}

    got = by_batch(texts.select(F.xxhash64("id").alias("mark"), F.xxhash64("t").alias("own"), "grade", "t"), "mark bigint, own bigint, grade double, words array<int>", make)
    first = F.min(F.struct("own", F.size("words").alias("n"), "words"))  # repeated ids: the text with the smallest hash
    got = written(got.groupBy("mark", "grade").agg(first.alias("x")).select("mark", "grade", "x.n", "x.words"), "labelled")
    # the order of the hashes, as far as the words go: a row for each of the sample
    sizes = got.select("mark", "n").toPandas().sort_values("mark")
    few = sizes["n"].cumsum() <= max_features
    if not few.any():
        return OrdinalModel({}, [])
    table = got.where(F.col("mark") <= int(sizes["mark"][few].max())).sort("mark").select("mark", "grade", "words").toArrow()
    grades, half = table.column("grade").to_numpy(), table.column("mark").to_numpy() % 2
    words = np.concatenate([np.asarray(c.flatten()) for c in table.column("words").chunks]).view(np.uint32)
    counts = np.concatenate([np.diff(np.asarray(c.offsets)) for c in table.column("words").chunks])
    del table
    rows = np.repeat(np.arange(len(grades), dtype=np.int32), counts)
    # most words are in one or two texts only: they can't keep a weight
    often = np.bincount(words & 0x3FFFFF, minlength=1 << 22)[words & 0x3FFFFF] >= 3
    rows, words = rows[often], words[often]
    ids, cols = np.unique(words, return_inverse=True)
    cols = cols.astype(np.int32)
    if len(np.unique(grades)) == 2:
        grades = refined((grades > grades.min()).astype(int), half, rows, cols, len(ids))
    return OrdinalModel.fit(grades, rows, cols, ids)


def severities(docs: DataFrame, model: OrdinalModel, reject: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, severity (expected grade), p_toxic = P(grade >= 1), grade (the most that P(grade >= k) >= 0.5 allows), toxic (p_toxic >= reject)."""
    data = docs.sparkSession.sparkContext.broadcast(model.plain())  # no larger than the sample's features

    def make():
        own = OrdinalModel(*data.value)

        def batch(b: pa.RecordBatch) -> dict:
            p = own.at_least(b.column(1).to_pylist())
            return {id_col: b.column(0), "severity": p.sum(1), "p_toxic": p[:, 0], "grade": (p >= 0.5).sum(1).astype(np.int32), "toxic": p[:, 0] >= reject}

        return batch

    kind = docs.schema[id_col].dataType.simpleString()
    return by_batch(docs.select(id_col, text_or_empty(text_col).alias("t")), f"`{id_col}` {kind}, severity double, p_toxic double, grade int, toxic boolean", make)


def without_toxic(docs: DataFrame, model: OrdinalModel, reject: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, with P(grade >= 1) below reject."""
    data = docs.sparkSession.sparkContext.broadcast(model.plain())

    def make():
        own = OrdinalModel(*data.value)
        return lambda texts: (own.at_least(texts)[:, 0] < reject).tolist()

    return kept_batches(docs, text_col, make)
