"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and underscores in lower case. Runs of
`min_match` words that a test item and a text share are the seeds; they join a
text with the items in question. For each such pair the longest run of words not
marked yet is marked again and again, so that passages in another order still
count; common runs are found by running Karp-Rabin hashes of min_match words and
joined along their diagonals. The share of the item's words under tiles is its
coverage.

Rows: a null or empty text, a null item and an item of fewer than min_match
words match nothing; an empty benchmark rejects nothing; of runs of equal length
the first in the item goes first, then the first in the text; repeated rows are
each judged on their own; columns beside the id and the text are not read, and
columns of any name are kept by `decontaminated`. Texts are never shuffled. A
very long text is held whole in its task, and so are the pairs of equal windows
of it and one item, 8 bytes each: those of a text that repeats one word without
end are as many as its words times the item's windows of that word. Items are
shipped to the tasks in parts of at most `max_bytes` (their size is summed up
first); more items mean more passes over the texts, one part at a time on the
driver and the executors, not a larger broadcast.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import by_batch, free_name, kept_batches, text_or_empty, total, written

WORD = re.compile(r"\w+")
BASE = np.uint64(0x9E3779B97F4A7C15)
PAIRS = 1 << 22  # pairs of equal windows looked at together
#: Results of tilings remembered by a task: many texts share a passage.
REMEMBERED = 20_000

SPACE = np.zeros(1, dtype=np.uint64)

Tile = tuple[int, int, int]  # start in the item, start in the text, words


def running(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of n ids: each polynomial runs over all windows at once."""
    h = np.zeros(max(0, len(ids) - n + 1), dtype=np.uint64)
    for k in range(n if len(h) else 0):
        h = h * BASE + ids[k : k + len(h)]
    return h


def common_runs(item: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, start in the item, start in the text) of all common runs of n words or more that can't be longer, the longest first, then by place."""
    h, g = running(item, n), running(text, n)
    order = np.argsort(h, kind="stable")
    low, high = np.searchsorted(h[order], g, side="left"), np.searchsorted(h[order], g, side="right")
    keys = []
    width = len(text) + 1
    at = np.flatnonzero(high > low)
    times = (high - low)[at]
    ends = np.cumsum(times)
    begin = 0
    while begin < len(at):  # so many pairs of equal windows at a time
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, side="right")))
        t = times[begin:stop]
        j = np.repeat(at[begin:stop], t)
        i = order[np.arange(t.sum()) - np.repeat(np.cumsum(t) - t - low[at[begin:stop]], t)]
        same = np.ones(len(i), dtype=bool)
        for k in range(n):  # equal hashes of different words are no match
            same &= item[i + k] == text[j + k]
        # pairs stand by diagonal, then along it; only where a run begins or ends is kept of a long one
        keys.append(((j - i + len(item)) * width + j)[same])
        begin = stop
    key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    first = np.append(True, key[1:] != key[:-1] + 1)[: len(key)]  # j can't run over to the next diagonal: width is more than any j
    starts = np.flatnonzero(first)
    words = np.diff(starts, append=len(key)) + n - 1
    diagonal, j = np.divmod(key[starts], width)
    i = j - (diagonal - len(item))
    by = np.lexsort((j, i, -words))
    return words[by], i[by], j[by]


def tiles(item, text, min_match: int) -> list[Tile]:
    """Greedy string tiling: of all common runs of unmarked words the longest, of equal ones the first in the item, then in the text, again and again.

    A run that a tile has cut goes back among the others as its unmarked parts, each
    at its length, so no shorter run is marked before it. It ends as soon as no
    window of min_match unmarked words of the item occurs in the text.
    """
    item, text = np.asarray(item, dtype=np.uint64), np.asarray(text, dtype=np.uint64)
    words, starts, places = common_runs(item, text, min_match)
    taken, used = np.zeros(len(item), dtype=bool), np.zeros(len(text), dtype=bool)
    seeded = np.zeros(len(item) + 1, dtype=np.int64)  # windows of the item that occur in the text
    np.add.at(seeded, starts, 1)
    np.add.at(seeded, starts + words - min_match + 1, -1)
    open_ = np.cumsum(seeded)[:-1] > 0
    cut: list[tuple[int, int, int]] = []
    out: list[Tile] = []
    at = 0
    while open_.any() and (cut or at < len(words)):
        if at < len(words) and (not cut or (-words[at], starts[at], places[at]) < cut[0]):
            n, i, j = int(words[at]), int(starts[at]), int(places[at])
            at += 1
        else:
            n, i, j = heapq.heappop(cut)
            n = -n
        marked = taken[i : i + n] | used[j : j + n]
        if not marked.any():
            taken[i : i + n] = used[j : j + n] = True
            open_[max(0, i - min_match + 1) : i + n] = False
            out.append((i, j, n))
        elif open_[i : i + n - min_match + 1].any():
            edges = np.flatnonzero(np.diff(np.concatenate([[True], marked, [True]]).astype(np.int8)))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if b - a >= min_match:
                    heapq.heappush(cut, (a - b, i + a, j + a))
    return out


class Items:
    """Test items, ready to be found in texts."""

    def __init__(self, rows: list[tuple], min_match: int):
        self.min_match = min_match
        self.ids: dict[str, int] = {}
        self.items: list[tuple[object, list[int]]] = []
        seeds: dict[int, set[int]] = defaultdict(set)
        for key, text in rows:
            words = [self.ids.setdefault(w, len(self.ids) + 1) for w in WORD.findall((text or "").lower())]
            if len(words) >= min_match:
                for h in running(np.array(words, dtype=np.uint64), min_match).tolist():
                    seeds[h].add(len(self.items))
                self.items.append((key, words))
        self.seeds = np.array(sorted(seeds), dtype=np.uint64)
        self.of = [sorted(seeds[h]) for h in self.seeds.tolist()]
        self.known: dict[tuple[int, bytes], list[Tile]] = {}

    def match(self, text: str) -> list[tuple[object, int, list[Tile]]]:
        """Of each item that shares a seed: its key, its words and its tiles."""
        n = self.min_match
        words = WORD.findall(text.lower())
        if len(words) < n or not len(self.seeds):
            return []
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.uint64, count=len(words))
        known = ids > 0
        inside = known[: len(ids) - n + 1].copy()
        for k in range(1, n):
            inside &= known[k : len(ids) - n + 1 + k]
        at = np.flatnonzero(inside)
        if not len(at):
            return []
        h = np.zeros(len(at), dtype=np.uint64)
        for k in range(n):
            h = h * BASE + ids[at + k]
        place = np.searchsorted(self.seeds, h)
        hit = self.seeds[np.minimum(place, len(self.seeds) - 1)] == h
        at, place = at[hit], place[hit]
        if not len(at):
            return []
        runs: dict[int, list[int]] = defaultdict(list)
        for p, s in zip(at.tolist(), place.tolist()):
            for item in self.of[s]:
                runs[item].append(p)
        return [(self.items[item][0], len(self.items[item][1]), self._tiles(item, ids, starts)) for item, starts in runs.items()]

    def _tiles(self, item: int, ids: np.ndarray, starts: list[int]) -> list[Tile]:
        """Tiling against the stretches of the text that hold the item's seeds, kept apart by a word of no item.

        Of a stretch that the text repeats, as many are taken as the item can have
        tiles: a tile marks one of them, and of equal runs the first goes first.
        """
        n, stretches = self.min_match, []
        begin = end = -1
        for p in [*starts, 1 << 60]:
            if p > end:
                if begin >= 0:
                    stretches.append((begin, end))
                begin = p
            end = p + n
        parts, places, again = [], [], Counter()
        for a, b in stretches:
            own = ids[a:b]
            again[key := own.tobytes()] += 1
            if again[key] <= len(self.items[item][1]) // n:
                parts += [own, SPACE]
                places += [np.arange(a, b), SPACE]
        text = np.concatenate(parts)
        key = (item, text.astype(np.uint32).tobytes())
        got = self.known.get(key)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            got = self.known[key] = tiles(self.items[item][1], text, n)
        place = np.concatenate(places)
        return [(i, int(place[j]), k) for i, j, k in got]

    def leaks(self, text: str, threshold: float) -> list[tuple[object, int, list[Tile]]]:
        return [x for x in self.match(text) if sum(t[2] for t in x[2]) >= threshold * x[1]]


def _parts(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, min_match: int, max_bytes: int) -> Iterator[tuple[Callable[[], Items], bool]]:
    """The items in parts of about max_bytes at most, shipped to the tasks, and whether it is the only one.

    With several, what a part is used for must be written before the next is asked
    for: then it is gone from the driver and the executors.
    """
    rows = benchmark.select(F.col(item_col).alias("k"), text_or_empty(item_text).alias("t"))
    (size,) = total(rows, F.sum(F.octet_length("t") + 64))
    n = max(1, -(-size // max_bytes))
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == i)
        data = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in part.collect()])
        yield lambda data=data: Items(data.value, min_match), n == 1
        if n > 1:
            data.destroy()


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, min_match: int = 5, max_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each text and item of which the text covers `threshold` or more.

    Columns: id, item, item_words, covered_words, coverage, tiles (array of
    item_start, text_start, words: positions count words).
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, item_words int, covered_words int, coverage double, tiles array<struct<item_start:int,text_start:int,words:int>>"
    out = None
    for ship, only in _parts(docs, benchmark, item_col, item_text, min_match, max_bytes):

        def make(ship=ship):
            items = ship()

            def batch(b: pa.RecordBatch) -> dict | None:
                rows = [(i, *x) for i, t in enumerate(b.column(1).to_pylist()) for x in items.leaks(t, threshold)]
                if not rows:
                    return None
                covered = [sum(t[2] for t in x[3]) for x in rows]
                return {
                    id_col: b.column(0).take(pa.array([x[0] for x in rows], pa.int64())),
                    item_col: [x[1] for x in rows],
                    "item_words": [x[2] for x in rows],
                    "covered_words": covered,
                    "coverage": [c / x[2] for c, x in zip(covered, rows)],
                    "tiles": [[{"item_start": i, "text_start": j, "words": n} for i, j, n in sorted(x[3])] for x in rows],
                }

            return batch

        found = by_batch(docs.select(id_col, text_or_empty(text_col).alias("t")), schema, make)
        if not only:
            found = written(found, "leaks")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, min_match: int = 5, max_bytes: int = 16 << 20, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that cover no item by `threshold` or more."""
    leaks = None
    for ship, only in _parts(docs, benchmark, item_col, item_text, min_match, max_bytes):
        if only:

            def make(ship=ship):
                items = ship()
                return lambda texts: [not items.leaks(t, threshold) for t in texts]

            return kept_batches(docs, text_col, make)

        def find(ship=ship):
            items = ship()

            def batch(b: pa.RecordBatch) -> dict:
                own = [k for k, t in enumerate(b.column(0).to_pylist()) if items.leaks(t, threshold)]
                return {"text_hash": b.column(1).take(pa.array(own, pa.int64())), "text_size": b.column(2).take(pa.array(own, pa.int64()))}

            return batch

        texts = docs.select(text_or_empty(text_col).alias("t"))
        found = by_batch(texts.select("t", F.xxhash64("t"), F.octet_length("t")), "text_hash bigint, text_size int", find)
        found = written(found.distinct(), "leaks")
        leaks = found if leaks is None else leaks.unionByName(found)
    # what a text covers depends on the text only
    names = [free_name(docs, n) for n in leaks.columns]
    keyed = docs.withColumns(dict(zip(names, (F.xxhash64(text_or_empty(text_col)), F.octet_length(text_or_empty(text_col))))))
    return keyed.join(leaks.distinct().toDF(*names), names, "left_anti").select(*docs.columns)
