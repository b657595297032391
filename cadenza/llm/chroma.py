"""Chroma audio fingerprints and their alignment.

A recording is a sequence of pitch-class frames: 12 energies each, taken from
PCM samples by a Fourier transform (`pcm_frames`) or from a pitch contour
(`contour_frames`). Frames are summed into an integral image; a bank of 16
rectangle filters compares the energy of two areas each, reading four corners
an area; every comparison is quantised to two bits in Gray code, which makes a
32-bit integer for each window of 16 frames.

Two recordings are aligned by an offset histogram: each pair of windows votes for
its offset with the bits in which it agrees. All offsets are counted at once, as
a correlation of bits by Fourier transform; offsets whose share of differing bits
over the whole overlap may be within the bound are then counted exactly on the
integers. No index of equal or partial codes stands before it: at 0.2 differing
bits over 16 windows no part of a code is certain to be equal, and strangers
agree in two thirds of their bits, so an index that finds nine tenths of the
alignments compares most pairs anyway.

Queries are a stated part of the rows, compared with all rows in blocks of both.
What leaves a block is a row for each recording in it that aligns (how often, and
its best partner) and a spanning forest of the links, never the pairs: a family
of k alike recordings gives k rows.

Rows: a null or empty recording, null or non-finite samples within it (which
count as silence) and windows without any energy have no integers; recordings
with the same integers form a class, compared once; repeated ids are recordings
of their own; other columns are not read, whatever their names. A recording of
fewer integers than the least overlap aligns with nothing. Recordings may differ
in length; one is held whole in memory, with 300 bytes a frame while its integers
are made and 600 while it is compared. Of equally good partners the one with the
smaller class hash is given. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cadenza.llm.common import by_batch, written
from cadenza.llm.components import components

BINS, SPAN = 12, 16  # pitch classes; frames in a window
#: Thresholds of the logarithm of an area's energy against the other's.
STEPS = (-0.25, 0.0, 0.25)
GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)
BLOCK = (256, 2048)  # queries and classes compared in a task
BLOCK_CODES = 1 << 17  # integers in a block, or one recording's
CELLS = 1 << 20  # numbers of an offset histogram held at a time
LINKED = "role string, class bigint, n bigint, votes bigint, bit_error double, frame_offset int, other bigint, link bigint"


def bank() -> list[tuple[int, int, int, int, int]]:
    """The 16 filters (kind, first class, classes, first frame, frames) by rule.

    Kinds in turn: lower against upper classes, earlier against later frames, the
    diagonal halves, the middle frames against the outer ones. Classes and frames
    go through their ranges with each round of kinds.
    """
    out = []
    for i in range(16):
        turn = i // 4
        height, width = (12, 6, 4, 8)[turn], (16, 8, 12, 4)[turn]
        out.append((i % 4, (5 * i) % (BINS - height + 1), height, (3 * i) % (SPAN - width + 1), width))
    return out


def pcm_frames(samples: np.ndarray, rate: int = 11025, size: int = 4096, hop: int = 1365) -> np.ndarray:
    """Pitch-class energies of windows of samples; frequencies from 28 Hz to 3520 Hz."""
    samples = np.nan_to_num(np.asarray(samples, dtype=np.float64), nan=0.0, posinf=0.0, neginf=0.0)
    if len(samples) < size:
        return np.zeros((0, BINS))
    windows = np.lib.stride_tricks.sliding_window_view(samples, size)[::hop] * np.hamming(size)
    power = np.abs(np.fft.rfft(windows, axis=1)) ** 2
    hertz = np.fft.rfftfreq(size, 1 / rate)
    use = np.flatnonzero((hertz >= 28) & (hertz <= 3520))
    pitch = np.round(12 * np.log2(hertz[use] / 440)).astype(int) % BINS
    out = np.zeros((len(windows), BINS))
    for c in range(BINS):
        out[:, c] = power[:, use[pitch == c]].sum(axis=1)
    return out


def contour_frames(hertz: np.ndarray) -> np.ndarray:
    """Pitch-class energies of a pitch contour, a value for each frame; no pitch at 0 or below. Shape (..., frames, 12)."""
    hertz = np.asarray(hertz, dtype=np.float64)
    voiced = np.isfinite(hertz) & (hertz > 0)
    pitch = 12 * np.log2(np.where(voiced, hertz, 440.0) / 440)
    low = np.floor(pitch)
    part = (pitch - low)[..., None]
    classes = np.arange(BINS)
    at = (low.astype(int) % BINS)[..., None]
    return np.where(voiced[..., None], (classes == at) * (1 - part) + (classes == (at + 1) % BINS) * part, 0.0)


def codes(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit integers of each window of SPAN frames, and whether the window has any energy. frames: (..., n, 12)."""
    n = frames.shape[-2] - SPAN + 1
    if n < 1:
        return np.zeros((*frames.shape[:-2], 0), dtype=np.uint32), np.zeros((*frames.shape[:-2], 0), dtype=bool)
    image = np.zeros((*frames.shape[:-2], frames.shape[-2] + 1, BINS + 1))
    image[..., 1:, 1:] = frames.cumsum(axis=-2).cumsum(axis=-1)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        row = lambda t, c: image[..., t : t + n, c]
        return row(t1, c1) - row(t0, c1) - row(t1, c0) + row(t0, c0)

    out = np.zeros((*frames.shape[:-2], n), dtype=np.uint32)
    for kind, c0, height, t0, width in bank():
        c1, t1, c, t = c0 + height, t0 + width, c0 + height // 2, t0 + width // 2
        whole = area(t0, t1, c0, c1)
        if kind == 0:
            one = area(t0, t1, c, c1)
        elif kind == 1:
            one = area(t, t1, c0, c1)
        elif kind == 2:
            one = area(t0, t, c0, c) + area(t, t1, c, c1)
        else:
            one = area(t0 + width // 4, t1 - width // 4, c0, c1)
        value = np.log((1e-3 + np.maximum(one, 0)) / (1e-3 + np.maximum(whole - one, 0)))
        out = (out << np.uint32(2)) | GRAY[np.searchsorted(STEPS, np.round(value, 9), side="right")]
    return out, area(0, SPAN, 0, BINS) > 1e-9


def fingerprints(recordings: DataFrame, id_col: str, column: str, to_frames) -> DataFrame:
    """Per row: id, codes (array of int, null for silent windows).

    to_frames: from numbers of some recordings of one length, a row each, to their
    frames (such as `contour_frames`; for samples, `pcm_frames` of each).
    """
    kind = recordings.schema[id_col].dataType.simpleString()

    def make():
        def batch(b: pa.RecordBatch) -> dict:
            rows = b.column(1).to_pylist()
            out: list = [[] for _ in rows]
            by_length: dict[int, list[int]] = {}
            for i, x in enumerate(rows):
                if x:
                    by_length.setdefault(len(x), []).append(i)
            for at in by_length.values():
                for k in range(0, len(at), 256):
                    part = at[k : k + 256]
                    got, sound = codes(to_frames(np.array([rows[i] for i in part], dtype=np.float64)))
                    values = np.where(sound, got.view(np.int32).astype(object), None).tolist()
                    for i, v in zip(part, values):
                        out[i] = v
            return {id_col: b.column(0), "codes": out}

        return batch

    return by_batch(recordings.select(id_col, column), f"`{id_col}` {kind}, codes array<int>", make)


class Recordings:
    """Integers of some recordings side by side, the shorter first: codes and has (whether there is one), a row each."""

    def __init__(self, lists: pa.Array):
        sizes = np.diff(lists.offsets.to_numpy())
        self.order = np.argsort(sizes, kind="stable")
        self.sizes = sizes[self.order]
        flat = lists.flatten()
        values = flat.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint32)
        there = np.asarray(flat.is_valid())
        at = np.arange(self.sizes.max(initial=0))
        inside = at < self.sizes[:, None]
        starts = (np.cumsum(sizes) - sizes)[self.order]
        place = np.where(inside, starts[:, None] + at, 0)
        self.has = inside & there[place] if len(flat) else inside
        self.codes = np.where(self.has, values[place], np.uint32(0)) if len(flat) else np.zeros(inside.shape, np.uint32)

    def runs(self, most: int) -> list[tuple[int, int]]:
        """Ranges of at most so many recordings whose lengths are within a factor of two."""
        scale = np.frexp(self.sizes.astype(np.float64))[1]
        cuts = [0, *(np.flatnonzero(np.diff(scale)) + 1).tolist(), len(scale)]
        return [(x, min(x + most, b)) for a, b in zip(cuts, cuts[1:]) for x in range(a, b, max(1, most))]

    def part(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        width = int(self.sizes[begin:end].max(initial=0))
        return self.codes[begin:end, :width], self.has[begin:end, :width]


def fast_length(n: int) -> int:
    """The least length from n on whose only factors are 2, 3 and 5."""
    best = 1 << max(n - 1, 0).bit_length()
    five = 1
    while five < best:
        three = five
        while three < best:
            best = min(best, three << max(-(-n // three) - 1, 0).bit_length())
            three *= 3
        five *= 5
    return best


def spectrum(codes: np.ndarray, has: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Transforms along time of each bit as 1 or -1 (0 without an integer), as (frequency, recording, bit), and of has."""
    kind = np.float32 if size <= 2048 else np.float64
    bits = np.unpackbits(codes.astype("<u4").view(np.uint8).reshape(*codes.shape, 4), axis=-1, bitorder="little")
    signs = np.where(has[..., None], 1 - 2 * bits.astype(np.int8), np.int8(0)).astype(kind)
    turn = lambda x: np.ascontiguousarray(np.moveaxis(np.fft.rfft(x, size, axis=1), 1, 0))
    return turn(signs), turn(has[..., None].astype(kind))


def histograms(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """For each of a and each of b (spectra), by offset modulo size: the agreeing less the differing votes."""
    return np.fft.irfft(np.conj(a) @ b.transpose(0, 2, 1), size, axis=0)


def alignments(asked: Recordings, others: Recordings, max_error: float, min_overlap: int) -> tuple[np.ndarray, ...]:
    """(i, j, offset, votes, error), as columns, of each of the asked and each of the others that align, at the best offset.

    An offset counts with at most max_error differing bits over min_overlap windows
    or more; the best has the most equal integers (votes), then the least error,
    then the least distance. Positions are those in the lists given.
    """
    found: list[tuple[np.ndarray, ...]] = []
    for a0, a1 in asked.runs(BLOCK[0]):
        a = asked.part(a0, a1)
        spectra: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b0, b1 in others.runs(len(others.sizes)):
            # offsets of less than min_overlap windows may fold onto others like them
            size = fast_length(max(1, a[0].shape[1] + int(others.sizes[b1 - 1]) - min_overlap))
            if min(a[0].shape[1], int(others.sizes[b1 - 1])) < min_overlap:
                continue
            if size not in spectra:
                spectra = {size: spectrum(*a, size)}
            step = max(1, CELLS // (size * (a1 - a0)))
            for b2 in range(b0, b1, step):
                i, j, *rest = _aligned(a, spectra[size], others.part(b2, min(b1, b2 + step)), size, max_error, min_overlap)
                if len(i):
                    found.append((asked.order[a0 + i], others.order[b2 + j], *rest))
    if not found:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int32, np.int64, np.float64))
    return tuple(np.concatenate(x) for x in zip(*found))


def _aligned(a, spectra, b, size: int, max_error: float, min_overlap: int) -> tuple[np.ndarray, ...]:
    (code_a, has_a), (code_b, has_b), (spec_a, mask_a) = a, b, spectra
    spec_b, mask_b = spectrum(code_b, has_b, size)
    pairs = len(code_a) * len(code_b)
    votes = histograms(spec_a, spec_b, size)
    whole = has_a.all() and has_b.all()
    windows = None if whole else np.round(histograms(mask_a, mask_b, size))
    hits = []
    for lo, hi in ((0, code_b.shape[1] - min_overlap + 1), (min_overlap - code_a.shape[1], 0)):  # offsets from 0 on stand first, those below 0 last
        if hi <= lo:
            continue
        offsets = np.arange(lo, hi)
        at = slice(lo, hi) if lo >= 0 else slice(size + lo, size + hi)
        if whole:
            overlap = (np.minimum(code_a.shape[1], code_b.shape[1] - offsets) - np.maximum(0, -offsets))[:, None, None]
            close = votes[at] >= ((1 - 2 * max_error) * 32 * overlap - 0.5).astype(votes.dtype)  # half a vote for rounding
        else:
            close = (votes[at] >= (1 - 2 * max_error) * 32 * windows[at] - 0.5) & (windows[at] >= min_overlap)
        k = np.flatnonzero(close)
        hits.append((offsets[k // pairs], k % pairs // len(code_b), k % len(code_b)))
    off, i, j = (np.concatenate(x) for x in zip(*hits)) if hits else (np.zeros(0, np.int64),) * 3
    equal, apart, windows = np.zeros(len(off), np.int64), np.zeros(len(off), np.int64), np.zeros(len(off), np.int64)
    step = max(1, CELLS // code_a.shape[1])
    for k in range(0, len(off), step):
        s = slice(k, k + step)
        place = np.arange(code_a.shape[1]) + off[s, None]
        inside = (place >= 0) & (place < code_b.shape[1])
        place = np.where(inside, place, 0)
        both = has_a[i[s]] & has_b[j[s, None], place] & inside
        differ = code_a[i[s]] ^ code_b[j[s, None], place]
        equal[s], windows[s] = ((differ == 0) & both).sum(axis=1), both.sum(axis=1)
        apart[s] = (np.bitwise_count(differ) * both).sum(axis=1, dtype=np.int64)
    error = apart / np.maximum(32 * windows, 1)
    ok = np.flatnonzero((error <= max_error) & (windows >= min_overlap))
    order = ok[np.lexsort((off[ok], np.abs(off[ok]), error[ok], -equal[ok], j[ok], i[ok]))]
    first = order[np.append(True, (i[order[1:]] != i[order[:-1]]) | (j[order[1:]] != j[order[:-1]]))] if len(order) else order
    return i[first], j[first], off[first].astype(np.int32), equal[first], error[first]


def fingerprint_classes(prints: DataFrame, id_col: str, every: int) -> tuple[DataFrame, DataFrame]:
    """(rows(id, class), classes(class, least, members, asked, first_asked, codes)): recordings of equal integers form a class."""
    every_code = F.transform("codes", lambda c: F.coalesce(c.cast("long"), F.lit(1 << 40)))  # a hash leaves nulls out
    rows = written(prints.select(F.col(id_col).alias("id"), "codes", F.xxhash64(every_code).alias("class")), "codes")
    asks = F.col("id") % every == 0
    classes = rows.groupBy("class").agg(F.min("id").alias("least"), F.count("*").alias("members"), F.count_if(asks).alias("asked"), F.min(F.when(asks, F.col("id"))).alias("first_asked"), F.first("codes").alias("codes"))
    return rows.select("id", "class"), written(classes, "classes")


def blocked(classes: DataFrame, rows: int, name: str) -> tuple[DataFrame, int]:
    """Classes with their integers as lists of about so many, and the number of lists."""
    n, codes = classes.agg(F.count("*"), F.coalesce(F.sum(F.size("codes")), F.lit(0))).first()
    n = max(1, -(-n // rows), -(-codes // BLOCK_CODES))
    block = F.pmod(F.xxhash64("class", F.lit(name)), F.lit(n)).cast("int")
    lists = classes.groupBy(block.alias(f"{name}_block")).agg(F.collect_list(F.struct("class", "members", "asked", "codes")).alias(name))
    return written(lists, f"blocks-{name}"), n


def align(prints: DataFrame, id_col: str, every: int = 50, max_error: float = 0.2, min_overlap: int = 16) -> DataFrame:
    """A row for each recording of prints(id, codes), queries being those whose id is divisible by `every`.

    Columns: id; class_id, the smallest id reachable over links (itself included);
    n_equal, the other recordings of the same integers (0 for one that aligns with nothing); n_links: of a query the
    other recordings that align with it, of another recording the queries that do;
    and of the best of these with other integers best_id (the smallest id of its
    class; of its class's queries, for a recording that is none), frame_offset
    (added to a window of the recording gives the partner's), votes (equal
    integers) and bit_error. Links are equal integers and alignments of queries.
    """
    rows, classes = fingerprint_classes(prints, id_col, every)
    # a class with fewer integers than the overlap links nothing, not even its equals
    windows = F.size(F.filter("codes", lambda c: c.isNotNull()))
    classes = classes.withColumn("sound", F.coalesce(windows >= min_overlap, F.lit(False)))
    sound = classes.where("sound").select("class", "members", "asked", "codes")
    b_blocks, n_b = blocked(sound, BLOCK[1], "b")
    a_blocks, n_a = blocked(sound.where("asked > 0"), BLOCK[0], "a")
    # each block of queries goes to each block of classes, a pair to a task
    pairs = b_blocks.withColumn("a_block", F.explode(F.sequence(F.lit(0), F.lit(n_a - 1)))).join(a_blocks.hint("shuffle_hash"), "a_block").select("a_block", "b_block", "a", "b")
    pairs = pairs.repartition(max(n_a * n_b, 1), "a_block", "b_block")

    schema = to_arrow_schema(StructType.fromDDL(LINKED))

    def run(batches):
        def out(role, own, n, votes, error, offset, other, link):
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((role, own, n, votes, error, offset, other, link), schema)], schema=schema)

        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (batch.column(batch.schema.get_field_index(c))[k].values for c in ("a", "b"))
                a_class, b_class = (x.field("class").to_numpy() for x in (a, b))
                i, j, offset, votes, error = alignments(Recordings(a.field("codes")), Recordings(b.field("codes")), max_error, min_overlap)
                for role, own, other, own_class, other_class, weight, sign in (("asks", i, j, a_class, b_class, b.field("members").to_numpy(), 1), ("asked", j, i, b_class, a_class, a.field("asked").to_numpy(), -1)):
                    times = np.bincount(own, weights=weight[other], minlength=len(own_class)).astype(np.int64)
                    there = np.flatnonzero(times)
                    best = np.full(len(own_class), -1)
                    new = np.flatnonzero(own_class[own] != other_class[other])
                    new = new[np.lexsort((sign * offset[new], np.abs(offset[new]), other_class[other[new]], error[new], -votes[new], own[new]))]
                    begins = new[np.append(True, own[new[1:]] != own[new[:-1]])] if len(new) else new
                    best[own[begins]] = begins
                    best = best[there]
                    at = lambda x, none=best < 0, best=best: pa.array(x[np.maximum(best, 0)] if len(x) else np.zeros(len(best), x.dtype), mask=none)
                    if len(there):
                        yield out([role] * len(there), own_class[there], times[there], at(votes), at(error), at(sign * offset), at(other_class[other] if len(other) else other), pa.nulls(len(there), pa.int64()))
                x, y = forest(a_class[i], b_class[j])
                if len(x):
                    yield out(["link"] * len(x), x, *(pa.nulls(len(x), schema.field(c).type) for c in ("n", "votes", "bit_error", "frame_offset", "other")), y)

    found = written(pairs.mapInArrow(run, LINKED), "aligned")
    linked = components(found.where("role = 'link'").select(F.col("class").alias("a"), F.col("link").alias("b")))
    named = classes.select("class", "least", "sound", "members", "first_asked").join(linked.withColumnRenamed("node", "class"), "class", "left")
    named = written(named.withColumn("component", F.coalesce("component", "class")), "named")
    least = written(named.groupBy("component").agg(F.min("least").alias("class_id")), "least")
    named = written(named.join(least, "component"), "classed")
    rank = F.struct((-F.col("votes")).alias("v"), F.col("bit_error").alias("e"), F.abs("frame_offset").alias("d"), F.col("frame_offset").alias("o"), F.col("other").alias("c"))
    counts = found.where("role <> 'link'").groupBy("role", "class").agg(F.sum("n").alias("n"), F.min(F.when(F.col("other").isNotNull(), rank)).alias("best"))
    partner = classes.select(F.col("class").alias("other"), F.col("least").alias("other_least"), "first_asked")
    best_id = F.when(F.col("role") == "asks", F.col("other_least")).otherwise(F.col("first_asked"))
    counts = counts.withColumn("other", F.col("best.c")).join(partner, "other", "left").select("role", "class", "n", "best", best_id.alias("best_id"))
    of = lambda role, p: written(counts.where(F.col("role") == role).select("class", F.col("n").alias(f"{p}_n"), F.col("best").alias(f"{p}_best"), F.col("best_id").alias(f"{p}_id")), role)
    info = written(named.drop("first_asked").join(of("asks", "q"), "class", "left").join(of("asked", "d"), "class", "left"), "info")
    out = rows.join(info, "class")
    asks = F.col("id") % every == 0
    either = lambda x: F.when(asks, F.col(f"q_{x}")).otherwise(F.col(f"d_{x}"))
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("sound"), F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        F.when(F.col("sound"), F.col("members") - 1).otherwise(0).alias("n_equal"),
        # a query's own class aligns with it too: it is not its own partner
        (F.coalesce(either("n"), F.lit(0)) - F.when(asks & F.col("sound"), 1).otherwise(0)).alias("n_links"),
        either("id").alias("best_id"),
        either("best")["o"].alias("frame_offset"),
        (-either("best")["v"]).alias("votes"),
        either("best")["e"].alias("bit_error"),
    )


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (x, y) that hold together what the links (a, b) do: a star for each component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if (root == before).all():
            break
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]
