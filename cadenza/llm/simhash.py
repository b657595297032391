"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint bit is 1 if it is set in over half of the hashes of the text's
word shingles (repeats included). Distinct fingerprints meet in buckets of equal
bits (bands). There they stand as bit planes: one machine word holds a bit of 64
fingerprints. A query's bits are taken off the planes one plane after the other,
carry-save adders count the differing bits of 64 pairs at a time, and a word
whose 64 counts all exceed the radius is abandoned. Of the links in a bucket
only a spanning forest leaves the task, so a group of k copies yields k rows.

With 64 bits and radius r the bits are cut into b > r blocks; one of the
combinations of b - r blocks is equal then, which makes the search exact. More
rows take more and shorter blocks, so that keys grow longer and buckets stay
small (4 keys of 16 bits up to 4 million rows, 10 of 26 up to 2 billion, ...).
Wider fingerprints
are for similarity, and made of distinct shingles: the share of equal bits
estimates the cosine of two sets. Such sets meet in buckets of equal hashes: at
the threshold or above they share one of the smallest hashes of each (`prefix`).
Fingerprints only propose, by a radius that no such pair exceeds; within the
components of the proposed links the sets themselves are compared.

Rows: a null text is empty; texts without words have fingerprint zero and are
linked like any other; texts of fewer words than a shingle have their whole word
sequence as the one shingle; repeated rows each get a row. Columns beside the id
and the text are not read. A null id is never a component's id.

A bucket's rows are counted first, which gathers one number a task. Buckets beyond
`CHUNK` rows are dealt into chunks, and each chunk and each pair of chunks is
compared in a group of its own, so no bucket is held in one place.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import by_batch, free_name, tasks, text_or_empty, total, written
from cadenza.llm.components import components

SEED = 42
BUFFER = 1 << 15  # rows whose buckets are compared together
CHUNK = 1 << 13  # the largest bucket that isn't cut, and the rows of a chunk
FULL_BUCKET = 1 << 6  # rows that strangers make in a bucket, above which keys grow longer
SETS = 1 << 12  # shingle sets compared together
ENTRIES = 1 << 15  # words of 64 pairs counted side by side
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: str, size: int) -> list[bytes]:
    """Runs of `size` words of a text in lower-case A-Z, joined by blanks; fewer words: all of them; none: nothing."""
    words = text.encode().lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    return [joined[a:b] for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())]


def shingle_set(text: str, size: int) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending."""
    import xxhash

    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, size)], dtype=np.uint64))


def fingerprint(text: str, size: int, words: int) -> tuple[bytes, int]:
    """A fingerprint of 64 * words bits, most significant first, and the number of shingles."""
    import xxhash

    return majority([xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, size)], words)


def majority(hashes, words: int) -> tuple[bytes, int]:
    """The fingerprint of shingle hashes, and their number."""
    n = len(hashes)
    if not n:
        return bytes(8 * words), 0
    h = np.array(hashes, dtype=np.uint64)
    if words > 1:  # further words by a finaliser on the hash and the word's number
        x = h[:, None] + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = x ^ (x >> np.uint64(31))
        h[:, 0] = hashes
    raw = h.reshape(n, words).astype(">u8").view(np.uint8)
    counts = np.zeros(64 * words, dtype=np.int64)
    for i in range(0, n, 255):  # sums of 255 bits fit a byte
        counts += np.unpackbits(raw[i : i + 255], axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > n).tobytes(), n


def fingerprints(docs: DataFrame, size: int, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, row (hash of id and text), fp (binary), n (shingles), node (the fingerprint as a long)."""
    import xxhash

    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def batch(b: pa.RecordBatch) -> dict:
            got = [fingerprint(t, size, words) for t in b.column(2).to_pylist()]
            nodes = [f if words == 1 else xxhash.xxh64_digest(f, SEED) for f, _ in got]
            return {id_col: b.column(0), "row": b.column(1), "fp": [f for f, _ in got], "n": np.array([n for _, n in got], dtype=np.int32), "node": np.frombuffer(b"".join(nodes), dtype=">i8").astype(np.int64)}

        return batch

    rows = docs.select(id_col, row_key(docs, id_col, text_col).alias("row"), text_or_empty(text_col).alias("t"))
    return by_batch(rows, f"`{id_col}` {kind}, row bigint, fp binary, n int, node bigint", make)


def set_prints(docs: DataFrame, size: int, words: int, jaccard: float, id_col: str, text_col: str) -> DataFrame:
    """As `fingerprints`, of distinct shingles; node is a hash of their set.

    prefix: the set's smallest hashes, so many that sets at jaccard or more have
    one of them in common (such sets share ceil(jaccard * n) at least).
    """
    import xxhash

    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def batch(b: pa.RecordBatch) -> dict:
            sets = [shingle_set(t, size) for t in b.column(2).to_pylist()]
            got = [majority(x, words) for x in sets]
            nodes = [xxhash.xxh64_digest(x.tobytes(), SEED) for x in sets]
            heads = [x[: len(x) - math.ceil(jaccard * len(x) - 1e-9) + 1].view(np.int64) for x in sets]
            return {id_col: b.column(0), "row": b.column(1), "fp": [f for f, _ in got], "n": np.array([n for _, n in got], dtype=np.int32), "node": np.frombuffer(b"".join(nodes), dtype=">i8").astype(np.int64), "prefix": heads}

        return batch

    rows = docs.select(id_col, row_key(docs, id_col, text_col).alias("row"), text_or_empty(text_col).alias("t"))
    return by_batch(rows, f"`{id_col}` {kind}, row bigint, fp binary, n int, node bigint, prefix array<bigint>", make)


def row_key(docs: DataFrame, id_col: str, text_col: str):
    return F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")), docs[id_col].cast("string"))


def planes_of(fps: np.ndarray) -> np.ndarray:
    """uint8 rows of fingerprints -> bit planes: a row for each bit, a 64-bit word for each 64 fingerprints."""
    lanes = -(-len(fps) // 64) * 64
    bits = np.unpackbits(fps, axis=1)
    bits = np.vstack([bits, np.zeros((lanes - len(fps), bits.shape[1]), np.uint8)])
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


class Counters:
    """Counts of 64 lanes a word, a bit of the count in each level, summed by carry-save adders."""

    def __init__(self):
        self.held: list[list[np.ndarray]] = []

    def add(self, x: np.ndarray, level: int = 0) -> None:
        while True:
            if level == len(self.held):
                self.held.append([])
            held = self.held[level]
            held.append(x)
            if len(held) < 3:
                return
            a, b, c = held
            ab = a ^ b
            held[:] = [ab ^ c]
            x, level = (a & b) | (ab & c), level + 1

    def over(self, limit: int) -> np.ndarray:
        """Lanes whose count exceeds limit."""
        bits, carries = [], []
        for held in self.held:
            own, carries = [*held, *carries], []
            while len(own) > 1:
                if len(own) > 2:
                    a, b, c = own[:3]
                    own = [a ^ b ^ c, *own[3:]]
                    carries.append((a & b) | ((a ^ b) & c))
                else:
                    a, b = own
                    own = [a ^ b]
                    carries.append(a & b)
            bits.append(own[0])
        while carries:
            own, carries = carries, []
            while len(own) > 1:
                a, b, *rest = own
                own = [a ^ b, *rest]
                carries.append(a & b)
            bits.append(own[0])
        more, same = np.zeros_like(bits[0]), np.full_like(bits[0], FULL)
        for level in range(max(len(bits), limit.bit_length()) - 1, -1, -1):
            bit = bits[level] if level < len(bits) else np.zeros_like(more)
            if limit >> level & 1:
                same = same & bit
            else:
                more = more | (same & bit)
                same = same & ~bit
        return more

    def keep(self, which: np.ndarray) -> None:
        self.held = [[x[which] for x in held] for held in self.held]


def close_pairs(fps: np.ndarray, first: np.ndarray, last: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of fps that differ in radius bits at most, for each i those with first[i] <= j < last[i]."""
    planes, bits = planes_of(fps), np.unpackbits(fps, axis=1).T.copy()
    asks = np.flatnonzero(last > first)
    lo, hi = first[asks] >> 6, (last[asks] + 63) >> 6
    ends = np.cumsum(hi - lo)
    steps = sorted({*range(16, len(planes), 16 if len(planes) <= 64 else 64), len(planes)} | ({8} if radius < 4 else set()))
    begin = 0
    while begin < len(asks):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + ENTRIES, side="right")))
        q, words = asks[begin:stop], hi[begin:stop] - lo[begin:stop]
        query = np.repeat(q, words)
        word = np.arange(words.sum()) - np.repeat(np.cumsum(words) - words - lo[begin:stop], words)
        begin = stop
        # lanes of the word that the query asks for
        down = np.clip(first[query] - word * 64, 0, 64)
        up = np.clip(last[query] - word * 64, 0, 64)
        ask = low_bits(up) & ~low_bits(down)
        counters, at = Counters(), 0
        for step in steps:
            for p in range(at, step):
                counters.add(planes[p][word] ^ (np.uint64(0) - bits[p][query].astype(np.uint64)))
            at = step
            ask &= ~counters.over(radius)
            live = ask != 0
            alive = np.count_nonzero(live)
            if not alive:
                break
            if alive < 0.7 * len(live):  # abandon the words where all exceed the radius
                query, word, ask = query[live], word[live], ask[live]
                counters.keep(live)
        if ask.any():
            live = np.flatnonzero(ask)
            lanes = np.unpackbits(ask[live].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            e, lane = np.nonzero(lanes)
            yield query[live[e]], word[live[e]] * 64 + lane


def low_bits(n: np.ndarray) -> np.ndarray:
    """Words with the n lowest bits set, n from 0 to 64."""
    return np.where(n >= 64, FULL, (np.uint64(1) << (n & 63).astype(np.uint64)) - np.uint64(1))


class Rule:
    """Which fingerprints are linked, and the bands that bring them together."""

    def __init__(self, words: int, radius: int, bands: list[np.ndarray], jaccard: float | None = None):
        self.words, self.radius, self.bands, self.jaccard = words, radius, bands, jaccard

    @classmethod
    def within(cls, radius: int, rows: int = 0) -> "Rule":
        """64 bits, at most radius of them different: exact, as one combination of blocks is equal then."""
        blocks = radius + 1
        while rows > FULL_BUCKET << (64 * (blocks - radius) // blocks) and blocks < 16:
            blocks += 1
        parts = np.array_split(np.arange(64), blocks)
        return cls(1, radius, [np.concatenate(x) for x in itertools.combinations(parts, blocks - radius)])

    @classmethod
    def near(cls, jaccard: float, words: int) -> "Rule":
        """Sets that may be similar: fingerprints at most 0.3 of their bits apart, sizes in proportion.

        At 0.8, a bit differs with probability 0.1875 at most (4 shingles against
        the same and one more; ties count as 0), 0.15 in long texts; of 1024 bits
        over 307 differ with probability 2e-18 then.
        """
        return cls(words, math.floor(64 * words * 0.3), [], jaccard)

    def linked(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Of pairs within the radius, those that the rule links."""
        if self.jaccard is None:
            return np.ones(len(a), dtype=bool)
        return np.minimum(n_a, n_b) / np.maximum(np.maximum(n_a, n_b), 1) >= self.jaccard


def forest(rule: Rule, nodes, fps, sizes, first, last) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows as (node, node of the smallest row linked with it by any path)."""
    root = np.arange(len(nodes))
    for i, j in close_pairs(fps, first, last, rule.radius):
        ok = rule.linked(fps[i], fps[j], sizes[i], sizes[j])
        i, j = i[ok], j[ok]
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    moved = np.flatnonzero(root != np.arange(len(root)))
    return nodes[moved], nodes[root[moved]]


def binary(rows: np.ndarray) -> pa.Array:
    """uint8 rows as a binary column."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of equal lengths as uint8 rows."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def in_bands(distinct: DataFrame, rule: Rule) -> DataFrame:
    """distinct(node, fp, n) -> (bucket, node, fp, n): a row for each band."""

    def make():
        def batch(b: pa.RecordBatch) -> dict:
            fps = matrix(b.column(1), 8 * rule.words)
            bits = np.unpackbits(fps, axis=1)
            keys = []
            for band, at in enumerate(rule.bands):
                key = np.full(len(fps), band, dtype=np.uint64)
                for i in range(0, len(at), 32):
                    part = bits[:, at[i : i + 32]].astype(np.uint64) @ (np.uint64(1) << np.arange(len(at[i : i + 32]), dtype=np.uint64))
                    key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band)
                    key ^= key >> np.uint64(29)
                keys.append(key)
            k = len(rule.bands)
            return {"bucket": np.concatenate(keys).view(np.int64) if len(fps) else [], "node": np.tile(b.column(0).to_numpy(), k), "fp": binary(np.tile(fps, (k, 1))), "n": np.tile(b.column(2).to_numpy(), k)}

        return batch

    return by_batch(distinct.select("node", "fp", "n"), "bucket bigint, node bigint, fp binary, n int", make)


def dealt(rows: DataFrame) -> DataFrame:
    """(bucket, node, ...) -> the same with i, j and side, without buckets of a single row.

    A bucket of several chunks comes as each chunk (i = j) and as each pair of
    chunks (i < j, side 0 and 1).
    """
    counts = written(rows.groupBy("bucket").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "shared")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    out = rows.join(counts, "bucket").withColumn("chunk", chunk)
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return out.select(*rows.columns, F.least("chunk", "other").cast("long").alias("i"), F.greatest("chunk", "other").cast("long").alias("j"), (F.col("chunk") > F.col("other")).cast("int").alias("side"))


def prefix_links(nodes: DataFrame, rule: Rule) -> DataFrame:
    """nodes(node, fp, n, prefix) -> edges (a, b): enough of the links of nodes with a hash of their prefixes in common."""
    n = tasks(nodes, int(total(nodes, F.sum(F.size("prefix")))[0]), 1 << 20)
    shared = written(dealt(nodes.select(F.explode("prefix").alias("bucket"), "node")), "dealt")
    return compared(shared.join(nodes.select("node", "fp", "n"), "node"), rule, n)


LINKS = "a bigint, b bigint"
KEYS = ["bucket", "i", "j"]


def compare_buckets(rows: DataFrame, rule: Rule, sides: bool) -> DataFrame:
    """(*KEYS, side, node, fp, n) -> links (a, b) of rows with the same keys, which come sorted within partitions.

    sides: rows are compared only with those of the other side.
    """
    width = 8 * rule.words

    def flush(key, side, node, fps, n):
        begins = np.append(True, np.any(key[1:] != key[:-1], axis=1))
        starts = np.flatnonzero(begins)
        group = np.cumsum(begins) - 1
        ends = np.append(starts[1:], len(key))[group]
        if sides:  # sorted by side within the group
            second = starts + np.bincount(group, weights=side == 0).astype(np.int64)
            first = np.where(side == 0, second[group], ends)
        else:
            first = np.arange(1, len(key) + 1)
        a, b = forest(rule, node, fps, n, first, ends)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                cols = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
                part = (np.stack([cols[k].to_numpy() for k in KEYS], axis=1), cols["side"].to_numpy(), cols["node"].to_numpy(), matrix(cols["fp"], width), cols["n"].to_numpy())
                rest = part if rest is None else tuple(np.concatenate(x) for x in zip(rest, part))
            if rest is None or not len(rest[0]) or len(rest[0]) < BUFFER and batch is not None:
                continue
            # the groups that are complete; one has two chunks at most
            same = (rest[0] == rest[0][-1]).all(axis=1)
            end = len(same) if batch is None else 0 if same.all() else len(same) - int(np.argmin(same[::-1]))
            if end:
                yield from flush(*(x[:end] for x in rest))
                rest = tuple(x[end:] for x in rest)

    return rows.mapInArrow(run, LINKS)


def compared(rows: DataFrame, rule: Rule, n: int) -> DataFrame:
    """The links of `dealt` rows, in n tasks."""
    within = rows.where("i = j").repartition(n, *KEYS).sortWithinPartitions(*KEYS)
    across = rows.where("i < j").repartition(n, *KEYS).sortWithinPartitions(*KEYS, "side")
    columns = [*KEYS, "side", "node", "fp", "n"]
    return compare_buckets(within.select(columns), rule, False).unionByName(compare_buckets(across.select(columns), rule, True))


def links(distinct: DataFrame, rule: Rule, rows: int) -> DataFrame:
    """distinct(node, fp, n) -> edges (a, b): enough of the links that every component holds together."""
    bands = written(in_bands(distinct, rule), "bands")
    return compared(dealt(bands), rule, tasks(distinct, rows * len(rule.bands), 1 << 20))


def similar(x: np.ndarray, sizes: np.ndarray, n: int, jaccard: float) -> np.ndarray:
    """Whether sets with x hashes in common with one of n are that similar to it."""
    return x / np.maximum(sizes + n - x, 1) >= jaccard


def exact_forest(sets: list[np.ndarray], jaccard: float) -> tuple[list[int], list[int]]:
    """Links (i, j) that hold together the sets joined over pairs at jaccard or more.

    A search from set to set: each is counted against those not reached yet by the
    lists of the sets that hold its hashes, which are made anew as half are reached.
    """
    sizes = np.array([len(x) for x in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    of = np.repeat(np.arange(len(sets)), sizes)
    own = np.split(code, np.cumsum(sizes)[:-1])
    out_a: list[int] = []
    out_b: list[int] = []
    free = np.ones(len(sets), dtype=bool)
    indexed = 0
    for seed in range(len(sets)):
        if not free[seed]:
            continue
        free[seed] = False
        stack = [seed]
        while stack and free.any():
            live = np.count_nonzero(free)
            if not indexed or 2 * live < indexed:
                at = free[of]
                order = np.argsort(code[at], kind="stable")
                holders, indexed = of[at][order], live
                begins = np.append(0, np.cumsum(np.bincount(code[at], minlength=code.max() + 1)))
            x = stack.pop()
            first, count = begins[own[x]], begins[own[x] + 1] - begins[own[x]]
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - first, count)
            shared = np.bincount(holders[place], minlength=len(sets))
            near = np.flatnonzero(free & similar(shared, sizes, sizes[x], jaccard))
            free[near] = False
            out_a += [x] * len(near)
            out_b += near.tolist()
            stack += near.tolist()
    return out_a, out_b


def exact_links(candidates: DataFrame, sets: DataFrame, jaccard: float) -> DataFrame:
    """candidates(node, component), sets(node, hashes) -> edges (a, b): nodes of a component joined over pairs at jaccard or more.

    Components beyond `SETS` nodes are dealt into chunks, and each pair of chunks is a group of its own.
    """
    chunks = candidates.groupBy("component").agg(F.ceil(F.count("*") / SETS).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    rows = candidates.join(chunks, "component").select("node", "component", "chunks", chunk.alias("chunk"))
    other = F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.array_except(F.sequence(F.lit(0), F.col("chunks") - 1), F.array("chunk"))))
    rows = rows.select("node", "component", "chunk", other.alias("other")).select("node", "component", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))

    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        a, b = exact_forest([np.frombuffer(x, dtype="<u8") for x in table.column("hashes").to_pylist()], jaccard)
        return pa.table({"a": nodes[a].astype(np.int64), "b": nodes[b].astype(np.int64)})

    return rows.join(sets, "node").groupBy("component", "i", "j").applyInArrow(run, "a bigint, b bigint")


def sets_of(docs: DataFrame, prints: DataFrame, candidates: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(node, hashes): the shingle sets of the candidates, from one text of each."""
    one = prints.join(candidates, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row"))
    texts = docs.select(row_key(docs, id_col, text_col).alias("row"), text_or_empty(text_col).alias("t"))
    texts = texts.join(written(one, "texts").hint("shuffle_hash"), "row").select("node", "t")

    def make():
        def batch(b: pa.RecordBatch) -> dict:
            return {"node": b.column(0), "hashes": [shingle_set(t, size).tobytes() for t in b.column(1).to_pylist()]}

        return batch

    return written(by_batch(texts, "node bigint, hashes binary", make).dropDuplicates(["node"]), "sets")


def groups(prints: DataFrame, links_of: Callable[[DataFrame, int], DataFrame], id_col: str) -> DataFrame:
    """prints (written) with component: the smallest id reachable over the links of distinct nodes and their number."""
    more = [F.first(c).alias(c) for c in prints.columns if c == "prefix"]
    distinct = written(prints.groupBy("node").agg(F.min("fp").alias("fp"), F.min("n").alias("n"), F.min(id_col).alias("least"), *more), "nodes")
    rows = distinct.count()
    found = components(links_of(distinct, rows))
    named = distinct.select("node", "least").join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("c"))
    named = written(named, "named")
    # written, so that both sides of the join are plain exchanges and a large class can be split
    best = written(named.groupBy("c").agg(F.min("least").alias("component_id")), "best")
    of_node = written(named.join(best, "c").select("node", "component_id", F.col("c").alias("class")), "classes")
    return prints.join(of_node, "node")


def simhash_components(docs: DataFrame, size: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fingerprint (64 bits in hex), component_id, links over at most `radius` differing bits."""
    prints = written(fingerprints(docs, size, 1, id_col, text_col), "prints")
    out = groups(prints, lambda nodes, rows: links(nodes, Rule.within(radius, rows), rows), id_col)
    return out.select(id_col, F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def without_near_copies(docs: DataFrame, size: int = 5, jaccard: float = 0.8, words: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies, all columns: the one with the smallest id.

    Texts are near copies if the Jaccard similarity of their sets of shingles is
    jaccard or more; groups are the components of these links. Fingerprints of
    the sets, 64 * words bits, only say which texts are compared.
    """
    prints = written(set_prints(docs, size, words, jaccard, id_col, text_col), "prints")

    def links_of(nodes: DataFrame, rows: int) -> DataFrame:
        candidates = components(prefix_links(nodes, Rule.near(jaccard, words)))
        return exact_links(candidates, sets_of(docs, prints, candidates, size, id_col, text_col), jaccard)

    grouped = groups(prints, links_of, id_col)
    # null ids come last; of rows with one id the text's hash decides
    order = F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("id"), "row")
    kept = grouped.groupBy("class").agg(F.min(order)["row"].alias("row")).select("row")
    times = prints.groupBy("row").agg(F.count("*").alias("times"))
    kept = written(kept.join(times, "row"), "kept")
    key = free_name(docs, "row")
    keyed = docs.withColumn(key, row_key(docs, id_col, text_col))
    once = kept.where("times = 1").select(F.col("row").alias(key)).hint("shuffle_hash")
    out = keyed.join(once, key, "left_semi")
    again = kept.where("times > 1").select(F.col("row").alias(key))
    if not again.isEmpty():
        out = out.unionByName(keyed.join(again.hint("shuffle_hash"), key, "left_semi").dropDuplicates([key]))
    return out.select(*docs.columns)
