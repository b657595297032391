"""Sharding by histogram sort, with shards of nearly equal bytes.

Rows are ordered by the hash of their text, so that equal texts stand together,
then by the hash of their id, then by their place in the written table: no two
keys are equal. Splitters are found by counting, in all partitions, the exact
bytes and rows below candidate keys, and drawing new candidates from the bracket
around each target until a splitter is within the tolerance or nothing lies in
its bracket. Then rows are exchanged once, by shard and by one of its pieces (a
hash of the key deals them), so no task holds a whole shard; the pieces' row
counts, summed up within the shard, tell where each piece's slots begin. A group
of equal texts as large as a third of all rows is split like anything else.

The driver holds the splitters of the shards, the counts below the candidates and
the candidates of each bracket, `PICKS` times 4 at most: tasks' candidates are
thinned out by bracket before they are gathered. None of these grow with the
rows, nor with the tasks.

Rows: null text has no bytes, a very long text is only measured; null ids are
ordered first; repeated rows get a slot each, and rows whose keys are equal in
all but their place are ordered by that; with fewer rows than shards some shards
are empty; an empty table gives an empty result; all columns are kept whatever
their names, but for those called shard and slot, which are replaced.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import free_name, tasks, total, written

WIDTH = 24  # bytes of a key
PICKS = 8  # candidates that a task draws from a bracket


def keys_of(batch: pa.RecordBatch) -> np.ndarray:
    """The three longs of a key as bytes that sort like them."""
    parts = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63) for i in range(3)]
    return np.ascontiguousarray(np.stack(parts, axis=1).astype(">u8")).view(f"V{WIDTH}").ravel()


def below(keys: np.ndarray, probes: list[bytes]) -> np.ndarray:
    """For each key, how many probes are not above it."""
    # a fixed width and no trailing zeros cut off: a last byte of one is appended
    wide = lambda x: np.frombuffer(b"".join(k + b"\x01" for k in x), dtype=f"S{WIDTH + 1}") if len(x) else np.zeros(0, f"S{WIDTH + 1}")
    return np.searchsorted(wide(probes), wide([k.tobytes() for k in keys]), side="right")


def counted(rows: DataFrame, probes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows below each probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, n = np.zeros(len(probes) + 1), np.zeros(len(probes) + 1, dtype=np.int64)
        for b in batches:
            at = below(keys_of(b), probes)
            size += np.bincount(at, weights=b.column(3).to_numpy(), minlength=len(size))
            n += np.bincount(at, minlength=len(n))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(size[used].astype(np.int64)), pa.array(n[used])], ["at", "size", "n"])

    got = rows.mapInArrow(run, "at bigint, size bigint, n bigint").groupBy("at").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
    size, n = np.zeros(len(probes) + 1, dtype=np.int64), np.zeros(len(probes) + 1, dtype=np.int64)
    for at, s, k in got.collect():
        size[at], n[at] = s, k
    return np.cumsum(size)[:-1], np.cumsum(n)[:-1]


def candidates(rows: DataFrame, brackets: list[tuple[bytes | None, bytes | None]]) -> list[bytes]:
    """Keys out of each bracket, evenly spaced in what the tasks found: 4 * PICKS of a bracket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[bytes]] = [[] for _ in brackets]
        for b in batches:
            keys = sorted(k.tobytes() for k in keys_of(b))
            for i, (lo, hi) in enumerate(brackets):
                begin = bisect.bisect_right(keys, lo) if lo is not None else 0
                end = bisect.bisect_left(keys, hi) if hi is not None else len(keys)
                if end > begin:
                    step = max(1, (end - begin) // PICKS)
                    kept[i] += keys[begin + step // 2 : end : step][: 2 * PICKS]
                    if len(kept[i]) > 64 * PICKS:
                        kept[i] = spaced(sorted(kept[i]), 32 * PICKS)
        out = [(i, k) for i, own in enumerate(kept) for k in spaced(sorted(own), PICKS)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int32()), pa.array([k for _, k in out], pa.binary())], ["bracket", "key"])

    def thin(keys):
        chosen = F.sequence(F.lit(0), F.least(F.size(keys), F.lit(4 * PICKS)) - 1)
        step = F.greatest(F.size(keys) / F.lit(4.0 * PICKS), F.lit(1.0))
        return F.transform(chosen, lambda i: keys[F.floor((i + 0.5) * step).cast("int")])

    found = rows.mapInArrow(run, "bracket int, key binary")
    # in two steps, so that no task gathers those of all tasks
    for part in (F.pmod(F.xxhash64("key"), F.lit(64)), F.lit(0)):
        keys = F.array_sort(F.collect_set("key"))
        found = found.groupBy("bracket", part.alias("part")).agg(keys.alias("keys")).select("bracket", F.explode(thin(F.col("keys"))).alias("key"))
    return sorted({bytes(r[0]) for r in found.select("key").distinct().collect()})


def spaced(keys: list[bytes], most: int) -> list[bytes]:
    """At most so many of sorted keys, evenly spaced."""
    step = len(keys) / most
    return keys if step <= 1 else [keys[int((i + 0.5) * step)] for i in range(most)]


def splitters(rows: DataFrame, targets: list[float], tolerance: float) -> tuple[list[bytes | None], list[int]]:
    """For each target, the key with about so many bytes below it (None: no row left), and the rows below it.

    rows(k1, k2, k3, size). A splitter is final if its bytes are within
    `tolerance` of the target, or no key lies between the nearest ones counted.
    """
    (everything, n_all) = total(rows, F.sum("size"), F.count("*"))
    known: dict[bytes | None, tuple[int, int]] = {None: (everything, n_all)}  # None: behind the last row
    order: list[bytes] = []
    while True:
        sizes = [known[k][0] for k in order] + [everything]
        open_, chosen = [], []
        for t in targets:
            i = bisect.bisect_left(sizes, t)
            lo, hi = (order[i - 1] if i else None), (order[i] if i < len(order) else None)
            (lo_size, lo_n) = known[lo] if i else (0, 0)
            hi_size, hi_n = known[hi]
            near = (lo, lo_size, lo_n) if i and t - lo_size <= hi_size - t else (hi, hi_size, hi_n)
            chosen.append((near[0], near[2]))
            # a key stands at its own row: rows strictly between are those from lo's row on, less lo's own
            if abs(near[1] - t) > tolerance and hi_n - lo_n > (1 if i else 0):
                open_.append((lo if i else None, hi))
        if not open_:
            return [k for k, _ in chosen], [n for _, n in chosen]
        new = [k for k in candidates(rows, sorted(set(open_), key=lambda x: (x[0] or b"", x[1] or b"\xff" * 25))) if k not in known]
        if not new:
            return [k for k, _ in chosen], [n for _, n in chosen]
        size, n = counted(rows, new)
        known |= {k: (int(s), int(c)) for k, s, c in zip(new, size, n)}
        order = sorted(k for k in known if k is not None)


def histogram_sort(df: DataFrame, shards: int, size_col: str, text_hash: str, id_col: str, tolerance: float = 0.001, piece_rows: int = 250_000) -> DataFrame:
    """df with shard (0 to shards - 1) and slot (gapless from 0 in the shard): ranges of the order with about equal sums of size_col.

    text_hash: a long column, equal for equal texts. tolerance: of a shard's share.
    """
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    k1, k2, k3, size, shard, piece, base = (free_name(df, n) for n in ("k1", "k2", "k3", "size_", "shard", "piece", "base"))
    key = {k1: F.coalesce(F.col(text_hash), F.lit(0)).cast("long"), k2: F.when(F.col(id_col).isNull(), F.lit(-(1 << 63))).otherwise(F.xxhash64(F.col(id_col).cast("string"))), k3: F.monotonically_increasing_id(), size: F.col(size_col).cast("long")}
    table = written(df.withColumns(key), "keys")
    rows = table.select(k1, k2, k3, F.col(size).alias("size"))
    everything, n = total(rows, F.sum("size"), F.count("*"))
    share = everything / shards
    found, _ = splitters(rows, [share * i for i in range(1, shards)], tolerance * share) if n else ([], [])
    keys = [k for k in found if k is not None]
    shipped = df.sparkSession.sparkContext.broadcast(keys)  # one for each shard

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = below(keys_of(b.select([k1, k2, k3])), shipped.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], [*b.schema.names, shard])

    from pyspark.sql.types import IntegerType, StructField, StructType

    pieces = max(4, -(-n // (shards * piece_rows)))
    placed = table.mapInArrow(place, StructType([*table.schema.fields, StructField(shard, IntegerType())]))
    placed = placed.withColumn(piece, F.pmod(F.xxhash64(k1, k2, k3), F.lit(pieces)).cast("int"))
    before = Window.partitionBy(shard).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(shard, piece).agg(F.count("*").alias("rows")).select(shard, piece, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias(base))
    slot = F.row_number().over(Window.partitionBy(shard, piece).orderBy(k1, k2, k3)) - 1
    out = placed.repartition(tasks(df, n, piece_rows), shard, piece).withColumn(k1, slot)
    return out.join(written(starts, "starts"), [shard, piece]).select(*kept, F.col(shard).alias("shard"), (F.col(k1) + F.col(base)).cast("long").alias("slot"))


def sharded(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null): docs in shards of about equal bytes."""
    text = F.col(text_col).cast("string")
    digest = docs.select(
        id_col,
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("__text"),
    )
    out = histogram_sort(digest, shards, "size", "__text", id_col)
    return out.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
