"""LM scoring: a Katz backoff model of word triples, counted and looked up in partitions.

Tokens are runs without ASCII white space, A-Z in lower case, then one end. The
probability of a token w after u, v (a start stands before the first token, whose
context is the start alone) is, recursively,

    P(w | u, v) = d3(c(u,v,w)) c(u,v,w) / c(u,v)    if the training texts hold the triple,
                = a(u,v) P(w | v)                   else; a(u,v) = 1 if they don't hold u, v,
    P(w | v)    = d2(c(v,w)) c(v,w) / c(v)          if they hold the pair,
                = a(v) P(w)                         else; a(v) = 1 if they don't hold v,
    P(w)        = d1(c(w)) c(w) / N                 if they hold w,
                = what that leaves                  else: all words never seen are one class.

d(r) for r up to 5 is the Good-Turing ratio with Katz's correction, from the
counts of counts of the whole training part (a ratio outside of (0, 1) becomes
(r - 0.5) / r); larger counts keep TRUSTED of themselves, so that every context
leaves something. Backoff weights are normalised exactly: what the seen words of
a context leave, over what the lower order leaves without them.

Plan. The texts are cut once into blocks of some million tokens, a table of their
own: the words' hashes and the tokens as places among them. What a block holds
distinct of each order is counted in exchanges: a block sends its n-grams, each
once with its count, packed, to buckets; a bucket adds up the blocks' counts and
answers each block in the block's own order. So words get their counts and
numbers (1), then pairs and triples theirs (2), and contexts that some text backs
off from their weights (3). The answers are tables partitioned by block, the same
way as the blocks, so they meet without moving the tokens; with them a block
evaluates the recursion for each of its tokens. No exchange sends tokens one by
one, and what is sent grows as the texts.

A bucket gets n-grams by a hash of their context; contexts that may occur HOT times
are spread over buckets by the last word. The same n-gram comes at most once from
a block. A weight's sums come from the first block that holds an n-gram, by
context summed up, for contexts in use.

The driver holds a few numbers: tokens, words, counts of counts.

Rows: a null text is empty (one end token); a null id trains (its crc32 counts as
0); repeated rows count and are scored each on its own; a text longer than a block
is a block of its own, whole in its task; without training texts every probability
is that of the unknown class, which is then 1; an empty table gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import slices, text_or_empty, total
from cadenza.sources.scratch import fresh

LOW = 5  # counts up to this one are discounted by Good-Turing
TRUSTED = 0.999  # what larger counts keep
BLOCK_TOKENS, BLOCK_DOCS = 850_000, 100_000
BUCKET_ROWS = 800_000  # n-grams of blocks that a bucket gets, about
PARTS = 4  # of the tables by block, for each partition of the texts: a block or none in most
HOT = 1_000_000  # occurrences of a context whose n-grams share a bucket
END = np.uint64(2)  # no word hashes to it but by chance of 2^-63
RANKS = 2 * (LOW + 1)  # numbers summed up for a weight

BLOCKS = "block bigint, ids array<string>, held array<boolean>, sizes binary, words binary, counts binary, tokens binary, n_words bigint, n_tokens bigint, n_starts bigint"
ASKED = pa.schema([("q", pa.int32()), ("block", pa.int64()), ("blob", pa.binary())])
#: kind: what the blob has; block: whose it is, below 0 for a bucket's counts of counts.
ANSWERS = "kind string, block bigint, q int, blob binary"
ANSWERED = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("q", pa.int32()), ("blob", pa.binary())])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; the bytes of a number's places stand together."""
    import zstandard

    parts = [(a.dtype.str, np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"") for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(parts, protocol=5))


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    out = []
    for kind, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(data)):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(width, -1).T).view(kind).ravel() if raw else np.zeros(0, dtype=kind))
    return out


def smallest(a: np.ndarray) -> np.ndarray:
    """a, not negative, in the narrowest unsigned type."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def steps(a: np.ndarray) -> np.ndarray:
    """Ascending numbers as differences."""
    return np.diff(a, prepend=a.dtype.type(0))


def climbs(a: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Numbers that ascend from each start to the next, as differences; at a start as they are."""
    out = np.diff(a, prepend=a.dtype.type(0))
    out[starts] = a[starts]
    return out


def climbed(d: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers that `climbs` made differences of."""
    total = np.cumsum(d)
    return total - np.repeat(total[starts] - d[starts], sizes)


def distinct(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, ascending; which of them each is; one place of each)."""
    order = np.argsort(code)
    ordered = code[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(code)]
    of = np.empty(len(code), dtype=np.int32 if len(code) < 1 << 31 else np.int64)
    of[order] = np.cumsum(new) - 1
    return ordered[new], of, order[new]


def mixed(gid: np.ndarray) -> np.ndarray:
    """A hash of words' numbers."""
    h = gid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(11)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the one before."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def discounts(of_counts: dict[int, int]) -> np.ndarray:
    """d(1) .. d(LOW) from how many n-grams have which count, and TRUSTED for all above."""
    n = [of_counts.get(r, 0) for r in range(LOW + 2)]
    cut = (LOW + 1) * n[LOW + 1] / n[1] if n[1] else 1.0
    out = []
    for r in range(1, LOW + 1):
        d = ((r + 1) * n[r + 1] / n[r] / r - cut) / (1 - cut) if n[r] and cut < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return np.array([*out, TRUSTED])


def kept(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted counts, for counts of 1 or more."""
    return d[np.minimum(c, LOW + 1) - 1] * c


class Numbers(dict):
    """Words and their numbers from 1 on, in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


class Cutter:
    """Texts side by side, until they make a block."""

    def __init__(self):
        self.words = Numbers()
        self.tokens: list[np.ndarray] = []
        self.ids: list = []
        self.held: list[bool] = []
        self.n = 0

    def add(self, key, held: bool, text: str) -> None:
        words = text.encode().lower().split()
        self.tokens += [np.fromiter(map(self.words.__getitem__, words), dtype=np.int64, count=len(words)), np.zeros(1, np.int64)]
        self.ids.append(key)
        self.held.append(held)
        self.n += len(words) + 1

    def row(self, block: int) -> list:
        import xxhash

        hashes = np.array([int(END), *(xxhash.xxh64_intdigest(w) for w in self.words)], dtype=np.uint64)
        order = np.argsort(hashes)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        tokens = place[np.concatenate(self.tokens)]
        sizes = np.array([len(t) + 1 for t in self.tokens[::2]])
        trains = ~np.repeat(np.array(self.held), sizes)
        counts = np.bincount(tokens[trains], minlength=len(order))
        return [block, self.ids, self.held, pack(smallest(sizes)), pack(steps(hashes[order])), pack(smallest(counts)), pack(smallest(tokens)), len(order), len(tokens), int((~np.array(self.held)).sum())]


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, held, t) -> blocks."""
    from pyspark import TaskContext

    kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.bool_()), *[pa.binary()] * 4, *[pa.int64()] * 3]
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    number, cutter = TaskContext.get().partitionId() << 32, Cutter()
    flush = lambda: pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(cutter.row(number), kinds)], names)
    for batch in batches:
        for part in slices(batch):
            for key, held, t in zip(*(c.to_pylist() for c in part.columns)):
                cutter.add(key, held, t)
                if cutter.n >= BLOCK_TOKENS or len(cutter.ids) >= BLOCK_DOCS:
                    yield flush()
                    number, cutter = number + 1, Cutter()
    if cutter.ids:
        yield flush()


def asked(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(ASKED)], schema=ASKED)


def answers(rows: list[tuple[str, int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(ANSWERED)], schema=ANSWERED)


def cuts_of(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by bucket, and where each bucket begins in it."""
    order = np.argsort(bucket.astype(np.uint16 if n <= 1 << 16 else np.uint32), kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=n))])


# words


def ask_words(row: dict, n: int) -> Iterator[tuple[int, int, bytes]]:
    """The hashes of a block's words, in ranges, with their training counts."""
    hashes, counts = np.cumsum(unpack(row["words"])[0], dtype=np.uint64), unpack(row["counts"])[0]
    edges = np.array([(i << 64) // n for i in range(1, n)], dtype=np.uint64)
    ends = [0, *np.searchsorted(hashes, edges).tolist(), len(hashes)]
    for q in range(n):
        a, b = ends[q], ends[q + 1]
        if b > a:
            yield q, row["block"], pack(steps(hashes[a:b]), smallest(counts[a:b]))


def answer_words(q: int, blocks: list[int], blobs: list[bytes], n: int) -> list[tuple]:
    """Numbers (frequent words have small ones; 0 is the start) and counts of the words; tokens, words and counts of counts."""
    parts = [unpack(x) for x in blobs]
    ends = np.cumsum([0, *(len(p[0]) for p in parts)])
    _, of, _ = distinct(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]))
    count = np.bincount(of, weights=np.concatenate([p[1].astype(np.int64) for p in parts])).astype(np.int64)
    rank = np.empty(len(count), dtype=np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
    gid = 1 + rank * n + q
    out = [("words", b, q, pack(smallest(gid[of[i:j]]), smallest(count[of[i:j]]))) for b, i, j in zip(blocks, ends[:-1], ends[1:])]
    tally = np.bincount(np.minimum(count, LOW + 2), minlength=LOW + 3)
    return [*out, ("tally1", -1 - q, q, pack(np.append(tally, count.sum())))]


# pairs and triples


class Block:
    """A block with its words' numbers and counts, and its distinct pairs and triples.

    Words stand in the order of their numbers, behind the start. A token's pair is
    it and the token before, or the start; its triple is the pair before it and
    itself, which the first has not.
    """

    def __init__(self, row: dict, starts: int):
        self.number = row["block"]
        self.sizes = unpack(row["sizes"])[0].astype(np.int64)
        answered = sorted((x for x in row["answers"] if x["kind"] == "words"), key=lambda x: x["q"])
        words = [unpack(x["blob"]) for x in answered]
        gid = np.concatenate([w[0].astype(np.int64) for w in words])
        order = np.argsort(gid)
        self.gid = np.append(0, gid[order])
        self.c1 = np.append(starts, np.concatenate([w[1].astype(np.int64) for w in words])[order])
        self.mixed = mixed(self.gid)
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(1, len(order) + 1)
        self.tokens = place[unpack(row["tokens"])[0]]
        self.first = np.cumsum(self.sizes) - self.sizes
        self.trains = ~np.repeat(np.array(row["held"], dtype=bool), self.sizes)
        width = len(self.gid)
        before = np.append(np.int32(0), self.tokens[:-1])
        before[self.first] = 0
        code, self.pair_of, _ = distinct(before.astype(np.int64) * width + self.tokens)
        self.v, self.w = (x.astype(np.int32) for x in np.divmod(code, width))
        inner = np.ones(len(self.tokens), dtype=bool)
        inner[self.first] = False
        self.inner = np.flatnonzero(inner)
        code, self.triple_of, at = distinct(self.pair_of[self.inner - 1].astype(np.int64) * width + self.tokens[self.inner])
        self.uv, self.w3 = (x.astype(np.int32) for x in np.divmod(code, width))
        self.vw = self.pair_of[self.inner[at]]  # the pair at the end of a triple
        self.hot2 = self.c1[self.v] >= HOT
        self.bound = np.minimum(self.c1[self.v], self.c1[self.w])  # of a pair's count
        self.hot3 = self.bound[self.uv] >= HOT

    def dealt(self, words: np.ndarray, n: int, *spread: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Buckets by a hash of words; spread: (other words, counts), what occurs HOT times is dealt by the other words as well."""
        bucket = (self.mixed % np.uint64(n)).astype(np.int64)[words]
        for other, count in spread:
            hot = np.flatnonzero(count >= HOT)
            part = self.mixed[other[hot]] % (count[hot] // HOT + 1).astype(np.uint64)
            bucket[hot] = (bucket[hot] + part.astype(np.int64) * 7919) % n
        return bucket

    def buckets2(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return cuts_of(self.dealt(self.v, n, (self.w, self.c1[self.v])), n)

    def buckets3(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """By the first word, so that pairs that begin alike stand together."""
        v, w = self.v[self.uv], self.w[self.uv]
        return cuts_of(self.dealt(v, n, (w, self.c1[v]), (self.w3, self.bound[self.uv])), n)

    def ask(self, n2: int, n3: int) -> Iterator[tuple[int, int, bytes]]:
        """Its pairs to the first n2 buckets, its triples to n3 others: words and pairs in order, how many follow each, training counts."""
        counts = np.bincount(self.pair_of[self.trains], minlength=len(self.v))
        order, cuts = self.buckets2(n2)
        for q in range(n2):
            at = order[cuts[q] : cuts[q + 1]]
            if len(at):
                new = runs(self.v[at])
                yield q, self.number, pack(smallest(steps(self.gid[self.v[at[new]]])), smallest(np.diff(new, append=len(at))), smallest(climbs(self.gid[self.w[at]], new)), smallest(counts[at]))
        counts = np.bincount(self.triple_of[self.trains[self.inner]], minlength=len(self.uv))
        order, cuts = self.buckets3(n3)
        for q in range(n3):
            at = order[cuts[q] : cuts[q + 1]]
            if len(at):
                new = runs(self.uv[at])
                pair = self.uv[at[new]]
                head = runs(self.v[pair])
                yield n2 + q, self.number, pack(
                    smallest(steps(self.gid[self.v[pair[head]]])), smallest(np.diff(head, append=len(pair))), smallest(climbs(self.gid[self.w[pair]], head)),
                    smallest(np.diff(new, append=len(at))), smallest(climbs(self.gid[self.w3[at]], new)), smallest(counts[at]),
                )

    def look_up(self, row: dict, n2: int, n3: int) -> None:
        """Takes the counts c2 and c3, and the marks (see `answer_ngrams`), from the answers."""
        for level, n, (order, cuts) in ((2, n2, self.buckets2(n2)), (3, n3, self.buckets3(n3))):
            c, mark = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=np.uint8)
            for x in row["answers"]:
                if x["kind"] == f"counts{level}":
                    at = order[cuts[x["q"]] : cuts[x["q"] + 1]]
                    c[at], mark[at] = unpack(x["blob"])
            setattr(self, f"c{level}", c)
            setattr(self, f"mark{level}", mark)

    def contexts(self) -> tuple[tuple, tuple]:
        """What its texts back off from: places of words, and of pairs, whose weights are needed."""
        two = np.unique(self.v[(self.c2 == 0) & (self.c1[self.v] > 0)])
        three = np.unique(self.uv[(self.c3 == 0) & (self.c2[self.uv] > 0)])
        return two, three

    def buckets4(self, contexts: np.ndarray, pairs: bool, n: int) -> tuple[np.ndarray, np.ndarray]:
        if pairs:
            v = self.v[contexts]
            return cuts_of(self.dealt(v, n, (self.w[contexts], self.c1[v])), n)
        return cuts_of(self.dealt(contexts, n), n)

    def ask_weights(self, n: int, tokens: int) -> Iterator[tuple[int, int, bytes]]:
        """Sums of the n-grams that it is first to hold, by context, and the contexts that it needs with their counts and their ends', to n buckets for each order."""
        need2, need3 = self.contexts()
        own = np.flatnonzero((self.mark2 & 1 > 0) & ((self.mark2 & 2 > 0) | self.hot2))
        sums2 = sums(self.v[own], self.c2[own], self.c1[self.w[own]])
        own = np.flatnonzero((self.mark3 & 1 > 0) & ((self.mark3 & 2 > 0) | self.hot3))
        sums3 = sums(self.uv[own], self.c3[own], self.c2[self.vw[own]])
        names2 = lambda x: (self.gid[x],)
        names3 = lambda x: (self.gid[self.v[x]], self.gid[self.w[x]])
        counts2 = (self.c1[need2], np.full(len(need2), tokens))
        counts3 = (self.c2[need3], self.c1[self.w[need3]])
        for base, names, (context, table), need, counts in ((0, names2, sums2, need2, counts2), (n, names3, sums3, need3, counts3)):
            (o, a), (p, b) = (self.buckets4(x, base > 0, n) for x in (context, need))
            for q in range(n):
                i, j = o[a[q] : a[q + 1]], p[b[q] : b[q + 1]]
                if len(i) or len(j):
                    yield base + q, self.number, pack(*(smallest(x) for x in (*stairs(*names(context[i])), *table[:, i], *stairs(*names(need[j])), counts[0][j], counts[1][j])))

    def scores(self, row: dict, n: int, words: "Words", d2: np.ndarray, d3: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each text the tokens known, the add-one score and the model's."""
        need2, need3 = self.contexts()
        a2, a3 = np.ones(len(self.gid)), np.ones(len(self.v))
        for level, need in ((2, need2), (3, need3)):
            order, cuts = self.buckets4(need, level == 3, n)
            for x in row["answers"]:
                if x["kind"] == f"weights{level}":
                    at = need[order[cuts[x["q"]] : cuts[x["q"] + 1]]]
                    (a2 if level == 2 else a3)[at] = unpack(x["blob"])[0]
        one = np.log10(words.p(self.c1))
        low, of_context = np.log10(a2), np.log10(np.maximum(self.c1, 1))
        two = np.where(self.c2 > 0, log_kept(self.c2, d2) - of_context[self.v], low[self.v] + one[self.w])
        low, of_context = np.log10(a3), np.log10(np.maximum(self.c2, 1))
        three = np.where(self.c3 > 0, log_kept(self.c3, d3) - of_context[self.uv], low[self.uv] + two[self.vw])
        score = two[self.pair_of]
        score[self.inner] = three[self.triple_of]
        base = np.log10((self.c1 + 1) / (words.n + words.v + 1))[self.tokens]
        by_text = lambda x: np.add.reduceat(x, self.first)
        return by_text((self.c1 > 0)[self.tokens].astype(np.int64)), by_text(base), by_text(score)


def stairs(first: np.ndarray, second: np.ndarray | None = None) -> list[np.ndarray]:
    """Ascending numbers, or pairs of them, as differences: the first ones, how many follow each, the second ones."""
    if second is None:
        return [steps(first)]
    at = runs(first) if len(first) else np.zeros(0, np.int64)
    return [steps(first[at]), np.diff(at, append=len(first)), climbs(second, at)]


def unstairs(parts: list[np.ndarray]) -> list[np.ndarray]:
    """What `stairs` made differences of."""
    first = np.cumsum(parts[0])
    if len(parts) == 1:
        return [first]
    starts = np.cumsum(parts[1]) - parts[1]
    return [np.repeat(first, parts[1]), climbed(parts[2], starts, parts[1])]


def log_kept(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Logarithms of discounted counts; most counts are small, and looked up."""
    few = np.append(0.0, np.log10(kept(np.arange(1, 256), d)))
    out = few[np.minimum(c, 255)]
    many = np.flatnonzero(c > 255)
    out[many] = np.log10(kept(c[many], d))
    return out


def sums(context: np.ndarray, c: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(contexts, RANKS sums of each): how many of its n-grams have count 1 .. LOW, the sum of larger counts; the same of their lower orders. context ascends."""
    at = runs(context) if len(context) else np.zeros(0, np.int64)
    out = np.zeros((RANKS, len(at)), dtype=np.int64)
    for k, x in enumerate((c, lower)):
        for r in range(1, LOW + 2):
            if len(at):
                out[k * (LOW + 1) + r - 1] = np.add.reduceat((x == r).astype(np.int64) if r <= LOW else np.where(x > LOW, x, 0), at)
    return context[at], out


def weighted(table: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The discounted counts that LOW + 1 rows of such sums stand for."""
    return (table * (d * np.append(np.arange(1, LOW + 1), 1))[:, None]).sum(axis=0)


def narrow(x: np.ndarray) -> np.ndarray:
    """Numbers under 2^32: as they are, or their ranks."""
    return x if not len(x) or int(x.max()) < 1 << 32 else np.unique(x, return_inverse=True)[1]


def answer_ngrams(level: int, q: int, blocks: list[int], blobs: list[bytes]) -> list[tuple]:
    """Counts of the pairs or triples of a bucket, and marks: 1 the first block to hold a training n-gram, 2 its context has n-grams that no training text holds."""
    parts = []
    for blob in blobs:
        *heads, sizes, last, train = (x.astype(np.int64) for x in unpack(blob))
        heads = unstairs(heads)
        parts.append(([np.repeat(h, sizes) for h in heads], climbed(last, np.cumsum(sizes) - sizes, sizes), train))
    ends = np.cumsum([0, *(len(p[2]) for p in parts)])
    context, *more = (narrow(np.concatenate([p[0][k] for p in parts])) for k in range(level - 1))
    if more:
        _, context, _ = distinct(context.astype(np.uint64) << np.uint64(32) | more[0].astype(np.uint64))
    last, train = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
    code = context.astype(np.uint64) << np.uint64(32) | narrow(last).astype(np.uint64)
    order = np.argsort(code)
    at = runs(code[order])
    count = np.add.reduceat(train[order], at)
    of = np.empty(len(code), dtype=np.int64)
    of[order] = np.repeat(np.arange(len(at)), np.diff(at, append=len(code)))
    # n-grams of a context stand together
    starts = runs(context[order[at]])
    back_off = np.repeat(np.logical_or.reduceat(count == 0, starts), np.diff(starts, append=len(at)))
    first = np.minimum.reduceat(np.where(train[order] > 0, order, len(code)), at)
    seen = count > 0
    mark = np.zeros(len(code), dtype=np.uint8)
    mark[first[seen]] = 1 + 2 * back_off[seen]
    c = count[of]
    out = [(f"counts{level}", b, q, pack(smallest(c[i:j]), mark[i:j])) for b, i, j in zip(blocks, ends[:-1], ends[1:])]
    return [*out, (f"tally{level}", -1 - q, q, pack(np.bincount(np.minimum(count[count > 0], LOW + 2), minlength=LOW + 3)))]


def answer_weights(level: int, q: int, blocks: list[int], blobs: list[bytes], d: np.ndarray, lower: np.ndarray) -> list[tuple]:
    """The weight of each context needed: what its words leave, over what the lower order leaves without them."""
    width = level - 1  # numbers in a context
    stair = 2 * width - 1  # arrays that they come as
    parts = []
    for blob in blobs:
        got = [x.astype(np.int64) for x in unpack(blob)]
        parts.append([*unstairs(got[:stair]), *got[stair : stair + RANKS], *unstairs(got[stair + RANKS : -2]), *got[-2:]])
    held, wanted = ([np.concatenate([p[i + k] for p in parts]) for k in range(width)] for i in (0, width + RANKS))
    both = [narrow(np.concatenate([h, w])).astype(np.uint64) for h, w in zip(held, wanted)]
    code = both[0] if width == 1 else both[0] << np.uint64(32) | both[1]
    _, of, _ = distinct(code)
    n = len(held[0])
    table = np.stack([np.bincount(of[:n], weights=np.concatenate([p[width + k] for p in parts]), minlength=int(of.max(initial=-1)) + 1) for k in range(RANKS)])
    want = of[n:]
    if not (table[:, want].sum(axis=0) > 0).all():
        raise RuntimeError("a context is needed of which no block holds a word")
    count, below = (np.concatenate([p[2 * width + RANKS + k] for p in parts]) for k in (0, 1))
    weight = (1 - weighted(table[: LOW + 1, want], d) / count) / np.maximum(1 - weighted(table[LOW + 1 :, want], lower) / below, 1e-12)
    ends = np.cumsum([0, *(len(p[width + RANKS]) for p in parts)])
    return [(f"weights{level}", b, q, pack(weight[i:j])) for b, i, j in zip(blocks, ends[:-1], ends[1:]) if j > i]


class Words:
    """P(w) by a word's count: n tokens of v words, their discounts, and the part of words never seen."""

    def __init__(self, n: int, v: int, of_counts: dict[int, int]):
        self.n, self.v, self.d = n, v, discounts(of_counts)
        low = [r * of_counts.get(r, 0) for r in range(1, LOW + 1)]
        held = sum(x * y for x, y in zip(low, self.d)) + (n - sum(low)) * self.d[LOW]
        self.unknown = 1 - held / n if n else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, kept(np.maximum(c, 1), self.d) / max(self.n, 1), self.unknown)


def training(id_col: str):
    """Whether a row trains: the crc32 of its id as text, modulo 7, is not 2."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 7 != 2, F.lit(True))


def by_block(df: DataFrame, name: str, n: int) -> DataFrame:
    """df written in n parts by block: tables of as many parts meet without an exchange."""
    table = f"katz_{name}_{uuid.uuid4().hex}"
    # the values are large and compressed: small row groups keep them out of memory, a dictionary has no use
    options = {"path": fresh(df.sparkSession, name), "parquet.block.size": 16 << 20, "parquet.enable.dictionary": "false"}
    df.write.bucketBy(n, "block").options(**options).saveAsTable(table)
    return df.sparkSession.table(table)


def exchanged(rows: DataFrame, answer: Callable[[int, list[int], list[bytes]], list[tuple]], name: str, parts: int) -> DataFrame:
    """(q, block, blob) -> the answers of the buckets q, a table by block."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        return answers(answer(table.column("q")[0].as_py(), table.column("block").to_pylist(), table.column("blob").to_pylist()))

    return by_block(rows.groupBy("q").applyInArrow(run, ANSWERS).repartition(parts, "block"), name, parts)


def gathered(answered: DataFrame) -> DataFrame:
    """The answers of each block in a row."""
    return answered.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("kind", "q", "blob")).alias("answers"))


def tallies(answered: DataFrame, kind: str) -> np.ndarray:
    """The sum of a few numbers from each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        for b in batches:
            for blob in b.column(0).to_pylist():
                k = k + unpack(blob)[0]
        if np.ndim(k):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(k))), pa.array(k.astype(np.int64))], ["r", "k"])

    got = {r: k for r, k in answered.where(F.col("kind") == kind).select("blob").mapInArrow(run, "r bigint, k bigint").groupBy("r").agg(F.sum("k")).collect()}
    return np.array([got.get(r, 0) for r in range(LOW + 4)])


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score (Katz, three words)."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), (~training(id_col)).alias("held"), text_or_empty(text_col).alias("t"))
    parts = max(8, PARTS * rows.rdd.getNumPartitions())
    blocks = by_block(rows.mapInArrow(cut, BLOCKS), "blocks", parts)
    n_words, n_tokens, starts = total(blocks, F.sum("n_words"), F.sum("n_tokens"), F.sum("n_starts"))

    def each(tables: list[DataFrame], use: Callable[[dict], Iterator[tuple]]) -> DataFrame:
        """(q, block, blob) of what `use` makes of each block with its answers."""
        joined = blocks
        for k, t in enumerate(tables):
            joined = joined.join(gathered(t).withColumnRenamed("answers", f"answers{k}").hint("shuffle_hash"), "block")
        columns, n = ["block", "held", "sizes", "words", "counts", "tokens"], len(tables)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = {c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names)}
                    row["answers"] = [x for i in range(n) for x in row.pop(f"answers{i}")]
                    yield asked(list(use(row)))

        return joined.select(*columns, *[f"answers{k}" for k in range(n)]).mapInArrow(run, "q int, block bigint, blob binary")

    n1 = max(8, -(-n_words // BUCKET_ROWS))
    numbered = exchanged(each([], lambda row: ask_words(row, n1)), lambda q, b, x: answer_words(q, b, x, n1), "numbered", parts)
    tally = tallies(numbered, "tally1")
    words = Words(int(tally[-1]), int(tally[1:-1].sum()), dict(enumerate(tally[: LOW + 2].tolist())))

    # about seven tenths of the tokens are pairs, and nine tenths triples, that their block holds once
    n2, n3 = (max(8, -(-n_tokens * tenths // 10 // BUCKET_ROWS)) for tenths in (7, 9))
    counted = exchanged(each([numbered], lambda row: Block(row, starts).ask(n2, n3)), lambda q, b, x: answer_ngrams(2 if q < n2 else 3, q if q < n2 else q - n2, b, x), "counted", parts)
    d2, d3 = (discounts(dict(enumerate(tallies(counted, f"tally{k}").tolist()))) for k in (2, 3))

    n4, d_of, n_all = max(8, -(-n_tokens * 3 // 10 // BUCKET_ROWS)), {2: (d2, words.d), 3: (d3, d2)}, words.n

    def known(row: dict) -> Block:
        block = Block(row, starts)
        block.look_up(row, n2, n3)
        return block

    weights = exchanged(each([numbered, counted], lambda row: known(row).ask_weights(n4, n_all)), lambda q, b, x: answer_weights(2 if q < n4 else 3, q % n4, b, x, *d_of[2 if q < n4 else 3]), "weights", parts)

    kind = docs.schema[id_col].dataType.simpleString()
    joined = blocks
    for name, t in zip("abc", (numbered, counted, weights)):
        joined = joined.join(gathered(t).withColumnRenamed("answers", name).hint("shuffle_hash"), "block", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names)}
                row["answers"] = [x for c in "abc" for x in row[c] or ()]
                block = known(row)
                got = block.scores(row, n4, words, d2, d3)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.string()), pa.array(row["held"], pa.bool_()), *(pa.array(x) for x in (block.sizes, *got))], ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    out = joined.select("block", "ids", "held", "sizes", "tokens", "a", "b", "c").mapInArrow(finish, "id string, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select(F.col("id").cast(kind).alias(id_col), "held_out", "n_tokens", "n_known", F.lit(words.n).cast("long").alias("train_tokens"), "base_score", "score")
