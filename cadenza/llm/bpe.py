"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

The merge list alone fixes how far to the right of a token boundary text can
still undo it (`Merges.lookahead`). A long piece is read in windows; the tokens
that end so far before the window's end are stable and go out, and reading goes
on behind them. This is whole BPE: no merge crosses a boundary of the final
result, so what stands left and right of one is encoded independently. Memory
is a window, the vocabulary and a bounded cache of short pieces, beside the text
itself, which a task reads whole, and its longest piece, which the pattern cuts
out of it whole (a piece is a run of letters, of digits, of signs or of white
space). Decoding is an incremental machine from bytes to text: a token may end
inside a character.

Rows: null text counts as empty (no ids); repeated rows are encoded each on its
own; an empty table gives an empty result; columns beside the id and the text are
passed over, whatever their names.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import by_batch, text_or_empty

#: White_Space of Unicode, and the pieces of the byte-level pattern.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

SPACES = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{SPACE}]", c))

SLICE = 1 << 16  # characters read at a time
CACHED = 250_000  # pieces remembered by a task at most
LONG = 64  # longer pieces aren't remembered


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for.

    Rule: printable Latin-1 characters stand for themselves; the other bytes, in
    order, for the characters from 256 on.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A byte-level BPE vocabulary: token bytes by id, merges by the pair of ids."""

    def __init__(self, data: str):
        got = json.loads(data)
        letters = byte_letters()
        vocab, merges = got["model"]["vocab"], got["model"]["merges"]
        self.special = {x["content"]: x["id"] for x in got.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token) if token not in self.special else token.encode()
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.first = [0] * 256
        for c, b in letters.items():
            self.first[b] = vocab[c]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(merges):
            left, right = m.split(" ") if isinstance(m, str) else m
            self.pairs[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Bytes after a boundary that suffice to know that it stays.

        A merge (x, y) can be undone from the right only by an earlier merge (u, v)
        that takes u, a token on the right edge of y while y is built. It brings
        the bytes of v, and can itself be undone by a still earlier merge. far[u]
        is the farthest such chain that begins by taking u, over the merges so far.
        """
        edge: dict[int, tuple[int, ...]] = {i: (i,) for i in self.first}  # tokens on the right edge, the token itself first
        far: dict[int, int] = {}
        most = 0
        for (left, right), (_, new) in self.pairs.items():
            chain = max(far.get(u, 0) for u in edge[right])
            reach = len(self.bytes[right]) + chain
            far[left] = max(far.get(left, 0), reach)
            edge.setdefault(new, (new, *edge[right]))
            most = max(most, reach)
        return most + max(len(x) for x in self.bytes)

    def merge(self, piece: bytes) -> list[int]:
        """All merges of a piece, the earliest of the list first, leftmost first."""
        ids = [self.first[b] for b in piece]
        pairs, none = self.pairs, (1 << 60, 0)
        while len(ids) > 1:
            ranks = [pairs.get(p, none) for p in zip(ids, ids[1:])]
            best = min(ranks)
            if best is none or best[0] == none[0]:
                break
            out, i, last = [], 0, len(ids) - 1
            while i <= last:
                if i < last and ranks[i] == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def transduce(self, piece: bytes) -> Iterator[list[int]]:
        """The tokens of a piece in parts, each as soon as it is stable."""
        window = 4 * self.lookahead
        at = 0
        while len(piece) - at > window:
            ids = self.merge(piece[at : at + window])
            sent, end, stable = 0, 0, window - self.lookahead
            for i in ids:
                if end + len(self.bytes[i]) > stable:
                    break
                end += len(self.bytes[i])
                sent += 1
            if not sent:
                raise AssertionError("a token is longer than the lookahead")
            yield ids[:sent]
            at += end
        yield self.merge(piece[at:])


class PairTable:
    """Ranks of many pairs at once: two hash tables, each pair in one of its two places."""

    def __init__(self, merges: Merges):
        keys = np.array([(left << 32) | right for left, right in merges.pairs], dtype=np.uint64)
        self.none = len(keys)
        self.new = np.array([new for _, new in merges.pairs.values()] + [0], dtype=np.int64)
        self.shift = np.uint64(64 - max(4, int(4 * len(keys)).bit_length()))
        odd = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
        while True:
            self.odd = [np.uint64(x & 0xFFFFFFFFFFFFFFFF) for x in odd]
            if self._fill(keys):
                break
            odd = [x * 0x5851F42D4C957F2D + 2 for x in odd]
        self.keys = np.append(keys, np.uint64(0xFFFFFFFFFFFFFFFF))

    def _fill(self, keys: np.ndarray) -> bool:
        at = [((keys * o) >> self.shift).astype(np.int64).tolist() for o in self.odd]
        self.slots = [np.full(1 << (64 - int(self.shift)), self.none, dtype=np.int32) for _ in range(2)]
        tables = [x.tolist() for x in self.slots]
        for k in range(len(keys)):
            side = 0
            for _ in range(500):
                place = at[side][k]
                k, tables[side][place] = tables[side][place], k
                if k == self.none:
                    break
                side = 1 - side
            else:
                return False
        self.slots = [np.array(x, dtype=np.int32) for x in tables]
        return True

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, `none` where it is no merge."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        one, two = (slots[(keys * o) >> self.shift] for slots, o in zip(self.slots, self.odd))
        return np.where(self.keys[one] == keys, one, np.where(self.keys[two] == keys, two, self.none))


class Encoder(dict):
    """Ids of texts as little-endian 32-bit integers; a dict of the runs met, by their text."""

    def __init__(self, merges: Merges):
        import regex

        super().__init__()
        self.merges = merges
        self.table = PairTable(merges)
        self.first = np.array(merges.first, dtype=np.int64)
        self.pieces = regex.compile(PIECES)
        # white space and the run behind it: a boundary of pieces stands before each
        self.chunks = re.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        # the longest special first
        self.split = re.compile("|".join(map(re.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None

    def __missing__(self, chunk: str) -> bytes:
        ids = b"".join(as_bytes(part) for piece in self.pieces.findall(chunk) for part in self.merges.transduce(piece.encode()))
        if len(chunk) <= LONG:
            self[chunk] = ids
        return ids

    def learn(self, chunks: set[str]) -> None:
        """Encodes the short ones of chunks that aren't known yet, all at once.

        Only runs that begin with white space and end without: put one after the
        other they are split into the same pieces as each on its own.
        """
        if len(self) + len(chunks) > CACHED:
            self.clear()
        new = [x for x in chunks if x not in self and len(x) <= LONG and x[0] in SPACES and x[-1] not in SPACES]
        if not new:
            return
        joined = "".join(new)
        flat = np.frombuffer(joined.encode(), dtype=np.uint8)
        piece_ends = np.cumsum(list(map(len, self.pieces.findall(joined))))
        chunk_ends = np.cumsum(list(map(len, new)))
        owner = np.searchsorted(chunk_ends, piece_ends, side="left")
        if len(flat) != len(joined):  # from characters to bytes
            piece_ends = np.append(np.flatnonzero((flat & 0xC0) != 0x80), len(flat))[piece_ends]
        ids, ends = self._merge_all(flat, np.diff(piece_ends, prepend=0))
        to = np.zeros(len(new), dtype=np.int64)
        to[owner] = ends  # the last piece of a run is the last to write
        blob, to = as_bytes(ids), (to * 4).tolist()
        self.update(zip(new, map(blob.__getitem__, map(slice, [0, *to[:-1]], to))))

    def _merge_all(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`Merges.merge` of many pieces side by side: one merge of each in a round. Ids, and where each piece ends."""
        own = np.repeat(np.arange(len(sizes)), sizes)
        ids = self.first[flat]
        none, done = self.table.none, []
        while len(ids):
            ranks = self.table.ranks(ids, np.append(ids[1:], 0))
            inside = np.append(own[1:] == own[:-1], False)
            ranks[~inside] = none
            starts = np.flatnonzero(np.append(True, ~inside[:-1]))
            best = np.repeat(np.minimum.reduceat(ranks, starts), np.diff(starts, append=len(ids)))
            ended = best == none
            if ended.any():
                done.append((own[ended], ids[ended]))
                go = ~ended
                own, ids, ranks, best = own[go], ids[go], ranks[go], best[go]
            hit = ranks == best
            if not len(hit):
                break
            # of overlapping pairs of one kind, the first, third, ... of the run
            at = np.flatnonzero(hit)
            begins = np.append(True, np.diff(at) != 1)
            run = np.maximum.accumulate(np.where(begins, at, 0))
            at = at[(at - run) % 2 == 0]
            ids[at] = self.table.new[ranks[at]]
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            own, ids = own[keep], ids[keep]
        owns, out = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return out[np.argsort(owns, kind="stable")], np.cumsum(np.bincount(owns, minlength=len(sizes)))

    def plain(self, text: str) -> Iterator[list[str]]:
        """The runs of text without specials, slice by slice."""
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > SLICE:
                size = SLICE
                while True:
                    chunks = self.chunks.findall(text, at, min(at + size, end))
                    if len(chunks) > 1 or at + size >= end:
                        break
                    size *= 2  # one run longer than the slice
                if at + size < end:
                    chunks.pop()  # it may go on in the next slice
            else:
                chunks = self.chunks.findall(text, at)
            yield chunks
            at += sum(map(len, chunks))

    def parts(self, text: str) -> Iterator[list[str] | bytes]:
        """The runs of each slice; the ids of a special."""
        at = 0
        for m in self.split.finditer(text) if self.split else ():
            yield from self.plain(text[at : m.start()])
            yield as_bytes([self.merges.special[m[0]]])
            at = m.end()
        yield from self.plain(text[at:] if at else text)

    def ids(self, part: list[str] | bytes) -> bytes:
        return part if isinstance(part, bytes) else b"".join(map(self.__getitem__, part))

    def stream(self, text: str) -> Iterator[bytes]:
        """The ids of one text, each as soon as it is stable."""
        for part in self.parts(text):
            if not isinstance(part, bytes):
                self.learn(set(part))
            yield self.ids(part)

    def streams(self, texts: list[str]) -> Iterator[Iterator[bytes]]:
        """`stream` of each text; texts of one slice are learnt some thousands of runs at a time."""
        i = 0
        while i < len(texts):
            group, size = [], 0
            while i < len(texts) and len(texts[i]) <= SLICE and size < 16 * SLICE:
                group.append(list(self.parts(texts[i])))
                size += len(texts[i])
                i += 1
            self.learn({x for parts in group for part in parts if not isinstance(part, bytes) for x in part})
            for parts in group:
                yield map(self.ids, parts)
            if i < len(texts) and len(texts[i]) > SLICE:
                yield self.stream(texts[i])
                i += 1


def as_bytes(ids) -> bytes:
    return np.asarray(ids).astype("<u4").tobytes()


class Decoder:
    """Ids to text by a machine whose state is the unfinished character."""

    def __init__(self, merges: Merges):
        self.flat = np.frombuffer(b"".join(merges.bytes), dtype=np.uint8)
        self.sizes = np.array([len(x) for x in merges.bytes], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        tokens = np.frombuffer(ids, dtype="<u4")
        sizes = self.sizes[tokens]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[tokens] - ends + sizes, sizes)
        at += np.arange(len(at))
        return self.machine.decode(self.flat[at].tobytes())

    def finish(self) -> str:
        out = self.machine.decode(b"", True)
        self.machine.reset()
        return out


def digests(stream: Iterable[bytes], decoder: Decoder) -> tuple[int, str, str]:
    """Token count and the digests of the ids and of the text decoded from them, as they come."""
    ids, back, n = hashlib.sha256(), hashlib.sha256(), 0
    for part in stream:
        n += len(part) // 4
        ids.update(part)
        back.update(decoder.feed(part).encode())
    back.update(decoder.finish().encode())
    return n, ids.hexdigest(), back.hexdigest()


def _shipped(df: DataFrame, vocabulary: str):
    """The vocabulary file, read once on the driver: its size doesn't depend on the data."""
    with open(vocabulary, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def bpe_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256. A null text is empty."""
    data = _shipped(docs, vocabulary)

    def make():
        merges = Merges(data.value)
        encoder, decoder = Encoder(merges), Decoder(merges)

        def batch(b: pa.RecordBatch) -> dict:
            got = [digests(ids, decoder) for ids in encoder.streams(b.column(1).to_pylist())]
            return {id_col: b.column(0), "n_tokens": [x[0] for x in got], "ids_sha256": [x[1] for x in got], "decoded_sha256": [x[2] for x in got]}

        return batch

    kind = docs.schema[id_col].dataType.simpleString()
    return by_batch(docs.select(id_col, text_or_empty(text_col).alias("t")), f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", make)


def bpe_ids(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", also: Iterable[str] = ()) -> DataFrame:
    """Per row: id, the columns in also, ids (array of int), n_tokens, and whether decoding gives the text back."""
    data = _shipped(docs, vocabulary)
    also = list(also)

    def make():
        merges = Merges(data.value)
        encoder, decoder = Encoder(merges), Decoder(merges)

        def batch(b: pa.RecordBatch) -> dict:
            values, ends, same = [], [0], []
            texts = b.column(b.num_columns - 1).to_pylist()
            for t, stream in zip(texts, encoder.streams(texts)):
                parts = list(stream)
                back = "".join(map(decoder.feed, parts)) + decoder.finish()
                same.append(back == t)
                values += parts
                ends.append(ends[-1] + sum(map(len, parts)) // 4)
            flat = np.frombuffer(b"".join(values), dtype="<i4")
            out = {n: b.column(i) for i, n in enumerate([id_col, *also])}
            return out | {"ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)).cast(pa.list_(pa.field("element", pa.int32()))), "n_tokens": np.diff(ends), "round_trip": same}

        return batch

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in [id_col, *also])
    return by_batch(docs.select(id_col, *also, text_or_empty(text_col).alias("__t")), schema + ", ids array<int>, n_tokens bigint, round_trip boolean", make)


def bpe_decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """df with out_col, the text of ids_col (null ids: null); bytes that are no UTF-8 become U+FFFD."""
    data = _shipped(df, vocabulary)

    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(Merges(data.value))
        for part in parts:
            yield part.map(lambda x: None if x is None else decoder.feed(as_bytes(x)) + decoder.finish())

    # the hints by hand: as text they say nothing to Spark
    decode.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out_col, F.pandas_udf(decode, "string")(F.col(ids_col)))
