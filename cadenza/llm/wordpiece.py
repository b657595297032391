"""Token counts by a linear longest-match automaton.

Greedy longest match over a byte-level vocabulary in which a leading blank marks
the start of a word. The trie's nodes carry a failure link (where matching goes
on once the longest piece on the path is popped) and the number of pieces popped
on the way there, so a word's token count comes from one pass over its bytes and
no piece is ever built. Every byte is a piece, so nothing is unknown.

Rows: a null or empty text has no words and no tokens; a very long text is read
whole in its task; repeated rows are counted each on its own; an empty table gives
an empty result; columns beside the id and the text are not read, whatever their
names.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cadenza.llm.bpe import byte_letters
from cadenza.llm.common import by_batch, text_or_empty

#: Words whose counts a task remembers.
REMEMBERED = 1_000_000


def byte_pieces(data: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary file that a word can hold: a blank at the start only."""
    letters = byte_letters()
    vocab = json.loads(data)["model"]["vocab"]
    pieces = [bytes(letters[c] for c in token) for token in vocab if all(c in letters for c in token)]
    return [p for p in pieces if not any(b in b" \t\n\v\f\r" for b in p[1:]) and (len(p) == 1 or p[0] not in b"\t\n\v\f\r")]


class Automaton:
    """Trie with failure links; popped[v] counts the pieces given up on the way from v to fail[v]."""

    def __init__(self, pieces: list[bytes]):
        step: list[dict[int, int]] = [{}]
        whole = [False]
        for p in pieces:
            v = 0
            for b in p:
                if b not in step[v]:
                    step[v][b] = len(step)
                    step.append({})
                    whole.append(False)
                v = step[v][b]
            whole[v] = True
        missing = [b for b in range(256) if b not in step[0] or not whole[step[0][b]]]
        for b in missing:  # every byte is a piece
            v = step[0].setdefault(b, len(step))
            if v == len(step):
                step.append({})
                whole.append(False)
            whole[v] = True
        fail, popped = [0] * len(step), [0] * len(step)
        queue = [0]
        for u in queue:  # breadth first: links of shorter strings are ready
            for b, v in step[u].items():
                if whole[v]:
                    fail[v], popped[v] = 0, 1
                else:
                    z, n = fail[u], popped[u]
                    while b not in step[z]:
                        n += popped[z]
                        z = fail[z]
                    fail[v], popped[v] = step[z][b], n
                queue.append(v)
        self.step, self.fail, self.popped = step, fail, popped

    def count(self, word: bytes) -> int:
        """Pieces of a greedy longest match from left to right."""
        step, fail, popped = self.step, self.fail, self.popped
        v = n = 0
        for b in word:
            while b not in step[v]:
                n += popped[v]
                v = fail[v]
            v = step[v][b]
        while v:
            n += popped[v]
            v = fail[v]
        return n


class WordCounts(dict):
    """Token counts by word, those met remembered."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.automaton.count(b" " + word)
        if len(word) <= 64:
            self[word] = n
        return n


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words (runs without ASCII white space), n_tokens (their greedy longest-match pieces)."""
    with open(vocabulary, encoding="utf-8") as f:  # its size doesn't depend on the data
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        counts = WordCounts(Automaton(byte_pieces(data.value)))

        def batch(b: pa.RecordBatch) -> dict:
            words = [t.encode().split() for t in b.column(1).to_pylist()]
            return {id_col: b.column(0), "n_words": np.array([len(w) for w in words], dtype=np.int64), "n_tokens": np.array([sum(map(counts.__getitem__, w)) for w in words], dtype=np.int64)}

        return batch

    kind = docs.schema[id_col].dataType.simpleString()
    return by_batch(docs.select(id_col, text_or_empty(text_col).alias("t")), f"`{id_col}` {kind}, n_words bigint, n_tokens bigint", make)
