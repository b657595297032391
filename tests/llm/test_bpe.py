import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.llm import bpe
from cadenza.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def coder():
    merges = bpe.Merges(open(PATH, encoding="utf-8").read())
    return bpe.Encoder(merges), bpe.Decoder(merges)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def same(coder, library, text):
    encoder, decoder = coder
    parts = list(encoder.stream(text))
    want = library.encode(text, add_special_tokens=False).ids
    assert list(memoryview(b"".join(parts)).cast("I")) == want
    assert "".join(map(decoder.feed, parts)) + decoder.finish() == library.decode(want, skip_special_tokens=False)


@settings(deadline=None, max_examples=300)
@given(st.text())
def test_any_text(text):
    same(*_both(), text)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from(["a", " ", "  ", "\n", "\t", "'s", "'LL", "é", "日本", "%%%", "12", "<|endoftext|>", "<|end", "\x1c", "\x85", "\xa0", "🎉", "é", "ing"])))
def test_pieces(parts):
    same(*_both(), "".join(parts))


_cache = []


def _both():
    if not _cache:
        from tokenizers import Tokenizer

        merges = bpe.Merges(open(PATH, encoding="utf-8").read())
        _cache.extend([(bpe.Encoder(merges), bpe.Decoder(merges)), Tokenizer.from_file(PATH)])
    return _cache


@pytest.mark.parametrize("text", ["a" * 20000, "ab" * 20000, " " * 70000, "-=_" * 9000, "x" + "\n" * 9000 + "y", "日本" * 9000], ids=range(6))
def test_long_runs(coder, library, text):
    same(coder, library, text)


def test_windows_agree_with_whole(coder):
    rng = random.Random(3)
    merges = coder[0].merges
    for letters in ("ab", "etaoin", "-", "aeiou-_"):
        piece = "".join(rng.choice(letters) for _ in range(12 * merges.lookahead)).encode()
        parts = list(merges.transduce(piece))
        assert len(parts) > 1
        # shorter windows at any place: what is sent must be what a longer look gives
        assert [i for p in parts for i in p][: len(parts[0])] == merges.merge(piece[: 8 * merges.lookahead])[: len(parts[0])]


def test_decoder_between_characters(coder):
    ids = coder[0].ids(["🎉é"])
    assert "".join(coder[1].feed(ids[i : i + 4]) for i in range(0, len(ids), 4)) + coder[1].finish() == "🎉é"
    assert coder[1].feed(ids[:4]) + coder[1].finish() == "�"


def test_rows(odd, library):
    got = bpe.bpe_digests(odd, PATH).collect()
    want = []
    for r in odd.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.bpe_digests(odd.limit(0), PATH).count() == 0


def test_decode(odd):
    ids = bpe.bpe_ids(odd, PATH, also=["lang"])
    assert all(r["round_trip"] for r in ids.collect())
    back = bpe.bpe_decode(ids, PATH).select("doc_id", "text").collect()
    assert sorted(map(tuple, back), key=str) == sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=str)
