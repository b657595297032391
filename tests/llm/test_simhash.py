import numpy as np
import pytest
import xxhash

from cadenza.llm import simhash
from cadenza.llm.components import components


def brute_print(text, size):
    words = text.encode().lower().split()
    runs = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    counts = [0] * 64
    for r in runs:
        h = xxhash.xxh64_intdigest(r, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(runs)) if runs else 0


def brute_components(rows, radius):
    out = [i for i, _ in rows]
    prints = [brute_print(t or "", 3) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k, f"{p:016x}", least.get(find(i))) for i, ((k, _), p) in enumerate(zip(rows, prints))), key=str), out


def copies(n, words, seed=0):
    """Texts of which many differ in a word or two."""
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(500)]
    base = [[vocab[i] for i in rng.integers(0, 500, words)] for _ in range(6)]
    rows = []
    for i in range(n):
        t = list(base[i % 6]) if i % 3 else [vocab[i] for i in rng.integers(0, 500, words)]
        for _ in range(i % 3):
            t[rng.integers(0, words)] = vocab[rng.integers(0, 500)]
        rows.append((i + 10, " ".join(t)))
    return rows


def test_components_of_documents(docs, odd):
    rows = copies(240, 120) + [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = simhash.simhash_components(docs(rows)).collect()
    want, _ = brute_components(rows, 3)
    assert sorted(map(tuple, got), key=str) == want
    assert sum(r["component_id"] != r["doc_id"] for r in got) > 20
    assert simhash.simhash_components(odd.limit(0)).count() == 0


def test_large_buckets(docs, monkeypatch):
    """A bucket of many chunks is compared in pairs of them, and nothing is lost."""
    monkeypatch.setattr(simhash, "BUFFER", 64)
    monkeypatch.setattr(simhash, "CHUNK", 16)
    monkeypatch.setattr(simhash.Rule, "within", classmethod(lambda cls, radius, rows=0: cls(1, radius, [np.arange(0, 1)])))
    rows = copies(300, 150, seed=1)
    got = simhash.simhash_components(docs(rows)).collect()
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in got}
    # links within the one band, whose only bit splits the table in two
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if j < i and prints[i] >> 63 == prints[j] >> 63 and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: find(i) for i in ids}


@pytest.mark.parametrize("rows", [1 << 23, 1 << 34])
def test_longer_keys(docs, monkeypatch, rows):
    """More rows take more combinations of shorter blocks: the same links."""
    assert [len(simhash.Rule.within(3, n).bands) for n in (0, 1 << 22, 1 << 23, 1 << 34)] == [4, 4, 10, 20]
    within = simhash.Rule.within
    monkeypatch.setattr(simhash.Rule, "within", lambda radius, n: within(radius, rows))
    texts = copies(240, 120, seed=2)
    got = simhash.simhash_components(docs(texts)).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(texts, 3)[0]


def test_near_copies_in_chunks(docs, monkeypatch):
    """Groups of near copies dealt into chunks, and columns that clash."""
    rows = copies(200, 200, seed=6)
    want = {r["doc_id"] for r in simhash.without_near_copies(docs(rows)).collect()}
    monkeypatch.setattr(simhash, "BUFFER", 32)
    monkeypatch.setattr(simhash, "CHUNK", 8)
    monkeypatch.setattr(simhash, "SETS", 8)
    clash = docs(rows).withColumnRenamed("node", "row").withColumnRenamed("source", "bucket")
    got = simhash.without_near_copies(clash)
    assert got.columns == clash.columns and {r["doc_id"] for r in got.collect()} == want and len(want) < 150


@pytest.mark.parametrize(("words", "radius"), [(1, 3), (1, 0), (4, 60), (16, 170)])
def test_close_pairs(words, radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 256, (200, 8 * words), dtype=np.uint8)
    for i in range(50, 150):
        fps[i] = fps[50]
        for k in rng.integers(0, 64 * words, rng.integers(0, radius + 2)):
            fps[i, k // 8] ^= 1 << (k % 8)
    first, last = np.arange(1, 201), np.full(200, 200)
    last[:30] = 90
    got = {p for a, b in simhash.close_pairs(fps, first, last, radius) for p in zip(a.tolist(), b.tolist())}
    apart = np.bitwise_count(fps.view("<u8")[:, None] ^ fps.view("<u8")[None]).sum(-1)
    assert got == {(i, j) for i in range(200) for j in range(first[i], last[i]) if apart[i, j] <= radius}


def test_near_copies(docs, odd):
    rows = copies(90, 300, seed=5)
    kept = {r["doc_id"] for r in simhash.without_near_copies(docs(rows)).collect()}
    texts = dict(rows)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts.items()}
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for i in texts:
        near = [j for j in texts if j != i and jaccard(i, j) >= 0.9]
        if i not in kept:
            assert any(jaccard(i, j) > 0.7 for j in texts if j != i)
        elif near:
            assert i == min([i, *near])
    got = simhash.without_near_copies(odd)
    assert got.columns == odd.columns
    # the three texts without words are copies, so are "one", "one" and "ONE"
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "4", "5", "7", "None"]
    assert simhash.without_near_copies(odd.limit(0)).count() == 0


def test_shared_line_is_no_copy(docs):
    """Texts that repeat one line and differ in the rest are no near copies."""
    line = " ".join(f"line{k}" for k in range(10))
    rows = [(i, " ".join([line] * 10 + [f"t{i}w{k}" for k in range(100)])) for i in range(12)]
    assert simhash.without_near_copies(docs(rows)).count() == 12


def test_short_near_copies(docs):
    """Texts of a few words at 0.8 to 0.9, each of which is a copy of the one before it."""
    rows, words = [], [8, 9, 10, 13, 24, 44]
    for k in range(60):
        own = [f"t{k}w{i}" for i in range(words[k % 6])]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join([*own, "more"]))]
    got = {r["doc_id"] for r in simhash.without_near_copies(docs(rows)).collect()}
    assert got == set(range(0, 120, 2))


def test_exact_forest(monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 60, (4, 60)).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(60) < rng.choice([0, 0.05, 0.15]), rng.integers(0, 1 << 60, 60).astype(np.uint64), base[i % 4])) for i in range(80)]
    near = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8
    got = list(zip(*simhash.exact_forest(sets, 0.8)))
    assert all(near(i, j) for i, j in got)

    def parts(edges):
        root = list(range(80))
        for _ in range(80):
            for i, j in edges:
                root[i] = root[j] = min(root[i], root[j])
        return root

    assert parts(got) == parts([(i, j) for i in range(80) for j in range(i) if near(i, j)])


def test_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (2000, 2001)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert len({got[i] for i in range(301)}) == 1 and got[2000] == got[2001] != got[0] and 1000 not in got
