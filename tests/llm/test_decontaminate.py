import random

from pyspark.sql import functions as F

from cadenza.llm import decontaminate as D


def brute_tiles(item, text, least):
    """The longest common run of unmarked words, the first in the item, then in the text, again and again."""
    taken, used, out = [False] * len(item), [False] * len(text), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not taken[i + n] and not used[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        taken[i : i + n] = used[j : j + n] = [True] * n
        out.append((i, j, n))


def test_tiles():
    rng = random.Random(0)
    for k in range(3000):
        letters, longest = rng.randint(2, 8), 25 if k % 10 else 90
        item = [rng.randint(1, letters) for _ in range(rng.randint(0, longest))]
        text = [rng.randint(1, letters) for _ in range(rng.randint(0, longest))]
        least = rng.choice((2, 3, 5))
        assert D.tiles(item, text, least) == brute_tiles(item, text, least)


def test_tiles_in_pieces(monkeypatch):
    """Passages cut, turned and repeated, found in few pairs at a time."""
    monkeypatch.setattr(D, "PAIRS", 7)
    rng = random.Random(1)
    for _ in range(300):
        item = [rng.randint(1, 40) for _ in range(rng.randint(10, 70))]
        text = []
        while len(text) < 80:
            a = rng.randrange(len(item))
            text += item[a : a + rng.randint(1, 20)] + [rng.randint(1, 40) for _ in range(rng.randint(0, 3))]
        assert D.tiles(item, text, 4) == brute_tiles(item, text, 4)


def test_repetitive():
    """The same word without end; a stretch again and again, of which only the first copies are compared."""
    assert D.tiles([1] * 400, [1] * 20_000, 5) == [(0, 0, 400)]
    assert D.tiles([2, 3, 4, 5, 6, 7] + [1] * 100, [1] * 20_000, 5) == [(6, 0, 100)]
    items = D.Items([("k", "a b c d e f g h i j k l m n o p"), ("t", "a b c d e f")], 5)
    rng = random.Random(2)
    for _ in range(60):
        text = []
        for _ in range(40):
            a = rng.randrange(10)
            text += list("abcdefghijklmnop")[a : a + rng.randint(5, 9)] + ["z"]
        for key, n, got in items.match(" ".join(text)):
            item = "abcdefghijklmnop"[:n]
            assert sorted(got) == sorted(brute_tiles(list(item), text, 5))


def words(n, seed):
    rng = random.Random(seed)
    return [f"t{seed}x{rng.randint(0, 999)}" for _ in range(n)]


def test_leaks(spark, docs, odd):
    items = [words(40, k) for k in range(4)]
    bench = spark.createDataFrame([(k, " ".join(w), 1) for k, w in enumerate(items)] + [(8, None, 1), (9, "one", 1)], "item_id long, text string, doc_id long")
    other = words(60, 99)
    rows = [
        (10, " ".join(other)),
        (11, " ".join(other[:20] + items[0] + other[20:])),
        (12, " ".join(other[:5] + items[1][20:] + other[5:9] + items[1][:20])),  # in another order
        (13, " ".join(items[2][:10] + other)),  # a quarter only
        (14, (" ".join(items[3]) + ". ").upper() + " " + " ".join(items[0])),
    ] + [(r["doc_id"], r["text"]) for r in odd.collect()]
    for max_bytes in (1 << 20, 600):  # shipped at once, and in parts
        got = D.contamination(docs(rows), bench, max_bytes=max_bytes).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(11, 0), (12, 1), (14, 0), (14, 3)]
        assert all(r["coverage"] == 1.0 for r in got)
        clean = D.decontaminated(docs(rows), bench, max_bytes=max_bytes)
        assert clean.columns == docs(rows).columns
        assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(i) for i, _ in rows if i not in (11, 12, 14))
    assert [len(r["tiles"]) for r in got if r["doc_id"] == 12] == [2]
    assert D.contamination(odd.limit(0), bench).count() == 0
    assert D.decontaminated(odd, bench.limit(0)).count() == odd.count()
    assert D.contamination(odd, bench.limit(0)).count() == 0
    clash = docs(rows).withColumn("text_hash", F.lit(1)).withColumn("Text_Size", F.lit(2))
    assert D.decontaminated(clash, bench, max_bytes=600).columns == clash.columns
