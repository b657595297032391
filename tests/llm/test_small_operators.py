"""Sharding, token counts, scores, toxicity, URLs, fingerprints and pages."""

import datetime
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import chroma, katz, shard, toxicity, urllist, wordpiece
from cadenza.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")


def test_shards(docs, odd):
    rng = random.Random(0)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(900)] + [(1000 + i, "the same text " * 10) for i in range(500)] + [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = shard.sharded(docs(rows), 10).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    sizes, largest = Counter(), max(r["size"] for r in got)
    slots = {}
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    share = sum(sizes.values()) / 10
    assert set(sizes) <= set(range(10)) and all(abs(x - share) <= largest for x in sizes.values())
    got = shard.sharded(docs(rows[:3]), 10).collect()  # fewer rows than shards
    assert len(got) == 3 and all(0 <= r["shard"] < 10 for r in got)
    assert shard.sharded(odd.limit(0), 10).count() == 0
    same = shard.sharded(docs([(1, "a")] * 40), 4).collect()  # one row again and again
    assert sorted(Counter(r["shard"] for r in same).values()) == [10] * 4
    clash = docs(rows).withColumn("shard", F.lit("s")).withColumn("k1", F.lit(1)).withColumn("piece", F.lit(2)).withColumn("h", F.xxhash64("text")).withColumn("b", F.lit(7))
    kept = shard.histogram_sort(clash, 5, "b", "h", "doc_id")
    assert kept.columns == [*[c for c in clash.columns if c != "shard"], "shard", "slot"] and kept.count() == len(rows)
    counts = Counter(r["shard"] for r in kept.collect())  # equal sizes: equal counts
    assert max(counts.values()) - min(counts.values()) <= 1 and {r["piece"] for r in kept.collect()} == {2}


def greedy(word, pieces, longest):
    n = i = 0
    while i < len(word):
        i += next(k for k in range(min(longest, len(word) - i), 0, -1) if word[i : i + k] in pieces or k == 1)
        n += 1
    return n


def test_automaton():
    rng = random.Random(1)
    for _ in range(60):
        pieces = ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 6))).encode() for _ in range(rng.randint(0, 12))]
        a = wordpiece.Automaton(pieces)
        for _ in range(30):
            w = "".join(rng.choice("abc") for _ in range(rng.randint(0, 20))).encode()
            assert a.count(w) == greedy(w, set(pieces), 6)


def test_token_counts(odd):
    pieces = wordpiece.byte_pieces(open(PATH, encoding="utf-8").read())
    known, longest = set(pieces), max(map(len, pieces))
    got = wordpiece.token_counts(odd, PATH).collect()
    want = [(r["doc_id"], len((r["text"] or "").encode().split()), sum(greedy(b" " + w, known, longest) for w in (r["text"] or "").encode().split())) for r in odd.collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert wordpiece.token_counts(odd.limit(0), PATH).count() == 0


def brute_katz(rows):
    toks = lambda t: [*(t or "").encode().lower().split(), 0]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    one, two, three, ctx = Counter(), Counter(), Counter(), Counter()
    for i, t in rows:
        if not held(i):
            u = v = None
            for k, w in enumerate(toks(t)):
                one[w] += 1
                two[v, w] += 1
                ctx[v] += 1
                if k:
                    three[u, v, w] += 1
                u, v = v, w
    n, v_all = sum(one.values()), len(one)
    d1, d2, d3 = (katz.discounts(Counter(x.values())) for x in (one, two, three))
    d = lambda x, c: x[min(c, katz.LOW + 1) - 1]
    unknown = 1 - sum(d(d1, c) * c for c in one.values()) / n if n else 1.0
    p1 = lambda w: d(d1, one[w]) * one[w] / n if w in one else unknown
    left2, low2, left3, low3 = Counter(), Counter(), Counter(), Counter()
    for (v, w), c in two.items():
        left2[v] += d(d2, c) * c / ctx[v]
        low2[v] += p1(w)
    a2 = {v: (1 - left2[v]) / (1 - low2[v]) for v in ctx}
    p2 = lambda v, w: d(d2, two[v, w]) * two[v, w] / ctx[v] if (v, w) in two else a2.get(v, 1) * p1(w)
    for (u, v, w), c in three.items():
        left3[u, v] += d(d3, c) * c / two[u, v]
        low3[u, v] += p2(v, w)
    a3 = {x: (1 - left3[x]) / (1 - low3[x]) for x in left3}
    p3 = lambda u, v, w: d(d3, three[u, v, w]) * three[u, v, w] / two[u, v] if (u, v, w) in three else a3.get((u, v), 1) * p2(v, w)
    for v in list(ctx)[:40]:  # what the model gives all words and the unknown class
        assert math.isclose(sum(p2(v, w) for w in one) + a2[v] * unknown, 1, rel_tol=1e-9)
    for u, v in list(a3)[:40]:
        assert math.isclose(sum(p3(u, v, w) for w in one) + a3[u, v] * a2[v] * unknown, 1, rel_tol=1e-9)
    out = []
    for i, t in rows:
        u, v, score, base, known = None, None, 0.0, 0.0, 0
        for k, w in enumerate(toks(t)):
            score += math.log10(p3(u, v, w) if k else p2(None, w))
            base += math.log10((one.get(w, 0) + 1) / (n + v_all + 1))
            known += w in one
            u, v = v, w
        out.append((i, held(i), len(toks(t)), known, n, base, score))
    return out


@pytest.mark.parametrize(("hot", "block", "bucket"), [(1_000_000, 2_000_000, 2_000_000), (20, 700, 300), (1, 200, 100)])
def test_katz(docs, odd, monkeypatch, hot, block, bucket):
    """Scores against the recursion by hand: in one block and in many, with contexts spread over buckets."""
    monkeypatch.setattr(katz, "HOT", hot)
    monkeypatch.setattr(katz, "BLOCK_TOKENS", block)
    monkeypatch.setattr(katz, "BUCKET_ROWS", bucket)
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(0, 60)))) for i in range(300)] + [(r["doc_id"], r["text"]) for r in odd.collect()]
    rows += [(400 + i, t) for i, (_, t) in enumerate(rows[:60])]  # texts that occur twice
    got = sorted(map(tuple, katz.katz_scores(docs(rows)).collect()), key=str)
    want = sorted(brute_katz(rows), key=str)
    key = lambda x: (str(x[0]), x[2])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9)


def test_katz_empty(docs, odd):
    assert katz.katz_scores(odd.limit(0)).count() == 0
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = katz.katz_scores(docs([(i, "a b a") for i in held])).collect()  # no training text
    assert {(r["train_tokens"], r["n_known"], r["score"]) for r in got} == {(0, 0, 0.0)}
    assert sorted(map(tuple, katz.katz_scores(docs([(held[0], ""), (1, None)])).collect())) == sorted(brute_katz([(held[0], ""), (1, None)]))


BAD = ["idiot", "scum", "trash", "moron", "loser", "clown", "stupid", "worthless"]


def rude(rng, n):
    words = [f"w{rng.randint(0, 400)}" for _ in range(80)]
    for k in rng.sample(range(80), n):
        words[k] = rng.choice(BAD)
    return " ".join(words)


def test_toxicity(spark, docs, odd):
    rng = random.Random(3)
    toxic = [i % 5 == 0 for i in range(1500)]
    rows = [(i, rude(rng, rng.randint(1, 8) if t else 0)) for i, t in enumerate(toxic)]
    labels = spark.createDataFrame([(i, 1, int(t)) for i, t in enumerate(toxic[:1000])] + [(None, 1, 1), (3, 1, None), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    # other texts of a labelled id: the one with the smallest hash counts, whatever the order of the rows
    again = [(7, rude(rng, 0)) for _ in range(30)]
    model = toxicity.fit_toxicity(docs(rows + again), labels)
    assert toxicity.fit_toxicity(docs(again + rows[::-1]).repartition(5), labels).plain() == model.plain()
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 3
    got = toxicity.severities(docs(rows), model).collect()
    held = [r for r in got if r["doc_id"] >= 1000]
    assert sum(r["toxic"] == toxic[r["doc_id"]] for r in held) / len(held) > 0.97
    mild, severe = ([r["severity"] for r in held if sum(w in BAD for w in rows[r["doc_id"]][1].split()) in n] for n in ((1, 2), (6, 7, 8)))
    assert np.mean(severe) > np.mean(mild) + 0.5
    # the model's formula, word by word
    for r in got[::40] + got[1000:1010]:
        x = sum(model.weights.get(zlib.crc32(w.encode()), 0) for w in set(rows[r["doc_id"]][1].split()))
        p = [1 / (1 + math.exp(t - x)) for t in model.thresholds]
        assert math.isclose(r["severity"], sum(p), rel_tol=1e-9) and math.isclose(r["p_toxic"], p[0], rel_tol=1e-9)
        assert r["grade"] == sum(q >= 0.5 for q in p) and r["toxic"] == (p[0] >= 0.5)
    assert toxicity.severities(odd, model).count() == odd.count()
    assert toxicity.without_toxic(odd, model).columns == odd.columns
    few = toxicity.fit_toxicity(docs(rows), labels, max_features=8000)  # about a hundred texts
    assert few.plain() != model.plain()
    none = toxicity.fit_toxicity(docs(rows), labels.limit(0))
    assert {r["severity"] for r in toxicity.severities(docs(rows), none).collect()} == {0.0}
    assert toxicity.without_toxic(odd, none).count() == odd.count()
    assert toxicity.severities(odd.limit(0), model).count() == 0


def test_ordinal_grades(spark, docs):
    """Grades that the table holds, with the cumulative link's own law: the fit orders texts and is no worse than a plain slow one."""
    rng = random.Random(5)
    strength = {w: 0.6 + 0.5 * k for k, w in enumerate(BAD)}
    rows, grade = [], []
    for i in range(1200):
        text = rude(rng, rng.randint(0, 5))
        x = sum(strength.get(w, 0) for w in set(text.split()))
        u = rng.random()
        grade.append(sum(u < 1 / (1 + math.exp(t - x)) for t in (1.5, 4.0, 7.0)))
        rows.append((i, text))
    labels = spark.createDataFrame(list(enumerate(grade)), "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs(rows), labels)
    got = {r["doc_id"]: r for r in toxicity.severities(docs(rows), model).collect()}
    by_grade = [np.mean([got[i]["severity"] for i, g in enumerate(grade) if g == k]) for k in range(4)]
    assert by_grade == sorted(by_grade) and by_grade[3] > by_grade[0] + 1.5
    weights = [model.weights.get(zlib.crc32(w.encode()), 0) for w in BAD]
    assert np.corrcoef(weights, list(strength.values()))[0, 1] > 0.9
    # log-likelihood against plain gradient ascent over the true features
    x = np.array([[float(w in set(t.split())) for w in BAD] for _, t in rows])
    y = np.array(grade)

    def likelihood(w, t):
        p = np.column_stack([np.ones(len(y)), 1 / (1 + np.exp(np.array(t) - (x @ w)[:, None])), np.zeros(len(y))])
        k = np.arange(len(y))
        return np.log(np.maximum(p[k, y] - p[k, y + 1], 1e-12)).mean()

    w, t = np.zeros(8), np.array([0.5, 1.5, 2.5])
    for _ in range(400):
        z = np.concatenate([w, t])
        grad = np.array([(likelihood((z + e)[:8], (z + e)[8:]) - likelihood((z - e)[:8], (z - e)[8:])) / 2e-4 for e in np.eye(11) * 1e-4])
        w, t = w + 3 * grad[:8], t + 3 * grad[8:]
    assert likelihood(np.array(weights), model.thresholds) > likelihood(w, t) - 0.02


def test_urls(spark):
    day = datetime.date(2024, 1, 1)
    at = lambda n: day + datetime.timedelta(n)
    log = [("bad.org", "add", at(10), "spam"), ("bad.org", "remove", at(20), "spam"), ("bad.org", "add", at(30), "malware"), ("x.bad.org/p", "add", at(0), "adult"), (None, "add", at(0), "v"), ("tie.org", "add", at(5), "c"), ("tie.org", "remove", at(5), "c")]
    entries = spark.createDataFrame(log, "pattern string, action string, at date, category string")
    urls = ["http://bad.org/", "https://u:p@WWW.Bad.org:80/x", "http://notbad.org/", "http://x.bad.org/p/q?a", "http://x.bad.org/pq", "http://tie.org/", None, "nonsense", "http://bad.org/"]
    rows = [(i, u, at(n), "mine") for i, u in enumerate(urls) for n in (0, 10, 15, 20, 40)] + [(50, "http://bad.org/", None, "mine")]
    got = {(r["page_id"], r["fetched_at"]): r for r in urllist.temporal_filter(spark.createDataFrame(rows, "page_id long, url string, fetched_at date, category string"), entries).collect()}

    def brute(url, when):
        if url in (None, "nonsense") or when is None:
            return None
        host, path = {0: ("bad.org", "/"), 1: ("www.bad.org", "/x"), 2: ("notbad.org", "/"), 3: ("x.bad.org", "/p/q"), 4: ("x.bad.org", "/pq"), 5: ("tie.org", "/"), 8: ("bad.org", "/")}[urls.index(url)]
        hits = []
        for p in {x[0] for x in log if x[0]}:
            dom, _, rest = p.partition("/")
            if (host == dom or host.endswith("." + dom)) and (not rest or path == "/" + rest or path.startswith(f"/{rest}/")):
                state = [x for x in sorted((x for x in log if x[0] == p), key=lambda x: (x[2], x[1] == "remove")) if x[2] <= when]
                if state and state[-1][1] == "add":
                    hits.append((len(p), p, state[-1][3]))
        return max(hits)[1:] if hits else None

    for i, u, when, _ in rows:
        r, want = got[i, when], brute(u, when)
        assert r["blocked"] == (want is not None) and (r["pattern"], r["category"]) == (want or (None, None))
    empty = spark.createDataFrame([], "page_id long, url string, fetched_at date")
    assert urllist.temporal_filter(empty, entries).count() == 0
    assert not any(r["blocked"] for r in urllist.temporal_filter(spark.createDataFrame(rows[:9], "page_id long, url string, fetched_at date, category string"), entries.limit(0)).collect())


def test_url_history(spark):
    """A long history of a host and its subdomains, with times, ties and columns that clash, for periods of several lengths."""
    rng = random.Random(12)
    start = datetime.datetime(2023, 12, 25)
    patterns = ["h.org", "a.h.org", "h.org/p", "a.h.org/p/q", "org"]
    log = [(rng.choice(patterns), rng.choice(("add", "add", "remove")), start + datetime.timedelta(hours=rng.randint(0, 5000)), rng.choice("xyz")) for _ in range(400)]
    log += [("h.org", "add", log[0][2], c) for c in "yxz"]
    captures = [(k, rng.choice(("http://h.org/p", "http://a.h.org/p/q/r", "http://b.a.h.org/", "http://h.org/pp")), start + datetime.timedelta(hours=rng.randint(-50, 5050)), 1, "m") for k in range(500)]

    def brute(url, when):
        host, _, path = url.removeprefix("http://").partition("/")
        hits = []
        for p in patterns:
            dom, _, rest = p.partition("/")
            if (host == dom or host.endswith("." + dom)) and (not rest or path == rest or path.startswith(f"{rest}/")):
                past = sorted((x for x in log if x[0] == p and x[2] <= when), key=lambda x: (x[2], x[1] == "remove", x[3]))
                if past and past[-1][1] == "add":
                    hits.append((len(p), p, past[-1][3]))
        return max(hits, default=(0, None, None))[1:]

    entries = spark.createDataFrame(log, "pattern string, action string, at timestamp, category string")
    df = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp, entries int, period string")
    for days in (1, 64, 4000):
        out = urllist.temporal_filter(df, entries, period_days=days)
        assert out.columns == [*df.columns, "host", "blocked", "pattern", "category"]
        got = {r["page_id"]: (r["pattern"], r["category"]) for r in out.collect()}
        assert got == {k: brute(u, t) for k, u, t, *_ in captures}


def prints_of(spark, rows):
    df = spark.createDataFrame([(i, None if x is None else [float(y) for y in x], 1, "x") for i, x in rows], "vec_id long, embedding array<double>, `class` int, codes string")
    return chroma.fingerprints(df, "vec_id", "embedding", lambda x: chroma.contour_frames(440 * (1 + x)))


def exhaustive(prints, every=50, max_error=0.2, least=16):
    """What align gives, by comparing every query with every recording at every offset."""
    rows = [(r["vec_id"], None if r["codes"] is None else tuple(r["codes"])) for r in prints.collect()]
    sound = [c is not None and sum(x is not None for x in c) >= least for _, c in rows]

    def best(a, b):
        found = []
        for o in range(-len(a), len(b)):
            both = [(x, b[w + o]) for w, x in enumerate(a) if 0 <= w + o < len(b) and x is not None and b[w + o] is not None]
            if len(both) >= least:
                error = sum(((x ^ y) & 0xFFFFFFFF).bit_count() for x, y in both) / 32 / len(both)
                if error <= max_error:
                    found.append((-sum(x == y for x, y in both), error, abs(o), o))
        return min(found, default=None)

    out = {i: [set(), None] for i, _ in rows}
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for k, (q, a) in enumerate(rows):
        for m, (i, b) in enumerate(rows):
            if k == m or not (sound[k] and sound[m]):
                continue
            if a == b:
                root[find(m)] = find(k)
            if q % every:
                continue
            got = best(a, b)
            if got:
                root[find(m)] = find(k)
                out[q][0].add(m)
                if a != b:
                    least_m = min(j for j, c in rows if c == b)
                    out[q][1] = min(filter(None, (out[q][1], (*got, least_m))))
                if i % every:
                    out[i][0].add(k)
                    if a != b:
                        least_q = min(j for j, c in rows if c == a and j % every == 0)
                        turned = (got[0], got[1], got[2], -got[3], least_q)
                        out[i][1] = min(filter(None, (out[i][1], turned)))
    classes = {}
    for k, (i, _) in enumerate(rows):
        classes[i] = min(rows[m][0] for m in range(len(rows)) if find(m) == find(k))
    return {i: (classes[i], sum(c == d for d in [x for _, x in rows]) - 1 if sound[k] else 0, len(out[i][0]), None if out[i][1] is None else -out[i][1][0], None if out[i][1] is None else out[i][1][1]) for k, (i, c) in enumerate(rows)}


def test_chroma(spark, monkeypatch):
    """Equal, shifted, noisy, shorter and strange recordings against an exhaustive search: nothing is missed and nothing added."""
    rng = np.random.default_rng(4)
    songs = rng.uniform(-0.3, 0.3, (4, 120))
    rows = [(0, songs[0][:64]), (1, songs[0][20:84]), (2, songs[0][:64]), (50, songs[0][:64] + rng.normal(0, 1e-4, 64)), (4, None), (5, []), (6, [float("nan")] * 64), (7, [float("nan")] * 64)]
    rows += [(50 * k + 100 + n, (s + rng.normal(0, 0.02 + 0.01 * k, 120))[(n % 4) * 9 :][: 64 - 6 * n]) for k, s in enumerate(songs) for n in range(5)]
    rows += [(400, np.concatenate([songs[1][:40], [-2.0] * 20, songs[1][40:90]])), (401, songs[1][:90]), (402, songs[2][:31]), (403, songs[2][:30]), (404, songs[2])]
    prints = prints_of(spark, rows)
    want = exhaustive(prints)
    for block, cells in (((256, 2048), 1 << 21), ((2, 3), 1 << 10)):
        monkeypatch.setattr(chroma, "BLOCK", block)
        monkeypatch.setattr(chroma, "CELLS", cells)
        got = {r["vec_id"]: r for r in chroma.align(prints, "vec_id").collect()}
        assert len(got) == len(rows)
        assert {i: (r["class_id"], r["n_equal"], r["n_links"], r["votes"]) for i, r in got.items()} == {i: x[:4] for i, x in want.items()}
        assert all(r["bit_error"] == want[i][4] or math.isclose(r["bit_error"], want[i][4]) for i, r in got.items())
        assert got[0]["n_equal"] == 2 and got[0]["n_links"] > 2 and got[4]["class_id"] == 4 and got[7]["class_id"] == 7
        assert got[1]["frame_offset"] == 20 and got[1]["best_id"] in (0, 50)
    assert sum(x[3] is not None and x[3] < 4 for x in want.values()) > 5  # found without equal integers
    assert chroma.align(prints.limit(0), "vec_id").count() == 0


def test_chroma_copies(spark):
    """A group of copies: a row each, and repeated ids are recordings of their own."""
    rng = np.random.default_rng(7)
    song = rng.uniform(-0.3, 0.3, 64)
    got = chroma.align(prints_of(spark, [(i, song) for i in range(1, 8)] + [(50, song), (50, song), (51, [])]), "vec_id").collect()
    assert sorted((r["vec_id"], r["class_id"], r["n_equal"], r["n_links"]) for r in got) == [(i, 1, 8, 2) for i in range(1, 8)] + [(50, 1, 8, 8)] * 2 + [(51, 51, 0, 0)]
    assert all(r["best_id"] is None for r in got)


def test_fast_length():
    smooth = [n for n in range(1, 2000) if all(p in (2, 3, 5) for p in range(2, n + 1) if n % p == 0 and all(p % k for k in range(2, p)))]
    assert [chroma.fast_length(n) for n in range(1, 1900)] == [next(s for s in smooth if s >= n) for n in range(1, 1900)]


def test_pcm(spark):
    tone = [float(x) for x in np.sin(np.arange(40000) / 7)]
    df = spark.createDataFrame([(1, tone), (2, tone[:100])], "id long, pcm array<double>")
    got = {r["id"]: r["codes"] for r in chroma.fingerprints(df, "id", "pcm", lambda x: np.stack([chroma.pcm_frames(r) for r in x])).collect()}
    assert len(got[1]) > 5 and got[2] == []
    t = np.arange(11025 * 4) / 11025
    frames = chroma.pcm_frames(np.sin(2 * np.pi * 440 * t))
    assert (frames.argmax(axis=1) == 0).all() and chroma.pcm_frames(np.zeros(10)).shape == (0, 12)
    a, b = (chroma.codes(chroma.pcm_frames(np.sin(2 * np.pi * f * t)))[0] for f in (440, 554.37))
    assert len(a) and (a != b).any()
