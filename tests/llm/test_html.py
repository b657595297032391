"""Pages: text by markup, and boilerplate of hosts against brute force."""

import random

import numpy as np

from cadenza.llm import html_extract as H

PAGE = (
    "<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=/>Home</a></nav><script>var x='</p>';</script>"
    "<div class='cookie-notice'>We use cookies</div><article><header><h1>Head &amp; line</h1></header><p>First <b>par</b>agraph&nbsp;one<br>two<p>Second <!-- no --> text"
    "<form>Send</form><ul><li>a<li>b</ul></article><section id=comments><article>A reader</article></section><aside>Side</aside><footer>&copy; us</footer>"
)


def article(page):
    return " ".join(t for t, inside in H.blocks(page) if inside and t)


def test_page():
    assert article(PAGE) == "Head & line First paragraph one two Second text a b"
    assert H.blocks("") == [] and H.blocks("plain") == [("plain", False)]
    assert [t for t, _ in H.blocks("<p>cut <b off")] == ["cut"]


def test_attributes():
    assert article("<article><p data-x=it's>Hello</p><p>we don't stop</p><p>end</article>") == "Hello we don't stop end"
    assert article("<article><p title='a > b' data-y = \"</p>\">One</p><p \"odd>two</p></article>") == "One two"
    assert article("<article><p class=share-price>Text</p><section id=menu-engineering><h2 id=related-work>More</h2></section></article>") == "Text More"
    assert article("<article><p>Text</p><div class='x ad'>Buy</div><div id=related-posts>See</div><div class=cookie-notice>OK</div><p hidden>no</p></article>") == "Text"
    assert article("<a href='#articlebody'>skip</a><div class='article-body'>Text</div><div>Other</div>") == "Text"
    assert article("<div itemprop=articleBody>Text</div><p>Other") == "Text"
    assert H.names_noise("site-footer") and H.names_noise("comments") and not H.names_noise("price") and not H.names_noise("été")


def brute(pages, run, least):
    """Words of each page of one host that no run found on `least` pages of different text covers."""
    seen = {}
    for words in {tuple(p) for p in pages}:
        for i in range(len(words) - run + 1):
            seen.setdefault(words[i : i + run], set()).add(words)
    out = []
    for words in pages:
        mask = [False] * len(words)
        for i in range(len(words) - run + 1):
            if len(seen[tuple(words[i : i + run])]) >= least:
                mask[i : i + run] = [True] * run
        out.append([w for w, m in zip(words, mask) if not m])
    return out


def test_suffix_array():
    rng = np.random.default_rng(5)
    for _ in range(150):
        streams = [rng.integers(0, 3, rng.integers(0, 30)).astype(np.uint64) for _ in range(rng.integers(1, 7))]
        run, least = int(rng.integers(1, 6)), int(rng.integers(1, 4))
        order, same = H.suffix_array(streams, run)
        text = [tuple(s[i:].tolist()) for s in streams for i in range(len(s))]
        runs = [text[k][:run] for k in order]
        assert runs == sorted(runs) and len(runs) == sum(len(t) >= run for t in text)
        assert same.tolist() == [k > 0 and runs[k] == runs[k - 1] for k in range(len(runs))]
        # the runs that leave two batches, counted together
        seen = {}
        for half in (streams[::2], streams[1::2]):
            for key, page in zip(*(x.tolist() for x in H.local_runs(["h"] * len(half), half, run, least))):
                seen.setdefault(key, set()).add(page)
        held = {}
        for s in {tuple(s.tolist()) for s in streams}:
            for i in range(len(s) - run + 1):
                held.setdefault(s[i : i + run], set()).add(s)
        assert sorted(min(len(x), least) for x in seen.values()) == sorted(min(len(x), least) for x in held.values())


def test_hosts(spark):
    """Pages without an article against brute force, on hosts of many and of few pages, in many partitions."""
    rng = random.Random(3)
    shared = [" ".join(f"s{k}w{i}" for i in range(rng.randint(3, 14))) for k in range(9)]

    def page(k):
        parts = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 20))) for _ in range(3)]
        for x in rng.sample(shared, 3):
            parts.insert(rng.randint(0, len(parts)), x)
        return parts

    rows, plain = [], {}
    for host, n in (("big.org", 400), ("b.org", 12), ("c.org", 2)):
        pages = [page(k) for k in range(n)]
        pages += pages[:3] * 2  # copies count as one page
        plain[host] = [" ".join(p).split() for p in pages]
        rows += [(len(rows) + k, f"http://{host}/{k}", "<body>" + "".join(f"<div>{x}</div>" for x in p), 1, "x") for k, p in enumerate(pages)]
    # a footer on six pages is cut whatever the size of the host
    foot = " ".join(f"f{i}" for i in range(9))
    for host, n in (("small.org", 20), ("large.org", 3000)):
        rows += [(10000 * n + k, f"http://{host}/{k}", f"<div>own {host} {k}</div>" + f"<div>{foot}</div>" * (k < 6), 1, "x") for k in range(n)]
    rows += [(-1, "http://c.org/a", PAGE, 1, "x"), (-1, "http://c.org/a", PAGE, 1, "x"), (-2, None, None, 1, "x"), (-3, "http://c.org/x", "", 1, "x"), (-4, "http://c.org/y", "<p>short", 1, "x"), (-5, "http://c.org/z", "<article>" + "word " * 100000, 1, "x"), (-6, "http://c.org/w", "<div>Menu</div><article><nav>x</nav></article>", 1, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, page int, blocks string").repartition(7)
    got = {}
    for r in H.extract_text(df).collect():
        got.setdefault(r["page_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    at = 0
    for pages in plain.values():
        for k, want in enumerate(brute(pages, 8, 3)):
            (r,) = got[at + k]
            assert r["text"] == " ".join(want) and r["n_chars"] == len(r["text"]) and r["repeated_words"] == len(pages[k]) - len(want)
        at += len(pages)
    assert sum(r[0]["repeated_words"] > 0 for r in got.values()) > 100
    for host, n in (("small.org", 20), ("large.org", 3000)):
        assert all(got[10000 * n + k][0]["text"] == f"own {host} {k}" for k in range(n))
    assert [r["text"][:11] for r in got[-1]] == ["Head & line"] * 2 and got[-1][0]["by_markup"]
    assert got[-2][0]["text"] == got[-3][0]["text"] == got[-6][0]["text"] == "" and got[-4][0]["text"] == "short" and got[-5][0]["n_chars"] == 499999
    assert H.extract_text(df.limit(0)).count() == 0


def test_common_prefixes():
    """Whole suffixes in order, also beyond min_run, and what neighbours have in common."""
    rng = np.random.default_rng(6)
    for _ in range(150):
        streams = [rng.integers(0, 2, rng.integers(1, 40)).astype(np.uint64) for _ in range(rng.integers(1, 6))]
        run = int(rng.integers(1, 6))
        order, same = H.suffix_array(streams, run)
        text = [tuple(s[i:].tolist()) for s in streams for i in range(len(s))]
        whole = [text[k] for k in order]
        common = [next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(whole, whole[1:])]
        assert whole == sorted(whole) and same.tolist() == [False, *(n >= run for n in common)][: len(whole)]


def test_articles_in_arrays(spark):
    """Articles go through the host's arrays too: what these take is given back there, and cut from pages without an article."""
    run = " ".join(f"r{i}" for i in range(10))
    page = lambda k, body: (k, f"http://a.org/{k}", body)
    rows = [page(k, f"<article><p>own {k}</p><p>{run}</p></article>") for k in range(2)]
    rows += [page(2, f"<div>own 2</div><div>{run}</div>"), page(3, "<article>alone</article>")]
    rows += [(4, "http://b.org/4", f"<div>other {run}</div>"), (5, "http://b.org/5", f"<article>{run}</article>")]
    got = {r["page_id"]: r for r in H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got[2]["text"] == "own 2" and got[2]["repeated_words"] == 10 and got[2]["restored_words"] == 0
    assert [got[k]["text"] for k in (0, 1, 3, 4, 5)] == [f"own 0 {run}", f"own 1 {run}", "alone", f"other {run}", run]
    assert [got[k]["restored_words"] for k in (0, 1, 3, 4, 5)] == [10, 10, 0, 0, 0] and not any(got[k]["repeated_words"] for k in (0, 1, 3, 4, 5))
