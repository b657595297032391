"""Main text of web pages: blocks by markup, boilerplate by host suffix arrays.

A page is cut into blocks of visible text. Markup decides what it names: menus,
headers, footers, asides, forms, notices, adverts, comments (by element, role,
class or id) are out. The token streams of all of a host's pages, with and without
articles, are concatenated; a suffix array and its common-prefix lengths bring
equal runs together, and runs of `min_run` tokens found on `min_pages` pages of
different text are boilerplate, wherever they stand. A check of the markup follows:
where a page has an article (or main) element, that is its text, and what the
array took of it is given back (`restored_words`), as articles quote each other
and a site holds copies; elsewhere the unique runs stay.

No task holds a host. A block of pages has a suffix array of its own, and the
host's runs are dealt by their first `min_run` tokens: a bucket gets each run once
from each block, as a hash of host and run with the number of different pages that
hold it there, and answers which are repeated. As most runs are unique, a smaller
exchange goes first: each run is stood for by one of the shorter runs within it
(the one with the least hash, 40 bits of it), and only runs whose stand-in is on
`min_pages` pages can be, and are, counted themselves. So a host's size changes
nothing but the work, and one with a third of all pages is dealt like the others.

Rows: null or empty html gives an empty text; a null url is a host of its own;
repeated pages, and others of equal text, count as one page when runs are
counted, and each gets a row; a page of fewer than min_run tokens has no runs; a
very long page is held whole in its task; malformed and cut-off markup is read as
far as it goes; columns other than the three read are left out, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import slices, total
from cadenza.llm.katz import by_block, pack, smallest, steps, unpack

BLOCK_TOKENS, BLOCK_PAGES = 1_000_000, 20_000
BUCKET_KEYS = 2_000_000  # of blocks that a bucket gets, about
PARTS = 4  # of the tables by block, for each partition of the pages
SHORTER = 3  # a run's stand-in has so many tokens less

#: Elements by what HTML makes of them.
RAW = frozenset("script style noscript template svg math iframe object embed canvas textarea select option button title head audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
NOISE = frozenset("nav header footer aside form menu dialog fieldset".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notification overlay popup promo promoted promotion recommended related replies reply respond share sharing sidebar skip social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
#: What such words are put together with in names of the same things.
GENERIC = frozenset("area bar block body bottom box btn button buttons column container content foot head holder icon icons inline inner item items label left links list main new outer page panel post posts reader readers right row section signup site slot text title top unit user wrap wrapper".split())

ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?)*+)(?:>|\Z)
    |</[^>]*(?:>|\Z)""",
    re.S | re.X,
)
PART = re.compile(r"[^\W\d_]+|\d+")


def names_noise(token: str) -> bool:
    """Whether a class or id names something other than text of the page: site-footer or ad, but not share-price."""
    parts = PART.findall(token)
    return any(p in NOISE_WORDS for p in parts) and all(p in NOISE_WORDS or p in GENERIC or p.isdigit() for p in parts)


def is_noise(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element is something other than text of the page; inside: of its article."""
    if name in NOISE and not (inside and name == "header"):
        return True
    if not attributes or name in ("html", "body"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        value = html.unescape(m[2] or m[3] or m[4] or "").lower()
        if key == "role" and value.strip() in NOISE_ROLES or key == "hidden" and value != "until-found" or key == "aria-hidden" and value == "true":
            return True
        if key in ("class", "id") and any(names_noise(t) for t in value.split()):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def is_article(name: str, attributes: str) -> bool:
    """Whether an element says that it is the page's text: by its name, role, class, id or schema.org property."""
    if name in ("article", "main"):
        return True
    if name in INLINE or not attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "itemprop") and any(t.replace("-", "").replace("_", "") == "articlebody" for t in value.split()) or key == "role" and value.strip() in ("main", "article"):
            return True
    return False


def blocks(page: str) -> list[tuple[str, bool]]:
    """The blocks of a page that markup doesn't rule out, as (text, whether in its article), in order; an article begins with an empty one."""
    out: list[tuple[str, bool]] = []
    parts: list[str] = []
    open_: list[tuple[str, bool, bool]] = []  # element, noise, article: of it or of one around it
    noise = article = False
    at = 0

    def end_block() -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, article))
        parts.clear()

    def pop(n: int) -> None:
        nonlocal noise, article
        del open_[n:]
        was = article
        noise, now = open_[-1][1:] if open_ else (False, False)
        if now != was:
            end_block()
            article = now

    while True:
        m = TOKEN.search(page, at)
        if not noise:
            text = page[at : m.start() if m else len(page)]
            if text:
                parts.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:  # an end tag
            if name not in INLINE:
                end_block()
            for n in range(len(open_) - 1, -1, -1):
                if open_[n][0] == name:
                    if name not in INLINE:
                        pop(n)
                    else:
                        pop(n) if n == len(open_) - 1 else open_.__setitem__(n, ("", *open_[n][1:]))
                    break
            continue
        if name not in INLINE:
            if name == "br":
                parts.append(" ")
            else:
                end_block()
        attributes = m[3] or ""
        if name in RAW:
            if not attributes.rstrip().endswith("/") and name not in VOID:
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = close.end() if close else (at if name in ("head", "button", "select", "option") else len(page))
            continue
        if name in VOID or attributes.rstrip().endswith("/"):
            continue
        if name in CLOSES_P and open_ and open_[-1][0] == "p":
            pop(len(open_) - 1)
        elif name in ("li", "dt", "dd", "tr", "td", "th") and open_ and open_[-1][0] == name:
            pop(len(open_) - 1)
        own = is_noise(name, attributes, article)
        body = is_article(name, attributes)
        if own and not noise:
            end_block()
        if body and not article and not (own or noise):
            end_block()
            out.append(("", True))  # an article, even if it holds nothing
            open_.append((name, noise, True))
            article = True
        else:
            open_.append((name, noise or own, article))
            noise = noise or own
    end_block()
    return out


def suffix_array(streams: list[np.ndarray], min_run: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the concatenated streams, of suffixes of min_run tokens or more, and whether one has the run of the one before.

    By prefix doubling of what is not told apart yet; the ranks of each depth give
    the common-prefix lengths of neighbours. Suffixes end with their page.
    """
    sizes = [len(s) for s in streams]
    n = sum(sizes)
    if n == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # tokens to the end of the page
    tokens = np.concatenate(streams)
    order = np.argsort(tokens)
    rank = np.empty(n, dtype=np.int32 if n < 1 << 31 else np.int64)  # the place of the first suffix that is equal so far
    first = np.append(True, tokens[order[1:]] != tokens[order[:-1]])
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, depth, tied = [rank], 1, order[~(first & np.append(first[1:], True))]
    while depth < max(sizes):
        if not len(tied):
            break
        second = np.zeros(len(tied), dtype=np.int64)
        far = left[tied] > depth
        second[far] = rank[tied[far] + depth] + 1
        both = rank[tied] * np.int64(n + 1) + second
        by = np.argsort(both)
        tied, both = tied[by], both[by]
        group = np.append(True, np.diff(rank[tied]) != 0)
        part = np.append(True, both[1:] != both[:-1])
        at = np.arange(len(tied))
        deeper = rank.copy()
        deeper[tied] += (np.maximum.accumulate(np.where(part, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))).astype(rank.dtype)
        rank = deeper
        levels.append(rank)
        tied = tied[~(part & np.append(part[1:], True))]
        depth *= 2
    order = np.argsort(rank)
    order = order[left[order] >= min_run]
    return order, np.append(False, common_prefixes(order, levels, left) >= min_run)[: len(order)]


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], left: np.ndarray) -> np.ndarray:
    """The tokens that suffixes have in common with the next in order; levels: ranks by the first 1, 2, 4, ... tokens."""
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), dtype=np.int64)
    most = np.minimum(left[a], left[b])
    for k in range(len(levels) - 1, -1, -1):
        # twice, as the last level may be all there is of longer prefixes
        open_ = np.flatnonzero(common < most)
        same = levels[k][a[open_] + common[open_]] == levels[k][b[open_] + common[open_]]
        common[open_[same]] += 1 << k
    return np.minimum(common, most)


def words_of(blocks: list[str]) -> list[str]:
    return [w for b in blocks for w in b.split(" ")]


class Hashes(dict):
    """Words and their hashes, made when they are first met."""

    def __missing__(self, word: str) -> int:
        import xxhash

        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def tokens_of(words: list[str], known: Hashes) -> np.ndarray:
    """The words' hashes."""
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def run_keys(hosts: np.ndarray, tokens: np.ndarray, at: np.ndarray, min_run: int) -> np.ndarray:
    """A hash of the host (its hash is given for each place) and of the run that begins at each place."""
    h = hosts.copy()
    for k in range(min_run):
        h = (h ^ tokens[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def host_hashes(hosts: list[str]) -> np.ndarray:
    import xxhash

    known = {h: xxhash.xxh64_intdigest(h) for h in set(hosts)}
    return np.array([known[h] for h in hosts], dtype=np.uint64)


def local_runs(hosts: list[str], streams: list[np.ndarray], min_run: int, min_pages: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, page): each run of the hosts' pages with min_pages of the different pages that hold it, or all; a page is a hash of its tokens."""
    import xxhash

    own = {xxhash.xxh64_intdigest(s.tobytes(), seed=int(h)): (h, s) for h, s in zip(host_hashes(hosts), streams)}  # pages of equal text are one
    marks, parts = np.array(list(own), dtype=np.uint64), [s for _, s in own.values()]
    # a host's tokens are its own, so no run is of two hosts
    order, same = suffix_array([(s ^ h) * np.uint64(0x9E3779B97F4A7C15) for h, s in own.values()], min_run)
    if not len(order):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    sizes = [len(s) for s in parts]
    of = np.repeat(np.arange(len(parts)), sizes)
    run = np.cumsum(~same)
    by = np.argsort(run * len(parts) + of[order])
    order, run = order[by], run[by]
    page = of[order]
    new = np.append(True, (run[1:] != run[:-1]) | (page[1:] != page[:-1]))
    order, page, run = order[new], page[new], run[new]
    first = np.append(True, run[1:] != run[:-1])
    keep = np.arange(len(run)) - np.maximum.accumulate(np.where(first, np.arange(len(run)), 0)) < min_pages
    order, page = order[keep], page[keep]
    hashes = np.array([h for h, _ in own.values()], dtype=np.uint64)
    return run_keys(hashes[page], np.concatenate(parts), order, min_run), marks[page]


class Block:
    """Pages side by side, as tokens, with their runs."""

    def __init__(self, row: dict, min_run: int, min_pages: int):
        import zstandard

        self.min_run, self.min_pages, self.hosts = min_run, min_pages, row["hosts"]
        self.pages = pickle.loads(zstandard.ZstdDecompressor().decompress(row["pages"]))
        known = Hashes()
        self.words = [words_of([t for t, _ in x if t]) for x in self.pages]
        self.streams = [tokens_of(w, known) for w in self.words]
        self.counted = np.zeros(len(self.pages), dtype=bool)  # not those whose text another page before has
        self.counted[row["firsts"] or []] = True
        self.sizes = [len(s) for s in self.streams]
        n = sum(self.sizes)
        tokens = np.concatenate([*self.streams, np.zeros(0, np.uint64)])
        page = np.repeat(np.arange(len(self.pages)), self.sizes)
        host = host_hashes(self.hosts)[page]
        self.at = np.flatnonzero(np.repeat(np.cumsum(self.sizes), self.sizes) - np.arange(n) >= min_run)
        self.page = page[self.at]
        self.runs = run_keys(host[self.at], tokens, self.at, min_run)
        size = max(1, min_run - SHORTER)
        within = run_keys(host[: max(0, n - size + 1)], tokens, np.arange(max(0, n - size + 1)), size)
        self.shorts = np.minimum.reduce([within[self.at + k] for k in range(min_run - size + 1)]) >> np.uint64(24)

    def ask_shorts(self) -> tuple[np.ndarray, np.ndarray]:
        """The stand-ins, ascending, and on how many of the counted pages each is, min_pages at most."""
        pair = np.sort(self.shorts << np.uint64(24) | self.page.astype(np.uint64))
        short, page = pair >> np.uint64(24), (pair & np.uint64((1 << 24) - 1)).astype(np.int64)
        new = np.append(True, short[1:] != short[:-1])[: len(short)]
        once = np.append(True, pair[1:] != pair[:-1])[: len(short)] & self.counted[page]
        n = np.bincount(np.cumsum(new) - 1, weights=once) if len(short) else np.zeros(0)
        return short[new], np.minimum(n, self.min_pages).astype(np.uint8)

    def candidates(self, answers: list, n: int) -> np.ndarray:
        """The runs whose stand-in is on min_pages pages."""
        keys = sorted_once(self.shorts)
        often = keys[answered(keys, answers, n, 40)]
        low = np.zeros(1 << 20, dtype=bool)
        low[often & np.uint64(len(low) - 1)] = True
        some = np.flatnonzero(low[self.shorts & np.uint64(len(low) - 1)])
        return some[np.isin(self.shorts[some], often)]

    def ask_runs(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs among some, ascending, and on how many of the counted pages each is, by the suffix array, min_pages at most."""
        keys = sorted_once(self.runs[some])
        counted = np.flatnonzero(self.counted).tolist()
        own, n = np.unique(local_runs([self.hosts[k] for k in counted], [self.streams[k] for k in counted], self.min_run, self.min_pages)[0], return_counts=True)
        counts = np.zeros(len(keys), dtype=np.uint8)
        if len(own):
            k = np.minimum(np.searchsorted(own, keys), len(own) - 1)
            counts = np.where(own[k] == keys, n[k], 0).astype(np.uint8)
        return keys, counts

    def covered(self, some: np.ndarray, answers: list, n: int) -> list[np.ndarray]:
        """Of each page, which tokens are under a repeated run."""
        keys, of = np.unique(self.runs[some], return_inverse=True)
        begin = self.at[some][answered(keys, answers, n, 64)[of]]
        cover = np.zeros(sum(self.sizes) + 1, dtype=np.int64)
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + self.min_run, -1)
        return np.split(np.cumsum(cover)[:-1] > 0, np.cumsum(self.sizes)[:-1])

    def texts(self, covered: list[np.ndarray]) -> Iterator[tuple[str, bool, int, int]]:
        """(text, whether it is an article's, words cut, words given back): what the arrays leave, but articles whole."""
        for page, words, cover in zip(self.pages, self.words, covered):
            if any(a for _, a in page):
                back = 0
                if cover.any():
                    article = np.repeat([a for t, a in page if t], [t.count(" ") + 1 for t, _ in page if t]).astype(bool)
                    back = int((cover & article).sum())
                yield " ".join(t for t, a in page if a and t), True, 0, back
            else:
                yield " ".join(w for w, c in zip(words, cover.tolist()) if not c), False, int(cover.sum()), 0


def sorted_once(a: np.ndarray) -> np.ndarray:
    a = np.sort(a)
    return a[np.append(True, a[1:] != a[:-1])[: len(a)]]


def bucket_ends(keys: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Where the keys of n buckets begin and end among ascending keys: a bucket has a range of keys."""
    top = keys if bits <= 40 else keys >> np.uint64(24)
    bucket = top * np.uint64(n) >> np.uint64(40)
    return np.searchsorted(bucket, np.arange(n + 1, dtype=np.uint64))


def asked(block: int, keys: np.ndarray, counts: np.ndarray, n: int, bits: int) -> Iterator[tuple]:
    ends = bucket_ends(keys, n, bits).tolist()
    for q, (i, j) in enumerate(zip(ends, ends[1:])):
        if i < j:
            yield q, block, pack(steps(keys[i:j]), smallest(counts[i:j]))


def answered(keys: np.ndarray, answers: list, n: int, bits: int) -> np.ndarray:
    """Which of a block's ascending keys are repeated."""
    out = np.zeros(len(keys), dtype=bool)
    ends = bucket_ends(keys, n, bits)
    for x in answers or ():
        i, j = ends[x["q"]], ends[x["q"] + 1]
        out[i:j] = np.unpackbits(np.frombuffer(unpack(x["blob"])[0], dtype=np.uint8), count=j - i)
    return out


def repeated(rows: DataFrame, min_pages: int, name: str, parts: int) -> DataFrame:
    """(q, block, blob) -> (block, q, n, blob), a table by block: which of its n keys the bucket finds on min_pages pages; no row where none is."""

    def run(table: pa.Table) -> pa.Table:
        got = [unpack(x) for x in table.column("blob").to_pylist()]
        keys = [np.cumsum(k, dtype=np.uint64) for k, _ in got]
        of = np.unique(np.concatenate(keys), return_inverse=True)[1]
        often = (np.bincount(of, weights=np.concatenate([c for _, c in got])) >= min_pages)[of]
        each = np.split(often, np.cumsum([len(k) for k in keys])[:-1])
        out = [(b, q, int(x.sum()), pack(np.packbits(x))) for b, q, x in zip(table.column("block").to_pylist(), table.column("q").to_pylist(), each) if x.any()]
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["block", "q", "n", "blob"])

    return by_block(rows.groupBy("q").applyInArrow(run, "block bigint, q int, n bigint, blob binary").repartition(parts, "block"), name, parts)


def extract_text(pages: DataFrame, min_run: int = 8, min_pages: int = 3, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars, host, by_markup (the page has an article), repeated_words (cut from the text as boilerplate), restored_words (repeated, but the article's)."""
    from cadenza.llm.urllist import host_of
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("h"))
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    parts = max(8, PARTS * rows.rdd.getNumPartitions())
    made = StructType.fromDDL(f"block bigint, ids array<{kinds[0]}>, urls array<{kinds[1]}>, hosts array<string>, pages binary, marks array<bigint>, n_tokens bigint")
    arrow = to_arrow_schema(made)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard
        from pyspark import TaskContext

        block, held, n = TaskContext.get().partitionId() << 32, ([], [], [], [], []), 0

        def made_block() -> pa.RecordBatch:
            ids, urls, hosts, got, marks = held
            data = zstandard.ZstdCompressor(level=3).compress(pickle.dumps(got, protocol=5))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((block, ids, urls, hosts, data, np.array(marks, np.uint64).view(np.int64).tolist(), n), arrow.types)], schema=arrow)

        for batch in batches:
            for part in slices(batch):
                columns = [c.to_pylist() for c in part.columns]
                for key, url, host, code, page in zip(*columns[:3], host_hashes(columns[2]), columns[3]):
                    got = blocks(page)
                    whole = " ".join(t for t, _ in got if t)
                    for x, y in zip(held, (key, url, host, got, xxhash.xxh64_intdigest(whole, seed=int(code)))):
                        x.append(y)
                    n += whole.count(" ") + 1
                    if n >= BLOCK_TOKENS or len(held[0]) >= BLOCK_PAGES:
                        yield made_block()
                        block, held, n = block + 1, ([], [], [], [], []), 0
        if held[0]:
            yield made_block()

    table = by_block(rows.mapInArrow(cut, made), "pages", parts)
    (n_tokens,) = total(table, F.sum("n_tokens"))
    firsts = table.select("block", F.posexplode("marks").alias("pos", "mark")).groupBy("mark").agg(F.min(F.struct("block", "pos")).alias("f")).select("f.*")
    joined = table.join(by_block(firsts.groupBy("block").agg(F.collect_list("pos").alias("firsts")).repartition(parts, "block"), "firsts", parts).hint("shuffle_hash"), "block", "left")

    def each(joined: DataFrame, use: Callable[[dict, Block], Iterator[tuple]]) -> DataFrame:
        """(q, block, blob) of what `use` makes of each block."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = {c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names)}
                    out = list(use(row, Block(row, min_run, min_pages)))
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["q", "block", "blob"])

        return joined.drop("ids", "urls", "marks", "n_tokens").mapInArrow(run, "q int, block bigint, blob binary")

    def gathered(t: DataFrame, name: str) -> DataFrame:
        return t.groupBy("block").agg(F.collect_list(F.struct("q", "blob")).alias(name)).hint("shuffle_hash")

    n1 = max(8, -(-n_tokens // 2 // BUCKET_KEYS))
    shorts = repeated(each(joined, lambda row, b: asked(row["block"], *b.ask_shorts(), n1, 40)), min_pages, "shorts", parts)
    joined = joined.join(gathered(shorts, "shorts"), "block", "left")
    # a stand-in stands for three runs, about
    n2 = max(8, -(-3 * total(shorts, F.sum("n"))[0] // BUCKET_KEYS))
    runs = repeated(each(joined, lambda row, b: asked(row["block"], *b.ask_runs(b.candidates(row["shorts"], n1)), n2, 64)), min_pages, "runs", parts)
    joined = joined.join(gathered(runs, "runs"), "block", "left")

    result = StructType.fromDDL(f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars bigint, host string, by_markup boolean, repeated_words bigint, restored_words bigint")
    final = to_arrow_schema(result)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names)}
                b = Block(row, min_run, min_pages)
                got = list(b.texts(b.covered(b.candidates(row["shorts"], n1), row["runs"], n2)))
                text, markup, cut_, back = ([x[i] for x in got] for i in range(4))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((row["ids"], row["urls"], text, [len(t) for t in text], row["hosts"], markup, cut_, back), final.types)], schema=final)

    return joined.drop("marks", "n_tokens").mapInArrow(finish, result)
