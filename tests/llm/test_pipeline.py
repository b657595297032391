import random

import pytest

import corpus_pipeline as pipeline
from cadenza.llm.queries import vocabulary

BAD = ["idiot", "scum", "trash", "moron", "loser", "clown"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("tables"), random.Random(8)
    fresh = lambda k, n=120: [f"k{k}w{rng.randint(0, 10**6)}" for _ in range(n)]
    common = lambda n: [f"c{rng.randint(0, 300)}" for _ in range(n)]
    items = [fresh(f"b{i}", 30) for i in range(3)]
    rows, toxic = [], {}
    for i in range(400):
        words = [w for pair in zip(fresh(i, 60), common(60)) for w in pair]
        toxic[i] = i % 7 == 0
        if toxic[i]:
            for _ in range(5):
                words[rng.randint(0, 119)] = rng.choice(BAD)
        rows.append((i, " ".join(words)))
    clean = [r for r in rows if not toxic[r[0]]]
    copy, near = clean[5], clean[9]
    words = near[1].split()
    words[60] = "changed"
    leak = clean[11][1].split()
    extra = [(1000, copy[1]), (1001, " ".join(words)), (1002, " ".join(leak[:50] + items[1][15:] + leak[50:90] + items[1][:15])), (1003, None), (1004, ""), (1004, ""), (None, " ".join(fresh("n"))), (1005, "solo")]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in rows + extra]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(toxic[i])) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, toxic, copy[0], near[0]


def test_run(spark, tables):
    folder, docs, toxic, copy, near = tables
    got = pipeline.run(spark, folder).collect()
    ids = sorted(str(r["doc_id"]) for r in got)
    # of the three texts without words one stays: the one with the smallest id
    want = sorted([str(i) for i in range(400) if not toxic[i]] + ["1003", "1005", "None"])
    assert ids == want
    from tokenizers import Tokenizer

    library, texts = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), {i: t for i, t, *_ in docs}
    for r in got:
        assert r["ids"] == library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids and r["round_trip"]
        assert r["n_tokens"] == len(r["ids"]) and r["lang"] == "en"


def test_stages_keep_columns(spark, tables):
    folder = tables[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0
