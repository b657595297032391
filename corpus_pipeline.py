"""A corpus pipeline: toxicity, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns the rows that stay, with the
columns of documents; the last returns the tokens. Each is written as Parquet
and read back before the next.

Rows: a null text counts as empty in every stage: clean, a copy of other texts
without words, without benchmark passages, without tokens. A null id stays a row.
Repeated rows are judged alike; of near copies the row with the smallest id stays,
of rows with one id the one whose text's hash is smallest, one row of those equal
in both. Very long texts are read whole. Columns of any name are kept up to the
last stage. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm.bpe import bpe_ids
from cadenza.llm.common import table, written
from cadenza.llm.decontaminate import decontaminated
from cadenza.llm.queries import vocabulary
from cadenza.llm.simhash import without_near_copies
from cadenza.llm.toxicity import fit_toxicity, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose probability of grade 1 or more is under a half, by ordinal regression."""
    return without_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: 5-word shingles, similarity 0.8, by SimHash."""
    return without_near_copies(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that cover no benchmark item by a half or more, by greedy string tiling."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, round_trip (decoding gives the text back)."""
    return bpe_ids(docs, vocabulary("byte_bpe_50k.json"), also=[c for c in ("lang", "source") if c in docs.columns])


STAGES = [("toxicity", toxicity), ("near copies", near_copies), ("benchmark passages", benchmark_passages), ("tokens", tokens)]

#: SQL can express neither the fits nor the hashes; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
