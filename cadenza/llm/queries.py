"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.bpe import bpe_digests
from cadenza.llm.chroma import align, contour_frames, fingerprints
from cadenza.llm.common import table
from cadenza.llm.decontaminate import contamination
from cadenza.llm.html_extract import extract_text
from cadenza.llm.katz import katz_scores
from cadenza.llm.shard import sharded
from cadenza.llm.simhash import simhash_components
from cadenza.llm.toxicity import fit_toxicity, severities
from cadenza.llm.urllist import host_of, temporal_filter
from cadenza.llm.wordpiece import token_counts


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return severities(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op4_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding is read as a pitch contour of 64 frames around 440 Hz."""
    vectors = table(spark, sf_dir, "embeddings")
    return align(fingerprints(vectors, "vec_id", "embedding", lambda x: contour_frames(440 * (1 + x))), "vec_id")


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def listed_hosts(pages: DataFrame) -> DataFrame:
    """A dated list for the pages' hosts: x, from the host's MD5, says when it is listed, delisted and listed again.

    Entries are (pattern, action, at, category); half of the hosts also have one for their path /en.
    """
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    x = F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int")
    hosts = hosts.select("host", x.alias("x"))

    def entry(pattern: str, action: str, days: str, category: str, where: str) -> DataFrame:
        at = F.date_add(F.lit("2024-01-01").cast("date"), F.expr(days))
        return hosts.where(where).select(F.expr(pattern).alias("pattern"), F.lit(action).alias("action"), at.alias("at"), F.lit(category).alias("category"))

    return (
        entry("host", "add", "x % 200", "spam", "x % 3 <> 0")
        .unionByName(entry("host", "remove", "x % 200 + 30 + x % 90", "spam", "x % 3 <> 0"))
        .unionByName(entry("host", "add", "x % 200 + 150", "malware", "x % 3 = 1"))
        .unionByName(entry("host || '/en'", "add", "x % 250", "adult", "x % 2 = 0"))
    )


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7 % 366).cast("int")))
    out = temporal_filter(captures, listed_hosts(pages))
    return out.select("page_id", "url", "host", F.col("fetched_at").cast("string").alias("fetched_at"), "blocked", "pattern", "category")


OP10_SQL = """
with captures as (
  select page_id, url, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '') as host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path,
    date '2024-01-01' + cast(page_id * 7 % 366 as int) as fetched_at
  from pages),
hosts as (select distinct host, cast('0x' || substr(md5(host), 1, 4) as int) as x from captures where host is not null),
entries as (
  select host as pattern, 'add' as action, date '2024-01-01' + x % 200 as listed, 'spam' as category from hosts where x % 3 <> 0
  union all select host, 'remove', date '2024-01-01' + (x % 200 + 30 + x % 90), 'spam' from hosts where x % 3 <> 0
  union all select host, 'add', date '2024-01-01' + (x % 200 + 150), 'malware' from hosts where x % 3 = 1
  union all select host || '/en', 'add', date '2024-01-01' + x % 250, 'adult' from hosts where x % 2 = 0),
periods as (
  select pattern, action, category, listed as since, lead(listed) over (partition by pattern order by listed, (action = 'remove'), category) as until,
    split_part(pattern, '/', 1) as domain, regexp_extract(pattern, '(/.*?)/?$', 1) as below
  from entries),
hits as (
  select c.page_id, p.pattern, p.category, row_number() over (partition by c.page_id order by length(p.pattern) desc, p.pattern desc, p.category desc) as k
  from captures c join periods p on p.action = 'add' and (c.host = p.domain or ends_with(c.host, '.' || p.domain))
    and p.since <= c.fetched_at and (p.until is null or c.fetched_at < p.until)
    and (p.below = '' or c.path = p.below or starts_with(c.path, p.below || '/')))
select c.page_id, c.url, c.host, cast(cast(c.fetched_at as date) as varchar) as fetched_at, h.page_id is not null as blocked, h.pattern, h.category
from captures c left join hits h on c.page_id = h.page_id and h.k = 1
"""


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html, op2_decontaminate, op3_simhash, op4_chroma, op5_shard, op6_katz, op7_tokens, op8_bpe, op9_toxicity, op10_urls)}


def oracle_sql() -> dict[str, str]:
    return {"op10_urls": OP10_SQL}
