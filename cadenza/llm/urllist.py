"""URL filters by a temporal list join, in DataFrame operations only.

A list is a log of dated entries (pattern, add or remove). Each addition holds
until the pattern's next entry: that makes validity intervals [from, until). A
pattern is a domain (it covers its subdomains) or a domain and a path (it covers
the path and what lies below). The captures' distinct pairs of host and period
(of `period_days`) are joined with the intervals by the host's suffixes, those
alone that hold at some time of the period; each capture then joins its host's
intervals of its period and takes, as of its fetch time, the longest active
pattern, of equally long ones the last in order.

So a row never holds a host's history, only what holds in a period, and a host
with a third of the captures is dealt by period; within a period the join splits
what is large.

Rows: a capture without url, host or time is evaluated too and matches nothing;
very long urls are only cut by pattern; repeated captures are each evaluated; of a
pattern's entries of one time a removal holds over additions, and of several
additions the one whose category comes last holds; an addition ends the addition
before it, of whatever category; entries without pattern or time are void, and
with an empty list nothing is blocked; an empty table gives an empty result; all
columns of the captures are kept, names of the result's that clash are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import free_name, written


def host_of(url):
    """The host of a URL in lower case, null without one."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.when(host != "", F.rtrim(host, F.lit(".")))


def path_of(url):
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """entries(pattern, action, at, category) -> (pattern, category, from, until); until is null where it still holds."""
    void = F.col("pattern").isNull() | F.col("at").isNull()
    # of one time the removal comes last
    order = Window.partitionBy("pattern").orderBy("at", F.when(F.col("action") == "remove", 1).otherwise(0), "category")
    last = F.lead("at").over(order)
    rows = entries.where(~void).select("pattern", "action", "category", F.col("at").alias("from"), last.alias("until"))
    return rows.where("action = 'add' and (until is null or until > `from`)").drop("action")


def temporal_filter(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at", period_days: int = 64) -> DataFrame:
    """captures with host, blocked, pattern and category (of the longest pattern active at the fetch time)."""
    seconds = lambda t: t.cast("timestamp").cast("long")
    period = lambda t: F.floor(seconds(t) / F.lit(period_days * 86400))
    listed = intervals(entries).select(
        F.lower(F.regexp_extract("pattern", "^[^/]+", 0)).alias("key"),
        period(F.col("from")).alias("first"),
        period(F.col("until")).alias("last"),
        F.struct(F.length("pattern").alias("size"), "pattern", "category", "from", "until", F.regexp_extract("pattern", "(/.*?)/?$", 1).alias("path")).alias("entry"),
    )
    base = captures.drop(*[c for c in ("host", "blocked", "pattern", "category") if c != url_col and c != time_col])
    base = base.withColumn("host", host_of(F.col(url_col)))
    entry_col, period_col = free_name(base, "entries"), free_name(base, "period")
    base = base.withColumn(period_col, period(F.col(time_col)))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = base.select("host", F.col(period_col).alias("period")).where("host is not null and period is not null").distinct().select("host", "period", F.explode(suffixes).alias("key"))
    held = asked.join(listed, "key").where("first <= period and (last is null or last >= period)")
    of_host = written(held.groupBy("host", F.col("period").alias(period_col)).agg(F.collect_list("entry").alias(entry_col)), "hosts")
    joined = base.join(of_host, ["host", period_col], "left")
    path = path_of(F.col(url_col))
    time = F.col(time_col)
    active = F.filter(
        F.col(entry_col),
        lambda e: (e["from"] <= time) & (e["until"].isNull() | (time < e["until"])) & ((e["path"] == "") | (path == e["path"]) | path.startswith(F.concat(e["path"], F.lit("/")))),
    )
    hit = F.array_max(active)
    out = joined.withColumn("blocked", F.coalesce(F.size(active) > 0, F.lit(False))).withColumn("pattern", hit["pattern"]).withColumn("category", hit["category"])
    return out.select(*[c for c in base.columns if c not in ("host", period_col)], "host", "blocked", "pattern", "category")
