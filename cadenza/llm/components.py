"""Connected components by contraction.

Each round every node picks the neighbour (or itself) that comes first in an
order drawn anew for the round, edges are renamed to the picks, loops and
repeats go. The expected number of nodes falls by a constant factor a round,
chains included. Edges are long pairs; nothing is gathered on the driver but a
count a round, and each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, component): a row for each node of an edge; component is one of its nodes."""
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    picks = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = F.struct(F.xxhash64("b", F.lit(len(picks))), "b")
        own = F.struct(F.xxhash64("a", F.lit(len(picks))), F.col("a").alias("b"))
        pick = both.groupBy("a").agg(F.min(first).alias("f")).select(F.col("a").alias("node"), F.least("f", own)["b"].alias("pick"))
        picks.append(written(pick, "picks"))
        left = picks[-1].select(F.col("node").alias("a"), F.col("pick").alias("x"))
        right = picks[-1].select(F.col("node").alias("b"), F.col("pick").alias("y"))
        renamed = edges.join(left, "a").join(right, "b").where("x <> y")
        edges = written(renamed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not picks:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = picks[0].select("node", F.col("pick").alias("component"))
    for p in picks[1:]:
        later = p.select(F.col("node").alias("component"), F.col("pick").alias("next"))
        out = out.join(later, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return written(out, "components")
