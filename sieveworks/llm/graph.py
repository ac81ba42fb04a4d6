"""Connected components of an edge table: contraction within tasks, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import with_leader, written

MOST_ROUNDS = 60
#: Edges that a task contracts at once.
EDGES = 1 << 18


def roots(edges: pd.DataFrame) -> pd.DataFrame:
    """(u, v): each node of the edges but the smallest of its component, with that smallest one."""
    up: dict = {}

    def top(x):
        over = x
        while (above := up.get(over, over)) != over:
            over = above
        while x != over:
            up[x], x = over, up[x]
        return over

    for u, v in zip(edges["u"], edges["v"], strict=True):
        a, b = top(u), top(v)
        if a != b:
            up[max(a, b)] = min(a, b)
    return pd.DataFrame([(x, top(x)) for x in list(up)], columns=["u", "v"])


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, with the same components: what a task holds, ``EDGES`` at a time, becomes stars around its smallest nodes."""

    def stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= EDGES:
                yield roots(pd.concat(held))
                held, n = [], 0
        if n:
            yield roots(pd.concat(held))

    kind = edges.schema["u"].dataType.simpleString()
    return edges.select("u", "v").mapInPandas(stars, f"u {kind}, v {kind}")


def unsettled(edges: DataFrame) -> int:
    """Nodes that keep the edges (u, v), u > v, from being stars around v: those with two v, and those that are u and v."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    return ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter("below > 1 or (below = 1 and above = 1)").count()


def components(edges: DataFrame, tag: str) -> DataFrame:
    """(node, root): every node of an edge (u, v), and the smallest node it can reach.

    Tasks contract their own edges first, as they come and twice by the larger end, of which each task before leaves one
    edge; that settles what is no long chain. Then each step points the neighbours of a node to its smallest neighbour,
    so the number of rounds grows with the logarithm of the graph, not with its longest path. Nodes with very many edges
    are summed over salts. Each round is written to the shared folder: its rows are no more than nodes and two each.
    """
    now = edges.filter(F.col("u") != F.col("v"))
    now = contracted(contracted(contracted(now).repartition("u")).repartition("u"))
    now = written(now.distinct(), tag)
    for _ in range(MOST_ROUNDS):
        if not unsettled(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_leader(both, "u", "v").filter("v > u").select(F.col("v").alias("u"), F.least("leader", "u").alias("v")).distinct()
        small = with_leader(large, "u", "v")
        linked = small.filter(F.col("v") != F.col("leader")).select(F.col("v").alias("u"), F.col("leader").alias("v"))
        now = written(linked.unionByName(small.select("u", F.col("leader").alias("v"))).distinct(), tag)
    else:
        raise RuntimeError(f"no end after {MOST_ROUNDS} rounds")
    top = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(top)
