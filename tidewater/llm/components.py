"""Connected components by alternating large-star and small-star rounds, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import cut


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(998244353)))).first()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b) links -> (node, root) for every node that is not its component's smallest; others are their own root.

    Each round keeps at most as many edges as it got and moves every node nearer to the smallest it can
    reach; nodes are of any one type that has an order; rounds grow with the logarithm of the longest path. A hot node is a hot key of a sort-merge join
    only, which adaptive execution splits; the minima are combined before they are shuffled.
    Empty input gives an empty table; loops and repeated links change nothing.
    """
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    edges = cut(edges, "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = cut(small.unionAll(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
