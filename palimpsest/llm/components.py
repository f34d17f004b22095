"""Connected components of a graph of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut

#: A round at least halves the linked nodes on average; this is far beyond what any table needs.
MOST_ROUNDS = 64


def components(links: DataFrame) -> DataFrame:
    """node, root for every end of `links` (a, b of type long); nodes of one component share their root.

    In each round every node points to the neighbour, or itself, that is first
    in an order drawn anew for the round; links are carried over to where their
    ends point, and loops and repeats go. An order by value would take one
    round per step along a chain; a drawn one shortens chains by a constant
    factor. A hub's links are folded by a partial aggregate, and the joins that
    carry links over are split by adaptive execution where a hub is hot.
    """
    links = cut(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    for k in range(MOST_ROUNDS):
        if links.isEmpty():
            break
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = F.min(F.struct(F.xxhash64("b", F.lit(k)).alias("o"), F.col("b").alias("n")))
        own = F.struct(F.xxhash64("node", F.lit(k)).alias("o"), F.col("node").alias("n"))
        step = both.groupBy(F.col("a").alias("node")).agg(first.alias("first"))
        step = cut(step.select("node", F.least("first", own)["n"].alias("root")))
        steps.append(step)
        moved = links.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        moved = moved.join(step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").filter("ra <> rb")
        links = cut(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    else:
        raise RuntimeError("components did not settle")
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # from the last round back: where the roots of a round went afterwards
    ended = steps[-1]
    for step in reversed(steps[:-1]):
        later = ended.select(F.col("node").alias("root"), F.col("root").alias("end"))
        ended = step.join(later, "root", "left").select("node", F.coalesce("end", "root").alias("root"))
    return cut(ended)
