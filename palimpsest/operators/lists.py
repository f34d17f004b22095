"""Position of nodes in linked lists, by pointer doubling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import cut


def _double(state: DataFrame) -> DataFrame:
    """Every unfinished node takes over the pointer of the node it points to."""
    targets = state.select(F.col("id").alias("at"), *[F.col(c).alias(f"t_{c}") for c in ("at", "dist", "done", "low")])
    moved = (
        state.where(~F.col("done"))
        .join(targets, "at")
        .select(
            "id",
            F.col("t_at").alias("at"),
            (F.col("dist") + F.col("t_dist")).alias("dist"),
            F.col("t_done").alias("done"),
            F.least("low", "t_low").alias("low"),
        )
    )
    return cut(state.where("done").unionByName(moved))


def _start(nodes: DataFrame) -> DataFrame:
    first = F.col("pred").isNull()
    return cut(
        nodes.select(
            "id",
            F.coalesce("pred", "id").alias("at"),
            F.when(first, 0).otherwise(1).cast("long").alias("dist"),
            first.alias("done"),
            F.least("id", F.coalesce("pred", "id")).alias("low"),
        )
    )


def rank_lists(nodes: DataFrame) -> DataFrame:
    """`(id, head, dist)` for `(id, pred)` where nobody is pred of two nodes.

    A cycle, for example a commit that is its own parent, has no head: it is
    refused after the rounds that any list of as many nodes needs.

    After each round a node points twice as far back, so a list of n nodes takes
    log2(n) rounds. Finished nodes are only targets; no round joins on a head
    that many nodes share.
    """
    state = _start(nodes)
    left = state.count().bit_length() + 1
    while unfinished := state.where(~F.col("done")).head(1):
        if not left:
            raise ValueError(f"cyclic_history: {unfinished[0]['id']} has no first node")
        state, left = _double(state), left - 1
    return state.select("id", F.col("at").alias("head"), "dist")


def rank_lists_and_cycles(nodes: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """As `rank_lists` where cycles of at most `longest` nodes may occur:
    `((id, dist) of lists, (id, dist, size) of cycles)`.

    A cycle is read from its least id, which has `dist` 0.
    """
    state = _start(nodes)
    for _ in range(math.ceil(math.log2(max(longest, 1))) + 1):
        if state.where(~F.col("done")).isEmpty():
            break
        state = _double(state)
    lists = state.where("done").select("id", "dist")
    cyclic = state.where(~F.col("done")).select("id", "low")
    links = nodes.join(cyclic, "id").select("id", F.when(F.col("id") != F.col("low"), F.col("pred")).alias("pred"))
    ranked = rank_lists(links)
    sizes = cyclic.groupBy("low").agg(F.count(F.lit(1)).alias("size"))
    cycles = ranked.join(sizes.withColumnRenamed("low", "head"), "head").select("id", "dist", "size")
    return lists, cycles
