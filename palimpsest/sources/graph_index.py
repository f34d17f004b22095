"""Commit graphs kept in chains and extended by what is new.

`history.graph` ranks the whole history. Here a history is ranked once: an append
ranks only the commits that it brings, puts each line of them at the end of the
chain that it continues, and looks up where their parents are. Questions read
the stored chains.

    parts/<id>/nodes     commits of one append, with chain and pos
    parts/<id>/edges     parent links that leave a chain, found by that append
    parts/<id>/waiting   links whose parent has not come so far, all of them
    log/<n>              the part of the n-th append

Commits may come in any order: a link to a parent that is not there waits for it.
A commit that is kept already is left out. A part is seen when its log entry is
there, so a writer that dies leaves nothing, and of two writers at once the
second does its append again on top of the first.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.history import Graph
from palimpsest.operators.lists import rank_lists
from palimpsest.operators.spread import lookup_large
from palimpsest.session import cut
from palimpsest.sources.log import Log

EDGE = ["chain", "from_pos", "bit", "to_chain", "to_pos"]
LINK = ["chain", "from_pos", "bit", "parent"]


class GraphIndex(Log):
    """The chains of all commits appended under `path`."""

    # --- reading ---------------------------------------------------------------

    def _read_parts(self, entries: list[tuple[int, dict]], name: str) -> DataFrame:
        # entries before the last whole one have been taken over by it
        start = next((i for i in reversed(range(len(entries))) if entries[i][1]["whole"]), 0)
        return self.spark.read.parquet(*[f"{self.path}/parts/{e['part']}/{name}" for _, e in entries[start:]])

    def graph(self) -> Graph:
        """All kept commits, for the operators of `history`."""
        entries = self.entries()
        if not entries:
            raise ValueError(f"no commit was appended to {self.path}")
        return Graph(self._read_parts(entries, "nodes"), self._read_parts(entries, "edges"))

    def waiting(self) -> DataFrame:
        """`(chain, from_pos, bit, parent)`: links to parents that have not come."""
        entries = self.entries()
        return self._read_parts(entries[-1:], "waiting")

    # --- writing ---------------------------------------------------------------

    def append(self, commits: DataFrame, before_claim: Callable[[], None] | None = None, tries: int = 100) -> int:
        """Keep the commits that are not kept; returns the number of the log entry.

        `commits(commit_id, parent_id, parent2_id, …)`, ids unique, columns the
        same in every append. Only the new commits are ranked; of the kept ones
        the id, chain and position are read, once for each of the two lookups.
        """
        rows = cut(commits)
        for _ in range(tries):
            entries = self.entries()
            part = uuid.uuid4().hex
            self._write(rows, entries, f"{self.path}/parts/{part}")
            if before_claim is not None:
                before_claim()
            number = entries[-1][0] + 1 if entries else 1
            if self.claim(number, {"part": part, "whole": not entries}):
                return number
        raise RuntimeError(f"other writers were faster {tries} times")

    def _write(self, rows: DataFrame, entries: list[tuple[int, dict]], home: str) -> None:
        place = ["commit_id", "chain", "pos"]
        if entries:
            kept = self._read_parts(entries, "nodes").select(*place)
            fresh = cut(rows.join(kept.select("commit_id"), "commit_id", "left_anti"))
        else:
            kept, fresh = None, rows
        # the least child continues a line, among commits that come together
        heirs = fresh.where(F.col("parent_id").isNotNull()).groupBy("parent_id").agg(F.min("commit_id").alias("commit_id"))
        heirs = cut(heirs)
        inner = heirs.join(fresh.select(F.col("commit_id").alias("parent_id")), "parent_id", "left_semi")
        linked = fresh.select("commit_id").join(inner, "commit_id", "left")
        ranked = rank_lists(linked.select(F.col("commit_id").alias("id"), F.col("parent_id").alias("pred")))
        placed = ranked.select(F.col("id").alias("commit_id"), F.col("head").alias("chain"), F.col("dist").alias("pos"))
        if kept is not None:
            # and a line goes on where its first commit's parent is the last of a chain
            ends = heirs.join(kept.withColumnRenamed("commit_id", "parent_id"), "parent_id")
            ends = ends.join(kept.select("chain", (F.col("pos") - 1).alias("pos")), ["chain", "pos"], "left_anti")
            onto = ends.select(F.col("commit_id").alias("head"), F.col("chain").alias("_chain"), (F.col("pos") + 1).alias("_from"))
            placed = lookup_large(placed.withColumnRenamed("chain", "head"), onto, ["head"], ["commit_id"], "left")
            placed = placed.select(
                "commit_id", F.coalesce("_chain", "head").alias("chain"), (F.col("pos") + F.coalesce("_from", F.lit(0))).alias("pos")
            )
        fresh.join(placed, "commit_id").write.parquet(f"{home}/nodes")
        nodes = self.spark.read.parquet(f"{home}/nodes")
        links = nodes.select("chain", F.col("pos").alias("from_pos"), F.posexplode(F.array("parent_id", "parent2_id")).alias("bit", "parent"))
        links = links.where(F.col("parent").isNotNull())
        known = nodes.select(*place)
        if kept is not None:
            links = links.unionByName(self._read_parts(entries[-1:], "waiting"))
            known = known.unionByName(kept)
        here = known.select(F.col("commit_id").alias("parent"), F.col("chain").alias("to_chain"), F.col("pos").alias("to_pos"))
        met = cut(lookup_large(links, here, ["parent"], ["chain", "from_pos"], "left"))
        along = (F.col("bit") == 0) & (F.col("chain") == F.col("to_chain")) & (F.col("to_pos") == F.col("from_pos") - 1)
        met.where(F.col("to_chain").isNotNull() & ~along).select(*EDGE).write.parquet(f"{home}/edges")
        met.where(F.col("to_chain").isNull()).select(*LINK).write.parquet(f"{home}/waiting")

    def compact(self) -> bool:
        """Write all parts as one; False if an append came between, which leaves the log as it is."""
        entries = self.entries()
        if len(entries) < 2:
            return True
        part = uuid.uuid4().hex
        for name, parts in (("nodes", entries), ("edges", entries), ("waiting", entries[-1:])):
            self._read_parts(parts, name).write.parquet(f"{self.path}/parts/{part}/{name}")
        return self.claim(entries[-1][0] + 1, {"part": part, "whole": True})
