"""Commits of table versions to branches, with compare-and-swap of heads.

A store is a folder that all writers reach:

    batches/<id>/rows/<table>   rows of all commits of one call, with commit_id
    batches/<id>/commits-<k>    which of them are made: one row per commit
    batches/<id>/heads-<k>      the heads of all branches, in every FULL-th entry
    log/<n>                     the name of the k-th form of a batch: entry n

Rows are written first and are seen by nobody. A batch of commits, to any number
of branches, becomes visible as a whole when its log entry is created; the entry
is complete at that moment, and creating it fails if another writer took the
number. The loser reads what was committed in between, judges its proposals
again, and tries the next number. A writer that dies leaves files that no entry
names. Nothing that is visible is ever changed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.cells import fingerprint
from palimpsest.session import cut
from palimpsest.sources.log import Log

FULL = 16
COMMITS = "entry long, branch_id string, commit_id string, parent_id string, parent2_id string, message string, hash_a long, hash_b long, n_rows long"
PROPOSAL = ["branch_id", "commit_id", "expected_head", "parent2_id", "message"]


class CommitStore(Log):
    """Branches and their versions under `path`."""

    # --- reading ---------------------------------------------------------------

    def _commits(self, entries: list[tuple[int, dict]]) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], COMMITS)
        paths = {f"{self.path}/batches/{e['batch']}/{e['commits']}": n for n, e in entries}
        schema = self.spark.createDataFrame([], COMMITS).drop("entry").schema
        found = self.spark.read.schema(schema).parquet(*paths)
        numbers = self.spark.createDataFrame([(f"{e['batch']}/{e['commits']}", n) for n, e in entries], "_at string, entry long")
        at = F.regexp_extract(F.col("_metadata.file_path"), "batches/([^/]+/[^/]+)/", 1)
        return found.withColumn("_at", at).join(F.broadcast(numbers), "_at").select("entry", *schema.names)

    def commits(self) -> DataFrame:
        """All visible commits with the log entry that made them."""
        return self._commits(self.entries())

    def heads(self, entries: list[tuple[int, dict]] | None = None) -> DataFrame:
        """`(branch_id, head, hash_a, hash_b, n_rows)` of every branch, from the
        last entry with all heads and the commits after it."""
        entries = self.entries() if entries is None else entries
        full = next((i for i in reversed(range(len(entries))) if "heads" in entries[i][1]), None)
        columns = ["branch_id", "commit_id", "hash_a", "hash_b", "n_rows"]
        moves = self._commits(entries if full is None else entries[full + 1 :]).select("entry", *columns)
        if full is not None:
            known = self.spark.read.parquet(f"{self.path}/batches/{entries[full][1]['batch']}/{entries[full][1]['heads']}")
            moves = moves.unionByName(known.select(F.lit(0).cast("long").alias("entry"), *columns))
        last = moves.groupBy("branch_id").agg(F.max_by(F.struct(*columns[1:]), "entry").alias("r")).select("branch_id", "r.*")
        return last.withColumnRenamed("commit_id", "head")

    def rows(self, table: str) -> DataFrame:
        """Rows of a table in all visible commits, with `commit_id`."""
        entries = [e for e in self.entries() if table in e[1]["tables"]]
        if not entries:
            raise ValueError(f"no commit has a table {table}")
        parts = [self.spark.read.parquet(f"{self.path}/batches/{e['batch']}/rows/{table}").withColumn("_entry", F.lit(n).cast("long")) for n, e in entries]
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        # an id that another batch was refused for has rows there, too
        made = self._commits(entries).select(F.col("entry").alias("_entry"), "commit_id")
        return every.join(made, ["_entry", "commit_id"], "left_semi").drop("_entry")

    # --- writing ---------------------------------------------------------------

    def _judged(self, proposals: DataFrame, entries: list[tuple[int, dict]]) -> DataFrame:
        """`proposals` with the status that each has after `entries`."""
        heads = self.heads(entries).select("branch_id", "head", *[F.col(c).alias(f"_{c}") for c in ("hash_a", "hash_b", "n_rows")])
        seen = self._commits(entries).select("commit_id", F.lit(True).alias("_seen")).distinct()
        met = proposals.join(heads, "branch_id", "left").join(seen, "commit_id", "left")
        moved = ~F.col("head").eqNullSafe(F.col("expected_head"))
        same = (F.col("hash_a") == F.col("_hash_a")) & (F.col("hash_b") == F.col("_hash_b")) & (F.col("n_rows") == F.col("_n_rows"))
        status = (
            F.when(F.col("_seen") | ~F.col("_once"), "repeated_commit")
            .when(moved, "branch_moved")
            .when(F.col("head").isNotNull() & same & F.col("parent2_id").isNull(), "no_change")
            .otherwise("fits")
        )
        judged = met.withColumn("status", status)
        # of several that fit one branch the least commit id is made, the others come too late
        first = judged.where("status = 'fits'").groupBy("branch_id").agg(F.min("commit_id").alias("_first"))
        judged = judged.join(first, "branch_id", "left")
        made = F.when(F.col("commit_id") == F.col("_first"), "committed").otherwise("branch_moved")
        return judged.withColumn("status", F.when(F.col("status") == "fits", made).otherwise(F.col("status"))).select(*proposals.columns, "status")

    def commit(
        self,
        proposals: DataFrame,
        tables: Mapping[str, DataFrame],
        before_claim: Callable[[], None] | None = None,
        tries: int = 100,
    ) -> DataFrame:
        """Commit every proposal whose branch still has the head that it expects.

        `proposals(branch_id, commit_id, expected_head[, parent2_id, message])`; a
        null `expected_head` makes a new branch. `tables` hold the rows of all
        proposals with their `commit_id`. Returns `(branch_id, commit_id,
        status)`: committed, branch_moved, no_change (the rows are those of the
        head, and it is no merge) or repeated_commit (the id is taken). What is
        not committed leaves nothing visible.
        """
        for c in ("parent2_id", "message"):
            if c not in proposals.columns:
                proposals = proposals.withColumn(c, F.lit(None).cast("string"))
        asked = proposals.select(*[F.col(c).cast("string").alias(c) for c in PROPOSAL])
        batch = uuid.uuid4().hex
        home = f"{self.path}/batches/{batch}"
        for name, df in tables.items():
            df.withColumn("commit_id", F.col("commit_id").cast("string")).write.parquet(f"{home}/rows/{name}")
        written = {name: self.spark.read.parquet(f"{home}/rows/{name}") for name in tables}
        prints = [fingerprint(df.withColumn("_table", F.lit(name)), sorted(set(df.columns) - {"commit_id"}) + ["_table"], ["commit_id"]) for name, df in written.items()]
        whole = reduce(DataFrame.unionByName, prints).groupBy("commit_id").agg(
            F.bit_xor("hash_a").alias("hash_a"), F.bit_xor("hash_b").alias("hash_b"), F.sum("n_rows").alias("n_rows")
        )
        once = asked.groupBy("commit_id").agg((F.count(F.lit(1)) == 1).alias("_once"))
        asked = asked.join(whole, "commit_id", "left").fillna(0, ["hash_a", "hash_b", "n_rows"]).join(once, "commit_id")
        asked = cut(asked)
        entries: list[tuple[int, dict]] = []
        for k in range(tries):
            entries += self.entries(entries[-1][0] if entries else 0)
            judged = cut(self._judged(asked, entries))
            made = judged.where("status = 'committed'")
            if made.isEmpty():
                return judged.select("branch_id", "commit_id", "status")
            number, content = (entries[-1][0] if entries else 0) + 1, {"batch": batch, "commits": f"commits-{k}", "tables": sorted(tables)}
            moves = made.select("branch_id", "commit_id", F.col("expected_head").alias("parent_id"), "parent2_id", "message", "hash_a", "hash_b", "n_rows")
            moves.write.parquet(f"{home}/commits-{k}")
            if number % FULL == 0:
                after = self.heads(entries).withColumnRenamed("head", "commit_id").join(moves.select("branch_id"), "branch_id", "left_anti")
                after.unionByName(moves.select(*after.columns)).write.parquet(f"{home}/heads-{k}")
                content["heads"] = f"heads-{k}"
            if before_claim is not None:
                before_claim()
            if self.claim(number, content):
                return judged.select("branch_id", "commit_id", "status")
        raise RuntimeError(f"other writers were faster {tries} times")
