"""Rows that vanished under one key and may be back under another."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.spread import lookup_large
from palimpsest.session import cut


def rekey_proposals(
    dropped: DataFrame,
    added: DataFrame,
    key: str,
    block_on: Sequence[str],
    weights: Mapping[str, int],
    threshold: int,
    decisions: DataFrame | None = None,
) -> DataFrame:
    """`(old_key, new_key, score, contested)`: the best candidate per old row.

    The score is the sum of the weights (whole percents) of the columns on which
    the two rows agree inside a block; ties go to the lower new key. Nothing is
    applied: proposals await a decision `(old_key, rename)`.

    No pairs are formed. A score is reached exactly when the rows agree on some
    set of columns, so each row looks up one signature per column set that can
    reach the threshold, and each signature keeps only its least new key. The
    work is rows × column sets, however large a block is.
    """
    names = list(weights)
    sets = [s for n in range(1, len(names) + 1) for s in combinations(names, n) if sum(weights[c] for c in s) >= threshold]

    def signatures(df: DataFrame) -> DataFrame:
        def one(cols: tuple[str, ...]) -> Column:
            ready = F.lit(True)
            for c in cols:
                ready = ready & F.col(c).isNotNull()
            cells = [F.col(c).cast("string") if c in cols else F.lit("") for c in names]
            score = sum(weights[c] for c in cols)
            return F.when(ready, F.struct(F.lit(sets.index(cols)).alias("_set"), F.lit(score).alias("_score"), F.array(*cells).alias("_sig")))

        return df.withColumn("_s", F.explode(F.array_compact(F.array(*[one(s) for s in sets])))).select(
            *[c for c in df.columns], "_s.*"
        )

    candidates = (
        signatures(added).groupBy(*block_on, "_set", "_sig").agg(F.min(key).alias("new_key"))
    )
    # Rows alike in every compared column get the same answer; ask once.
    like = [*block_on, *names]
    vectors = cut(dropped.select(*like).dropDuplicates()).withColumn("_vector", F.struct(*like))
    asked = signatures(vectors)
    met = lookup_large(asked, candidates, [*block_on, "_set", "_sig"], ["_vector"])
    best = met.groupBy("_vector").agg(
        F.max(F.struct(F.col("_score").alias("score"), (-F.col("new_key")).alias("least"))).alias("b")
    )
    answers = best.select("_vector", F.col("b.score").alias("score"), (-F.col("b.least")).alias("new_key"))
    askers = dropped.select(F.col(key).alias("old_key"), F.struct(*like).alias("_vector"))
    proposed = cut(lookup_large(askers, answers, ["_vector"], ["old_key"]).drop("_vector"))
    wanted = proposed.groupBy("new_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    flagged = lookup_large(proposed, wanted, ["new_key"], ["old_key"], "left")
    out = flagged.select("old_key", "new_key", "score", F.col("_n").isNotNull().alias("contested"))
    if decisions is not None:
        out = out.join(decisions.select("old_key"), "old_key", "left_anti")
    return out
