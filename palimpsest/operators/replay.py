"""Replay of an edit log `(key…, seq, op, cells…, assigned)` on a keyed table.

`op` is insert, update or delete; `assigned` is an array naming the cells an
update sets. A log position `seq` is a whole number, unique per key. Edits that
do not fit (insert on a present row, update or delete on an absent one) are
reported and skipped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.spread import ROWS, ordered_scan, running_last

BASE_SEQ = -(1 << 62)


def _events(base: DataFrame, log: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    everything = F.array(*[F.lit(c) for c in cols])
    start = base.select(
        *key, F.lit(BASE_SEQ).cast("long").alias("seq"), F.lit("insert").alias("op"), *cols, everything.alias("assigned")
    )
    assigned = F.when(F.col("op") == "insert", everything).otherwise(F.coalesce("assigned", F.array().cast("array<string>")))
    edits = log.select(*key, F.col("seq").cast("long"), "op", *cols, assigned.alias("assigned"))
    return start.unionByName(edits)


def _judged(base: DataFrame, log: DataFrame, key: Sequence[str], cols: Sequence[str], rows: int) -> DataFrame:
    events = _events(base, log, key, cols)
    alive = F.when(F.col("op") == "insert", True).when(F.col("op") == "delete", False)
    known = running_last(events, key, "seq", {"_alive": alive}, inclusive=False, rows=rows)
    there = F.coalesce("_alive", F.lit(False))
    reason = (
        F.when(~F.col("op").isin("insert", "update", "delete"), "unknown_operation")
        .when((F.col("op") == "insert") & there, "insert_on_existing")
        .when((F.col("op") == "update") & ~there, "update_on_missing")
        .when((F.col("op") == "delete") & ~there, "delete_on_missing")
    )
    return known.withColumn("reason", reason).drop("_alive")


def _boxed(col: str) -> Column:
    """The cell as a struct where this edit sets it, so a null can be set."""
    return F.when((F.col("op") != "delete") & F.array_contains("assigned", col), F.struct(F.col(col).alias("v")))


def replay_errors(
    base: DataFrame, log: DataFrame, key: Sequence[str], cols: Sequence[str], *, rows: int = ROWS
) -> DataFrame:
    return _judged(base, log, key, cols, rows).where(F.col("reason").isNotNull()).select(*key, "seq", "op", "reason")


def replay_rows(
    base: DataFrame, log: DataFrame, key: Sequence[str], cols: Sequence[str], *, rows: int = ROWS
) -> DataFrame:
    """Final rows after the whole log; one fold per key and cell."""
    valid = _judged(base, log, key, cols, rows).where(F.col("reason").isNull())
    life = F.when(F.col("op").isin("insert", "delete"), F.col("seq"))
    folded = valid.groupBy(*key).agg(
        F.max_by("op", life).alias("_life"),
        *[F.max_by(_boxed(c), F.when(_boxed(c).isNotNull(), F.col("seq"))).alias(c) for c in cols],
    )
    return folded.where(F.col("_life") == "insert").select(*key, *[F.col(c)["v"].alias(c) for c in cols])


def as_of(
    base: DataFrame, log: DataFrame, key: Sequence[str], cols: Sequence[str], seq: int, *, rows: int = ROWS
) -> DataFrame:
    """Rows after the edits up to and including `seq`."""
    return replay_rows(base, log.where(F.col("seq") <= seq), key, cols, rows=rows)


def validity_intervals(
    base: DataFrame, log: DataFrame, key: Sequence[str], cols: Sequence[str], *, rows: int = ROWS
) -> DataFrame:
    """`(key…, from_seq, to_seq, cells…)`: every version of every row.

    `from_seq` is null for rows of the base, `to_seq` for rows still current.
    """
    valid = _judged(base, log, key, cols, rows).where(F.col("reason").isNull())
    boxes = {f"_b_{c}": _boxed(c) for c in cols}
    filled = ordered_scan(valid, key, "seq", upto=boxes, ahead={"to_seq": F.col("seq")}, rows=rows)
    started = F.when(F.col("seq") != BASE_SEQ, F.col("seq"))
    return filled.where(F.col("op") != "delete").select(
        *key, started.alias("from_seq"), "to_seq", *[F.col(f"_b_{c}")["v"].alias(c) for c in cols]
    )
