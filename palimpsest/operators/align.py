"""Bring several versions of a keyed table side by side, one row per key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.cells import all_of, any_of, digest, key_present

SIDE, ROW = "_side", "_row"


def _stack(sides: Mapping[str, DataFrame], key: Sequence[str], payload) -> DataFrame:
    parts = []
    for i, df in enumerate(sides.values()):
        present = df.where(key_present(key))
        parts.append(present.select(*key, F.lit(i).cast("tinyint").alias(SIDE), *payload(df)))
    return reduce(DataFrame.unionByName, parts)


def _on(i: int, value: Column) -> Column:
    return F.when(F.col(SIDE) == i, value)


def counts_by_key(sides: Mapping[str, DataFrame], key: Sequence[str]) -> DataFrame:
    """`(key…, n_<side>…)`; one exchange, hash aggregation, keys only."""
    stacked = _stack(sides, key, lambda df: [])
    return stacked.groupBy(*key).agg(*[F.count(_on(i, F.lit(1))).alias(f"n_{s}") for i, s in enumerate(sides)])


def differing_keys(sides: Mapping[str, DataFrame], key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Keys whose row is not the same on every side.

    A key that is not there once on every side differs, also where its rows are equal.
    Moves only the key and a 128-bit digest per row, never the row, and keeps
    fixed-width buffers, so the aggregation hashes and does not sort.
    """

    def payload(df: DataFrame) -> list[Column]:
        first, second = digest(df, cols)
        return [first.alias("_h1"), second.alias("_h2")]

    stacked = _stack(sides, key, payload)
    spread = stacked.groupBy(*key).agg(
        *[F.count(_on(i, F.lit(1))).alias(f"_n{i}") for i in range(len(sides))],
        F.min("_h1").alias("_a"),
        F.max("_h1").alias("_b"),
        F.min("_h2").alias("_c"),
        F.max("_h2").alias("_d"),
    )
    moved = any_of([F.col(f"_n{i}") != 1 for i in range(len(sides))]) | (F.col("_a") != F.col("_b")) | (F.col("_c") != F.col("_d"))
    return spread.where(moved).select(*key)


def align(
    sides: Mapping[str, DataFrame],
    key: Sequence[str],
    cols: Sequence[str],
    *,
    changed_only: bool = False,
    keys_checked: bool = False,
) -> DataFrame:
    """`(key…, <side> struct…, n_<side>…)`, a null struct where a side has no row.

    One tagged union and one `groupBy(key)`: a single exchange for any number of
    sides, key filters reach every scan, and a key that repeats is folded before
    the exchange instead of being multiplied by a join. `n_<side>` keeps the
    repeat visible; see `unique_only` and `key_problems`.

    `changed_only` first finds the differing keys from digests and fetches only
    those rows: the form for wide tables that are mostly unchanged.

    `keys_checked` says that `key_problems` found no repeats: rows are then sent
    to their key as they are, which saves the sort before the exchange.
    """
    if changed_only:
        keys = differing_keys(sides, key, cols)
        sides = {s: df.join(keys, list(key), "left_semi") for s, df in sides.items()}
    stacked = _stack(sides, key, lambda df: [F.struct(*[F.col(f"`{c}`") for c in cols]).alias(ROW)])
    aggs = []
    for i, side in enumerate(sides):
        aggs.append(F.first(_on(i, F.col(ROW)), ignorenulls=True).alias(side))
        aggs.append(F.count(_on(i, F.lit(1))).alias(f"n_{side}"))
    if keys_checked:
        stacked = stacked.repartition(*[F.col(f"`{k}`") for k in key])
    return stacked.groupBy(*key).agg(*aggs)


def unique_only(aligned: DataFrame, sides: Sequence[str]) -> DataFrame:
    """Keys that are unique on every side; the others are `skipped_keys`."""
    return aligned.where(all_of([F.col(f"n_{s}") <= 1 for s in sides]))


def skipped_keys(aligned: DataFrame, sides: Mapping[str, DataFrame], key: Sequence[str]) -> DataFrame:
    """`(key…, problem, n_<side>…)`: what `unique_only` leaves out of `aligned`, and null keys of the sides."""
    repeated = aligned.where(any_of([F.col(f"n_{s}") > 1 for s in sides])).select(
        *key, F.lit("duplicate_key").alias("problem"), *[f"n_{s}" for s in sides]
    )
    parts = []
    for i, df in enumerate(sides.values()):
        absent = df.where(any_of([F.col(f"`{k}`").isNull() for k in key]))
        parts.append(absent.select(*key, F.lit(i).cast("tinyint").alias(SIDE)))
    null = reduce(DataFrame.unionByName, parts).groupBy(*key)
    counts = null.agg(*[F.count(_on(i, F.lit(1))).alias(f"n_{s}") for i, s in enumerate(sides)])
    return repeated.unionByName(counts.withColumn("problem", F.lit("null_key")))


def by_side(skipped: DataFrame, sides: Sequence[str], key: Sequence[str]) -> DataFrame:
    """`skipped_keys` as `(side, problem, key…, n)`, one row for each side at fault."""
    at_fault = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"n_{s}") > F.when(F.col("problem") == "null_key", 0).otherwise(1),
                    F.struct(F.lit(s).alias("side"), F.col(f"n_{s}").alias("n")),
                )
                for s in sides
            ]
        )
    )
    return skipped.select(F.explode(at_fault).alias("f"), "problem", *key).select("f.side", "problem", *key, "f.n")


def key_problems(sides: Mapping[str, DataFrame], key: Sequence[str]) -> DataFrame:
    """`(side, problem, key…, n)` for repeated and null keys of each side."""
    found = []
    for side, df in sides.items():
        counted = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        is_null = any_of([F.col(f"`{k}`").isNull() for k in key])
        found.append(
            counted.where(is_null | (F.col("n") > 1)).select(
                F.lit(side).alias("side"),
                F.when(is_null, "null_key").otherwise("duplicate_key").alias("problem"),
                *key,
                "n",
            )
        )
    return reduce(DataFrame.unionByName, found)
