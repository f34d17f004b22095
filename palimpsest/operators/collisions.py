"""Two objects of a merged result that claim one name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.cells import all_of, key_text
from palimpsest.operators.merge import KEY_PART, answer_problem, final_resolutions
from palimpsest.operators.spread import lookup_large, running_last
from palimpsest.session import cut


def _order(order: Sequence[str], key: Sequence[str]) -> Column:
    return F.struct(*order, *[k for k in key if k not in order])


def first_holders(df: DataFrame, scope: Sequence[str], key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`(scope…, first, n)` for each name held more than once."""
    named = df.where(all_of([F.col(s).isNotNull() for s in scope]))
    holders = named.groupBy(*scope).agg(
        F.min_by(F.struct(*key), _order(order, key)).alias("_first"),
        F.min(_order(order, key)).alias("_first_order"),
        F.count(F.lit(1)).alias("_holders"),
    )
    return holders.where(F.col("_holders") > 1)


def collisions(
    df: DataFrame, scope: Sequence[str], key: Sequence[str], order: Sequence[str], *, kind: str = "name_collision"
) -> DataFrame:
    """One row per later holder of a name already taken in its scope.

    `scope` includes the name column itself. The first holder is an aggregate,
    not a window, so a name held by a third of all rows is folded before the
    exchange; only names held twice are looked up again, salted. The row keeps
    all columns of `df`, plus `first` (the first holder's key) and
    `conflict_id`.
    """
    held = first_holders(df, scope, key, order)
    pairs = lookup_large(df, held, scope, key)
    later = pairs.where(F.struct(*key) != F.col("_first"))
    first_text = key_text(key, df.schema)
    flat = later.select(*df.columns, F.col("_first").alias("first"))
    other = flat.withColumns({"_other": first_text, **{f"_first_{k}": F.col("first")[k] for k in key}})
    ident = key_text([f"_first_{k}" for k in key], other.schema)
    return other.withColumn("conflict_id", F.concat(F.lit(f"{kind}:"), ident, F.lit(":"), F.col("_other"))).drop(
        "_other", *[f"_first_{k}" for k in key]
    )


def unique_collisions(
    merged: DataFrame, cols: Sequence[str], key: Sequence[str], order: Sequence[str] = ("origin",)
) -> DataFrame:
    """Merged rows that share the value of a unique column list. Only the key,
    the value and the order are kept of the rows, so the merge runs once."""
    narrow = cut(merged.select(*dict.fromkeys([*key, *cols, *order])))
    found = collisions(narrow, cols, key, order, kind="unique_collision")
    value = F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
    return found.select(
        *key,
        "conflict_id",
        F.lit("unique_collision").alias("class"),
        F.lit(",".join(cols)).alias("property"),
        value.alias("value"),
        *[F.col("first")[k].alias(f"first_{k}") for k in key],
    )


def _pair_answers(df: DataFrame, name: str, key: Sequence[str], resolutions: DataFrame, kind: str) -> DataFrame:
    """`(first, second, choice, custom)` of usable answers, read from their
    conflict ids; `first` and `second` are keys as text."""
    known = final_resolutions(resolutions).withColumns({"property": F.lit(name), "allow_custom": F.lit(True)})
    usable = known.where(F.col("conflict_id").startswith(f"{kind}:") & answer_problem(known, {}).isNull())
    both = F.substr("conflict_id", F.lit(len(kind) + 2))
    # an empty match may follow the last part
    parts = F.slice(F.regexp_extract_all(both, F.lit(KEY_PART + "(?::|$)"), F.lit(1)), 1, 2 * len(key))
    text = lambda start: F.array_join(F.slice("_parts", start, len(key)), ":")
    cut_up = usable.withColumns({"_both": both, "_parts": parts}).withColumns({"first": text(1), "second": text(len(key) + 1)})
    whole = F.concat("first", F.lit(":"), "second") == F.col("_both")
    return cut_up.where((F.size("_parts") == 2 * len(key)) & whole).select("first", "second", "choice", "custom")


def _on_path(starts: DataFrame, steps: DataFrame) -> DataFrame:
    """`(at)`: every node on the paths from `starts` (at) along `steps` (at, to), at most one per node.

    Tables of 1, 2, 4 … steps are made by doubling; taken from the longest down,
    each adds to every node found so far the one that many steps on. A path of n
    nodes takes 2 × log2(n) joins, and all paths are walked together.
    """
    found, jumps = starts, []
    jump = cut(steps)
    while not jump.isEmpty():
        jumps.append(jump)
        jump = cut(jump.join(jump.select(F.col("at").alias("to"), F.col("to").alias("end")), "to").select("at", F.col("end").alias("to")))
    for jump in reversed(jumps):
        found = cut(found.unionByName(found.join(jump, "at").select(F.col("to").alias("at"))).distinct())
    return found


def resolve_collisions(
    df: DataFrame,
    scope: Sequence[str],
    name: str,
    key: Sequence[str],
    order: Sequence[str],
    resolutions: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Apply answers to name collisions; `(kept rows, open conflicts)`.

    Rows of a name are read in order. Each later row meets the holder at that
    moment: ours keeps the holder, theirs makes the later row the holder in its
    place, custom renames the later row; without an answer both stay and the
    conflict is open. An answer counts only for the two rows that its id names.

    So a holder gives way to the first row after it whose answer to just this
    pair is theirs. These steps form paths from the first row of each name; the
    rows on them are the holders, and the holder at any place is the last one
    before it. Jobs grow with the logarithm of the longest such path, whatever
    the number of answers.
    """
    schema, key, order = df.schema, list(key), list(order)
    kind = "name_collision"
    held = first_holders(df, scope, key, order).select(*scope)
    contested = lookup_large(df, held, scope, key, "left_semi").withColumn("_text", key_text(key, schema))
    contested = cut(contested)
    untouched = df.join(contested.select(*key), key, "left_anti")
    answers = cut(_pair_answers(df, name, key, resolutions, kind))

    # where a holder would give way, and which of the rows that could hold do
    place = contested.select(*scope, "_text", _order(order, key).alias("_place"))
    swaps = answers.where(F.col("choice") == "theirs").select(F.col("first").alias("at"), F.col("second").alias("to"))
    before = place.select(*scope, F.col("_text").alias("at"), F.col("_place").alias("_from"))
    after = place.select(*[F.col(s).alias(f"_to_{i}") for i, s in enumerate(scope)], F.col("_text").alias("to"), "_place")
    same_name = all_of([F.col(s).eqNullSafe(F.col(f"_to_{i}")) for i, s in enumerate(scope)])
    later = swaps.join(before, "at").join(after, "to").where(same_name & (F.col("_place") > F.col("_from")))
    steps = later.groupBy("at").agg(F.min_by("to", "_place").alias("to"))
    first = place.groupBy(*scope).agg(F.min_by("_text", "_place").alias("at")).select("at")
    holders = cut(_on_path(first, steps)).withColumn("_holds", F.lit(True))

    # the holder that each row meets, and what was said about the two
    marked = contested.join(holders.withColumnRenamed("at", "_text"), "_text", "left")
    tie = [*order[1:], *[k for k in key if k not in order]]
    holds = {"_holder": F.when(F.col("_holds"), F.struct("_text", *key))}
    met = running_last(marked, scope, order[0], holds, inclusive=False, tie=tie)
    said = met.withColumn("_first", F.col("_holder._text")).join(
        answers.select(F.col("first").alias("_first"), F.col("second").alias("_text"), "choice", "custom"), ["_first", "_text"], "left"
    )
    # a holder whose step is taken has gone
    gone = steps.join(holders, "at", "left_semi").select(F.col("at").alias("_text"))
    settled = cut(said.join(gone.withColumn("_gone", F.lit(True)), "_text", "left"))
    stays = F.col("_gone").isNull() & (F.col("choice").isNull() | (F.col("choice") != "ours"))
    renamed = F.when(F.col("choice") == "custom", F.col("custom")).otherwise(F.col(name))
    kept = untouched.unionByName(settled.where(stays).withColumn(name, renamed).select(*untouched.columns))
    open_ = settled.where(F.col("_first").isNotNull() & F.col("choice").isNull())
    ident = F.concat(F.lit(f"{kind}:"), "_first", F.lit(":"), "_text")
    return kept, open_.select(*df.columns, F.struct(*[F.col(f"_holder.{k}") for k in key]).alias("first"), ident.alias("conflict_id"))
