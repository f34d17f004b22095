"""Difference of two versions of a keyed table: rows, then cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.cells import comparable, rows_same, same, text
from palimpsest.operators.align import align, counts_by_key, skipped_keys, unique_only

SIDES = ("frm", "to")


def diff_keys(frm: DataFrame, to: DataFrame, key: Sequence[str]) -> DataFrame:
    """`(key…, change)` with change added, dropped or common; `duplicate_key` or
    `null_key` where a key cannot be compared."""
    sides = {"frm": frm, "to": to}
    counts = counts_by_key(sides, key)
    change = F.when(F.col("n_frm") == 0, "added").when(F.col("n_to") == 0, "dropped").otherwise("common")
    compared = unique_only(counts, SIDES).select(*key, change.alias("change"))
    return compared.unionByName(skipped_keys(counts, sides, key).select(*key, F.col("problem").alias("change")))


def _cell(row: str, col: str) -> Column:
    return F.col(f"{row}.`{col}`")


def cell_changes(
    aligned: DataFrame, key: Sequence[str], cols: Sequence[str], name_col: str | None = None
) -> DataFrame:
    """`(key…, kind, property, from_value, to_value)` from an aligned pair.

    Only changed cells are built and exploded, so unchanged cells never become
    rows. A change of `name_col` reads as a rename.
    """
    schema = aligned.schema["to"].dataType
    entry = lambda kind, prop, a, b: F.struct(
        F.lit(kind).alias("kind"),
        prop.cast("string").alias("property"),
        a.cast("string").alias("from_value"),
        b.cast("string").alias("to_value"),
    )
    nothing = F.lit(None)
    cells = []
    for c in cols:
        dtype = schema[c].dataType
        a, b = _cell("frm", c), _cell("to", c)
        kind = "renamed" if c == name_col else "cell_changed"
        changed = ~same(comparable(a, dtype), comparable(b, dtype))
        cells.append(F.when(changed, entry(kind, F.lit(c), text(a, dtype), text(b, dtype))))
    changes = (
        F.when(F.col("frm").isNull(), F.array(entry("row_added", nothing, nothing, nothing)))
        .when(F.col("to").isNull(), F.array(entry("row_dropped", nothing, nothing, nothing)))
        .otherwise(F.array_compact(F.array(*cells)))
    )
    return aligned.select(*key, F.explode(changes).alias("c")).select(*key, "c.*")


def diff_cells(
    frm: DataFrame,
    to: DataFrame,
    key: Sequence[str],
    cols: Sequence[str],
    *,
    name_col: str | None = None,
    changed_only: bool = False,
    keys_checked: bool = False,
) -> DataFrame:
    """Cell-level difference; one row per changed cell, added or dropped row.

    A key that is repeated or null cannot be compared: it is one row of kind
    `duplicate_key` or `null_key` with its number of rows on either side.
    """
    sides = {"frm": frm, "to": to}
    aligned = align(sides, key, cols, changed_only=changed_only, keys_checked=keys_checked)
    skipped = skipped_keys(aligned, sides, key).select(
        *key,
        F.col("problem").alias("kind"),
        F.lit(None).cast("string").alias("property"),
        F.col("n_frm").cast("string").alias("from_value"),
        F.col("n_to").cast("string").alias("to_value"),
    )
    return cell_changes(unique_only(aligned, SIDES), key, cols, name_col).unionByName(skipped)


def diff_summary(
    frm: DataFrame, to: DataFrame, key: Sequence[str], cols: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Rows added, dropped, changed and unchanged, changed cells in all, and
    keys that are repeated or null and so are in none of the other counts."""
    sides = {"frm": frm, "to": to}
    aligned = align(sides, key, cols)
    skipped = skipped_keys(aligned, sides, key)
    aligned = aligned.withColumn("_skip", F.greatest("n_frm", "n_to") > 1)
    schema = aligned.schema["to"].dataType
    equal = rows_same("frm", "to", cols, schema)
    sound = ~F.col("_skip")
    both = sound & F.col("frm").isNotNull() & F.col("to").isNotNull()
    cells = sum(
        F.when(
            both & ~same(comparable(_cell("frm", c), schema[c].dataType), comparable(_cell("to", c), schema[c].dataType)),
            1,
        ).otherwise(0)
        for c in cols
    )
    counted = aligned.select(
        *by,
        (sound & F.col("frm").isNull()).cast("int").alias("added"),
        (sound & F.col("to").isNull()).cast("int").alias("dropped"),
        (both & ~equal).cast("int").alias("changed"),
        (both & equal).cast("int").alias("unchanged"),
        cells.alias("changed_cells"),
        F.col("_skip").cast("int").alias("skipped_keys"),
    )
    names = counted.columns[len(by) :]
    null = skipped.where("problem = 'null_key'")
    counted = counted.unionByName(null.select(*by, F.lit(1).alias("skipped_keys")), allowMissingColumns=True)
    return counted.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
