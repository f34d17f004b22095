"""Keys, uniqueness, references and predicates checked on the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.cells import all_of, any_of
from palimpsest.operators.spread import lookup


def _stacked(counts: DataFrame, labels: Sequence[str], label_col: str, n_col: str) -> DataFrame:
    """One wide row of counts to long form."""
    entries = [F.struct(F.lit(name).alias(label_col), F.col(f"_c{i}").alias(n_col)) for i, name in enumerate(labels)]
    return counts.select(F.inline(F.array(*entries)))


def not_null_violations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """`(column, violations)` for every column, counted in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"_c{i}") for i, c in enumerate(cols)])
    return _stacked(counts, cols, "column", "violations")


def key_violations(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """`(key…, problem, n)`: null members and repeated keys."""
    counted = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    is_null = any_of([F.col(k).isNull() for k in key])
    return counted.where(is_null | (F.col("n") > 1)).select(
        *key, F.when(is_null, "null_key").otherwise("duplicate_key").alias("problem"), "n"
    )


def unique_violations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """`(cols…, n)` of repeated values; a null member never collides."""
    full = df.where(all_of([F.col(c).isNotNull() for c in cols]))
    return full.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def fk_orphans(child: DataFrame, cols: Sequence[str], parent: DataFrame, ref_cols: Sequence[str]) -> DataFrame:
    """`(cols…, n_rows)`: child values without a parent.

    The child is folded to its distinct values first, so a value held by a third
    of the rows crosses the exchange as a few partial counts. A null member
    passes.
    """
    values = child.where(all_of([F.col(c).isNotNull() for c in cols])).groupBy(*cols).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    known = parent.select(*[F.col(r).alias(c) for c, r in zip(cols, ref_cols)])
    return values.join(known, list(cols), "left_anti")


def fk_orphan_rows(
    child: DataFrame, cols: Sequence[str], parent: DataFrame, ref_cols: Sequence[str], key: Sequence[str]
) -> DataFrame:
    """The child rows behind `fk_orphans`, found through the orphan values."""
    return lookup(child, fk_orphans(child, cols, parent, ref_cols).select(*cols), cols, key, "left_semi")


def check_violations(df: DataFrame, expr: str) -> DataFrame:
    """Rows for which the predicate is false; null passes."""
    return df.where(~F.coalesce(F.expr(expr), F.lit(True)))


def new_orphans(
    merged: tuple[DataFrame, DataFrame],
    sides: Mapping[str, tuple[DataFrame, DataFrame]],
    cols: Sequence[str],
    ref_cols: Sequence[str],
    key: Sequence[str],
) -> DataFrame:
    """Orphan rows of the merge that are orphans on no side.

    `merged` and each side are `(child, parent)`.
    """
    found = fk_orphan_rows(merged[0], cols, merged[1], ref_cols, key).select(*key, *cols)
    for child, parent in sides.values():
        known = fk_orphan_rows(child, cols, parent, ref_cols, key).select(*key, *cols)
        found = found.join(known, [*key, *cols], "left_anti")
    return found


@dataclass(frozen=True)
class NotNull:
    table: str
    column: str


@dataclass(frozen=True)
class Check:
    table: str
    name: str
    expr: str


@dataclass(frozen=True)
class Unique:
    table: str
    cols: tuple[str, ...]
    primary: bool = False


@dataclass(frozen=True)
class ForeignKey:
    table: str
    cols: tuple[str, ...]
    parent: str
    ref_cols: tuple[str, ...]
    on_delete: str = "no_action"


Rule = NotNull | Check | Unique | ForeignKey


def _sample(cols: Sequence[str]) -> Column:
    return F.min(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]))


def integrity_report(
    tables: Mapping[str, DataFrame], rules: Sequence[Rule], keys: Mapping[str, Sequence[str]]
) -> DataFrame:
    """`(code, table, object, violations, sample)`, one row per rule.

    The not-null and check rules of a table share one scan. `sample` is the
    least key (or value) that breaks the rule.
    """
    parts = []
    for name, df in tables.items():
        row_rules = [r for r in rules if isinstance(r, (NotNull, Check)) and r.table == name]
        if not row_rules:
            continue
        shown = F.concat_ws("|", *[F.col(k).cast("string") for k in keys[name]])
        aggs, entries = [], []
        for i, rule in enumerate(row_rules):
            if isinstance(rule, NotNull):
                broken, code, obj = F.col(rule.column).isNull(), "not_null", rule.column
            else:
                broken, code, obj = ~F.coalesce(F.expr(rule.expr), F.lit(True)), "check", rule.name
            aggs += [F.count_if(broken).alias(f"_c{i}"), F.min(F.when(broken, shown)).alias(f"_s{i}")]
            entries.append(
                F.struct(
                    F.lit(code).alias("code"),
                    F.lit(name).alias("table"),
                    F.lit(obj).alias("object"),
                    F.col(f"_c{i}").alias("violations"),
                    F.col(f"_s{i}").alias("sample"),
                )
            )
        parts.append(df.agg(*aggs).select(F.inline(F.array(*entries))))
    for rule in rules:
        if isinstance(rule, Unique):
            df = tables[rule.table]
            if rule.primary:
                broken, code = key_violations(df, rule.cols), "primary_key"
            else:
                broken, code = unique_violations(df, rule.cols), "unique"
            count, obj = F.count(F.lit(1)), ",".join(rule.cols)
        elif isinstance(rule, ForeignKey):
            broken = fk_orphans(tables[rule.table], rule.cols, tables[rule.parent], rule.ref_cols)
            code, count = "foreign_key", F.coalesce(F.sum("n_rows"), F.lit(0))
            obj = f"{','.join(rule.cols)}->{rule.parent}"
        else:
            continue
        parts.append(
            broken.agg(count.alias("violations"), _sample(rule.cols).alias("sample")).select(
                F.lit(code).alias("code"),
                F.lit(rule.table).alias("table"),
                F.lit(obj).alias("object"),
                "violations",
                "sample",
            )
        )
    return reduce(DataFrame.unionByName, parts)
