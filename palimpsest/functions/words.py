"""Text shown to people: quoting, nullability, short ids, edit descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(col: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(col, F.lit('"'), F.lit('""')), F.lit('"'))


def nullability(nullable: Column) -> Column:
    return F.when(nullable, "nullable").otherwise("NOT NULL")


def or_none(col: Column) -> Column:
    return F.when(col.isNull() | (col == ""), "none").otherwise(col)


def bool_word(col: Column) -> Column:
    return F.when(col, "true").otherwise("false")


def has_text(col: Column) -> Column:
    return F.coalesce(F.trim(col) != "", F.lit(False))


def short_id(col: Column, n: int = 8) -> Column:
    return F.substring(col.cast("string"), 1, n)


def file_safe(col: Column) -> Column:
    return F.replace(col, F.lit("/"), F.lit("-"))


def column_description(type_text: Column, nullable: Column, default: Column) -> Column:
    return F.concat(
        type_text,
        F.when(nullable, "").otherwise(" NOT NULL"),
        F.when(has_text(default), F.concat(F.lit(" DEFAULT "), default)).otherwise(""),
    )


def edit_description(op: Column, table: Column, target: Column, value: Column) -> Column:
    """One edit as a phrase; `target` is `table.column` where there is one."""
    arrow = F.lit(" → ")
    return (
        F.when(op == "create_table", F.concat(F.lit("create table "), value))
        .when(op == "drop_table", F.concat(F.lit("drop table "), table))
        .when(op == "rename_table", F.concat(F.lit("rename table "), table, arrow, value))
        .when(op == "add_column", F.concat(F.lit("add column "), target))
        .when(op == "drop_column", F.concat(F.lit("drop column "), target))
        .when(op == "rename_column", F.concat(F.lit("rename "), target, arrow, value))
        .when(op == "retype_column", F.concat(F.lit("retype "), target, arrow, value))
        .when((op == "set_nullable") & (value == "false"), F.concat(F.lit("set "), target, F.lit(" NOT NULL")))
        .when(op == "set_nullable", F.concat(F.lit("set "), target, F.lit(" nullable")))
        .when((op == "set_default") & (value == ""), F.concat(F.lit("clear default on "), target))
        .when(op == "set_default", F.concat(F.lit("set default on "), target))
        .when(op == "add_constraint", F.concat(F.lit("add "), value, F.lit(" on "), table))
        .when(op == "drop_constraint", F.concat(F.lit("drop constraint on "), table))
        .when(op == "add_index", F.concat(F.lit("add index "), value))
        .when(op == "drop_index", F.concat(F.lit("drop index on "), table))
        .otherwise(op)
    )


def commit_messages(edits: DataFrame, by: list[str]) -> DataFrame:
    """Edits `(by…, seq, text)` of one commit joined by `; ` in their order."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return edits.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda e: e["text"]), "; ").alias("message"))
