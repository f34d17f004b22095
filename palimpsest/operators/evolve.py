"""Carry a DataFrame from one schema to another, with measured hazards.

A column is known by `field_id` in its metadata. The target field may also
carry `default` (a SQL expression) and `max_length`. Schemas are a few fields,
so they are walked on the driver; the rows are touched by one projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def field(
    field_id: int | str,
    name: str,
    dtype: T.DataType,
    nullable: bool = True,
    *,
    default: str | None = None,
    max_length: int | None = None,
) -> T.StructField:
    meta = {"field_id": field_id}
    if default is not None:
        meta["default"] = default
    if max_length is not None:
        meta["max_length"] = max_length
    return T.StructField(name, dtype, nullable, meta)


def identify(df: DataFrame, ids: dict[str, int | str]) -> DataFrame:
    """Give columns their field ids."""
    return df.select(*[F.col(c).alias(c, metadata={"field_id": ids[c]}) for c in df.columns])


def _by_id(schema: T.StructType) -> dict:
    return {f.metadata["field_id"]: f for f in schema.fields if "field_id" in (f.metadata or {})}


def _value(source: T.StructField | None, target: T.StructField) -> Column:
    default = target.metadata.get("default")
    if source is None:
        return (F.expr(default) if default is not None else F.lit(None)).cast(target.dataType)
    col = F.col(f"`{source.name}`")
    return col if source.dataType == target.dataType else col.try_cast(target.dataType)


def _does_not_fit(source: T.StructField, target: T.StructField) -> Column | None:
    """Non-null cells the new type cannot hold."""
    col, tests = F.col(f"`{source.name}`"), []
    if source.dataType != target.dataType:
        tests.append(_value(source, target).isNull())
    limit = target.metadata.get("max_length")
    if limit is not None and source.metadata.get("max_length") != limit:
        tests.append(F.char_length(col.cast("string")) > limit)
    if not tests:
        return None
    broken = tests[0] if len(tests) == 1 else tests[0] | tests[1]
    return col.isNotNull() & broken


def _checks(frm: T.StructType, to: T.StructType) -> list[tuple[str, str, Column]]:
    known, checks = _by_id(frm), []
    for target in to.fields:
        source = known.get(target.metadata["field_id"])
        if source is None:
            if not target.nullable and target.metadata.get("default") is None:
                checks.append(("add_not_null_no_default", target.name, F.lit(True)))
            continue
        misfit = _does_not_fit(source, target)
        if misfit is not None:
            checks.append(("retype_needs_using", target.name, misfit))
        already = source.metadata.get("not_null", False) or not source.nullable
        if not target.nullable and not already:
            checks.append(("set_not_null", target.name, F.col(f"`{source.name}`").isNull()))
    return checks


def hazards(df: DataFrame, to: T.StructType) -> DataFrame:
    """`(code, column, rows)`: rows each step would fail on, from one scan."""
    checks = _checks(df.schema, to)
    if not checks:
        return df.sparkSession.createDataFrame([], "code string, column string, rows long")
    counts = df.agg(*[F.count_if(test).alias(f"_c{i}") for i, (_, _, test) in enumerate(checks)])
    entries = [
        F.struct(F.lit(code).alias("code"), F.lit(name).alias("column"), F.col(f"_c{i}").alias("rows"))
        for i, (code, name, _) in enumerate(checks)
    ]
    return counts.select(F.inline(F.array(*entries)))


def _project(df: DataFrame, to: T.StructType) -> DataFrame:
    known = _by_id(df.schema)
    cells = []
    for target in to.fields:
        value = _value(known.get(target.metadata["field_id"]), target)
        cells.append(value.alias(target.name, metadata=dict(target.metadata)))
    return df.select(*cells)


def evolve(df: DataFrame, to: T.StructType) -> tuple[DataFrame, DataFrame]:
    """`(rows in the new schema, rejects)`.

    Drops, renames, casts, adds and reorders in one `select`; simultaneous
    aliases make a swap of names safe. Rejects keep the old row and say which
    hazards it meets.
    """
    checks = _checks(df.schema, to)
    notes = F.array_compact(
        F.array(*[F.when(test, F.lit(f"{code}:{name}")) for code, name, test in checks])
        if checks
        else F.array().cast("array<string>")
    )
    bad = F.size(notes) > 0
    return _project(df.where(~bad), to), df.where(bad).withColumn("reasons", F.array_join(notes, "; "))


def same_shape(a: T.StructType, b: T.StructType) -> bool:
    """Equal ids, names and types, in order."""
    brief = lambda s: [(f.metadata.get("field_id"), f.name, f.dataType) for f in s.fields]
    return brief(a) == brief(b)


def evolve_columns(df: DataFrame, edits: Sequence[dict]) -> DataFrame:
    """Apply schema edits to a DataFrame: rename_column, retype_column,
    drop_column, add_column, set_default, set_nullable. Ids stay in metadata;
    a wrong edit raises before any row is read."""
    fields = [
        T.StructField(f.name, f.dataType, f.nullable, {"field_id": f.name, **(f.metadata or {})}) for f in df.schema.fields
    ]
    start = {f.metadata["field_id"]: f.name for f in fields}
    for n, edit in enumerate(edits, 1):
        op = edit["op"]
        names = [f.name for f in fields]

        def fail(reason: str, n=n, op=op):
            raise ValueError(f"operation {n} ({op}): {reason}")

        if op == "add_column":
            if not edit.get("name"):
                fail("a column needs a name")
            if edit["name"] in names:
                fail(f"a column named {edit['name']} exists")
            ident = edit.get("field_id", f"{edit['name']}#{n}")
            fields.append(
                field(ident, edit["name"], edit["type"], edit.get("nullable", True), default=edit.get("default"))
            )
            continue
        at = next((i for i, f in enumerate(fields) if f.name == edit["column"]), None)
        if at is None:
            fail("column not found")
        old = fields[at]
        meta = dict(old.metadata)
        if op == "drop_column":
            fields.pop(at)
        elif op == "rename_column":
            if not edit.get("name"):
                fail("new column name must not be empty")
            if edit["name"] in names and edit["name"] != old.name:
                fail(f"a column named {edit['name']} exists")
            fields[at] = T.StructField(edit["name"], old.dataType, old.nullable, meta)
        elif op == "retype_column":
            fields[at] = T.StructField(old.name, edit["type"], old.nullable, meta)
        elif op == "set_nullable":
            fields[at] = T.StructField(old.name, old.dataType, edit["nullable"], meta)
        elif op == "set_default":
            meta.pop("default", None)
            if edit["default"] != "":
                meta["default"] = edit["default"]
            fields[at] = T.StructField(old.name, old.dataType, old.nullable, meta)
        else:
            fail("unknown operation")
        if not fields:
            fail("a table needs at least one column")
    cells = []
    for f in fields:
        ident, default = f.metadata["field_id"], f.metadata.get("default")
        if ident in start:
            value = F.col(f"`{start[ident]}`")
            if df.schema[start[ident]].dataType != f.dataType:
                value = value.try_cast(f.dataType)
            if default is not None and not f.nullable:
                value = F.coalesce(value, F.expr(default).cast(f.dataType))
        else:
            value = (F.expr(default) if default is not None else F.lit(None)).cast(f.dataType)
        cells.append(value.alias(f.name, metadata=dict(f.metadata)))
    return df.select(*cells)
