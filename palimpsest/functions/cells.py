"""Column expressions on single cells: equality, text form, three-way choice."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ABSENT = "absent"


def comparable(col: Column, dtype: T.DataType) -> Column:
    """A form of the cell that `<=>` accepts; maps become sorted entries."""
    if isinstance(dtype, T.MapType):
        return F.array_sort(F.map_entries(col))
    return col


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def text(col: Column, dtype: T.DataType) -> Column:
    """The cell as text; nested values as JSON."""
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(col)
    return col.cast("string")


def three_way(base: Column, ours: Column, theirs: Column) -> Column:
    """Merged value; ours stands in where both sides changed differently."""
    return F.when(same(base, ours), theirs).otherwise(ours)


def diverged(base: Column, ours: Column, theirs: Column) -> Column:
    return ~same(ours, theirs) & ~same(base, ours) & ~same(base, theirs)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def rows_same(a: str, b: str, cols: Sequence[str], schema: T.StructType) -> Column:
    """Null-safe equality of `cols` in the struct columns `a` and `b`."""
    return all_of(
        [
            same(
                comparable(F.col(f"{a}.`{c}`"), schema[c].dataType),
                comparable(F.col(f"{b}.`{c}`"), schema[c].dataType),
            )
            for c in cols
        ]
    )


def row_text(side: str, cols: Sequence[str], schema: T.StructType) -> Column:
    """All cells of a side as one text, `∅` for null."""
    return F.concat_ws(
        "|",
        *[F.coalesce(text(F.col(f"{side}.`{c}`"), schema[c].dataType), F.lit("∅")) for c in cols],
    )


def key_text(key: Sequence[str], schema: T.StructType) -> Column:
    """Key columns as one text; the separator is escaped inside each, and a null
    part is written as no value can be."""
    parts = [F.coalesce(escaped(text(F.col(f"`{k}`"), schema[k].dataType)), F.lit("\\N")) for k in key]
    return F.concat_ws(":", *parts)


def escaped(part: Column) -> Column:
    return F.replace(F.replace(part, F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:"))


def key_present(key: Sequence[str]) -> Column:
    return all_of([F.col(f"`{k}`").isNotNull() for k in key])


def digest(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    """Two 64-bit hashes of a row. The null pattern is hashed as well, since
    `xxhash64` skips nulls and would not see a value move to another column."""
    cells = [comparable(F.col(f"`{c}`"), df.schema[c].dataType) for c in cols]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cells]) if cells else F.lit("")
    return [F.xxhash64(nulls, *cells), F.xxhash64(F.lit("second"), *cells, nulls)]


def fingerprint(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Order-free fingerprint of a set of rows: xor of row hashes and a count."""
    first, second = digest(df, cols)
    return df.groupBy(*by).agg(
        F.bit_xor(first).alias("hash_a"), F.bit_xor(second).alias("hash_b"), F.count(F.lit(1)).alias("n_rows")
    )
