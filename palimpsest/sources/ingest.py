"""Load with nothing silently lost: accepted rows and quarantine records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.cells import key_text
from palimpsest.functions.types import length_limit, spark_type
from palimpsest.operators.integrity import fk_orphans
from palimpsest.operators.spread import lookup


@dataclass(frozen=True)
class Column:
    """A wanted column: name, written type, and whether null is allowed."""

    name: str
    type: str
    nullable: bool = True


@dataclass(frozen=True)
class Reference:
    column: str
    parent: DataFrame
    ref_column: str


def ingest(
    raw: DataFrame, key: Sequence[str], columns: Sequence[Column], references: Sequence[Reference] = ()
) -> tuple[DataFrame, DataFrame]:
    """`(accepted, quarantine)`.

    `quarantine(row_key, construct, object, detail)` has one record per fault: a
    cell that does not cast, is too long or is missing, a reference to nothing,
    a column outside the model or of a type without a Spark form (recorded once
    and kept as text, or left out). Rows with a faulty cell are not accepted.
    """
    cells, faults, notes = [], [], []
    known = {c.name for c in columns}
    for col in columns:
        value, dtype = F.col(f"`{col.name}`"), spark_type(col.type)
        if dtype is None:
            notes.append(("unsupported_type", col.name, f"{col.type} (kept as text)"))
            dtype = T.StringType()
        cast = value.try_cast(dtype)
        cells.append(cast.alias(col.name))
        limit = length_limit(col.type)
        faults.append(_fault(value.isNotNull() & cast.isNull(), "bad_cast", col.name, value))
        if limit is not None:
            faults.append(_fault(F.char_length(cast.cast("string")) > limit, "too_long", col.name, value))
        if not col.nullable:
            faults.append(_fault(value.isNull(), "missing_value", col.name, F.lit("")))
    for name in raw.columns:
        if name not in known:
            notes.append(("unmapped_column", name, f"{raw.schema[name].dataType.simpleString()} (not imported)"))
    judged = raw
    for i, ref in enumerate(references):
        missing = fk_orphans(raw, [ref.column], ref.parent, [ref.ref_column])
        missing = missing.select(F.col(ref.column), F.lit(True).alias(f"_orphan{i}"))
        judged = lookup(judged, missing, [ref.column], key, "left")
        faults.append(_fault(F.col(f"_orphan{i}"), "unknown_reference", ref.column, F.col(ref.column)))
    judged = judged.withColumn("_faults", F.array_compact(F.array(*faults)))
    accepted = judged.where(F.size("_faults") == 0).select(*cells)
    records = judged.where(F.size("_faults") > 0).select(
        key_text(key, raw.schema).alias("row_key"), F.explode("_faults").alias("f")
    )
    quarantine = records.select("row_key", "f.*")
    if notes:
        extra = raw.sparkSession.createDataFrame(
            [(None, *n) for n in notes], "row_key string, construct string, object string, detail string"
        )
        quarantine = quarantine.unionByName(extra)
    return accepted, quarantine


def _fault(test, construct: str, name: str, detail):
    record = F.struct(
        F.lit(construct).alias("construct"), F.lit(name).alias("object"), detail.cast("string").alias("detail")
    )
    return F.when(test, record)


def coverage(quarantine: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """`(construct, object, n)`: what an export of this load does not cover."""
    return quarantine.groupBy(*by, "construct", "object").agg(F.count(F.lit(1)).alias("n"))


def carried_quarantine(sides: Mapping[str, DataFrame]) -> DataFrame:
    """Quarantine of a merge: the records of its sides, each kept once."""
    frames = list(sides.values())
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out.dropDuplicates()
