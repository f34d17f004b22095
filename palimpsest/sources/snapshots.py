"""Nested snapshots (one JSON text per commit) to the long catalog and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.catalog import Catalog

# Field names of the nested form.
SNAPSHOT = (
    "struct<tables:array<struct<id:string,name:string,"
    "columns:array<struct<id:string,name:string,type:struct<base:string,params:array<int>>,nullable:boolean,"
    "`default`:string,position:int>>,"
    "constraints:array<struct<id:string,name:string,kind:string,column_ids:array<string>,ref_table_id:string,"
    "ref_column_ids:array<string>,on_delete:string,on_update:string,expr:string>>,"
    "indexes:array<struct<id:string,name:string,columns:array<struct<column_id:string,desc:boolean>>,"
    "`unique`:boolean,method:string>>>>>"
)


def explode_snapshots(df: DataFrame, text: str = "schema_json") -> Catalog:
    """`(project_id, commit_id, schema_json)` to long tables with `commit_id`."""
    ids = ["project_id", "commit_id"]
    parsed = df.select(*ids, F.from_json(text, SNAPSHOT).alias("s"))
    tables = parsed.select(*ids, F.posexplode("s.tables").alias("ordinal", "t"))
    inner = tables.select(*ids, F.col("t.id").alias("table_id"), "t")

    def members(name: str) -> DataFrame:
        return inner.select(*ids, "table_id", F.posexplode(f"t.{name}").alias("ordinal", "m"))

    m = lambda c: F.col(f"m.{c}")
    no_ids = F.array().cast("array<string>")
    return Catalog(
        tables.select(*ids, F.col("t.id").alias("table_id"), F.col("t.name").alias("name"), "ordinal"),
        members("columns").select(
            *ids,
            "table_id",
            m("id").alias("column_id"),
            m("name"),
            m("type.base").alias("type_base"),
            F.coalesce(m("type.params"), F.array().cast("array<int>")).alias("type_params"),
            m("nullable"),
            F.coalesce(m("default"), F.lit("")).alias("default_expr"),
            m("position"),
        ),
        members("constraints").select(
            *ids,
            "table_id",
            m("id").alias("constraint_id"),
            F.coalesce(m("name"), F.lit("")).alias("name"),
            m("kind"),
            F.coalesce(m("column_ids"), no_ids).alias("column_ids"),
            m("ref_table_id"),
            F.coalesce(m("ref_column_ids"), no_ids).alias("ref_column_ids"),
            *[F.coalesce(m(c), F.lit("")).alias(c) for c in ("on_delete", "on_update", "expr")],
            "ordinal",
        ),
        members("indexes").select(
            *ids,
            "table_id",
            m("id").alias("index_id"),
            m("name"),
            F.transform(
                m("columns"), lambda c: F.struct(c["column_id"].alias("column_id"), F.coalesce(c["desc"], F.lit(False)).alias("desc"))
            ).alias("columns"),
            F.coalesce(m("unique"), F.lit(False)).alias("is_unique"),
            F.coalesce(m("method"), F.lit("")).alias("method"),
            "ordinal",
        ),
    )


def nest_snapshots(cat: Catalog) -> DataFrame:
    """Long tables with `commit_id` back to `(project_id, commit_id,
    schema_json)`. A snapshot is one row by definition, so its size bounds what
    a group holds."""
    ids = ["project_id", "commit_id"]

    def folded(df: DataFrame, order: str, fields: list[Column], name: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("v"))))
        return df.groupBy(*ids, "table_id").agg(F.transform(ordered, lambda e: e["v"]).alias(name))

    c = F.col
    columns = folded(
        cat.columns,
        "position",
        [
            c("column_id").alias("id"),
            c("name"),
            F.struct(c("type_base").alias("base"), c("type_params").alias("params")).alias("type"),
            c("nullable"),
            c("default_expr").alias("default"),
            c("position"),
        ],
        "columns",
    )
    fields = ["name", "kind", "column_ids", "ref_table_id", "ref_column_ids", "on_delete", "on_update", "expr"]
    constraints = folded(cat.constraints, "ordinal", [c("constraint_id").alias("id"), *[c(f) for f in fields]], "constraints")
    indexes = folded(
        cat.indexes, "ordinal", [c("index_id").alias("id"), c("name"), c("columns"), c("is_unique").alias("unique"), c("method")], "indexes"
    )
    full = cat.tables
    for part in (columns, constraints, indexes):
        full = full.join(part, [*ids, "table_id"], "left")
    table = F.struct(c("table_id").alias("id"), "name", "columns", "constraints", "indexes")
    ordered = F.array_sort(F.collect_list(F.struct(c("ordinal").alias("_o"), table.alias("v"))), )
    return full.groupBy(*ids).agg(
        F.to_json(F.struct(F.transform(ordered, lambda e: e["v"]).alias("tables"))).alias("schema_json")
    )
