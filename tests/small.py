"""Small catalogs as literal rows; one project per case."""

from __future__ import annotations

import copy

from palimpsest.operators.catalog import Catalog

TABLES = "project_id long, table_id long, name string, ordinal int"
COLUMNS = (
    "project_id long, table_id long, column_id long, name string, type_base string, type_params array<int>, nullable boolean, "
    "default_expr string, position int"
)
CONSTRAINTS = (
    "project_id long, table_id long, constraint_id long, name string, kind string, column_ids array<long>, ref_table_id long, "
    "ref_column_ids array<long>, on_delete string, on_update string, expr string, ordinal int"
)
INDEXES = (
    "project_id long, table_id long, index_id long, name string, columns array<struct<column_id:long,desc:boolean>>, is_unique boolean, "
    "method string, ordinal int"
)
USERS, ORDERS = 1, 2
U_ID, U_EMAIL, U_NAME, O_ID, O_USER, O_STATUS = 11, 12, 13, 21, 22, 23
PK_U, PK_O, FK, IX = 101, 102, 103, 201


def col(name, base, params=(), nullable=True, default=""):
    return {"name": name, "base": base, "params": list(params), "nullable": nullable, "default": default}


def con(kind, cols=(), ref=None, ref_cols=(), expr="", name="", on_delete=""):
    return {"kind": kind, "cols": list(cols), "ref": ref, "ref_cols": list(ref_cols), "expr": expr, "name": name, "on_delete": on_delete}


def index(name, cols, unique=False):
    return {"name": name, "cols": [c if isinstance(c, tuple) else (c, False) for c in cols], "unique": unique}


def shop() -> dict:
    return {
        USERS: {
            "name": "users",
            "columns": {U_ID: col("id", "bigint", nullable=False), U_EMAIL: col("email", "varchar", [255], False), U_NAME: col("name", "text")},
            "constraints": {PK_U: con("primary_key", [U_ID])},
            "indexes": {},
        },
        ORDERS: {
            "name": "orders",
            "columns": {
                O_ID: col("id", "bigint", nullable=False),
                O_USER: col("user_id", "bigint", nullable=False),
                O_STATUS: col("status", "varchar", [16], False, "'pending'"),
            },
            "constraints": {PK_O: con("primary_key", [O_ID]), FK: con("foreign_key", [O_USER], USERS, [U_ID])},
            "indexes": {IX: index("idx_orders_status", [O_STATUS])},
        },
    }


def edited(schema: dict, fn) -> dict:
    out = copy.deepcopy(schema)
    fn(out)
    return out


def catalog(spark, projects: dict[int, dict]) -> Catalog:
    t, c, k, x = [], [], [], []
    for p, schema in projects.items():
        for n, (tid, tab) in enumerate(schema.items()):
            t.append((p, tid, tab["name"], n))
            for i, (cid, v) in enumerate(tab["columns"].items(), 1):
                c.append((p, tid, cid, v["name"], v["base"], v["params"], v["nullable"], v["default"], i))
            for i, (kid, v) in enumerate(tab["constraints"].items(), 1):
                k.append((p, tid, kid, v["name"], v["kind"], v["cols"], v["ref"], v["ref_cols"], v["on_delete"], "", v["expr"], i))
            for i, (xid, v) in enumerate(tab["indexes"].items(), 1):
                x.append((p, tid, xid, v["name"], v["cols"], v["unique"], "", i))
    make = spark.createDataFrame
    return Catalog(make(t, TABLES), make(c, COLUMNS), make(k, CONSTRAINTS), make(x, INDEXES))
