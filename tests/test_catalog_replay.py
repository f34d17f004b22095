"""Replay of random schema edits against the sequential model."""

from __future__ import annotations

import random

from palimpsest.operators.catalog import Catalog
from palimpsest.operators.catalog_replay import replay_catalog
from tests.model import apply

LOG = (
    "project_id long, seq long, op string, table_id long, column_id long, constraint_id long, index_id long, name string, type string, "
    "nullable boolean, default_expr string, columns array<struct<column_id:long,name:string,type:string,nullable:boolean,default_expr:string>>, "
    "kind string, column_ids array<long>, ref_table_id long, ref_column_ids array<long>, on_delete string, on_update string, expr string, "
    "index_columns array<struct<column_id:long,desc:boolean>>, is_unique boolean, method string"
)
FIELDS = [f.split()[0] for f in LOG.replace("struct<column_id:long,name:string,type:string,nullable:boolean,default_expr:string>", "s").split(", ")]
POOL = ["a", "b", "c", "d", "e", "f"]


def base_tables(rng):
    state = {}
    for t in (1, 2):
        cols = {t * 10 + i: {"name": POOL[i], "type": "text", "nullable": i > 0, "default": ""} for i in range(3)}
        pk = {t * 100: {"kind": "primary_key", "column_ids": [t * 10], "ref_table_id": None, "ref_column_ids": []}} if rng.random() < 0.5 else {}
        state[t] = {"name": POOL[t], "columns": cols, "constraints": pk, "indexes": {}}
    return state


def random_edits(rng, n):
    edits, fresh = [], 1000
    tables, columns = [1, 2, 3], [10, 11, 12, 20, 21, 22]
    made_k, made_x = [100, 200], [999]
    for seq in range(n):
        fresh += 1
        e = {"seq": seq * 3, "table_id": rng.choice(tables)}
        op = rng.choice(
            ["create_table", "drop_table", "rename_table", "add_column", "add_column", "drop_column", "rename_column", "rename_column"]
            + ["retype_column", "set_nullable", "set_default", "add_constraint", "add_constraint", "drop_constraint", "add_index", "drop_index"]
        )
        e["op"] = op
        if op == "create_table":
            e |= {"table_id": fresh, "name": rng.choice(POOL), "columns": [{"column_id": fresh + 5000, "name": "a", "type": "text", "nullable": True}]}
            tables.append(fresh)
            columns.append(fresh + 5000)
        elif op == "rename_table":
            e |= {"name": rng.choice(POOL)}
        elif op == "add_column":
            e |= {"column_id": fresh, "name": rng.choice(POOL), "type": "integer", "nullable": rng.random() < 0.5}
            columns.append(fresh)
        elif op in ("drop_column", "rename_column", "retype_column", "set_nullable", "set_default"):
            e |= {"column_id": rng.choice(columns), "name": rng.choice(POOL), "type": "bigint", "nullable": rng.random() < 0.5, "default_expr": "0"}
            e["table_id"] = e["column_id"] // 10 if e["column_id"] < 100 else e["table_id"]
        elif op == "add_constraint":
            kind = rng.choice(["primary_key", "unique", "foreign_key"])
            e |= {"constraint_id": fresh, "kind": kind, "column_ids": [rng.choice(columns[:6])], "ref_table_id": None, "ref_column_ids": []}
            e["table_id"] = e["column_ids"][0] // 10
            if kind == "foreign_key":
                e |= {"ref_table_id": 2, "ref_column_ids": [rng.choice([20, 21])]}
            made_k.append(fresh)
        elif op == "drop_constraint":
            e |= {"constraint_id": rng.choice(made_k)}
        elif op == "add_index":
            e |= {"index_id": fresh, "name": rng.choice(POOL), "index_columns": [rng.choice(columns[:6])]}
            e["table_id"] = e["index_columns"][0] // 10
            made_x.append(fresh)
        elif op == "drop_index":
            e |= {"index_id": rng.choice(made_x)}
        edits.append(e)
    return edits


def frames(spark, states):
    t, c, k, x = [], [], [], []
    for p, state in states.items():
        for n, (tid, tab) in enumerate(state.items()):
            t.append((p, tid, tab["name"], n))
            for i, (cid, col) in enumerate(tab["columns"].items(), 1):
                c.append((p, tid, cid, col["name"], col["type"], [], col["nullable"], col["default"], i))
            for i, (kid, con) in enumerate(tab["constraints"].items(), 1):
                k.append((p, tid, kid, "", con["kind"], con["column_ids"], con["ref_table_id"], con["ref_column_ids"], "", "", "", i))
    return Catalog(
        spark.createDataFrame(t, "project_id long, table_id long, name string, ordinal int"),
        spark.createDataFrame(
            c,
            "project_id long, table_id long, column_id long, name string, type_base string, type_params array<int>, nullable boolean, default_expr string, position int",
        ),
        spark.createDataFrame(
            k,
            "project_id long, table_id long, constraint_id long, name string, kind string, column_ids array<long>, ref_table_id long, "
            "ref_column_ids array<long>, on_delete string, on_update string, expr string, ordinal int",
        ),
        spark.createDataFrame(
            x,
            "project_id long, table_id long, index_id long, name string, columns array<struct<column_id:long,desc:boolean>>, is_unique boolean, method string, ordinal int",
        ),
    )


def log_row(p, e):
    full = {f: None for f in FIELDS} | e | {"project_id": p}
    if "index_columns" in e:
        full["index_columns"] = [(c, False) for c in e["index_columns"]]
        full["is_unique"] = False
    if "columns" in e:
        full["columns"] = [(c["column_id"], c["name"], c["type"], c["nullable"], "") for c in e["columns"]]
    return tuple(full[f] for f in FIELDS)


def test_replay_equals_sequential_application(spark):
    rng = random.Random(7)
    states = {p: base_tables(rng) for p in range(150)}
    logs = {p: random_edits(rng, rng.randint(1, 9)) for p in states}
    expected, failed = {}, {}
    for p in states:
        expected[p], error = apply(states[p], logs[p])
        if error:
            failed[p] = error
    log = spark.createDataFrame([log_row(p, e) for p, es in logs.items() for e in es], LOG)
    # A narrow bucket makes every carry between buckets happen.
    state, errors = replay_catalog(frames(spark, states), log, rows=8)
    got = {r.project_id: (r.seq, r.reason) for r in errors.collect()}
    assert got == failed
    assert 30 < len(failed) < 140

    want_columns = {
        (p, t, c, v["name"], v["type"], v["nullable"], v["default"], i)
        for p, s in expected.items()
        for t, tab in s.items()
        for i, (c, v) in enumerate(tab["columns"].items(), 1)
    }
    found = {
        (r.project_id, r.table_id, r.column_id, r.name, r.type_base, r.nullable, r.default_expr, r.position) for r in state.columns.collect()
    }
    assert found == want_columns
    assert {(r.project_id, r.table_id, r.name) for r in state.tables.collect()} == {
        (p, t, tab["name"]) for p, s in expected.items() for t, tab in s.items()
    }
    assert {(r.project_id, r.table_id, r.constraint_id, tuple(r.column_ids)) for r in state.constraints.collect()} == {
        (p, t, k, tuple(v["column_ids"])) for p, s in expected.items() for t, tab in s.items() for k, v in tab["constraints"].items()
    }
    assert {(r.project_id, r.table_id, r.index_id, r.name) for r in state.indexes.collect()} == {
        (p, t, x, v["name"]) for p, s in expected.items() for t, tab in s.items() for x, v in tab["indexes"].items()
    }
