"""A sequential model of schema edits, to test the replay against."""

from __future__ import annotations

import copy


def apply(base: dict, edits: list[dict]):
    """`(state, None)` or `(base, (seq, reason))`."""
    state = copy.deepcopy(base)
    for e in edits:
        reason = _one(state, e)
        if reason:
            return base, (e["seq"], reason)
    return state, None


def _one(s: dict, e: dict) -> str | None:  # noqa: C901
    op, tid = e["op"], e.get("table_id")
    names = lambda: {t["name"]: i for i, t in s.items()}
    if op == "create_table":
        if not e.get("name"):
            return "name_empty"
        if e["name"] in names():
            return "name_taken"
        s[tid] = {
            "name": e["name"],
            "columns": {c["column_id"]: {k: c[k] for k in ("name", "type", "nullable")} | {"default": ""} for c in e["columns"]},
            "constraints": {},
            "indexes": {},
        }
        return None
    if tid not in s:
        return "table_not_found"
    t = s[tid]
    cols = t["columns"]
    if op == "drop_table":
        del s[tid]
    elif op == "rename_table":
        if e["name"] in names() and names()[e["name"]] != tid:
            return "name_taken"
        t["name"] = e["name"]
    elif op == "add_column":
        if any(c["name"] == e["name"] for c in cols.values()):
            return "name_taken"
        cols[e["column_id"]] = {"name": e["name"], "type": e["type"], "nullable": e["nullable"], "default": ""}
    elif op in ("drop_column", "rename_column", "retype_column", "set_nullable", "set_default"):
        cid = e["column_id"]
        if cid not in cols:
            return "column_not_found"
        if op == "drop_column":
            used = any(cid in k["column_ids"] + k["ref_column_ids"] for k in t["constraints"].values())
            if used or any(cid in x["columns"] for x in t["indexes"].values()):
                return "still_referenced"
            del cols[cid]
        elif op == "rename_column":
            if any(c["name"] == e["name"] for i, c in cols.items() if i != cid):
                return "name_taken"
            cols[cid]["name"] = e["name"]
        elif op == "retype_column":
            cols[cid]["type"] = e["type"]
        elif op == "set_default":
            cols[cid]["default"] = e["default_expr"]
        else:
            pk = [k for k in t["constraints"].values() if k["kind"] == "primary_key"]
            if e["nullable"] and any(cid in k["column_ids"] for k in pk):
                return "primary_key_member"
            cols[cid]["nullable"] = e["nullable"]
    elif op == "add_constraint":
        if any(c not in cols for c in e["column_ids"]):
            return "column_not_found"
        if e["kind"] == "primary_key":
            if any(k["kind"] == "primary_key" for k in t["constraints"].values()):
                return "has_primary_key"
            for c in e["column_ids"]:
                cols[c]["nullable"] = False
        if e["kind"] == "foreign_key":
            if e["ref_table_id"] not in s:
                return "ref_table_not_found"
            if any(c not in s[e["ref_table_id"]]["columns"] for c in e["ref_column_ids"]):
                return "ref_column_not_found"
        t["constraints"][e["constraint_id"]] = {k: e[k] for k in ("kind", "column_ids", "ref_table_id", "ref_column_ids")}
    elif op == "drop_constraint":
        if e["constraint_id"] not in t["constraints"]:
            return "constraint_not_found"
        del t["constraints"][e["constraint_id"]]
    elif op == "add_index":
        if any(x["name"] == e["name"] for o in s.values() for x in o["indexes"].values()):
            return "name_taken"
        if any(c not in cols for c in e["index_columns"]):
            return "column_not_found"
        t["indexes"][e["index_id"]] = {"name": e["name"], "columns": list(e["index_columns"])}
    elif op == "drop_index":
        if e["index_id"] not in t["indexes"]:
            return "index_not_found"
        del t["indexes"][e["index_id"]]
    else:
        return "unknown_operation"
    return None
