"""The conflict taxonomy: for each class a case that must conflict and a
neighbour that must merge, all as projects of one merge."""

from __future__ import annotations

import random

from palimpsest.operators.catalog_diff import catalog_diff
from palimpsest.operators.catalog_merge import merge_catalogs
from tests.small import (
    FK,
    IX,
    O_ID,
    O_STATUS,
    O_USER,
    ORDERS,
    PK_U,
    U_EMAIL,
    U_ID,
    U_NAME,
    USERS,
    catalog,
    col,
    con,
    edited,
    index,
    shop,
)


def users(s):
    return s[USERS]["columns"]


def orders(s):
    return s[ORDERS]["columns"]


def put(getter, key, **fields):
    return lambda s: getter(s)[key].update(fields)


def drop_users(s):
    del s[ORDERS]["constraints"][FK]
    del orders(s)[O_USER]
    del s[USERS]


def add_buyer(s):
    orders(s)[29] = col("buyer_id", "bigint")
    s[ORDERS]["constraints"][109] = con("foreign_key", [29], USERS, [U_ID])


NO_PK = edited(shop(), lambda s: s[USERS]["constraints"].pop(PK_U))
nothing = lambda s: None
# name: (base, ours, theirs, classes expected, problem codes expected)
CASES = {
    "same change": (shop(), put(users, U_EMAIL, base="text", params=[]), put(users, U_EMAIL, base="text", params=[]), [], []),
    "c1 rename rename": (shop(), put(users, U_EMAIL, name="a"), put(users, U_EMAIL, name="b"), ["rename_rename"], []),
    "c1 one side": (shop(), lambda s: s[USERS].update(name="accounts"), nothing, [], []),
    "c2 retype retype": (shop(), put(users, U_EMAIL, params=[500]), put(users, U_EMAIL, base="text", params=[]), ["retype_retype"], []),
    "c2 rename and retype": (shop(), put(users, U_EMAIL, base="text", params=[]), put(users, U_EMAIL, name="mail"), [], []),
    "c3 delete modify": (shop(), lambda s: users(s).pop(U_EMAIL), put(users, U_EMAIL, base="text", params=[]), ["delete_modify"], []),
    "c3 delete untouched": (shop(), lambda s: users(s).pop(U_NAME), nothing, [], []),
    "c3 table": (shop(), drop_users, put(users, U_EMAIL, base="text", params=[]), ["delete_modify"], []),
    "c4 add add": (
        shop(),
        lambda s: users(s).update({18: col("status", "varchar", [20])}),
        lambda s: users(s).update({19: col("status", "integer")}),
        ["name_collision"],
        ["duplicate_column_name"],
    ),
    "c4 renames collide": (
        shop(),
        lambda s: s[USERS].update(name="archive"),
        lambda s: s[ORDERS].update(name="archive"),
        ["name_collision"],
        ["duplicate_table_name"],
    ),
    "c5 two keys": (
        NO_PK,
        lambda s: s[USERS]["constraints"].update({111: con("primary_key", [U_ID])}),
        lambda s: s[USERS]["constraints"].update({112: con("primary_key", [U_EMAIL])}),
        ["pk_pk"],
        [],
    ),
    "c5 same unique": (
        shop(),
        lambda s: s[USERS]["constraints"].update({111: con("unique", [U_EMAIL])}),
        lambda s: s[USERS]["constraints"].update({112: con("unique", [U_EMAIL])}),
        [],
        [],
    ),
    "c5 both modify": (
        shop(),
        lambda s: s[ORDERS]["constraints"][FK].update(on_delete="cascade"),
        lambda s: s[ORDERS]["constraints"][FK].update(on_delete="set_null"),
        ["constraint_constraint"],
        [],
    ),
    "c6 index": (
        shop(),
        lambda s: s[ORDERS]["indexes"][IX].update(unique=True),
        lambda s: s[ORDERS]["indexes"][IX]["cols"].append((O_ID, False)),
        ["index_index"],
        [],
    ),
    "c6 one name": (
        shop(),
        lambda s: s[USERS]["indexes"].update({211: index("idx_new", [U_EMAIL])}),
        lambda s: s[ORDERS]["indexes"].update({212: index("idx_new", [O_STATUS])}),
        ["name_collision"],
        ["duplicate_index_name"],
    ),
    "c6 index renamed by them": (shop(), nothing, lambda s: s[ORDERS]["indexes"][IX].update(name="idx_s"), [], []),
    "c7 defaults": (shop(), put(orders, O_STATUS, default="'new'"), put(orders, O_STATUS, default="'open'"), ["default_default"], []),
    "c7 default and null": (shop(), put(orders, O_STATUS, default="'new'"), put(orders, O_STATUS, nullable=True), [], []),
    "c8 broken together": (shop(), drop_users, add_buyer, [], ["fk_missing_table"]),
    "c8 disjoint": (
        shop(),
        lambda s: users(s).update({18: col("age", "integer")}),
        lambda s: orders(s).update({28: col("note", "text")}),
        [],
        [],
    ),
}
NUMBER = {name: i for i, name in enumerate(CASES, 1)}


def sides(spark):
    base = {NUMBER[n]: c[0] for n, c in CASES.items()}
    ours = {NUMBER[n]: edited(c[0], c[1]) for n, c in CASES.items()}
    theirs = {NUMBER[n]: edited(c[0], c[2]) for n, c in CASES.items()}
    return catalog(spark, base), catalog(spark, ours), catalog(spark, theirs)


def test_taxonomy(spark):
    merge = merge_catalogs(*sides(spark))
    conflicts, problems = {}, {}
    for r in merge.conflicts.collect():
        conflicts.setdefault(r.project_id, []).append(r["class"])
    for r in merge.problems().collect():
        problems.setdefault(r.project_id, []).append(r.code)
    for name, (_, _, _, classes, codes) in CASES.items():
        assert sorted(conflicts.get(NUMBER[name], [])) == sorted(classes), name
        if name != "c3 delete modify" and name != "c3 table":
            assert sorted(problems.get(NUMBER[name], [])) == sorted(codes), name
    gate = {r.project_id: r.decision for r in merge.gate(merge.merged.tables.select("project_id").distinct()).collect()}
    for name, (_, _, _, classes, codes) in CASES.items():
        want = "conflicts" if classes else "problems" if codes else "commit"
        assert gate[NUMBER[name]] == want, name


def test_merged_values(spark):
    merged = merge_catalogs(*sides(spark)).merged
    cols = {(r.project_id, r.column_id): r for r in merged.columns.collect()}
    both = cols[NUMBER["c2 rename and retype"], U_EMAIL]
    assert (both.name, both.type_base) == ("mail", "text")
    both = cols[NUMBER["c7 default and null"], O_STATUS]
    assert (both.default_expr, both.nullable) == ("'new'", True)
    assert (NUMBER["c3 delete untouched"], U_NAME) not in cols
    assert cols[NUMBER["c8 disjoint"], 18].position == 4 and cols[NUMBER["c8 disjoint"], 28].position == 4
    uniques = [r for r in merged.constraints.collect() if r.project_id == NUMBER["c5 same unique"] and r.kind == "unique"]
    assert [r.constraint_id for r in uniques] == [111]
    names = {(r.project_id, r.index_id): r.name for r in merged.indexes.collect()}
    assert names[NUMBER["c6 index renamed by them"], IX] == "idx_s"


def test_answers(spark):
    base, ours, theirs = sides(spark)
    ids = {r.project_id: r.conflict_id for r in merge_catalogs(base, ours, theirs).conflicts.collect()}
    n = NUMBER
    answers = [
        (ids[n["c1 rename rename"]], "custom", "primary_email"),
        (ids[n["c2 retype retype"]], "custom", "varchar(1000)"),
        (ids[n["c3 delete modify"]], "theirs", None),
        (ids[n["c3 table"]], "theirs", None),
        (ids[n["c4 add add"]], "custom", "status_code"),
        (ids[n["c4 renames collide"]], "theirs", None),
        (ids[n["c5 two keys"]], "theirs", None),
        (ids[n["c5 both modify"]], "custom", "x"),
        (ids[n["c6 index"]], "theirs", None),
        (ids[n["c6 one name"]], "ours", None),
        (ids[n["c7 defaults"]], "both", None),
        ("column_name:0:0:0", "ours", None),
    ]
    resolved = merge_catalogs(base, ours, theirs, spark.createDataFrame(answers, "conflict_id string, choice string, custom string"))
    left = {r.project_id for r in resolved.conflicts.collect()}
    assert left == {n["c5 both modify"], n["c7 defaults"]}
    problems = {r.conflict_id: r.problem for r in resolved.resolution_problems.collect()}
    assert problems == {
        ids[n["c5 both modify"]]: "custom_not_accepted",
        ids[n["c7 defaults"]]: "unknown_choice",
        "column_name:0:0:0": "unknown_conflict",
    }
    cols = {(r.project_id, r.column_id): r for r in resolved.merged.columns.collect()}
    assert cols[n["c1 rename rename"], U_EMAIL].name == "primary_email"
    retyped = cols[n["c2 retype retype"], U_EMAIL]
    assert (retyped.type_base, retyped.type_params) == ("varchar", [1000])
    assert cols[n["c3 delete modify"], U_EMAIL].type_base == "text"
    assert cols[n["c3 table"], U_EMAIL].type_base == "text"
    assert (cols[n["c4 add add"], 18].name, cols[n["c4 add add"], 19].name) == ("status", "status_code")
    tables = {(r.project_id, r.table_id): r.name for r in resolved.merged.tables.collect()}
    assert (n["c4 renames collide"], USERS) not in tables and tables[n["c4 renames collide"], ORDERS] == "archive"
    assert not [k for k in cols if k == (n["c4 renames collide"], U_ID)]
    keys = [r.constraint_id for r in resolved.merged.constraints.collect() if r.project_id == n["c5 two keys"] and r.table_id == USERS]
    assert keys == [112]
    indexes = {(r.project_id, r.index_id): r for r in resolved.merged.indexes.collect()}
    assert [c.column_id for c in indexes[n["c6 index"], IX].columns] == [O_STATUS, O_ID]
    assert (n["c6 one name"], 211) in indexes and (n["c6 one name"], 212) not in indexes


def test_fast_forward_is_identity(spark):
    base, ours, _ = sides(spark)
    for a, b in ((base, ours), (ours, base)):
        merge = merge_catalogs(base, a, b)
        assert merge.conflicts.isEmpty()
        assert catalog_diff(ours, merge.merged).isEmpty()


def test_identical_and_disjoint_random_edits(spark):
    """The same edits on both sides never conflict; edits in different tables
    conflict only where a global name is claimed twice."""
    rng = random.Random(21)
    base, same, left, right = {}, {}, {}, {}

    def change(s, table, tag):
        cols = s[table]["columns"]
        for c in list(cols):
            what = rng.randrange(6)
            if what == 0:
                cols[c]["name"] = f"{tag}{c}"
            elif what == 1:
                cols[c].update(base="text", params=[])
            elif what == 2:
                cols[c]["default"] = f"'{tag}'"
            elif what == 3 and len(cols) > 1:
                del cols[c]
        if rng.random() < 0.6:
            s[table]["name"] = rng.choice(["x", "y"])

    for p in range(60):
        base[p] = shop()
        same[p] = edited(base[p], lambda s: [change(s, t, "o") for t in (USERS, ORDERS)])
        if same[p][USERS]["name"] == same[p][ORDERS]["name"]:  # not a sound schema
            same[p][ORDERS]["name"] = "z"
        left[p] = edited(base[p], lambda s: change(s, USERS, "l"))
        right[p] = edited(base[p], lambda s: change(s, ORDERS, "r"))
    cat = {n: catalog(spark, d) for n, d in {"base": base, "same": same, "left": left, "right": right}.items()}
    merge = merge_catalogs(cat["base"], cat["same"], cat["same"])
    assert merge.conflicts.isEmpty() and catalog_diff(cat["same"], merge.merged).isEmpty()
    apart = merge_catalogs(cat["base"], cat["left"], cat["right"])
    clash = {p for p in base if left[p][USERS]["name"] == right[p][ORDERS]["name"]}
    assert {(r.project_id, r["class"]) for r in apart.conflicts.collect()} == {(p, "name_collision") for p in clash}
    assert clash and len(clash) < 60
