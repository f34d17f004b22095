"""Identity is proposed, never guessed."""

from __future__ import annotations

import copy
import random

from palimpsest.functions import types, words
from palimpsest.operators import match
from palimpsest.operators.catalog_merge import merge_catalogs
from palimpsest.plans.reimport import reimport
from pyspark.sql import functions as F
from tests.small import U_EMAIL, USERS, catalog, col, con, index, shop

SHIFT = 1000


def fresh(schema: dict) -> dict:
    """The same schema as it is loaded without ids: all ids are new."""
    out = {}
    for t, tab in schema.items():
        out[t + SHIFT] = {
            "name": tab["name"],
            "columns": {c + SHIFT: copy.deepcopy(v) for c, v in tab["columns"].items()},
            "constraints": {
                k + SHIFT: v | {"cols": [c + SHIFT for c in v["cols"]], "ref": v["ref"] and v["ref"] + SHIFT, "ref_cols": [c + SHIFT for c in v["ref_cols"]]}
                for k, v in tab["constraints"].items()
            },
            "indexes": {x + SHIFT: v | {"cols": [(c + SHIFT, d) for c, d in v["cols"]]} for x, v in tab["indexes"].items()},
        }
    return out


def decide(spark, *answers):
    return spark.createDataFrame(list(answers), "old_id long, rename boolean")


def test_reimport_outcomes(spark):
    head = shop()
    head[USERS]["indexes"][301] = index("idx_users_email", [U_EMAIL])
    renamed = fresh(head)
    renamed[USERS + SHIFT]["columns"][U_EMAIL + SHIFT]["name"] = "email_address"
    table = fresh(head)
    table[USERS + SHIFT]["name"] = "accounts"
    broken = fresh(head)
    broken[USERS + SHIFT]["constraints"][1999] = con("check", expr="")
    cases = {1: fresh(head), 2: renamed, 3: table, 4: broken}
    heads, new = catalog(spark, {p: head for p in cases}), catalog(spark, cases)
    got = reimport(heads, new)
    assert {r.project_id: r.status for r in got.status.collect()} == {1: "no_change", 2: "needs_decision", 3: "needs_decision", 4: "invalid"}
    proposals = {(r.project_id, r.kind, r.old_name, r.new_name) for r in got.proposals.collect()}
    assert proposals == {(2, "column", "email", "email_address"), (3, "table", "users", "accounts")}

    accepted = reimport(heads, new, decide(spark, (U_EMAIL, True), (USERS, True)))
    assert {r.project_id: r.status for r in accepted.status.collect()} == {1: "no_change", 2: "commit", 3: "commit", 4: "invalid"}
    kinds = {(r.project_id, r.kind) for r in accepted.changes.collect()}
    assert kinds == {(2, "column_renamed"), (3, "table_renamed"), (4, "constraint_added")}

    declined = reimport(heads, new, decide(spark, (U_EMAIL, False), (USERS, True)))
    kinds = {r.kind for r in declined.changes.collect() if r.project_id == 2}
    assert {"column_added", "column_dropped"} <= kinds and "column_renamed" not in kinds
    # The untouched head merges with the same load without a trace.
    merge = merge_catalogs(heads, heads, accepted.catalog)
    assert merge.conflicts.where("project_id = 1").isEmpty()


def serial(head, new, decisions):
    """Serve the head columns of one table one after another."""
    taken, proposals, accepted = set(), {}, {}
    names_new, names_old = {c["name"] for c in new.values()}, {c["name"] for c in head.values()}

    def similarity(a, b):
        if a == b:
            return 1.0
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
            prev = cur
        return 1 - prev[-1] / max(len(a), len(b))

    for i, (h, hc) in enumerate(head.items(), 1):
        if hc["name"] in names_new:
            continue
        best, top = None, 0.0
        for j, (n, nc) in enumerate(new.items(), 1):
            if nc["name"] in names_old or n in taken:
                continue
            kind = 0.5 if (hc["base"], hc["params"]) == (nc["base"], nc["params"]) else 0.3 if hc["base"] == nc["base"] else 0.0
            place = 0.2 if i == j else 0.1 if abs(i - j) == 1 else 0.0
            score = kind + place + 0.3 * similarity(hc["name"], nc["name"])
            if score > top + 1e-12:
                best, top = n, score
        if best is None or top < 0.5:
            continue
        answer = decisions.get(h)
        if answer is None:
            proposals[h] = best
        elif answer:
            taken.add(best)
            accepted[h] = best
    return proposals, accepted


def test_decisions_equal_serving_in_head_order(spark):
    rng = random.Random(6)
    heads, news, decisions, want_p, want_a = {}, {}, {}, {}, {}
    for p in range(40):
        side = lambda lo, tag: {
            p * 1000 + lo + i: col(f"{tag}{rng.choice(['aa', 'ab', 'bb', 'abc'])}{i}", rng.choice(["int", "text"]), [rng.choice([1, 2])]) for i in range(rng.randint(1, 5))
        }
        old, new = side(0, "x"), side(500, "y")
        heads[p] = {p: {"name": "t", "columns": old, "constraints": {}, "indexes": {}}}
        news[p] = {p + 100: {"name": "t", "columns": new, "constraints": {}, "indexes": {}}}
        mine = {h: rng.choice([True, True, False]) for h in old if rng.random() < 0.7}
        decisions |= mine
        pr, ac = serial(old, new, mine)
        want_p |= pr
        want_a |= ac
    got = match.rename_proposals(catalog(spark, heads), catalog(spark, news), decide(spark, *decisions.items()))
    assert {r.old_id: r.new_id for r in got.proposals.collect()} == want_p
    assert {r.old_id: r.new_id for r in got.columns.collect()} == want_a


def test_table_similarity_loses_no_pair(spark):
    rng = random.Random(12)
    pool = [(f"c{i}", rng.choice(["int", "text"])) for i in range(12)]

    def tables(lo):
        out = {}
        for t in range(25):
            cols = [("id", "bigint"), *rng.sample(pool, rng.randint(1, 8))]
            out[lo + t] = {"name": f"n{lo + t}", "columns": {(lo + t) * 100 + i: col(n, b) for i, (n, b) in enumerate(cols)}, "constraints": {}, "indexes": {}}
        return out

    old, new = tables(0), tables(100)
    a, b = catalog(spark, {1: old}), catalog(spark, {1: new})
    plain = lambda c: match.plain_columns(c.columns)
    got = {(r.old_id, r.new_id): round(r.score, 9) for r in match.table_similarity(plain(a), plain(b)).collect()}
    want = {}
    for o, ot in old.items():
        for n, nt in new.items():
            x = {(c["name"], c["base"]) for c in ot["columns"].values()}
            y = {(c["name"], c["base"]) for c in nt["columns"].values()}
            score = 2 * len(x & y) / (len(x) + len(y))
            if score >= 0.4:
                want[o, n] = round(score, 9)
    assert got == want and len(want) > 20


def test_types_and_words(spark):
    df = spark.createDataFrame([("varchar(255)",), (" Numeric(10, 2) ",), ("text",), ("numeric(",), ("",)], "t string")
    parsed = [r.p for r in df.select(types.parse_type(F.col("t")).alias("p")).collect()]
    assert [p and (p.base, p.params) for p in parsed] == [("varchar", [255]), ("numeric", [10, 2]), ("text", []), None, None]
    shown = df.limit(2).select(types.parse_type(F.col("t")).alias("p")).select(types.render_type(F.col("p.base"), F.col("p.params")).alias("s"))
    assert [r.s for r in shown.collect()] == ["varchar(255)", "numeric(10,2)"]
    one = spark.createDataFrame([("int4", "c", 'a"b')], "a string, c string, q string")
    got = one.select(types.normal_type_name(F.col("a")), types.action_name(F.col("c")), words.quoted(F.col("q"))).first()
    assert tuple(got) == ("integer", "cascade", '"a""b"')
    edits = spark.createDataFrame(
        [(1, 2, "rename_column", "t", "t.a", "b"), (1, 1, "drop_table", "u", None, None), (1, 3, "set_default", "t", "t.b", "")],
        "c int, seq int, op string, tab string, target string, value string",
    )
    told = edits.withColumn("text", words.edit_description(*[F.col(x) for x in ("op", "tab", "target", "value")]))
    assert words.commit_messages(told, ["c"]).first().message == "drop table u; rename t.a → b; clear default on t.b"
