"""Integrity, replay, evolution, loading and re-keying queries on rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import cells
from palimpsest.operators import diff, evolve, integrity, merge, referential, rekey, replay
from palimpsest.operators.integrity import Check, ForeignKey, NotNull, Unique
from palimpsest.session import shared_dir
from palimpsest.sources import ingest, versions
from palimpsest.sources.deltas import DeltaVersions
from workloads import rows
from workloads.data import Data, oracle

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Data(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle(sql)
        return fn

    return register


@query(
    "duplicate_keys_lineitem",
    """SELECT l_orderkey, l_linenumber, 'duplicate_key' AS problem, count(*) AS n FROM {lineitem}
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def duplicate_keys_lineitem(d):
    return integrity.key_violations(d["lineitem"], ["l_orderkey", "l_linenumber"])


@query(
    "merge_key_problems_lineitem",
    """SELECT 'base' AS side, 'duplicate_key' AS problem, l_orderkey, l_linenumber, count(*) AS n FROM {lineitem}
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'ours', 'duplicate_key', l_orderkey, l_linenumber, count(*) FROM {lineitem} WHERE l_returnflag <> 'R'
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'theirs', 'duplicate_key', l_orderkey, l_linenumber, count(*) FROM {lineitem} WHERE l_linestatus = 'O'
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def merge_key_problems_lineitem(d):
    li = d["lineitem"]
    return merge.merge_key_problems(
        li, li.where("l_returnflag <> 'R'"), li.where("l_linestatus = 'O'"), ["l_orderkey", "l_linenumber"]
    )


_LINE_SIDES = {
    "frm": "SELECT l_orderkey AS o, l_linenumber AS n, l_quantity AS q, l_tax AS t FROM {lineitem}",
    "to": "SELECT l_orderkey AS o, l_linenumber AS n, l_quantity + CASE WHEN l_tax > 0.05 THEN 1 ELSE 0 END AS q, l_tax AS t FROM {lineitem} WHERE l_returnflag <> 'R'",
}


def _lines(d):
    li = d["lineitem"].selectExpr("l_orderkey AS o", "l_linenumber AS n", "l_quantity AS q", "l_tax AS t", "l_returnflag AS flag")
    moved = li.where("flag <> 'R'").withColumn("q", F.col("q") + F.when(F.col("t") > 0.05, 1).otherwise(0))
    return li.drop("flag"), moved.drop("flag")


# A key that is repeated on either side is counted and told, never left out unseen.
_LINE_PAIRS = f"""f AS (SELECT o, n, count(*) AS c, min(q) AS q FROM ({_LINE_SIDES['frm']}) GROUP BY o, n),
g AS (SELECT o, n, count(*) AS c, min(q) AS q FROM ({_LINE_SIDES['to']}) GROUP BY o, n),
j AS (SELECT f.o, f.n, coalesce(f.c, 0) AS fc, coalesce(g.c, 0) AS gc, f.q AS fq, g.q AS gq,
        f.c > 1 OR coalesce(g.c, 0) > 1 AS twice FROM f LEFT JOIN g ON f.o = g.o AND f.n = g.n)"""


@query(
    "diff_summary_lineitem",
    f"""WITH {_LINE_PAIRS}
SELECT cast(0 AS bigint) AS added, count(*) FILTER (NOT twice AND gc = 0) AS dropped, count(*) FILTER (NOT twice AND gc = 1 AND fq <> gq) AS changed,
  count(*) FILTER (NOT twice AND gc = 1 AND fq = gq) AS unchanged, count(*) FILTER (NOT twice AND gc = 1 AND fq <> gq) AS changed_cells,
  count(*) FILTER (twice) AS skipped_keys FROM j""",
)
def diff_summary_lineitem(d):
    return diff.diff_summary(*_lines(d), ["o", "n"], ["q", "t"])


@query(
    "diff_keys_lineitem",
    f"""WITH {_LINE_PAIRS}
SELECT o, n, CASE WHEN twice THEN 'duplicate_key' WHEN gc = 0 THEN 'dropped' ELSE 'common' END AS change FROM j""",
)
def diff_keys_lineitem(d):
    return diff.diff_keys(*_lines(d), ["o", "n"])


@query(
    "merge_gate_repeated_keys",
    f"""WITH {_LINE_PAIRS}
SELECT cast(0 AS bigint) AS n_conflicts, cast(sum(CASE WHEN twice THEN 2 * (CASE WHEN fc > 1 THEN 1 ELSE 0 END) + CASE WHEN gc > 1 THEN 1 ELSE 0 END ELSE 0 END) AS bigint) AS n_problems,
  count(*) FILTER (twice) = 0 AS clean, CASE WHEN count(*) FILTER (twice) > 0 THEN 'problems' ELSE 'commit' END AS decision FROM j""",
)
def merge_gate_repeated_keys(d):
    base, ours = _lines(d)
    return merge.merge3(base, ours, base, ["o", "n"], ["q", "t"]).gate()


@query(
    "not_null_report",
    """SELECT 'cust' AS column, count(*) FILTER (cust IS NULL) AS violations FROM {orders_ours}
UNION ALL SELECT 'status', count(*) FILTER (status IS NULL) FROM {orders_ours}
UNION ALL SELECT 'code', count(*) FILTER (code IS NULL) FROM {orders_ours}""",
)
def not_null_report(d):
    return integrity.not_null_violations(d["orders_ours"], ["cust", "status", "code"])


@query(
    "unique_report_customer",
    """SELECT c_nationkey, c_mktsegment, count(*) AS n FROM {customer}
WHERE c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""",
)
def unique_report_customer(d):
    return integrity.unique_violations(d["customer"], ["c_nationkey", "c_mktsegment"])


@query(
    "fk_report_star",
    """
SELECT 'orders.o_custkey' AS fk, cast(o_custkey AS string) AS value, count(*) AS n_rows FROM {orders}
  WHERE o_custkey NOT IN (SELECT c_custkey FROM {customer_pruned}) GROUP BY o_custkey
UNION ALL SELECT 'lineitem.l_orderkey', cast(l_orderkey AS string), count(*) FROM {lineitem}
  WHERE l_orderkey NOT IN (SELECT k FROM {orders_ours}) GROUP BY l_orderkey
UNION ALL SELECT 'customer.c_nationkey', cast(c_nationkey AS string), count(*) FROM {customer_raw}
  WHERE c_nationkey NOT IN (SELECT n_nationkey FROM {nation}) GROUP BY c_nationkey
UNION ALL SELECT 'events.user_id', cast(user_id AS string), count(*) FROM {events}
  WHERE user_id NOT IN (SELECT c_custkey FROM {customer_pruned}) GROUP BY user_id
UNION ALL SELECT 'documents.doc_id', cast(doc_id AS string), count(*) FROM {documents}
  WHERE doc_id NOT IN (SELECT doc_id FROM {labels}) GROUP BY doc_id
""",
)
def fk_report_star(d):
    checks = [
        ("orders.o_custkey", d["orders"], "o_custkey", d["customer_pruned"], "c_custkey"),
        ("lineitem.l_orderkey", d["lineitem"], "l_orderkey", d["orders_ours"], "k"),
        ("customer.c_nationkey", d["customer_raw"], "c_nationkey", d["nation"], "n_nationkey"),
        ("events.user_id", d["events"], "user_id", d["customer_pruned"], "c_custkey"),
        ("documents.doc_id", d["documents"], "doc_id", d["labels"], "doc_id"),
    ]
    out = None
    for label, child, col, parent, ref in checks:
        found = integrity.fk_orphans(child, [col], parent, [ref]).select(
            F.lit(label).alias("fk"), F.col(col).cast("string").alias("value"), "n_rows"
        )
        out = found if out is None else out.unionByName(found)
    return out


@query(
    "check_violations_lineitem",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM {lineitem}
WHERE NOT coalesce(l_quantity < 50 AND l_discount <= 0.09, true)""",
)
def check_violations_lineitem(d):
    broken = integrity.check_violations(d["lineitem"], "l_quantity < 50 AND l_discount <= 0.09D")
    return broken.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query(
    "integrity_report",
    """
SELECT 'not_null' AS code, 'orders' AS table, 'cust' AS object, count(*) AS violations, min(cast(k AS string)) AS sample
  FROM {orders_ours} WHERE cust IS NULL
UNION ALL SELECT 'check', 'orders', 'price_range', count(*), min(cast(k AS string)) FROM {orders_ours}
  WHERE price < 2000 OR price > 499000
UNION ALL SELECT 'not_null', 'customer', 'c_name', count(*), min(cast(c_custkey AS string)) FROM {customer_raw} WHERE c_name IS NULL
UNION ALL SELECT 'check', 'customer', 'known_balance', count(*), min(cast(c_custkey AS string)) FROM {customer_raw} WHERE c_acctbal = 'n/a'
UNION ALL SELECT 'primary_key', 'lineitem', 'l_orderkey,l_linenumber', count(*), min(v) FROM (
  SELECT cast(l_orderkey AS string) || '|' || cast(l_linenumber AS string) AS v FROM {lineitem}
  GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'unique', 'orders', 'code', count(*), min(code) FROM (SELECT code FROM {orders_ours} GROUP BY code HAVING count(*) > 1)
UNION ALL SELECT 'foreign_key', 'customer', 'c_nationkey->nation', count(*), min(cast(c_nationkey AS string)) FROM {customer_raw}
  WHERE c_nationkey NOT IN (SELECT n_nationkey FROM {nation})
UNION ALL SELECT 'foreign_key', 'lineitem', 'l_orderkey->orders', count(*), min(cast(l_orderkey AS string)) FROM {lineitem}
  WHERE l_orderkey NOT IN (SELECT k FROM {orders_ours})
""",
)
def integrity_report(d):
    tables = {"orders": d["orders_ours"], "customer": d["customer_raw"], "lineitem": d["lineitem"], "nation": d["nation"]}
    keys = {"orders": ["k"], "customer": ["c_custkey"], "lineitem": ["l_orderkey", "l_linenumber"], "nation": ["n_nationkey"]}
    rules = [
        NotNull("orders", "cust"),
        Check("orders", "price_range", "price >= 2000 AND price <= 499000"),
        NotNull("customer", "c_name"),
        Check("customer", "known_balance", "c_acctbal <> 'n/a'"),
        Unique("lineitem", ("l_orderkey", "l_linenumber"), primary=True),
        Unique("orders", ("code",)),
        ForeignKey("customer", ("c_nationkey",), "nation", ("n_nationkey",)),
        ForeignKey("lineitem", ("l_orderkey",), "orders", ("k",)),
    ]
    return integrity.integrity_report(tables, rules, keys)


@query(
    "fk_orphans_merged_orders",
    f"""WITH {rows._JOINED.replace("{orders_ours}", "{orders_pruned}")},
m AS ({rows._merged_sql(False).replace("WITH " + rows._JOINED, "").strip()})
SELECT k, cust FROM m WHERE cust IS NOT NULL AND cust NOT IN (SELECT c_custkey FROM {{customer_pruned}})
  AND NOT EXISTS (SELECT 1 FROM {{orders_pruned}} o WHERE o.k = m.k AND o.cust = m.cust
                  AND o.cust NOT IN (SELECT c_custkey FROM {{customer_pruned}}))
  AND NOT EXISTS (SELECT 1 FROM {{orders_theirs}} t WHERE t.k = m.k AND t.cust = m.cust
                  AND t.cust NOT IN (SELECT c_custkey FROM {{customer}}))""",
)
def fk_orphans_merged_orders(d):
    merged = merge.merge3(d["orders_base"], d["orders_pruned"], d["orders_theirs"], ["k"], rows.COLS).merged
    customers = d["customer"]
    parents = merge.merge3(
        customers, d["customer_pruned"], customers, ["c_custkey"], [c for c in customers.columns if c != "c_custkey"]
    ).merged
    sides = {"ours": (d["orders_pruned"], d["customer_pruned"]), "theirs": (d["orders_theirs"], customers)}
    return integrity.new_orphans((merged, parents), sides, ["cust"], ["c_custkey"], ["k"])


# --- replay -------------------------------------------------------------------

def _live(upto: int | None = None) -> str:
    """Edits up to `upto` that count, and the last of each kind for every key."""
    bound = "" if upto is None else f" WHERE seq <= {upto}"
    return f"""e AS (SELECT k, cast(-1 AS bigint) AS seq, 'insert' AS op, val, kind, 'val,kind' AS assigned FROM {{balances}}
  UNION ALL SELECT k, seq, op, val, kind, CASE WHEN op = 'insert' THEN 'val,kind' ELSE assigned END FROM {{edit_log}}{bound}),
p AS (SELECT *, coalesce(last_value(CASE op WHEN 'insert' THEN 1 WHEN 'delete' THEN 0 END IGNORE NULLS)
    OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS alive FROM e),
w AS (SELECT *, CASE WHEN op = 'insert' AND alive = 1 THEN 'insert_on_existing' WHEN op = 'update' AND alive = 0 THEN 'update_on_missing'
   WHEN op = 'delete' AND alive = 0 THEN 'delete_on_missing' END AS reason FROM p),
v AS (SELECT *, CASE WHEN op <> 'delete' AND assigned LIKE '%val%' THEN seq END AS vs,
   CASE WHEN op <> 'delete' AND assigned LIKE '%kind%' THEN seq END AS ks,
   CASE WHEN op <> 'update' THEN seq END AS ls FROM w WHERE reason IS NULL),
f AS (SELECT k, max(vs) AS vs, max(ks) AS ks, max(ls) AS ls FROM v GROUP BY k)"""


def _state(upto: int | None = None) -> str:
    return f"""WITH {_live(upto)} SELECT f.k, a.val, b.kind FROM f JOIN v a ON a.k = f.k AND a.seq = f.vs
JOIN v b ON b.k = f.k AND b.seq = f.ks JOIN v l ON l.k = f.k AND l.seq = f.ls WHERE l.op = 'insert'"""


#: The edit that `as_of_orders` looks back to; the smallest tables have edits after it.
AS_OF = 500


def _log(d):
    return d["edit_log"].withColumn("assigned", F.split("assigned", ","))


@query("replay_state_orders", _state())
def replay_state_orders(d):
    return replay.replay_rows(d["balances"], _log(d), ["k"], ["val", "kind"])


@query("replay_errors_orders", f"WITH {_live()} SELECT k, seq, op, reason FROM w WHERE reason IS NOT NULL")
def replay_errors_orders(d):
    return replay.replay_errors(d["balances"], _log(d), ["k"], ["val", "kind"])


@query("as_of_orders", _state(AS_OF))
def as_of_orders(d):
    return replay.as_of(d["balances"], _log(d), ["k"], ["val", "kind"], AS_OF)


@query(
    "validity_intervals_orders",
    f"""WITH {_live()}, t AS (SELECT k, seq, op, lead(seq) OVER (PARTITION BY k ORDER BY seq) AS to_seq,
  last_value(vs IGNORE NULLS) OVER (PARTITION BY k ORDER BY seq ROWS UNBOUNDED PRECEDING) AS vs,
  last_value(ks IGNORE NULLS) OVER (PARTITION BY k ORDER BY seq ROWS UNBOUNDED PRECEDING) AS ks FROM v)
SELECT t.k, CASE WHEN t.seq >= 0 THEN t.seq END AS from_seq, t.to_seq, a.val, b.kind FROM t
JOIN v a ON a.k = t.k AND a.seq = t.vs JOIN v b ON b.k = t.k AND b.seq = t.ks WHERE t.op <> 'delete'""",
)
def validity_intervals_orders(d):
    return replay.validity_intervals(d["balances"], _log(d), ["k"], ["val", "kind"])


# --- evolution ----------------------------------------------------------------

_IDS = {"k": 1, "cust": 2, "status": 3, "prio": 4, "price": 5, "code": 6}


@query(
    "hazards_orders",
    """
SELECT 'set_not_null' AS code, 'cust' AS column, count(*) FILTER (cust IS NULL) AS rows FROM {orders_ours}
UNION ALL SELECT 'retype_needs_using', 'prio', count(*) FILTER (length(prio) > 8) FROM {orders_ours}
UNION ALL SELECT 'retype_needs_using', 'price', count(*) FILTER (price > 99999.99) FROM {orders_ours}
UNION ALL SELECT 'retype_needs_using', 'code', count(*) FILTER (try_cast(code AS bigint) IS NULL) FROM {orders_ours}
UNION ALL SELECT 'add_not_null_no_default', 'region', count(*) FROM {orders_ours}
""",
)
def hazards_orders(d):
    to = T.StructType(
        [
            evolve.field(1, "k", T.LongType()),
            evolve.field(2, "cust", T.LongType(), False),
            evolve.field(3, "state", T.StringType()),
            evolve.field(4, "prio", T.StringType(), max_length=8),
            evolve.field(5, "price", T.DecimalType(7, 2)),
            evolve.field(6, "code", T.LongType()),
            evolve.field(7, "region", T.StringType(), False),
        ]
    )
    return evolve.hazards(evolve.identify(d["orders_ours"], _IDS), to)


_TARGET = T.StructType(
    [
        evolve.field(2, "cust", T.StringType(), False),
        evolve.field(1, "k", T.LongType()),
        evolve.field(4, "status", T.StringType(), max_length=10),
        evolve.field(3, "prio", T.StringType()),
        evolve.field(5, "price", T.DecimalType(7, 2)),
        evolve.field(8, "source", T.StringType(), False, default="'import'"),
    ]
)
_FITS = "cust IS NOT NULL AND length(prio) <= 10 AND price <= 99999.99"


@query(
    "evolve_orders",
    f"""SELECT cast(cust AS string) AS cust, k, prio AS status, status AS prio, cast(price AS decimal(7,2)) AS price,
'import' AS source FROM {{orders_ours}} WHERE {_FITS}""",
)
def evolve_orders(d):
    return evolve.evolve(evolve.identify(d["orders_ours"], _IDS), _TARGET)[0]


@query(
    "evolve_rejects_orders",
    """SELECT k, concat_ws('; ', CASE WHEN cust IS NULL THEN 'set_not_null:cust' END,
  CASE WHEN length(prio) > 10 THEN 'retype_needs_using:status' END,
  CASE WHEN price > 99999.99 THEN 'retype_needs_using:price' END) AS reasons
FROM {orders_ours} WHERE NOT (cust IS NOT NULL AND length(prio) <= 10 AND price <= 99999.99)""",
)
def evolve_rejects_orders(d):
    return evolve.evolve(evolve.identify(d["orders_ours"], _IDS), _TARGET)[1].select("k", "reasons")


@query(
    "evolve_columns_orders",
    """SELECT k, coalesce(cust, 0) AS customer, price, cast(substr(code, 2) AS bigint) AS number, 'new' AS source
FROM {orders_base}""",
)
def evolve_columns_orders(d):
    df = d["orders_base"].withColumn("code", F.expr("substr(code, 2)"))
    return evolve.evolve_columns(
        df,
        [
            {"op": "rename_column", "column": "cust", "name": "customer"},
            {"op": "set_default", "column": "customer", "default": "0"},
            {"op": "set_nullable", "column": "customer", "nullable": False},
            {"op": "drop_column", "column": "status"},
            {"op": "drop_column", "column": "prio"},
            {"op": "rename_column", "column": "code", "name": "number"},
            {"op": "retype_column", "column": "number", "type": T.LongType()},
            {"op": "add_column", "name": "source", "type": T.StringType(), "default": "'new'"},
        ],
    )


# --- loading ------------------------------------------------------------------


def _ingest(d):
    wanted = [
        ingest.Column("c_custkey", "bigint", False),
        ingest.Column("c_name", "varchar(40)", False),
        ingest.Column("c_acctbal", "numeric(12,2)"),
        ingest.Column("c_nationkey", "integer"),
    ]
    return ingest.ingest(
        d["customer_raw"], ["c_custkey"], wanted, [ingest.Reference("c_nationkey", d["nation"], "n_nationkey")]
    )


_FAULTS = """SELECT cast(c_custkey AS string) AS row_key, 'missing_value' AS construct, 'c_name' AS object, '' AS detail
  FROM {customer_raw} WHERE c_name IS NULL
UNION ALL SELECT cast(c_custkey AS string), 'bad_cast', 'c_acctbal', c_acctbal FROM {customer_raw} WHERE c_acctbal = 'n/a'
UNION ALL SELECT cast(c_custkey AS string), 'unknown_reference', 'c_nationkey', cast(c_nationkey AS string) FROM {customer_raw}
  WHERE c_nationkey NOT IN (SELECT n_nationkey FROM {nation})
UNION ALL SELECT NULL, 'unmapped_column', 'c_mktsegment', 'string (not imported)'"""


@query("ingest_quarantine_customer", _FAULTS)
def ingest_quarantine_customer(d):
    return _ingest(d)[1]


@query(
    "ingest_accepted_customer",
    f"""WITH q AS ({_FAULTS}) SELECT c_custkey, c_name, cast(c_acctbal AS decimal(12,2)) AS c_acctbal, c_nationkey
FROM {{customer_raw}} WHERE cast(c_custkey AS string) NOT IN (SELECT row_key FROM q WHERE row_key IS NOT NULL)""",
)
def ingest_accepted_customer(d):
    return _ingest(d)[0]


@query(
    "coverage_customer",
    f"WITH q AS ({_FAULTS}) SELECT construct, object, count(*) AS n FROM q GROUP BY construct, object",
)
def coverage_customer(d):
    return ingest.coverage(_ingest(d)[1])


# --- re-keying and deletes ----------------------------------------------------


@query(
    "rekey_proposals_customer",
    """WITH o AS (SELECT * FROM {customer_old} WHERE key NOT IN (SELECT key FROM {customer_new})),
n AS (SELECT * FROM {customer_new} WHERE key NOT IN (SELECT key FROM {customer_old})),
s AS (SELECT o.key AS old_key, n.key AS new_key, (CASE WHEN o.name = n.name THEN 50 ELSE 0 END
   + CASE WHEN o.segment = n.segment THEN 20 ELSE 0 END + CASE WHEN o.balance = n.balance THEN 30 ELSE 0 END) AS score
  FROM o JOIN n ON o.nation = n.nation),
r AS (SELECT *, row_number() OVER (PARTITION BY old_key ORDER BY score DESC, new_key) AS rn FROM s WHERE score >= 20)
SELECT old_key, new_key, score, count(*) OVER (PARTITION BY new_key) > 1 AS contested FROM r WHERE rn = 1""",
)
def rekey_proposals_customer(d):
    old, new = d["customer_old"], d["customer_new"]
    dropped = old.join(new.select("key"), "key", "left_anti")
    added = new.join(old.select("key"), "key", "left_anti")
    return rekey.rekey_proposals(dropped, added, "key", ["nation"], {"name": 50, "segment": 20, "balance": 30}, 20)


@query(
    "cascade_deletes",
    """WITH r AS (SELECT r_regionkey AS x FROM {region} WHERE r_regionkey = 1),
n AS (SELECT n_nationkey AS x FROM {nation} WHERE n_regionkey IN (SELECT x FROM r)),
c AS (SELECT c_custkey AS x FROM {customer} WHERE c_nationkey IN (SELECT x FROM n))
SELECT 'nation' AS table, cast(x AS string) AS key, 'delete' AS effect, 'region' AS via, 'n_regionkey' AS columns, 1 AS depth FROM n
UNION ALL SELECT 'customer', cast(x AS string), 'delete', 'nation', 'c_nationkey', 2 FROM c
UNION ALL SELECT 'supplier', cast(s_suppkey AS string), 'set_null', 'nation', 's_nationkey', 2 FROM {supplier} WHERE s_nationkey IN (SELECT x FROM n)
UNION ALL SELECT 'orders', cast(o_orderkey AS string), 'delete', 'customer', 'o_custkey', 3 FROM {orders} WHERE o_custkey IN (SELECT x FROM c)
UNION ALL SELECT 'events', cast(event_id AS string), 'blocked', 'customer', 'user_id', 3 FROM {events} WHERE user_id IN (SELECT x FROM c)""",
)
def cascade_deletes(d):
    names = ["region", "nation", "customer", "supplier", "orders", "events"]
    keys = dict(zip(names, [["r_regionkey"], ["n_nationkey"], ["c_custkey"], ["s_suppkey"], ["o_orderkey"], ["event_id"]]))
    fks = [
        ForeignKey("nation", ("n_regionkey",), "region", ("r_regionkey",), "cascade"),
        ForeignKey("customer", ("c_nationkey",), "nation", ("n_nationkey",), "cascade"),
        ForeignKey("supplier", ("s_nationkey",), "nation", ("n_nationkey",), "set_null"),
        ForeignKey("orders", ("o_custkey",), "customer", ("c_custkey",), "cascade"),
        ForeignKey("events", ("user_id",), "customer", ("c_custkey",), "restrict"),
    ]
    gone = d["region"].where("r_regionkey = 1").select("r_regionkey")
    return referential.referential_effects({n: d[n] for n in names}, keys, fks, {"region": gone})


# All five actions, two references to one parent, and a table that refers to itself.
@query(
    "referential_actions",
    """WITH RECURSIVE g AS (SELECT k, 0 AS depth FROM {staff} WHERE k <= 3
  UNION ALL SELECT s.k, g.depth + 1 FROM {staff} s JOIN g ON s.boss = g.k WHERE s.k > 3),
o AS (SELECT k FROM {dealt_orders} WHERE nat = 3)
SELECT 'staff' AS table, cast(k AS string) AS key, 'delete' AS effect, 'staff' AS via, 'boss' AS columns, depth FROM g WHERE depth > 0
UNION ALL SELECT 'staff', cast(k AS string), 'set_null', 'nation', 'nat', 1 FROM {staff} WHERE nat = 3 AND k NOT IN (SELECT k FROM g WHERE depth > 0)
UNION ALL SELECT 'staff', cast(k AS string), 'set_null', 'nation', 'home', 1 FROM {staff} WHERE home = 3 AND k NOT IN (SELECT k FROM g WHERE depth > 0)
UNION ALL SELECT 'supplier', cast(s_suppkey AS string), 'set_default', 'nation', 's_nationkey', 1 FROM {supplier} WHERE s_nationkey = 3
UNION ALL SELECT 'dealt_orders', cast(k AS string), 'delete', 'nation', 'nat', 1 FROM o
UNION ALL SELECT 'dealt_orders', cast(d.k AS string), 'blocked', 'staff', 'cust', g.depth + 1 FROM {dealt_orders} d JOIN g ON d.cust = g.k
  WHERE d.k NOT IN (SELECT k FROM o)
UNION ALL SELECT 'events', cast(event_id AS string), 'blocked', 'staff', 'user_id', g.depth + 1 FROM {events} e JOIN g ON e.user_id = g.k""",
)
def referential_actions(d):
    names = ["nation", "staff", "supplier", "dealt_orders", "events"]
    keys = dict(zip(names, [["n_nationkey"], ["k"], ["s_suppkey"], ["k"], ["event_id"]]))
    fks = [
        ForeignKey("staff", ("boss",), "staff", ("k",), "cascade"),
        ForeignKey("staff", ("nat",), "nation", ("n_nationkey",), "set_null"),
        ForeignKey("staff", ("home",), "nation", ("n_nationkey",), "set_null"),
        ForeignKey("supplier", ("s_nationkey",), "nation", ("n_nationkey",), "set_default"),
        ForeignKey("dealt_orders", ("nat",), "nation", ("n_nationkey",), "cascade"),
        ForeignKey("dealt_orders", ("cust",), "staff", ("k",), "no_action"),
        ForeignKey("events", ("user_id",), "staff", ("k",), "restrict"),
    ]
    gone = {"nation": d["nation"].where("n_nationkey = 3"), "staff": d["staff"].where("k <= 3")}
    return referential.referential_effects({n: d[n] for n in names}, keys, fks, gone)


# --- composite keys -----------------------------------------------------------


@query(
    "add_add_conversations",
    """WITH o AS (SELECT conv_id, turn, role, text FROM {conversations}),
t AS (SELECT conv_id, turn, CASE WHEN role = 'user' AND turn % 3 = 0 THEN 'system' ELSE role END AS role, text FROM {conversations})
SELECT o.conv_id, o.turn, 'row_addition:' || cast(o.conv_id AS string) || ':' || cast(o.turn AS string) AS conflict_id,
  o.role || '|' || o.text AS ours_value, t.role || '|' || t.text AS theirs_value
FROM o JOIN t ON o.conv_id = t.conv_id AND o.turn = t.turn
WHERE (o.role <> t.role OR o.text <> t.text)""",
)
def add_add_conversations(d):
    ours = d["conversations"]
    theirs = ours.withColumn("role", F.expr("CASE WHEN role = 'user' AND turn % 3 = 0 THEN 'system' ELSE role END"))
    nothing = ours.limit(0)
    found = merge.merge3(nothing, ours, theirs, ["conv_id", "turn"], ["role", "text"]).conflicts
    return found.where("class = 'add_add'").select("conv_id", "turn", "conflict_id", "ours_value", "theirs_value")


@query(
    "fingerprint_orders",
    """WITH b AS (SELECT cust, count(*) AS n FROM {orders_base} GROUP BY cust),
o AS (SELECT cust, count(*) AS n FROM {orders_ours} WHERE cust IS NOT NULL GROUP BY cust),
x AS (SELECT DISTINCT cust FROM (
  (SELECT * FROM {orders_base} EXCEPT SELECT * FROM {orders_ours}) UNION ALL (SELECT * FROM {orders_ours} EXCEPT SELECT * FROM {orders_base})))
SELECT b.cust, b.n AS n_base, o.n AS n_ours, b.cust NOT IN (SELECT cust FROM x WHERE cust IS NOT NULL) AS same
FROM b JOIN o ON b.cust = o.cust""",
)
def fingerprint_orders(d):
    cols = ["k", *rows.COLS]
    a = cells.fingerprint(d["orders_base"], cols, ["cust"]).select("cust", F.struct("hash_a", "hash_b", "n_rows").alias("a"))
    b = cells.fingerprint(d["orders_ours"], cols, ["cust"]).select("cust", F.struct("hash_a", "hash_b", "n_rows").alias("b"))
    return a.join(b, "cust").select(
        "cust", F.col("a.n_rows").alias("n_base"), F.col("b.n_rows").alias("n_ours"), (F.col("a") == F.col("b")).alias("same")
    )


# --- versions in storage ------------------------------------------------------


@query(
    "versions_orders",
    """SELECT 'base' AS commit_id, k, status, cast(price AS string) AS price FROM {orders_base}
UNION ALL SELECT 'theirs', k, status, cast(price AS string) FROM {orders_theirs}""",
)
def versions_orders(d):
    """Three versions written once each; two of them read back together."""
    path = f"{shared_dir(d.spark).rstrip('/')}/versions-{uuid.uuid4().hex}"
    for side in ("base", "ours", "theirs"):
        versions.write_version(d[f"orders_{side}"], path, side)
    wanted = d.spark.createDataFrame([("base",), ("theirs",)], "commit_id string")
    return versions.load_versions(d.spark, path, wanted).select("commit_id", "k", "status", F.col("price").cast("string").alias("price"))


_ORDER = ["cust", "status", "prio", "price", "code"]
_LINES = (("base", None), ("ours", "base"), ("theirs", "base"), ("after", "theirs"))


def _deltas(d):
    """base, two versions after it, and one that goes back from theirs to ours."""
    store = DeltaVersions(d.spark, f"{shared_dir(d.spark).rstrip('/')}/deltas-{uuid.uuid4().hex}", ["k"], _ORDER)
    for version, parent in _LINES:
        store.write(version, d["orders_ours" if version == "after" else f"orders_{version}"], parent)
    return store


@query(
    "delta_versions_orders",
    """SELECT 'ours' AS version, k, cust, status, prio, cast(price AS string) AS price, code FROM {orders_ours}
UNION ALL SELECT 'theirs', k, cust, status, prio, cast(price AS string), code FROM {orders_theirs}
UNION ALL SELECT 'after', k, cust, status, prio, cast(price AS string), code FROM {orders_ours}""",
)
def delta_versions_orders(d):
    """Versions kept as changes read back whole, one of them two changes after the full copy."""
    store = _deltas(d)
    read = lambda v: store.load(v).select(F.lit(v).alias("version"), "k", "cust", "status", "prio", F.col("price").cast("string").alias("price"), "code")
    return read("ours").unionByName(read("theirs")).unionByName(read("after"))


@query(
    "delta_changes_orders",
    """WITH m AS (SELECT coalesce(n.k, w.k) AS k, n.k IS NULL AS gone, w.k IS NULL AS added, n.cust, n.status, n.prio, cast(n.price AS string) AS price, n.code,
  (n.cust IS NOT DISTINCT FROM w.cust AND n.status IS NOT DISTINCT FROM w.status AND n.prio IS NOT DISTINCT FROM w.prio
   AND n.price IS NOT DISTINCT FROM w.price AND n.code IS NOT DISTINCT FROM w.code) AS alike
  FROM {orders_ours} n FULL JOIN {orders_theirs} w ON n.k = w.k)
SELECT k, gone, cust, status, prio, price, code FROM m WHERE gone OR added OR NOT alike""",
)
def delta_changes_orders(d):
    """What the version after theirs keeps: the rows that differ, and the keys that went."""
    return _deltas(d).changes("after").select("k", F.col("_gone").alias("gone"), "cust", "status", "prio", F.col("price").cast("string").alias("price"), "code")


@query(
    "merged_coverage_customer",
    f"""WITH q AS ({_FAULTS}), t AS (SELECT row_key, construct, object, detail FROM q UNION SELECT cast(c_custkey AS string), 'too_long', 'c_mktsegment', c_mktsegment
  FROM {{customer_raw}} WHERE length(c_mktsegment) > 9 UNION SELECT NULL, 'unmapped_column', x, y FROM (VALUES ('c_name', 'string (not imported)'),
  ('c_acctbal', 'string (not imported)')) v(x, y) UNION SELECT NULL, 'unmapped_column', 'c_nationkey', 'int (not imported)')
SELECT construct, object, count(*) AS n FROM t GROUP BY construct, object""",
)
def merged_coverage_customer(d):
    """What two loads of one table left out stays known through their merge."""
    wanted = [ingest.Column("c_custkey", "bigint", False), ingest.Column("c_mktsegment", "varchar(9)")]
    other = ingest.ingest(d["customer_raw"], ["c_custkey"], wanted)[1]
    return ingest.coverage(ingest.carried_quarantine({"ours": _ingest(d)[1], "theirs": other}))
