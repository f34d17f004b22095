"""Versions, fleets and logs derived from the given tables.

Every view is one SQL text accepted by Spark and DuckDB, so that a query and its
oracle start from the same rows. The modulo terms make *edits* (drops, changes,
breaks) on a version; every view reads the whole of its table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.spread import running_last
from palimpsest.session import cut, read_table

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

VIEWS: dict[str, str] = {}
# Views built in another way on Spark, where a user may hold a third of all
# events: no window over a whole user, no join without an equality. The oracle
# reads the SQL.
SPREAD: dict[str, Callable[["Data"], DataFrame]] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def _inputs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


class Data:
    """Tables and views of one folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._seen = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._seen:
            if name in SPREAD:
                self._seen[name] = SPREAD[name](self)
            elif name in VIEWS:
                sql = VIEWS[name]
                self._seen[name] = self.spark.sql(sql, **{i: self[i] for i in _inputs(sql)})
            else:
                self._seen[name] = read_table(self.spark, f"{self.dir}/{name}.parquet")
        return self._seen[name]


def oracle(sql: str) -> str:
    """Prefix `sql` with the views it needs, in dependency order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in _inputs(text):
            if name in VIEWS and name not in ordered:
                visit(VIEWS[name])
                ordered.append(name)

    visit(sql)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text).strip()
    body = plain(sql)
    if not ordered:
        return body
    views = ",\n".join(f"{n} AS (\n{plain(VIEWS[n])}\n)" for n in ordered)
    recursive = ""
    if body.upper().startswith("WITH RECURSIVE"):
        recursive, body = "RECURSIVE ", body[len("WITH RECURSIVE") :].lstrip()
        return f"WITH {recursive}{views},\n{body}"
    if body.upper().startswith("WITH"):
        return f"WITH {views},\n{body[4:].lstrip()}"
    return f"WITH {views}\n{body}"


# --- three versions of orders -------------------------------------------------

view(
    "orders_base",
    """
SELECT o_orderkey AS k, o_custkey AS cust, o_orderstatus AS status, o_orderpriority AS prio,
       cast(o_totalprice AS decimal(12,2)) AS price, 'C' || cast(o_orderkey AS string) AS code
FROM {orders}
""",
)
view(
    "orders_ours",
    """
SELECT k, CASE WHEN k % 101 = 0 THEN NULL ELSE cust END AS cust,
       CASE WHEN k % 10 = 0 THEN 'X' ELSE status END AS status,
       CASE WHEN k % 7 = 0 THEN '1-URGENT' ELSE prio END AS prio, price, code
FROM {orders_base} WHERE k % 17 <> 0
UNION ALL
SELECT k + 10000000, cust, status, prio, price, 'N' || cast(k AS string) FROM {orders_base} WHERE k % 50 = 0
""",
)
view(
    "orders_theirs",
    """
SELECT k, CASE WHEN k % 103 = 0 THEN 1499 ELSE cust END AS cust,
       CASE WHEN k % 20 = 0 THEN 'X' WHEN k % 15 = 0 THEN 'Y' ELSE status END AS status,
       CASE WHEN k % 11 = 0 THEN '5-LOW' ELSE prio END AS prio, price, code
FROM {orders_base} WHERE k % 19 <> 0
UNION ALL
SELECT k + 20000000, cust, status, prio, price, 'N' || cast(k AS string) FROM {orders_base} WHERE k % 60 = 0
""",
)
# One answer per conflicted cell or row, by the key; every ninth is custom where
# that is accepted, and some answers are wrong, repeated or refer to nothing.
view(
    "orders_answers",
    """
SELECT 'cell:status:' || cast(k AS string) AS conflict_id,
       CASE WHEN k % 9 = 0 THEN 'ours' WHEN k % 9 < 6 THEN 'theirs' ELSE 'custom' END AS choice,
       CASE WHEN k % 9 >= 6 THEN 'Z' END AS custom, 1 AS seq
FROM {orders_base} WHERE k % 10 = 0 AND k % 15 = 0
UNION ALL
SELECT 'cell:prio:' || cast(k AS string), CASE WHEN k % 2 = 0 THEN 'theirs' ELSE 'custom' END,
       CASE WHEN k % 2 = 1 AND k % 3 <> 0 THEN 'NEW' WHEN k % 2 = 1 THEN ' ' END, 1
FROM {orders_base} WHERE k % 77 = 0
UNION ALL
SELECT 'row_existence:' || cast(k AS string),
       CASE WHEN k % 4 = 0 THEN 'ours' WHEN k % 4 = 1 THEN 'theirs' WHEN k % 4 = 2 THEN 'custom' ELSE 'both' END,
       CASE WHEN k % 4 = 2 THEN 'x' END, 1
FROM {orders_base} WHERE k % 17 = 0 OR k % 19 = 0
UNION ALL
SELECT 'cell:cust:' || cast(k AS string), 'custom', 'not a number', 1 FROM {orders_base} WHERE k % 10403 = 0
UNION ALL
SELECT 'cell:status:' || cast(k AS string), 'theirs', NULL, 2 FROM {orders_base} WHERE k % 270 = 0
""",
)

# Our side removes every 29th customer together with its orders, their side adds
# orders: each is sound alone, together some new orders have no customer.
view("orders_pruned", "SELECT * FROM {orders_ours} WHERE cust IS NULL OR cust % 29 <> 0")
view("customer_pruned", "SELECT * FROM {customer} WHERE c_custkey % 29 <> 0")

# --- an edit log on customers -------------------------------------------------

view(
    "balances",
    """
SELECT c_custkey AS k, cast(c_acctbal AS decimal(12,2)) AS val, c_mktsegment AS kind
FROM {customer}
""",
)
view(
    "staff",
    """
SELECT c_custkey AS k, c_nationkey AS nat, (c_nationkey + 3) % 25 AS home,
       CASE WHEN c_custkey >= 10 THEN cast(floor(c_custkey / 10) AS bigint) END AS boss
FROM {customer}
""",
)
view("dealt_orders", "SELECT o_orderkey AS k, o_custkey AS cust, o_orderkey % 25 AS nat FROM {orders}")
view(
    "edit_log",
    """
SELECT user_id AS k, event_id AS seq,
       CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op,
       cast(value AS decimal(12,2)) AS val, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS kind,
       CASE event_type WHEN 'view' THEN 'val' WHEN 'click' THEN 'kind' ELSE 'val,kind' END AS assigned
FROM {events}
""",
)

# --- bad input ----------------------------------------------------------------

view(
    "customer_raw",
    """
SELECT c_custkey, CASE WHEN c_custkey % 43 = 0 THEN NULL ELSE c_name END AS c_name,
       CASE WHEN c_custkey % 37 = 0 THEN 'n/a' ELSE cast(cast(c_acctbal AS decimal(12,2)) AS string) END AS c_acctbal,
       CASE WHEN c_custkey % 41 = 0 THEN 99 ELSE c_nationkey END AS c_nationkey, c_mktsegment
FROM {customer}
""",
)

# --- re-keyed rows ------------------------------------------------------------

view(
    "customer_new",
    """
SELECT CASE WHEN c_custkey % 13 = 0 THEN c_custkey + 100000000 ELSE c_custkey END AS key,
       CASE WHEN c_custkey % 39 = 0 THEN c_name || ' II' ELSE c_name END AS name, c_nationkey AS nation,
       CASE WHEN c_custkey % 26 = 0 THEN 'MOVED' ELSE c_mktsegment END AS segment,
       CASE WHEN c_custkey % 65 = 0 THEN NULL ELSE cast(cast(c_acctbal AS decimal(12,2)) AS string) END AS balance
FROM {customer}
""",
)
view(
    "customer_old",
    """
SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment,
       cast(cast(c_acctbal AS decimal(12,2)) AS string) AS balance
FROM {customer}
""",
)

# --- commit graphs ------------------------------------------------------------
# Event ids follow time, so the latest earlier commit is the greatest earlier id.

view(
    "commits",
    """
SELECT user_id AS project_id, event_id AS commit_id, ts, event_type,
       CASE WHEN event_type IN ('error', 'signup') THEN 'feature' ELSE 'main' END AS branch,
       coalesce(
         max(event_id) OVER (PARTITION BY user_id, event_type IN ('error', 'signup') ORDER BY event_id
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         CASE WHEN event_type IN ('error', 'signup') THEN
           max(CASE WHEN event_type NOT IN ('error', 'signup') THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END) AS parent_id,
       CASE WHEN event_type = 'purchase' THEN
         max(CASE WHEN event_type IN ('error', 'signup') THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent2_id
FROM {events}
""",
)
view(
    "branches",
    """
SELECT project_id, branch AS name, project_id * 2 + CASE WHEN branch = 'main' THEN 0 ELSE 1 END AS branch_id,
       max(commit_id) AS head_commit_id
FROM {commits} GROUP BY project_id, branch
""",
)
# Both heads of a project against each other, and its last merge commit against
# its first.
view(
    "commit_pairs",
    """
SELECT m.head_commit_id AS a, f.head_commit_id AS b FROM {branches} m JOIN {branches} f
  ON m.project_id = f.project_id WHERE m.name = 'main' AND f.name = 'feature'
UNION ALL
SELECT f.head_commit_id, m.head_commit_id FROM {branches} m JOIN {branches} f
  ON m.project_id = f.project_id WHERE m.name = 'main' AND f.name = 'feature'
UNION ALL
SELECT max(commit_id), min(commit_id) FROM {commits} WHERE parent2_id IS NOT NULL GROUP BY project_id
""",
)
# A proposal mostly expects the commit before it, sometimes one further back.
view(
    "head_proposals",
    """
SELECT user_id AS branch_id, event_id AS seq, event_id AS commit_id,
       CASE WHEN event_id % 5 = 0 THEN lag(event_id, 2) OVER (PARTITION BY user_id ORDER BY event_id)
            ELSE lag(event_id, 1) OVER (PARTITION BY user_id ORDER BY event_id) END AS expected_head
FROM {events}
""",
)
view("branch_starts", "SELECT user_id AS branch_id, min(event_id) AS head_commit_id FROM {events} GROUP BY user_id")
# Tables of each commit's snapshot: one to five per commit.
view(
    "commit_tables",
    """
SELECT c.commit_id, r.r_regionkey AS table_id, r.r_name AS name FROM {commits} c JOIN {region} r
  ON r.r_regionkey <= c.commit_id % 5
""",
)


def _commits(d: Data) -> DataFrame:
    feature = F.col("event_type").isin("error", "signup")
    last = {"last_main": F.when(~feature, F.col("event_id")), "last_feature": F.when(feature, F.col("event_id"))}
    seen = running_last(d["events"].select("event_id", "ts", "user_id", "event_type"), ["user_id"], "event_id", last, inclusive=False)
    parent = F.when(feature, F.coalesce("last_feature", "last_main")).otherwise(F.col("last_main"))
    return seen.select(
        F.col("user_id").alias("project_id"),
        F.col("event_id").alias("commit_id"),
        "ts",
        "event_type",
        F.when(feature, "feature").otherwise("main").alias("branch"),
        parent.alias("parent_id"),
        F.when(F.col("event_type") == "purchase", F.col("last_feature")).alias("parent2_id"),
    )


def _head_proposals(d: Data) -> DataFrame:
    one = running_last(d["events"].select("event_id", "user_id"), ["user_id"], "event_id", {"p1": F.col("event_id")}, inclusive=False)
    two = running_last(one, ["user_id"], "event_id", {"p2": F.col("p1")}, inclusive=False)
    return two.select(
        F.col("user_id").alias("branch_id"),
        F.col("event_id").alias("seq"),
        F.col("event_id").alias("commit_id"),
        F.when(F.col("event_id") % 5 == 0, F.col("p2")).otherwise(F.col("p1")).alias("expected_head"),
    )


# Stored once: the views and operators read it many times.
SPREAD["commits"] = lambda d: cut(_commits(d))
SPREAD["head_proposals"] = _head_proposals


def _commit_tables(d: Data) -> DataFrame:
    numbered = d["commits"].select("commit_id", F.explode(F.sequence(F.lit(0), F.col("commit_id") % 5)).alias("r_regionkey"))
    named = numbered.join(d["region"], "r_regionkey")
    return named.select("commit_id", F.col("r_regionkey").alias("table_id"), F.col("r_name").alias("name"))


SPREAD["commit_tables"] = _commit_tables
