"""Commit graph operators on random graphs against a plain walk."""

from __future__ import annotations

import random
from collections import deque

from palimpsest.operators import history
from palimpsest.plans.migration import order_renames


def random_graphs(rng, projects=40):
    rows, parents = [], {}
    for p in range(projects):
        ids = []
        for i in range(rng.randint(2, 14)):
            c = p * 100 + i
            first = rng.choice(ids[-4:]) if ids and rng.random() < 0.93 else None
            second = rng.choice(ids) if ids and first is not None and rng.random() < 0.35 else None
            rows.append((p, c, first, second))
            parents[c] = [x for x in (first, second) if x is not None]
            ids.append(c)
    return rows, parents


def walk(parents, start):
    seen, queue = [], deque([start])
    while queue:
        c = queue.popleft()
        if c not in seen:
            seen.append(c)
            queue.extend(parents[c])
    return seen


def test_graph_questions(spark):
    rng = random.Random(11)
    rows, parents = random_graphs(rng)
    commits = spark.createDataFrame(rows, "project_id long, commit_id long, parent_id long, parent2_id long")
    g = history.graph(commits)
    starts = rng.sample(sorted(parents), 60)
    got = {}
    for r in history.ancestors(g, spark.createDataFrame([(s,) for s in starts], "start long")).collect():
        got.setdefault(r.start, set()).add(r.commit_id)
    assert got == {s: set(walk(parents, s)) for s in starts}

    by_project = {}
    for p, c, _, _ in rows:
        by_project.setdefault(p, []).append(c)
    pairs = sorted({(rng.choice(ids), rng.choice(ids)) for ids in by_project.values() for _ in range(8)})
    df = spark.createDataFrame(pairs, "a long, b long")
    found = {(r.a, r.b): r.base for r in history.merge_base(g, df).collect()}
    split = {(r.a, r.b): (r.a_only, r.b_only) for r in history.divergence(g, df).collect()}
    for a, b in pairs:
        of_a = set(walk(parents, a))
        line = walk(parents, b)
        assert found[a, b] == next((c for c in line if c in of_a), None)
        assert split[a, b] == (len(of_a - set(line)), len(set(line) - of_a))

    first = {c: f for _, c, f, _ in rows}
    history_rows = {}
    for r in history.first_parent_history(g, spark.createDataFrame([(s,) for s in starts], "start long"), 4).collect():
        history_rows.setdefault(r.start, {})[r.depth] = r.commit_id
    for s in starts:
        want, c = {}, s
        while c is not None and len(want) < 4:
            want[len(want)] = c
            c = first[c]
        assert history_rows[s] == want


def test_head_moves_equal_serial_order(spark):
    rng = random.Random(4)
    proposals, status = [], {}
    for b in range(20):
        head, seen = f"h{b}", [f"h{b}"]
        for s in range(30):
            c = f"c{b}.{s}"
            expected = rng.choice(seen[-3:]) if rng.random() < 0.8 else head
            proposals.append((b, s, c, expected))
            status[b, s] = "accepted" if expected == head else "stale"
            head = c if expected == head else head
            seen.append(c)
    df = spark.createDataFrame(proposals, "branch_id long, seq long, commit_id string, expected_head string")
    heads = spark.createDataFrame([(b, f"h{b}") for b in range(20)], "branch_id long, head_commit_id string")
    assert {(r.branch_id, r.seq): r.status for r in history.head_moves(heads, df).collect()} == status


def test_renames_never_land_on_a_held_name(spark):
    tables = {
        1: {1: ("a", "b"), 2: ("b", "a")},
        2: {1: ("a", "b"), 2: ("b", "c"), 3: ("c", "d")},
        3: {1: ("a", "c"), 2: ("b", "a"), 3: ("c", "b"), 4: ("x", "y")},
        4: {1: ("a", "b"), 2: ("b", "b")},
    }
    renames = [(t, i, a, b) for t, m in tables.items() for i, (a, b) in m.items() if a != b]
    held = [(t, i, a) for t, m in tables.items() for i, (a, _) in m.items()]
    found = order_renames(
        spark.createDataFrame(renames, "table_id long, column_id long, current string, target string"),
        spark.createDataFrame(held, "table_id long, column_id long, name string"),
        ["table_id"],
        "column_id",
    ).collect()
    for t, m in tables.items():
        steps = sorted((r.rename_order, r.column_id, r.from_name, r.to_name) for r in found if r.table_id == t)
        if t == 4:
            assert [r.warning_code for r in found if r.table_id == t] == ["name_taken"]
            continue
        names = {i: a for i, (a, _) in m.items()}
        for _, i, a, b in steps:
            assert names[i] == a and b not in names.values()
            names[i] = b
        assert names == {i: b for i, (_, b) in m.items()}
    assert len([r for r in found if r.table_id == 1]) == 3
