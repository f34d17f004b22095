"""Objects served by class, against serving them one after another."""

from __future__ import annotations

import random

import pytest
from palimpsest.operators import classes as op
from palimpsest.operators import match
from tests.small import catalog, col


def serial(old, new, edges, answers):
    """old: (id, order, a); new: (id, order, b)."""
    taken, offered, claimed = {}, {}, set()
    for oid, _, a in sorted(old, key=lambda o: (o[1], o[0])):
        best = None
        for nid, order, b in sorted(new, key=lambda n: (n[1], n[0])):
            score = edges.get((a, b))
            if score is not None and nid not in claimed and (best is None or score > best[0]):
                best = (score, nid)
        answer = answers.get(oid)
        if best is None or answer is False:
            continue
        if answer:
            claimed.add(best[1])
            taken[oid] = best
        else:
            offered[oid] = best
    return taken, offered


def tables(spark, cases):
    old, new, edges, answers = [], [], [], []
    for p, (o, n, e, a) in cases.items():
        old += [(p, i, f"o{i}", order, c) for i, order, c in o]
        new += [(p, i, f"n{i}", order, c) for i, order, c in n]
        edges += [(p, x, y, s) for (x, y), s in e.items()]
        answers += [(p, i, r) for i, r in a.items()]
    made = op.Classes(
        spark.createDataFrame(old, "project_id long, old_id long, old_name string, old_order int, a string"),
        spark.createDataFrame(new, "project_id long, new_id long, new_name string, new_order int, b string"),
        spark.createDataFrame(edges, "project_id long, a string, b string, score double"),
    )
    return made, spark.createDataFrame(answers, "project_id long, old_id long, rename boolean")


def served(df):
    return {(r.project_id, r.old_id): (r.score, r.new_id) for r in df.collect()}


def case(seed):
    draw = random.Random(seed)
    kinds = [f"k{i}" for i in range(draw.randrange(1, 5))]
    old = [(i, draw.randrange(12), draw.choice(kinds)) for i in range(draw.randrange(1, 14))]
    new = [(100 + i, draw.randrange(12), draw.choice(kinds)) for i in range(draw.randrange(1, 14))]
    edges = {(a, b): draw.choice([0.4, 0.5, 0.5, 1.0]) for a in kinds for b in kinds if draw.random() < 0.7}
    answers = {i: draw.random() < 0.8 for i, *_ in old if draw.random() < 0.8}
    return old, new, edges, answers


def test_equal_to_serving_one_after_another(spark):
    """Classes that tie, share objects and run out; equal orders; all in one job."""
    cases = {p: case(p) for p in range(120)}
    made, answers = tables(spark, cases)
    taken, offered, _ = op.serve(made, answers)
    want = {p: serial(*c) for p, c in cases.items()}
    assert served(taken) == {(p, o): v for p, (t, _) in want.items() for o, v in t.items()}
    assert served(offered) == {(p, o): v for p, (_, f) in want.items() for o, v in f.items()}
    assert len(served(taken)) > 200 and len(served(offered)) > 40
    none, first, rounds = op.serve(made)
    assert rounds == 0 and none.isEmpty()
    want = {p: serial(o, n, e, {})[1] for p, (o, n, e, _) in cases.items()}
    assert served(first) == {(p, o): v for p, f in want.items() for o, v in f.items()}


def test_ten_thousand_alike_objects_take_few_rounds(spark):
    """Two head classes compete for three alike classes, two of which tie, of 10,000 objects in all."""
    n = 10_000
    old = [(i, i, f"a{i % 2}") for i in range(n)]
    new = [(n + i, i, ("b0", "b0", "b1", "b2")[i % 4] if i < n // 2 else "b0") for i in range(n)]
    edges = {("a0", "b0"): 0.8, ("a0", "b1"): 0.5, ("a1", "b0"): 0.8, ("a1", "b2"): 0.9}
    made, answers = tables(spark, {1: (old, new, edges, {i: True for i, *_ in old if i % 5})})
    taken, offered, rounds = op.serve(made, answers)
    assert rounds <= 20
    left = {"b0": [], "b1": [], "b2": []}
    for i, _, b in reversed(new):
        left[b].append(i)
    want_taken, want_offered = {}, {}
    for i, _, a in old:
        b = next((b for b in (("b0", "b1") if a == "a0" else ("b2", "b0")) if left[b]), None)
        if b is None:
            continue
        if i % 5:
            want_taken[1, i] = (edges[a, b], left[b].pop())
        else:
            want_offered[1, i] = (edges[a, b], left[b][-1])
    assert served(taken) == want_taken and served(offered) == want_offered


@pytest.mark.parametrize("tables_each", [300])
def test_alike_tables_of_two_schemas(spark, tables_each):
    """All tables have the same columns: no pair of tables is ever made, the k-th takes the k-th."""
    side = lambda lo: {lo + t: {"name": f"n{lo + t}", "columns": {(lo + t) * 10 + i: col(f"c{i}", "int") for i in range(4)}, "constraints": {}, "indexes": {}} for t in range(tables_each)}
    head, new = catalog(spark, {1: side(0)}), catalog(spark, {1: side(1000)})
    found = match.table_candidates(head, new, match.match_tables(head.tables, new.tables))
    assert found.edges.count() == 1 and found.old.count() == found.new.count() == tables_each
    yes = spark.createDataFrame([(t, True, "table") for t in range(tables_each)], "old_id long, rename boolean, kind string")
    got = match.rename_proposals(head, new, yes)
    assert {r.old_id: r.new_id for r in got.tables.collect()} == {t: 1000 + t for t in range(tables_each)}
    assert got.columns.count() == 4 * tables_each
