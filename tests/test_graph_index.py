"""Kept chains answer as freshly ranked ones do."""

from __future__ import annotations

import random

import pytest
from palimpsest.operators import history
from palimpsest.sources.graph_index import GraphIndex
from pyspark.sql import functions as F

from tests.test_history import random_graphs, walk

SCHEMA = "project_id long, commit_id long, parent_id long, parent2_id long"


def answers(spark, g, starts, pairs):
    s = spark.createDataFrame([(x,) for x in starts], "start long")
    p = spark.createDataFrame(pairs, "a long, b long")
    return [sorted(tuple(r) for r in df.collect()) for df in (history.first_parent_history(g, s, 6), history.merge_base(g, p).fillna(-1))]


def test_appends_answer_like_one_graph(spark, tmp_path):
    rng = random.Random(5)
    rows, parents = random_graphs(rng)
    half = rows[: len(rows) // 2]  # the other half comes in any order, children before their parents
    late = rows[len(rows) // 2 :]
    rng.shuffle(late)
    rows = half + late
    index = GraphIndex(spark, str(tmp_path))
    bounds = [0, len(rows) // 2, len(rows) - 12, len(rows) - 12, len(rows)]
    for low, high in zip(bounds, bounds[1:]):
        # the rows before are sent again and left out; one append brings nothing
        index.append(spark.createDataFrame(rows[max(0, low - 5) : high], SCHEMA))
        there = {r[1] for r in rows[:high]}
        assert index.waiting().count() == sum(len([x for x in parents[c] if x not in there]) for c in there)
    g = index.graph()
    assert g.commits.count() == len(rows)
    assert g.commits.groupBy("chain", "pos").count().where("count > 1").isEmpty()
    starts = rng.sample(sorted(parents), 30)
    pairs = [(a, rng.choice(starts)) for a in starts] + [(c, c + 1) for c in range(0, 900, 100) if c + 1 in parents]
    got = answers(spark, g, starts, pairs)
    assert got == answers(spark, history.graph(spark.createDataFrame(rows, SCHEMA)), starts, pairs)
    spans = history.ancestors(g, spark.createDataFrame([(x,) for x in starts], "start long")).collect()
    assert sorted(tuple(r) for r in spans) == sorted((s, c) for s in starts for c in walk(parents, s))
    assert index.compact() and [e["whole"] for _, e in index.entries()] == [True, False, False, False, True]
    again = GraphIndex(spark, str(tmp_path)).graph()
    assert again.commits.exceptAll(g.commits).isEmpty() and again.edges.exceptAll(g.edges).isEmpty() and again.edges.count() == g.edges.count()


def test_an_append_writes_and_ranks_what_is_new(spark, tmp_path, monkeypatch):
    import palimpsest.sources.graph_index as module

    ranked, plain = [], module.rank_lists
    monkeypatch.setattr(module, "rank_lists", lambda nodes: ranked.append(nodes.count()) or plain(nodes))
    index = GraphIndex(spark, str(tmp_path))
    line = [(1, i, i - 1 if i else None, None) for i in range(600)]
    for low, high in ((0, 500), (500, 597), (597, 600)):
        index.append(spark.createDataFrame(line[low:high], SCHEMA))
    assert ranked == [500, 97, 3]
    g = index.graph()
    assert [tuple(r) for r in g.commits.groupBy("chain").agg(F.max("pos")).collect()] == [(0, 599)] and g.edges.isEmpty()


def test_two_writers_and_one_that_dies(spark, tmp_path):
    index, other = GraphIndex(spark, str(tmp_path)), GraphIndex(spark, str(tmp_path))
    rows = [(1, 1, None, None), (1, 2, 1, None), (1, 3, 2, None), (1, 4, 2, None), (1, 5, 3, 4)]
    part = lambda *ids: spark.createDataFrame([r for r in rows if r[1] in ids], SCHEMA)
    index.append(part(1, 2))

    def die():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        index.append(part(3), die)
    assert index.graph().commits.count() == 2
    due = [1]
    # both lines continue commit 2; the first to be seen gets the chain
    assert index.append(part(3, 5), lambda: due and due.pop() and other.append(part(4))) == 3
    g = index.graph()
    chains = {r.commit_id: (r.chain, r.pos) for r in g.commits.collect()}
    assert chains == {1: (1, 0), 2: (1, 1), 4: (1, 2), 3: (3, 0), 5: (3, 1)} and index.waiting().isEmpty()
    links = {tuple(r) for r in g.edges.collect()}
    assert links == {(3, 0, 0, 1, 1), (3, 1, 1, 1, 2)}
