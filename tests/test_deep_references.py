"""Deletes along references of a table to itself, however deep."""

from __future__ import annotations

import random

from palimpsest.operators import referential
from palimpsest.operators.integrity import ForeignKey
from pyspark.sql import functions as F

FKS = [
    ForeignKey("people", ("boss",), "people", ("id",), "cascade"),
    ForeignKey("people", ("twin",), "people", ("id",), "cascade"),
    ForeignKey("people", ("home",), "places", ("p",), "cascade"),
    ForeignKey("places", ("owner",), "people", ("id",), "cascade"),
    ForeignKey("places", ("heir",), "people", ("id",), "set_null"),
]
KEYS = {"people": ["id"], "places": ["p"]}


def plain(people, places, gone):
    """Breadth-first over all references; ties by (via, columns)."""
    depth = {("people", i): (0, None) for i in gone}
    level, effects = set(depth), []
    rows = {"people": {r[0]: dict(zip(("boss", "twin", "home"), r[1:], strict=True)) for r in people}, "places": {r[0]: dict(zip(("owner", "heir"), r[1:], strict=True)) for r in places}}
    d = 0
    while level:
        d += 1
        fresh = {}
        for fk in FKS:
            for key, row in rows[fk.table].items():
                if (fk.parent, row[fk.cols[0]]) in level:
                    by = (fk.parent, fk.cols[0])
                    if fk.on_delete == "cascade" and (fk.table, key) not in depth:
                        fresh[fk.table, key] = min(by, fresh.get((fk.table, key), by))
                    elif fk.on_delete != "cascade":
                        effects.append((fk.table, str(key), "set_null", *by, d))
        depth |= {k: (d, by) for k, by in fresh.items()}
        level = set(fresh)
    deletes = [(t, str(k), "delete", *by, n) for (t, k), (n, by) in depth.items() if n]
    return sorted(deletes + [e for e in effects if (e[0], int(e[1])) not in depth])


def test_equal_to_breadth_first_on_mixed_graphs(spark):
    for seed in (1,):
        draw = random.Random(seed)
        pick = lambda n: draw.choice([None, None, draw.randrange(n)])
        people = [(i, i - 1 if i and draw.random() < 0.8 else pick(60), pick(60), pick(20)) for i in range(60)]
        places = [(p, pick(60), pick(60)) for p in range(20)]
        gone = draw.sample(range(60), 3)
        made = {
            "people": spark.createDataFrame(people, "id long, boss long, twin long, home long"),
            "places": spark.createDataFrame(places, "p long, owner long, heir long"),
        }
        got = referential.referential_effects(made, KEYS, FKS, {"people": made["people"].where(F.col("id").isin(gone))})
        assert sorted(tuple(r) for r in got.collect()) == plain(people, places, gone)


def test_a_hundred_thousand_levels(spark, monkeypatch):
    n, rounds = 100_000, []
    honest = referential.cut
    monkeypatch.setattr(referential, "cut", lambda df: rounds.append(1) or honest(df))
    chain = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("boss"))
    got = referential.referential_effects({"people": chain}, {"people": ["id"]}, FKS[:1], {"people": chain.where("id = 40000")})
    told = got.agg(F.count("*"), F.min("depth"), F.max("depth"), F.sum(F.col("depth") - F.col("key").cast("long"))).first()
    assert tuple(told) == (n - 40_001, 1, n - 40_001, -40_000 * (n - 40_001))
    assert len(rounds) < 30


def test_referred_values_that_repeat(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", "a"), (4, "c", "b")], "id long, code string, above string")
    fk = ForeignKey("t", ("above",), "t", ("code",), "cascade")
    got = referential.referential_effects({"t": rows}, {"t": ["id"]}, [fk], {"t": rows.where("id = 2")})
    assert sorted((r.key, r.depth) for r in got.collect()) == [("3", 1), ("4", 2)]
