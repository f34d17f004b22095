from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from palimpsest.llm import mixture as op

from .helpers import ODD, clashing, docs, prose


def plain_rake(table, targets, rounds=400):
    """Raking of a three-way array by plain scaling."""
    w = table / table.sum()
    for _ in range(rounds):
        for axis, target in enumerate(targets):
            others = tuple(a for a in range(3) if a != axis)
            have = w.sum(axis=others)
            factor = np.divide(target, have, out=np.zeros_like(target), where=have > 0)
            w = w * factor.reshape([-1 if a == axis else 1 for a in range(3)])
    return w


def cells_of(table):
    names = [["s0", "s1", "s2"], ["en", None], ["0", "1", "2", "3"]]
    return pd.DataFrame(
        [(names[0][i], names[1][j], names[2][k], int(table[i, j, k])) for i in range(3) for j in range(2) for k in range(4)], columns=[*op.MARGINS, "tokens"]
    )


def test_raking_meets_margins_like_a_plain_form():
    table = np.random.default_rng(1).integers(1, 1000, (3, 2, 4)).astype(float)
    wanted = {"source": {"s0": 0.5, "s1": 0.2, "s2": 0.3}, "lang": {"en": 0.9, None: 0.1}, "topic": {"0": 0.1, "1": 0.2, "2": 0.3, "3": 0.4}}
    cells = cells_of(table)
    got = op.rake(cells, wanted)
    want = plain_rake(table, [np.array(list(t.values())) for t in wanted.values()])
    assert np.allclose(got, want.ravel(), atol=1e-7)
    p = op.rates(cells["tokens"].to_numpy(float), got, 0.2)
    assert (p * cells["tokens"]).sum() == pytest.approx(0.2 * table.sum(), rel=1e-6) and p.max() <= 1


def test_default_and_partial_targets():
    cells = cells_of(np.full((3, 2, 4), 10.0))
    cells.loc[cells["source"] == "s0", "tokens"] *= 50
    got = cells.assign(w=op.rake(cells)).groupby("source")["w"].sum()
    have = cells.groupby("source")["tokens"].sum() / cells["tokens"].sum()
    assert np.allclose(got, have**op.TEMPER / (have**op.TEMPER).sum(), atol=1e-6)
    got = cells.assign(w=op.rake(cells, {"source": {"s1": 0.5}})).groupby("source")["w"].sum()
    assert got["s1"] == pytest.approx(0.5, abs=1e-6) and got["s0"] == pytest.approx(0.5 * 50 / 51, abs=1e-6)


def rows():
    odd = [(900 + i, t, None if i % 2 else "en", None if i % 3 else "s1") for i, t in enumerate(ODD)]
    hot = [(i, prose(i, 5 + i % 60), ("en", "de", "fr")[i % 3 if i % 2 else 0], "hot" if i % 3 else f"s{i % 5}") for i in range(400)]
    return odd + hot + [hot[0], (None, "x y z", "en", "hot")]


def test_both_forms_agree_and_rows_are_whole(spark, monkeypatch):
    monkeypatch.setattr(op, "CLOSE", 1e-3)
    table = clashing(docs(spark, rows()))
    near = op.mix(table, keep=0.4).collect()
    far = op.mix(table, keep=0.4, most_cells=0).collect()
    key = lambda r: (str(r["doc_id"]), r["tokens"])
    assert len(near) == len(far) == len(rows())
    for a, b in zip(sorted(near, key=key), sorted(far, key=key), strict=True):
        assert a["probability"] == pytest.approx(b["probability"], abs=1e-5) and a["weight"] == pytest.approx(b["weight"], abs=1e-6)
    assert [r["tokens"] for r in sorted(near, key=key)] == [n for _, n in sorted((str(d), len((t or "").encode().split())) for d, t, *_ in rows())]
    total = sum(r["tokens"] for r in near)
    assert sum(r["tokens"] * r["probability"] for r in near) == pytest.approx(0.4 * total, rel=1e-4)


def test_named_topic_and_targets(spark):
    table = docs(spark, rows()).withColumnRenamed("n_chars", "kind")
    out = op.mix(table, {"source": {"hot": 0.2}, "lang": {"de": 0.5}}, keep=0.1, topic="kind").collect()
    assert {r["topic"] for r in out} == {None if t is None else str(len(t)) for _, t, *_ in rows()}


def test_draws_follow_probabilities(spark):
    table = docs(spark, [(i, prose(i, 20), "en", f"s{i % 3}") for i in range(3000)])
    out = op.mix(table, keep=0.3).collect()
    assert sum(r["sampled"] for r in out) / 3000 == pytest.approx(0.3, abs=0.03)
    assert [r["sampled"] for r in op.mix(table, keep=1.0).collect()] == [True] * 3000


@pytest.mark.parametrize("given", [[], [(1, None)], [(1, ""), (None, None)]])
@pytest.mark.parametrize("most", [0, 100])
def test_nothing_to_weigh(spark, given, most):
    out = op.mix(docs(spark, given), most_cells=most).collect()
    assert len(out) == len(given) and all(r["tokens"] == 0 and r["probability"] == op.KEEP for r in out)


@pytest.mark.parametrize("most", [0, 100])
def test_margins_that_cannot_be_met_are_told(spark, monkeypatch, most):
    monkeypatch.setattr(op, "ROUNDS", 6)
    table = docs(spark, [(i, prose(i, 20), "fr" if i % 2 else "en", "a" if i % 2 else "b") for i in range(200)])
    met = op.mix(table, {"source": {"a": 0.3}, "lang": {"fr": 0.3}}, most_cells=most).select("margin_gap").distinct().collect()
    torn = op.mix(table, {"source": {"a": 0.3}, "lang": {"fr": 0.8}}, most_cells=most).select("margin_gap").distinct().collect()
    assert len(met) == len(torn) == 1 and met[0][0] < 0.02 and torn[0][0] > 0.3
