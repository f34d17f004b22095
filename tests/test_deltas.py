"""Versions kept as changes read like full copies."""

from __future__ import annotations

import random

import pytest
from palimpsest.sources.deltas import DeltaVersions

SCHEMA = "k long, part string, v string, m array<int>"


def frame(spark, state):
    return spark.createDataFrame([(*k, *r) for k, r in state.items()], SCHEMA)


def test_any_version_equals_its_full_copy(spark, tmp_path):
    rng = random.Random(3)
    store = DeltaVersions(spark, str(tmp_path), ["k", "part"], ["v", "m"], every=3)
    state = {(i, "ab"[i % 2]): (f"v{i}", [i]) for i in range(50)}
    copies, stored, lines = {"v0": dict(state)}, {}, {"v0": None}
    stored["v0"] = store.write("v0", frame(spark, state))
    for n in range(1, 7):
        parent = f"v{n - 1}" if n != 5 else "v1"  # a branch from an early version
        state = dict(copies[parent])
        for k in rng.sample(sorted(state), 3):
            del state[k]
        for k in rng.sample(sorted(state), 4):
            state[k] = (None, state[k][1]) if rng.random() < 0.5 else (state[k][0], None)
        state[(100 + n, "c")] = (None, None)  # an added row without values is no removal
        if n == 4:  # a key that went comes back
            back = next(k for k in copies["v0"] if k not in copies["v3"])
            state[back] = copies["v0"][back]
        copies[f"v{n}"], lines[f"v{n}"] = state, parent
        stored[f"v{n}"] = store.write(f"v{n}", frame(spark, state), parent)
    again = DeltaVersions(spark, str(tmp_path), ["k", "part"], ["v", "m"], every=3)
    for name, want in copies.items():
        got = {(r.k, r.part): (r.v, r.m) for r in again.load(name).collect()}
        assert got == want, name
        if lines[name]:
            was = copies[lines[name]]
            assert stored[name] == sum(was.get(k) != want.get(k) or (k in was) != (k in want) for k in {*was, *want})
    made = again.versions()
    assert [len(made[f"v{n}"]["folders"]) for n in range(7)] == [1, 2, 3, 1, 2, 3, 1]
    gone = {(r.k, r.part) for r in again.changes("v1").where("_gone").collect()}
    assert gone == set(copies["v0"]) - set(copies["v1"])


def test_refused_and_empty(spark, tmp_path):
    store = DeltaVersions(spark, str(tmp_path), ["k", "part"], ["v", "m"])
    full = {(1, "a"): ("x", None)}
    store.write("one", frame(spark, full))
    assert store.write("same", frame(spark, full), "one") == 0 and store.write("none", frame(spark, {}), "same") == 1
    assert store.load("none").isEmpty() and store.load("same").count() == 1
    with pytest.raises(ValueError, match="there already"):
        store.write("one", frame(spark, full))
    with pytest.raises(ValueError, match="no version"):
        store.write("two", frame(spark, full), "gone")
    for bad in ([(1, "a", "x", None)] * 2, [(None, "a", "x", None)]):
        with pytest.raises(ValueError, match="repeated or null"):
            store.write("bad", spark.createDataFrame(bad, SCHEMA), "one")
    assert sorted(store.versions()) == ["none", "one", "same"]
