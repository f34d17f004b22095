"""The commit store: one winner, nothing half done."""

from __future__ import annotations

import threading

from palimpsest.sources import commits
from palimpsest.sources.commits import CommitStore
from pyspark.sql import functions as F

PROPOSAL = "branch_id string, commit_id string, expected_head string, parent2_id string"
ROWS = "commit_id string, k long, v string"


def ask(spark, *rows):
    return spark.createDataFrame([(*r, None)[:4] for r in rows], PROPOSAL)


def table(spark, *rows):
    return {"t": spark.createDataFrame(list(rows), ROWS)}


def statuses(df):
    return {(r.branch_id, r.commit_id): r.status for r in df.collect()}


def heads(store):
    return {r.branch_id: r["head"] for r in store.heads().collect()}


def test_swap_no_change_repeats_and_full_entries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "FULL", 2)
    store = CommitStore(spark, str(tmp_path))
    first = store.commit(ask(spark, ("a", "a1", None), ("b", "b1", None), ("c", "c1", "x")), table(spark, ("a1", 1, "p"), ("a1", 2, None), ("b1", 1, "p"), ("c1", 1, "p")))
    assert statuses(first) == {("a", "a1"): "committed", ("b", "b1"): "committed", ("c", "c1"): "branch_moved"}
    second = store.commit(
        ask(spark, ("a", "a2", "a1"), ("b", "b2", "b1"), ("b", "b3", "b1"), ("a", "b1", "a1"), ("d", "d1", None)),
        table(spark, ("a2", 2, None), ("a2", 1, "p"), ("b2", 1, "q"), ("b3", 1, "r"), ("b1", 9, "z"), ("d1", 5, "d")),
    )
    assert statuses(second) == {
        ("a", "a2"): "no_change", ("b", "b2"): "committed", ("b", "b3"): "branch_moved", ("a", "b1"): "repeated_commit", ("d", "d1"): "committed",
    }
    # the same rows again, as a merge of two commits, are a commit
    third = store.commit(ask(spark, ("a", "a3", "a1", "b2"), ("d", "d2", "d1")), table(spark, ("a3", 1, "p"), ("a3", 2, None), ("d2", 5, "e")))
    assert statuses(third) == {("a", "a3"): "committed", ("d", "d2"): "committed"}
    again = CommitStore(spark, str(tmp_path))
    assert heads(again) == {"a": "a3", "b": "b2", "d": "d2"}
    assert [n for n, e in again.entries() if "heads" in e] == [2]
    seen = {(r.commit_id, r.k, r.v) for r in again.rows("t").collect()}
    assert seen == {("a1", 1, "p"), ("a1", 2, None), ("b1", 1, "p"), ("b2", 1, "q"), ("d1", 5, "d"), ("a3", 1, "p"), ("a3", 2, None), ("d2", 5, "e")}
    parents = {r.commit_id: (r.parent_id, r.parent2_id) for r in again.commits().collect()}
    assert parents == {"a1": (None, None), "b1": (None, None), "b2": ("b1", None), "d1": (None, None), "a3": ("a1", "b2"), "d2": ("d1", None)}


def test_a_writer_that_dies_leaves_nothing(spark, tmp_path):
    store = CommitStore(spark, str(tmp_path))
    store.commit(ask(spark, ("a", "a1", None)), table(spark, ("a1", 1, "p")))

    def die():
        raise KeyboardInterrupt

    try:
        store.commit(ask(spark, ("a", "a2", "a1")), table(spark, ("a2", 1, "q")), before_claim=die)
    except KeyboardInterrupt:
        pass
    assert heads(store) == {"a": "a1"} and [r.commit_id for r in store.rows("t").collect()] == ["a1"]
    assert statuses(store.commit(ask(spark, ("a", "a2", "a1")), table(spark, ("a2", 1, "q")))) == {("a", "a2"): "committed"}


def test_the_second_of_two_writers_sees_the_first(spark, tmp_path):
    store, other = CommitStore(spark, str(tmp_path)), CommitStore(spark, str(tmp_path))
    names = [f"b{i}" for i in range(6)]
    store.commit(ask(spark, *[(b, f"{b}-0", None) for b in names]), table(spark, *[(f"{b}-0", 1, "p") for b in names]))
    moved, due = names[:2], [1]

    def meanwhile():
        if due:
            due.pop()
            other.commit(ask(spark, *[(b, f"{b}-x", f"{b}-0") for b in moved]), table(spark, *[(f"{b}-x", 1, "x") for b in moved]))

    got = store.commit(ask(spark, *[(b, f"{b}-1", f"{b}-0") for b in names]), table(spark, *[(f"{b}-1", 1, "q") for b in names]), meanwhile)
    assert statuses(got) == {(b, f"{b}-1"): "branch_moved" if b in moved else "committed" for b in names}
    assert heads(store) == {b: f"{b}-x" if b in moved else f"{b}-1" for b in names}
    assert store.rows("t").where(F.col("commit_id").isin(*[f"{b}-1" for b in moved])).isEmpty()


def test_writers_at_the_same_time(spark, tmp_path):
    base = CommitStore(spark, str(tmp_path))
    names = [f"b{i}" for i in range(4)]
    base.commit(ask(spark, *[(b, f"{b}-0", None) for b in names]), table(spark, *[(f"{b}-0", 1, "p") for b in names]))
    gate, results = threading.Barrier(3), {}

    def write(who):
        store = CommitStore(spark, str(tmp_path))
        proposals = ask(spark, *[(b, f"{b}-{who}", f"{b}-0") for b in names])
        waited = []

        def together():
            if not waited:
                waited.append(1)
                gate.wait(timeout=120)

        results[who] = statuses(store.commit(proposals, table(spark, *[(f"{b}-{who}", 1, who) for b in names]), together))

    threads = [threading.Thread(target=write, args=(w,)) for w in "xyz"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [w for w in "xyz" if set(results[w].values()) == {"committed"}]
    assert len(won) == 1 and all(set(results[w].values()) == {"branch_moved"} for w in "xyz" if w not in won)
    assert heads(base) == {b: f"{b}-{won[0]}" for b in names} and [n for n, _ in base.entries()] == [1, 2]
