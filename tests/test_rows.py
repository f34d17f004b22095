"""Row diff, merge, collisions, replay and evolution against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators import collisions, diff, evolve, integrity, merge, referential, rekey, replay, spread
from palimpsest.operators.integrity import ForeignKey
from palimpsest.sources import versions

ROW = "k long, a string, b int"
KEY, COLS = ["k"], ["a", "b"]


def rows(rng, n=60):
    return {k: (rng.choice([None, "x", "y"]), rng.choice([None, 1, 2])) for k in rng.sample(range(100), n)}


def frame(spark, d):
    return spark.createDataFrame([(k, *v) for k, v in d.items()], ROW)


def versions_of(rng):
    base = rows(rng)
    out = []
    for _ in range(2):
        side = {k: v for k, v in base.items() if rng.random() > 0.15}
        for k in list(side):
            if rng.random() < 0.4:
                side[k] = (rng.choice([None, "x", "y", "z"]), side[k][1]) if rng.random() < 0.5 else (side[k][0], rng.choice([None, 1, 2, 3]))
        for k in rng.sample(range(100, 130), 10):
            side[k] = (rng.choice(["x", "y"]), 1)
        out.append(side)
    return base, *out


def model(base, ours, theirs):
    merged, conflicts = {}, set()
    for k in {*base, *ours, *theirs}:
        b, o, t = base.get(k), ours.get(k), theirs.get(k)
        if b is None:
            if o is not None and t is not None and o != t:
                conflicts.add((k, "row"))
            merged[k] = o if o is not None else t
        elif o is None and t is None:
            continue
        elif o is None or t is None:
            if (o if o is not None else t) != b:
                conflicts.add((k, "existence"))
                if o is not None:
                    merged[k] = o
        else:
            cells = []
            for i, c in enumerate(COLS):
                if o[i] != t[i] and b[i] not in (o[i], t[i]):
                    conflicts.add((k, c))
                cells.append(t[i] if b[i] == o[i] else o[i])
            merged[k] = tuple(cells)
    return merged, conflicts


def as_dict(df):
    return {r.k: (r.a, r.b) for r in df.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_merge_equals_model(spark, seed):
    base, ours, theirs = versions_of(random.Random(seed))
    frames = [frame(spark, d) for d in (base, ours, theirs)]
    got = merge.merge3(*frames, KEY, COLS)
    merged, conflicts = model(base, ours, theirs)
    assert as_dict(got.merged) == merged
    assert {(r.k, r.property) for r in got.conflicts.collect()} == conflicts
    changes = merge.changes_to_ours(frames[1], got)
    assert {r.k for r in changes.collect()} == {k for k in {*merged, *ours} if merged.get(k) != ours.get(k)}
    swapped = merge.merge3(frames[0], frames[2], frames[1], KEY, COLS).conflicts
    one = {(r.conflict_id, r.ours_value, r.theirs_value) for r in got.conflicts.collect()}
    assert {(r.conflict_id, r.theirs_value, r.ours_value) for r in swapped.collect()} == one


def test_merge_laws(spark):
    base, x, _ = (frame(spark, d) for d in versions_of(random.Random(9)))
    want = as_dict(x)
    for a, b in ((base, x), (x, base), (x, x)):
        got = merge.merge3(base, a, b, KEY, COLS)
        assert as_dict(got.merged) == want and got.conflicts.isEmpty()
    assert diff.diff_cells(x, x, KEY, COLS).isEmpty()


def test_digest_form_equals_plain_form(spark):
    base, x, y = (frame(spark, d) for d in versions_of(random.Random(3)))
    order = ["k", "kind", "property"]
    plain = diff.diff_cells(x, y, KEY, COLS).orderBy(order).collect()
    assert diff.diff_cells(x, y, KEY, COLS, changed_only=True).orderBy(order).collect() == plain
    a = merge.all_conflicts(merge.align3(base, x, y, KEY, COLS), KEY, COLS).orderBy("conflict_id").collect()
    b = merge.all_conflicts(merge.align3(base, x, y, KEY, COLS, changed_only=True), KEY, COLS).orderBy("conflict_id").collect()
    assert a == b


def test_a_value_moving_between_columns_changes_the_digest(spark):
    schema = "k long, a string, b string"
    x, y = spark.createDataFrame([(1, None, "v")], schema), spark.createDataFrame([(1, "v", None)], schema)
    assert diff.diff_cells(x, y, KEY, COLS, changed_only=True).count() == 2


def test_repeated_and_null_keys_are_reported_not_merged(spark):
    bad = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (None, "z", 3), (2, "x", 1)], ROW)
    good = spark.createDataFrame([(1, "x", 1), (2, "q", 1)], ROW)
    assert {r.k for r in merge.merge3(good, bad, good, KEY, COLS).merged.collect()} == {2}
    found = {(r.side, r.problem, r.k, r.n) for r in merge.merge_key_problems(good, bad, good, KEY).collect()}
    assert found == {("ours", "duplicate_key", 1, 2), ("ours", "null_key", None, 1)}


def test_map_cells(spark):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("a", T.MapType(T.StringType(), T.IntegerType()))])
    make = lambda m: spark.createDataFrame([(1, m)], schema)
    same = diff.diff_cells(make({"x": 1, "y": 2}), make({"y": 2, "x": 1}), KEY, ["a"])
    assert same.isEmpty()
    merged = merge.merge3(make({"x": 1}), make({"x": 1}), make({"x": 2}), KEY, ["a"]).merged.collect()
    assert merged[0].a == {"x": 2}


def test_answers_are_final_and_checked(spark):
    base, ours, theirs = (spark.createDataFrame([(k, v, n) for k in range(6)], ROW) for v, n in (("p", 0), ("q", 1), ("r", 2)))
    answers = spark.createDataFrame(
        [
            ("cell:a:0", "ours", None, 1),
            ("cell:a:0", "theirs", None, 2),
            ("cell:b:1", "custom", "7", 1),
            ("cell:b:2", "custom", "seven", 1),
            ("cell:a:3", "custom", "  ", 1),
            ("cell:a:99", "ours", None, 1),
        ],
        "conflict_id string, choice string, custom string, seq int",
    )
    got = merge.merge3(base, ours, theirs, KEY, COLS, answers)
    state = as_dict(got.merged)
    assert state[0] == ("r", 1) and state[1] == ("q", 7) and state[2] == ("q", 1)
    found = {(r.conflict_id, r.problem, r.severity) for r in got.resolution_problems.collect()}
    assert found == {
        ("cell:a:0", "repeated_answer", "warning"),
        ("cell:b:2", "unparsable_custom", "error"),
        ("cell:a:3", "blank_custom", "error"),
        ("cell:a:99", "unknown_conflict", "warning"),
    }
    assert got.conflicts.count() == 12 - 2


def test_collision_rounds_equal_reading_in_order(spark):
    rng = random.Random(5)
    for _ in range(3):
        names = {k: rng.choice("pqr") for k in range(1, 25)}
        answers, holder, kept, still = {}, {}, {}, set()
        for k, n in names.items():
            if n not in holder:
                holder[n] = k
                kept[k] = n
                continue
            ident = f"name_collision:{holder[n]}:{k}"
            choice = rng.choice(["ours", "theirs", "custom", None])
            if choice is None:
                kept[k] = n
                still.add(ident)
                continue
            answers[ident] = (choice, f"new{k}" if choice == "custom" else None)
            if choice == "theirs":
                del kept[holder[n]]
                holder[n] = k
                kept[k] = n
            elif choice == "custom":
                kept[k] = f"new{k}"
        df = spark.createDataFrame(list(names.items()), "k long, name string")
        res = spark.createDataFrame([(i, *a) for i, a in answers.items()], "conflict_id string, choice string, custom string")
        rows_, open_ = collisions.resolve_collisions(df, ["name"], "name", KEY, ["k"], res)
        assert {r.k: r.name for r in rows_.collect()} == kept
        assert {r.conflict_id for r in open_.collect()} == still


def test_bucketed_scans_equal_plain_order(spark):
    rng = random.Random(1)
    data = [(rng.choice("ab") if rng.random() < 0.3 else "hot", s, rng.choice([None, s])) for s in rng.sample(range(500), 200)]
    df = spark.createDataFrame(data, "g string, s long, v long")
    for rows in (8, 1 << 20):
        last = {(r.g, r.s): r.p for r in spread.running_last(df, ["g"], "s", {"p": F.col("v")}, inclusive=False, rows=rows).collect()}
        upto = {(r.g, r.s): r.p for r in spread.running_last(df, ["g"], "s", {"p": F.col("v")}, inclusive=True, rows=rows).collect()}
        nxt = {(r.g, r.s): r.n for r in spread.ordered_scan(df, ["g"], "s", ahead={"n": F.col("s")}, rows=rows).collect()}
        num = {(r.g, r.s): r.n for r in spread.number_within(df, ["g"], "s", "n", rows=rows).collect()}
        for g in "ab", "hot":
            seen = None
            line = sorted((s, v) for gg, s, v in data if gg == g)
            for i, (s, v) in enumerate(line):
                assert last[g, s] == seen
                seen = v if v is not None else seen
                assert upto[g, s] == seen
                assert nxt[g, s] == (line[i + 1][0] if i + 1 < len(line) else None)
                assert num[g, s] == i + 1


def test_buckets_hold_equal_numbers_of_rows_in_any_unit(spark):
    """Dense numbers, microseconds with gaps, text, long ties; null groups too."""
    n = 40_000
    at = F.col("id")
    df = spark.range(n).select(
        F.when(at % 10 == 0, F.lit(None)).otherwise(F.lit("hot")).alias("g"),
        at.alias("dense"),
        (F.lit(1_700_000_000_000_000) + at * at * 7).alias("micros"),
        F.lpad(at.cast("string"), 9, "0").alias("word"),
        F.floor(at / 20_000).alias("tied"),
        F.xxhash64(at).alias("id"),
    ).repartition(7)
    for order in (["dense"], ["micros"], ["word"], ["tied", "id"]):
        got = spread.bucketed(df, ["g"], order, rows=1000).where("g is not null")
        sizes = [r["n"] for r in got.groupBy("_bucket").agg(F.count("*").alias("n")).collect()]
        assert 18 <= len(sizes) <= 72 and max(sizes) < 4000, (order, sizes)
        ends = got.groupBy("_bucket").agg(F.min(F.struct(*order)).alias("a"), F.max(F.struct(*order)).alias("b")).orderBy("_bucket").collect()
        assert all(x["b"] < y["a"] for x, y in zip(ends, ends[1:], strict=False))
        numbered = spread.number_within(df, ["g"], order[0], "n", tie=order[1:], rows=1000).where("g is null")
        assert sorted(r["n"] for r in numbered.select("n").collect()) == list(range(1, n // 10 + 1))


def test_lookups_keep_every_row_of_a_hot_key(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("i"))
    small = spark.createDataFrame([(1, "hot"), (2, "two"), (5, "five")], "k long, v string")
    want = sorted(map(tuple, big.join(small, "k").collect()))
    assert sorted(map(tuple, spread.lookup(big, small, ["k"], ["i"]).collect())) == want
    assert sorted(map(tuple, spread.lookup_large(big, small, ["k"], ["i"], hot_rows=100).collect())) == want
    left = big.join(small, "k", "left").count()
    assert spread.lookup(big, small, ["k"], ["i"], "left").count() == left
    assert spread.lookup_large(big, small, ["k"], ["i"], "left", hot_rows=100).count() == left
    anti = big.join(small, "k", "left_anti").count()
    assert spread.lookup_large(big, small, ["k"], ["i"], "left_anti", hot_rows=100).count() == anti


def test_replay_equals_sequential_log(spark):
    rng = random.Random(2)
    base = {k: (rng.choice("xy"), 1) for k in range(5)}
    log = []
    for s in range(200):
        op = rng.choice(["insert", "update", "update", "delete"])
        log.append((rng.choice([1, 1, rng.randrange(8)]), s, op, rng.choice(["p", "q", None]), rng.randrange(9), rng.choice([["a"], ["b"], ["a", "b"]])))
    schema = "k long, seq long, op string, a string, b int, assigned array<string>"
    df, start = spark.createDataFrame(log, schema), frame(spark, base)
    state, errors, states = dict(base), set(), {}
    for k, s, op, a, b, assigned in log:
        if op == "insert":
            if k in state:
                errors.add((s, "insert_on_existing"))
            else:
                state[k] = (a, b)
        elif k not in state:
            errors.add((s, f"{op}_on_missing"))
        elif op == "delete":
            del state[k]
        else:
            state[k] = (a if "a" in assigned else state[k][0], b if "b" in assigned else state[k][1])
        states[s] = dict(state)
    for rows in (16, 1 << 20):
        assert as_dict(replay.replay_rows(start, df, KEY, COLS, rows=rows)) == state
        assert as_dict(replay.as_of(start, df, KEY, COLS, 77, rows=rows)) == states[77]
        assert {(r.seq, r.reason) for r in replay.replay_errors(start, df, KEY, COLS, rows=rows).collect()} == errors
        spans = replay.validity_intervals(start, df, KEY, COLS, rows=rows).collect()
        for s in (0, 50, 133, 199):
            at = {r.k: (r.a, r.b) for r in spans if (r.from_seq is None or r.from_seq <= s) and (r.to_seq is None or r.to_seq > s)}
            assert at == states[s]


def test_evolve_round_trip_swap_and_rejects(spark):
    df = evolve.identify(spark.createDataFrame([(1, "5", 3), (2, "x", 4), (3, None, 5)], "id long, a string, b int"), {"id": 1, "a": 2, "b": 3})
    swap = T.StructType([evolve.field(1, "id", T.LongType()), evolve.field(2, "b", T.StringType()), evolve.field(3, "a", T.IntegerType())])
    out, rejects = evolve.evolve(df, swap)
    assert rejects.isEmpty() and evolve.same_shape(out.schema, swap)
    assert {(r.id, r.b, r.a) for r in out.collect()} == {(1, "5", 3), (2, "x", 4), (3, None, 5)}
    back, _ = evolve.evolve(out, df.schema)
    assert evolve.same_shape(back.schema, df.schema) and sorted(back.collect()) == sorted(df.collect())
    hard = T.StructType([evolve.field(1, "id", T.LongType()), evolve.field(2, "a", T.IntegerType(), False), evolve.field(9, "c", T.StringType(), default="'n'")])
    out, rejects = evolve.evolve(df, hard)
    assert [tuple(r) for r in out.collect()] == [(1, 5, "n")]
    assert {(r.id, r.reasons) for r in rejects.collect()} == {(2, "retype_needs_using:a"), (3, "set_not_null:a")}
    assert out.schema["a"].metadata["field_id"] == 2
    assert evolve.hazards(df, df.schema).isEmpty()
    assert {(r.code, r.rows) for r in evolve.hazards(df, hard).collect()} == {("retype_needs_using", 1), ("set_not_null", 1)}


def test_evolve_columns_rules(spark):
    df = spark.createDataFrame([(1, "a")], "id long, name string")
    for edit, text in (
        ({"op": "rename_column", "column": "name", "name": "id"}, "exists"),
        ({"op": "drop_column", "column": "zip"}, "not found"),
        ({"op": "mystery", "column": "id"}, "unknown"),
    ):
        with pytest.raises(ValueError, match=text):
            evolve.evolve_columns(df, [edit])


def test_referential_actions_follow_cycles_and_self_references(spark):
    people = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 9), (6, 6)], "id long, boss long")
    notes = spark.createDataFrame([(1, 4), (2, 5), (3, 6)], "note long, person long")
    fks = [
        ForeignKey("people", ("boss",), "people", ("id",), "cascade"),
        ForeignKey("notes", ("person",), "people", ("id",), "set_null"),
    ]
    gone = spark.createDataFrame([(1,), (6,)], "id long")
    keys = {"people": ["id"], "notes": ["note"]}
    got = referential.referential_effects({"people": people, "notes": notes}, keys, fks, {"people": gone}).collect()
    assert {(r.table, r.key, r.effect, r.depth) for r in got} == {
        ("people", "2", "delete", 1),
        ("people", "3", "delete", 2),
        ("people", "4", "delete", 3),
        ("notes", "1", "set_null", 4),
        ("notes", "3", "set_null", 1),
    }


def test_rekey_equals_brute_force(spark):
    rng = random.Random(8)
    make = lambda lo: [(lo + i, rng.choice("mn"), rng.choice(["u", "v", None]), rng.choice("st"), rng.choice("0123")) for i in range(40)]
    schema = "key long, block string, p string, q string, r string"
    old, new = make(0), make(100)
    weights = {"p": 50, "q": 20, "r": 30}
    want = {}
    for o in old:
        best = None
        for n in new:
            if n[1] == o[1]:
                score = sum(w for (c, w), i in zip(weights.items(), (2, 3, 4)) if o[i] is not None and o[i] == n[i])
                if score >= 40 and (best is None or score > best[1]):
                    best = (n[0], score)
        if best:
            want[o[0]] = best
    found = rekey.rekey_proposals(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), "key", ["block"], weights, 40)
    assert {r.old_key: (r.new_key, r.score) for r in found.collect()} == want


def test_nulls_in_unique_and_foreign_keys(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (1, 2, "b"), (1, 2, "c"), (7, 8, "d")], "x long, y long, z string")
    assert [tuple(r) for r in integrity.unique_violations(df, ["x", "y"]).collect()] == [(1, 2, 2)]
    parent = spark.createDataFrame([(1, 2)], "p long, q long")
    assert [tuple(r) for r in integrity.fk_orphans(df, ["x", "y"], parent, ["p", "q"]).collect()] == [(7, 8, 1)]
    assert integrity.check_violations(df, "y > 5").count() == 2


def test_versions_are_immutable(spark, tmp_path):
    path = str(tmp_path / "t")
    a, b = (spark.createDataFrame([(1, v)], "k long, v string") for v in "ab")
    versions.write_version(a, path, "c1")
    versions.write_version(b, path, "c2")
    with pytest.raises(Exception, match="(?i)exists"):
        versions.write_version(b, path, "c1")
    assert versions.load_version(spark, path, "c1").first().v == "a"
    assert versions.load_version(spark, path, "c2", ["v"]).columns == ["v"]
    some = spark.createDataFrame([("c2",)], "commit_id string")
    assert [(r.commit_id, r.v) for r in versions.load_versions(spark, path, some).collect()] == [("c2", "b")]


def test_answers_find_keys_with_separators(spark):
    schema = "p string, q string, a string"
    keys = [("x:y", "z"), ("x", "y:z"), ("back\\", "slash"), ("back", "\\:slash"), ("", "")]
    base, ours, theirs = (spark.createDataFrame([(*k, v) for k in keys], schema) for v in "bot")
    conflicts = merge.merge3(base, ours, theirs, ["p", "q"], ["a"]).conflicts.collect()
    assert len({r.conflict_id for r in conflicts}) == len(keys)
    answers = spark.createDataFrame(
        [(r.conflict_id, "custom", f"{r.p}+{r.q}") for r in conflicts], "conflict_id string, choice string, custom string"
    )
    got = merge.merge3(base, ours, theirs, ["p", "q"], ["a"], answers)
    assert {(r.p, r.q): r.a for r in got.merged.collect()} == {k: f"{k[0]}+{k[1]}" for k in keys}
    assert got.conflicts.isEmpty() and got.resolution_problems.isEmpty()
