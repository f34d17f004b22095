"""Doubled rows that digests could hide."""

from __future__ import annotations

from palimpsest.operators import diff


def test_a_doubled_row_that_is_dropped_is_told_by_digests_too(spark):
    make = lambda rows: spark.createDataFrame(rows, "k long, a string")
    frm, to = make([(1, "x"), (1, "x"), (2, "x"), (3, "x"), (3, "x")]), make([(2, "x"), (3, "x"), (3, "x")])
    plain, digests = ({tuple(r) for r in diff.diff_cells(frm, to, ["k"], ["a"], changed_only=c).collect()} for c in (False, True))
    assert digests == plain == {(1, "duplicate_key", None, "2", "0"), (3, "duplicate_key", None, "2", "2")}
