"""Tables with repeated rows and null ids through the stages of the pipeline."""

from __future__ import annotations

import corpus_pipeline as op
from palimpsest.llm import mixture

from .helpers import docs, prose
from .test_simhash import near, plain_simhash


def texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_exact_leaves_one_row_of_each_group(spark):
    rows = [(3, "a b"), (3, "a b"), (3, "ab"), (None, "a b "), (None, "only"), (None, "only"), (4, "x"), (4, "y")]
    assert texts(op.exact(spark, docs(spark, rows), "")) == sorted([(3, "a b"), (None, "only"), (4, "x"), (4, "y")], key=str)


def test_near_leaves_one_row_of_each_component(spark):
    one, two, three = (prose(k, 600) for k in range(3))
    close = one.replace(one.split()[300], "edit", 1)
    assert near(plain_simhash(one), plain_simhash(close)) and not near(plain_simhash(one), plain_simhash(two))
    rows = [(1, one), (None, close), (None, two), (None, two), (7, three), (7, close), (7, three)]
    assert texts(op.near(spark, docs(spark, rows), "")) == sorted([(1, one), (None, two), (7, three)], key=str)


def test_each_drawn_row_is_kept_by_itself(spark):
    rows = [(None if i % 2 else i % 7, prose(i, 5 + i % 50), ("en", "de")[i % 2], f"s{i % 5}") for i in range(300)]
    table = op.cut(docs(spark, rows))
    drawn = [r["sampled"] for r in mixture.mix(table).collect()]
    assert 0 < sum(drawn) < len(rows)
    got = op.mix(spark, table, "").collect()
    assert len(got) == sum(drawn)
