from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from palimpsest.llm import knn_quality as op
from pyspark.sql import functions as F

from .helpers import ODD, clashing, docs, prose

SF = "/root/testdata/sf0.01"


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus():
    good = [(i, prose(i, 60)) for i in range(60)]
    bad = [(1000 + i, " | ".join(f"X{w}!!" for w in prose(i, 60).split())) for i in range(60)]
    return good + bad


def brute(model, text):
    known = op.Features()
    vector = op.latent([text.encode()], model.projection, known)[0]
    cosines = sorted(((float(vector @ v), y) for v, y in zip(model.vectors, model.labels, strict=True)), reverse=True)[: op.NEIGHBOURS]
    weights = [max(0.0, c) ** op.SHARPNESS for c, _ in cosines]
    return sum(w * y for w, (_, y) in zip(weights, cosines, strict=True)) / sum(weights)


def test_scores_agree_with_a_search_of_all_labelled_vectors(spark):
    rows = corpus()
    labels = labelled(spark, [(d, int(d < 1000), 0) for d, _ in rows] + [(5, None, 1), (7, 3, 0), (9, 0, 0), (None, 1, 0)])
    table = docs(spark, rows + [(2000 + i, t) for i, t in enumerate(ODD)] + [(3, rows[3][1])])
    model = op.fit(table, labels)
    got = {(r["doc_id"], r["score"]): r for r in op.score(clashing(table), model).collect()}
    assert len({d for d, _ in got}) == len(rows) + len(ODD)
    by_id = {d: r for (d, _), r in got.items()}
    for d, text in rows[::7]:
        assert by_id[d]["score"] == pytest.approx(brute(model, text), abs=1e-4)
        assert by_id[d]["predicted"] == int(by_id[d]["score"] >= 0.5) == int(d < 1000)
    assert [by_id[2000 + i]["score"] for i in (0, 1, 2)] == [0, 0, 0]


def test_nothing_to_learn_or_score(spark):
    table = docs(spark, [(1, "a b"), (2, None), (None, "x")])
    model = op.fit(table, labelled(spark, []))
    assert model is None
    assert sorted((r["score"], r["predicted"]) for r in op.score(table, model).collect()) == [(0.0, 0), (0.5, 1), (0.5, 1)]
    assert op.score(docs(spark, []), model).collect() == []


def test_sample_is_bounded_and_never_held_out(spark):
    labels = labelled(spark, [(i, i % 2, 0) for i in range(500)])
    chosen = op.training_rows(labels, 40).withColumn("h", op.held_out(F.col("doc_id"))).collect()
    assert len(chosen) == 80 and not any(r["h"] for r in chosen)


def test_singular_vectors_span_the_space():
    rows = np.random.default_rng(1).standard_normal((40, 6)) @ np.random.default_rng(2).standard_normal((6, 90))
    rows = rows.astype(np.float32)
    basis = op.singular_vectors(rows, 6)
    assert np.allclose(rows @ basis @ basis.T, rows, atol=1e-2)


def test_held_out_accuracy(spark):
    table, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = op.score(table, op.fit(table, labels)).filter("held_out").join(labels, "doc_id").collect()
    for value in (0, 1):
        own = [r["predicted"] == value for r in found if r["quality"] == value]
        assert sum(own) / len(own) > 0.9


def test_executors_need_no_package(tmp_path):
    """The package is on the driver's path only, and its folder is not the workers' own."""
    script = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
from pyspark.sql import SparkSession
from palimpsest.llm import knn_quality as op
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "X | Y !! ") * 9) for i in range(40)], "doc_id long, text string")
labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
model = op.fit(docs, labels)
print("rows", op.score(docs, model).filter("predicted = doc_id % 2").count(), op.accepted(docs, model).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 40 20" in done.stdout, done.stderr[-2000:]
