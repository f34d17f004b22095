"""Each stage of the pipeline against brute force on its own input."""

from __future__ import annotations

import shutil
from collections import Counter

import corpus_pipeline as op
import numpy as np
import pytest
from palimpsest.llm import knn_quality, mixture, packing

from .helpers import DOCS, ODD, clashing, docs, prose
from .test_exact_dedup import brute as exact_groups
from .test_simhash import near as near_bits
from .test_simhash import plain_simhash, roots


def rows():
    good = [(i, prose(i, 40 + i % 90), ("en", "de")[i % 2], f"s{i % 3}") for i in range(90)]
    bad = [(200 + i, " | ".join(f"X{w}!!" for w in prose(i, 60).split()), "en", "s0") for i in range(60)]
    copies = [(300 + i, good[i][1] if i % 2 else good[i][1] + " \n", "en", "s1") for i in range(10)]
    long = prose(77, 400).split()
    near = [(400 + i, " ".join(long[:i] + ["edit"] + long[i + 1 :]), "en", "hot") for i in range(12)]
    return good + bad + copies + near + [(500 + i, t, None, None) for i, t in enumerate(ODD)] + [(None, prose(999, 50), "en", "s2")]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs(spark, rows()).write.parquet(f"{path}/documents.parquet")
    labels = [(d, int(d < 200), 0) for d, *_ in rows()[:150]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    yield path
    shutil.rmtree(path)


def test_each_stage_on_its_own_input(spark, sf_dir):
    table = docs(spark, rows())
    columns = table.columns
    kept = op.quality(spark, table, sf_dir)
    assert kept.columns == columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    scores = {r["doc_id"]: r["score"] for r in knn_quality.score(table, knn_quality.fit(table, spark.read.parquet(f"{sf_dir}/labels.parquet"))).collect()}
    assert set(texts) == {d for d, s in scores.items() if s >= 0.5}
    assert set(range(90)) <= set(texts) and not set(range(200, 260)) & set(texts)

    kept = op.exact(spark, table, sf_dir)
    assert kept.columns == columns
    plain = [(d, t) for d, t, *_ in rows()]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((g[0] for g in exact_groups(plain) if g[3]), key=str)

    kept = op.near(spark, table, sf_dir)
    fps = [plain_simhash(t) for _, t in plain]
    first = {}
    for (d, _), r in zip(plain, roots(fps, near_bits), strict=True):
        first[r] = d if first.get(r) is None else first[r] if d is None else min(d, first[r])
    assert kept.columns == columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(first.values(), key=str)

    kept = op.mix(spark, table, sf_dir)
    drawn = {r["doc_id"] for r in mixture.mix(table).collect() if r["sampled"]}
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == drawn

    packed = op.pack(spark, table, sf_dir).collect()
    known = packing.Ids(packing.TOKENIZER)
    want = Counter({d: len(known.of([t or ""])[0]) // 4 + 1 for d, t in plain})
    got = Counter()
    for r in packed:
        got[r["doc_id"]] += len(np.frombuffer(r["ids"], "<u4"))
    assert got == want


def test_run_is_its_stages(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in op.STAGES:
        table = op.cut(stage(spark, table, sf_dir))
    strip = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert strip(op.run(spark, sf_dir)) == strip(table) != []


def test_other_columns_pass_through_and_empty_stays_empty(spark, sf_dir):
    table = clashing(docs(spark, rows()[:30]))
    for _, stage in op.STAGES[:-1]:
        assert stage(spark, table, sf_dir).columns == table.columns
    empty = spark.createDataFrame([], DOCS)
    for _, stage in op.STAGES:
        assert stage(spark, empty, sf_dir).collect() == []
