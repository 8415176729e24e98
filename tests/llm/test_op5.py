import zlib

import numpy as np

import llm.op5_quality as op5_quality_module
from llm.op5_quality import (
    ACCEPT, FEATURES, Block, Blocks, SharedBlocks, _blocks, _training_rows, accepted,
    features, fit, fit_blocks, op5_quality, score, train,
)
from tests.llm.brute import table

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = op5_quality(spark, FOLDER).collect()
    labels = dict(table(spark, FOLDER, "labels", "doc_id", "quality"))
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    good = np.array([r.score for r in held if labels[r.doc_id]])
    bad = np.array([r.score for r in held if not labels[r.doc_id]])
    auc = (good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2
    right = np.mean([r.predicted == labels[r.doc_id] for r in held])
    print("auc", auc, "accuracy", right)
    assert auc > 0.97 and right > 0.95


def test_fit_finds_the_order():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(500, 3))
    y = (x @ [2, -1, 0] + draw.normal(size=500) > -1).astype(int)
    found = fit(x, y, 5000)
    ranks = np.corrcoef(x @ found.weights, x @ [2, -1, 0])[0, 1]
    assert ranks > 0.99
    assert abs((found.score(x) < ACCEPT).mean() - (y == 0).mean()) < 0.02
    assert fit(x, np.ones(500)).score(x).min() == 1
    assert fit(x, np.zeros(500)).score(x).max() == 0


def test_edges(spark):
    texts = [(1, None), (2, ""), (3, "good words here"), (4, "a|b ### $$$"), (None, "x"),
             (3, "good words here"), (5, "long word " * 300_000), (6, "y" * 3_000_000)]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in texts],
                               "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, None), (None, 1), (99, 1), (1, 2)],
                                   "doc_id long, quality int")
    ranker = train(df, labels)
    rows = score(df, ranker).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in texts)
    empty = {r.score for r in rows if r.doc_id in (1, 2)}
    assert len(empty) == 1
    kept = accepted(df, ranker)
    assert kept.columns == df.columns
    assert kept.count() == sum(r.score >= ACCEPT for r in rows)
    assert score(df.limit(0), train(df, labels.limit(0))).count() == 0
    assert len(features(np.zeros(0, np.uint8))) == len(features(np.full(9, 65, np.uint8)))


def test_every_label_trains(spark, monkeypatch):
    """Each labelled text is owned by one block, and each block has both labels."""
    monkeypatch.setattr(op5_quality_module, "BLOCK", 16)
    monkeypatch.setattr(op5_quality_module, "OTHERS", 4)
    x = np.zeros((300, FEATURES), "<f4")
    x[:, 0] = np.arange(300)
    rows = spark.createDataFrame(
        [(k, int(k % 10 > 0), bytearray(x[k].tobytes())) for k in range(300)],
        "doc_id long, quality int, x binary")
    owned, blocks = [], _blocks(rows, 270, 30).collect()
    assert len(blocks) > 10
    for b in blocks:
        sides = [np.frombuffer(side, "<f4").reshape(-1, FEATURES)[:, 0]
                 for side in (b.good, b.bad)]
        assert len(sides[0]) and len(sides[1])
        owned += [*sides[0][:b.own_good], *sides[1][:b.own_bad]]
    assert sorted(owned) == list(range(300))


def test_blocks_give_the_local_fit(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(400, 3))
    y = (x @ [2, -1, 0] + draw.normal(size=400) > -1).astype(int)
    blocks = [Block(part[label == 1], part[label == 0],
                    (int((label == 1).sum()), int((label == 0).sum())))
              for part, label in zip(np.split(x, 4), np.split(y, 4))]
    counts = int((y == 1).sum()), int((y == 0).sum())
    here = fit_blocks(Blocks(blocks), *counts, 3, 10)
    there = fit_blocks(SharedBlocks(spark.sparkContext.parallelize(blocks, 3)), *counts, 3, 10)
    assert np.allclose(here.weights, there.weights)
    assert np.isclose(here.cut, there.cut) and here.slope == there.slope
    raw = x @ here.weights
    assert np.isclose(here.cut, np.quantile(raw, counts[1] / 400))


def test_texts_stay_where_they_are(spark):
    """One plan for few and many labels: descriptions move, texts do not."""
    docs = spark.createDataFrame(
        [(k, f"text {k} " * 5) for k in range(40)] + [(7, "again"), (None, "x"), (8, None)],
        "doc_id long, text string")
    labels = spark.createDataFrame(
        [(k, k % 2) for k in range(0, 40, 3)] + [(7, 1), (7, 0), (8, 1), (None, 1), (99, 1)],
        "doc_id long, quality int")
    rows = _training_rows(docs, labels)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert "text" not in "".join(
        line for line in plan.splitlines() if "Exchange" in line or "Sort [" in line)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(
        (i, y, features(np.frombuffer((t or "").encode(), np.uint8)).astype("<f4").tobytes())
        for i, t in texts for j, y in [tuple(r) for r in labels.collect()]
        if i is not None and i == j and zlib.crc32(str(i).encode()) % 4 != 2)
    assert sorted((r.doc_id, r.quality, bytes(r.x)) for r in rows.collect()) == want
    assert {y for i, y, _ in want if i == 7} == {0, 1} or zlib.crc32(b"7") % 4 == 2
