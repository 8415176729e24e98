"""Each stage of the pipeline against a brute-force version, on its own input."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from llm.op5_quality import ACCEPT, features, train
from tests.llm import test_op1, test_op2, test_op8, test_op10
from tests.llm.brute import table

FOLDER = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage, written and read as Parquet."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{name}")
        result = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs, result
        docs = result
    return out


def test_order_and_columns(stages):
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "secrets",
                            "packing"]
    assert all(stages[n][1].columns == COLUMNS for n in list(stages)[:-1])


def test_quality(spark, stages):
    before, after = stages["quality"]
    ranker = train(before, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    expected = [r for r in rows(before) if ranker.score(np.array([features(
        np.frombuffer((r[1] or "").encode(), np.uint8))]))[0] >= ACCEPT]
    assert Counter(rows(after)) == Counter(expected)
    assert 0 < len(expected) < before.count()


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    kept = {i for i, _, _, stays in test_op10.brute(
        [r[:2] for r in rows(before)], 80) if stays}
    assert Counter(rows(after)) == Counter(r for r in rows(before) if r[0] in kept)
    assert after.count() < before.count()


def test_near_duplicates_of_repeated_rows(spark):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (2, "other"),
            (3, None), (3, None), (3, ""), (None, "a b c d e f"), (None, "alone"),
            (1, "a  b c d e f")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs],
                               "doc_id long, text string, _many string")
    df = df.withColumnRenamed("_many", "kept")
    got = Counter(r[:2] for r in rows(corpus_pipeline.deduplicated(spark, df, FOLDER)))
    first = [k for k in got if k[0] == 1]
    assert len(first) == 1 and got.pop(first[0]) == 1
    assert got == Counter([(2, "other"), (3, None), (3, None), (3, ""), (None, "alone")])


def test_near_duplicates_keep_one_row_of_each_group(spark):
    base = [f"w{i}" for i in range(120)]
    near = [" ".join([*base[k:], "new"]) for k in range(3)]
    other = " ".join(f"v{i}" for i in range(30))
    docs = [(4, near[0]), (4, other), (4, other), (9, near[1]), (None, "a b"), (None, "a b"),
            (None, "c d e f g h"), (None, None), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert Counter(rows(corpus_pipeline.deduplicated(spark, df, FOLDER))) == Counter(
        [(4, near[0]), (4, other), (None, "a b"), (None, "c d e f g h"), (None, None),
         (None, None)])
    lost = spark.createDataFrame([(None, t) for t in near], "doc_id long, text string")
    assert len(rows(corpus_pipeline.deduplicated(spark, lost, FOLDER))) == 1


def test_decontamination(spark, stages):
    before, after = stages["decontamination"]
    bad = {r[0] for r in test_op1.brute(
        [r[:2] for r in rows(before)],
        table(spark, FOLDER, "benchmark", "item_id", "text")) if r[5]}
    assert Counter(rows(after)) == Counter(r for r in rows(before) if r[0] not in bad)


def test_secrets(stages):
    before, after = ({r[0]: r for r in rows(d)} for d in stages["secrets"])
    assert before.keys() == after.keys()
    changed = 0
    for i, r in before.items():
        assert not test_op8.base(after[i][1])
        if not test_op8.base(r[1]) and r != after[i]:
            assert "[SECRET]" in after[i][1]
        if r != after[i]:
            changed += 1
            assert after[i][4] == len(after[i][1]) and after[i][2:4] == r[2:4]
    assert changed


def test_packing(stages):
    before, after = stages["packing"]
    test_op2.check(after.collect(), [r[:2] for r in rows(before)])


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER)
    columns = ["doc_id", "start", "length", "doc_tokens"]
    total = {r.doc_id: r.doc_tokens for r in got.select(*columns).collect()}
    expected = {r.doc_id: r.doc_tokens
                for r in stages["packing"][1].select(*columns).collect()}
    assert total == expected
