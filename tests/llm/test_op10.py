import itertools
import re

import pytest
from pyspark.sql import functions as F

from llm.op10_minhash import linked, near_duplicates, op10_minhash
from tests.llm.brute import lower

FOLDER = "/root/testdata/sf0.01"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute(rows, least=85):
    """component_id by comparing all pairs; linked are similarities of `least` percent."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if min(len(sets[a]), len(sets[b])) * 100 >= least * max(
                len(sets[a]), len(sets[b])) > 0:
            both = len(sets[a] & sets[b])
            if 100 * both >= least * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    lowest = {}
    for k, (i, _) in enumerate(rows):
        lowest[find(k)] = min(lowest.get(find(k), i), i)
    return sorted((i, len(sets[k]), lowest[find(k)], i == lowest[find(k)])
                  for k, (i, _) in enumerate(rows))


def got(df):
    return sorted(tuple(r) for r in df.drop("text_hash").collect())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(op10_minhash(spark, FOLDER)) == brute(rows)


@pytest.mark.parametrize("block", [3, 1024])
def test_edges(spark, block):
    base = " ".join(f"w{i}" for i in range(120))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c"),
            (7, base), (8, base), (7, base), (9, base + " more"),
            (10, base.replace("w60", "x")), (11, base.replace("w30", "y")),
            (12, base.replace("w60", "x").replace("w30", "y").replace("w90", "z")),
            (13, "ÉA été " * 40), (14, "Éa été " * 40), (15, "éa été " * 40)]
    rows += [(100 + i, base.replace(f"w{i} ", f"v{i} ")) for i in range(1, 60, 5)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows],
                               "doc_id long, text string, key string")
    assert got(near_duplicates(df, block=block)) == brute(rows)


def test_empty_and_no_id(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert got(near_duplicates(empty)) == []
    rows = spark.createDataFrame([(None, "a b"), (3, "a b"), (None, "only this")],
                                 "doc_id long, text string")
    found = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(rows).collect()}
    assert found == {(None, 3, False), (3, 3, True), (None, None, True)}


def test_near_copies_without_ids_and_shared_ids(spark):
    """Near copies that all lack ids are linked, unrelated texts under one id are not."""
    base = [f"w{i}" for i in range(120)]
    near = [" ".join([*base[k:], "new"]) for k in range(3)]
    rows = [(None, t) for t in near] + [(5, f"{near[0]} end")]
    rows += [(7, " ".join(f"u{k}x{i}" for i in range(30))) for k in range(40)]
    rows += [(7, " ".join(f"u{k}x{i}" for i in range(30)) + " more") for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = linked(df).join(df.withColumn("text_hash", F.xxhash64("text")).drop("doc_id"),
                          "text_hash").collect()
    root = {r.text: r.root for r in out}
    assert len({root[t] for _, t in rows[:4]}) == 1
    assert {r.component_id for r in out if r.text in near} == {5}
    assert all(root[rows[4 + k][1]] == root[rows[44 + k][1]] for k in range(3))
    assert len(set(root.values())) == 41
    alone = linked(df.where("doc_id is null")).collect()
    assert len(alone) == 3 and len({r.root for r in alone}) == 1
    assert {r.component_id for r in alone} == {None}
