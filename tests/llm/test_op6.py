import math

import numpy as np

from llm import op6_permutation as op6
from llm.op6_permutation import op6_permutation, search, valid_vectors
from tests.llm.brute import table


def brute(rows, k=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = []
    for q in np.flatnonzero(ids % 20 == 0):
        scores = (x * x[q]).sum(1)
        keep = np.flatnonzero(ids != ids[q])
        best = keep[np.lexsort((ids[keep], -scores[keep]))][:k]
        out += [(int(ids[q]), n + 1, int(ids[b]), scores[b]) for n, b in enumerate(best)]
    return out


def same(got, expected):
    got, expected = sorted(map(tuple, got)), sorted(expected)
    assert [r[:3] for r in got] == [r[:3] for r in expected]
    assert all(math.isclose(a[3], b[3], abs_tol=1e-12)
               for a, b in zip(got, expected, strict=True))


def test_small_table_is_exact(spark):
    folder = "/root/testdata/sf0.01"
    same(op6_permutation(spark, folder).collect(),
         brute(table(spark, folder, "embeddings", "vec_id", "embedding")))


def test_recall(spark):
    """A quarter of the vectors are ranked again, in blocks."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = valid_vectors(df)
    got = search(vectors, vectors.where("vec_id % 20 = 0"), least=500, share=0.0,
                 block=700).collect()
    expected = brute([(r.vec_id, r.embedding) for r in df.collect()])
    found = {(r.query_id, r.vec_id) for r in got}
    assert sum((q, v) in found for q, _, v, _ in expected) >= 0.9 * len(expected)
    assert len(got) == len(expected)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [3.0, 4.0]), (20, [3.0, 4.0]), (1, [0.0, 0.0]),
            (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []),
            (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (40, [0.0, 0.0])]
    rows += [(100 + i, [1.0, 1.0]) for i in range(1, 40)] + [(60, [-5.0, 0.5])]
    df = spark.createDataFrame([(*r, "x") for r in rows],
                               "vec_id long, embedding array<double>, rank string")
    vectors = valid_vectors(df)
    asked = vectors.where("vec_id % 20 = 0")
    kept = [(0, [1.0, 0.0]), (20, [3.0, 4.0]), (60, [-5.0, 0.5])]
    kept += [(100 + i, [1.0, 1.0]) for i in range(1, 40)]
    same(search(vectors, asked).collect(), brute(kept))
    same(search(vectors, asked, block=7).collect(), brute(kept))
    assert search(vectors.limit(0), asked).count() == 0
    assert search(vectors, asked.limit(0)).count() == 0


def test_huge_and_tiny_components(spark):
    """The order of pivots does not depend on the size of the numbers."""
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 8)))]
    for scale in (2.0 ** 480, 2.0 ** -480):
        df = spark.createDataFrame([(i, [x * scale for x in v]) for i, v in rows],
                                   "vec_id long, embedding array<double>")
        vectors = valid_vectors(df)
        got = search(vectors, vectors.where("vec_id % 20 = 0"), least=150, share=0.0).collect()
        found = {(r.query_id, r.vec_id) for r in got}
        expected = brute(rows)
        assert sum((q, v) in found for q, _, v, _ in expected) >= 0.9 * len(expected)


def test_shuffled_rows_follow_the_input():
    """Vectors meet all queries of 8,192 at once: copies of a vector are few."""
    rows = []
    for n in (10_000, 50_000):
        asked = n // 20
        rows.append(n * -(-asked // op6.QUERIES) + asked * -(-n // op6.BLOCK))
    assert rows[1] / rows[0] < 5 ** 1.25
