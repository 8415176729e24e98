import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from llm import op9_suffix_tree as op9
from llm.op9_suffix_tree import as_slice, fit, op9_suffix_tree, score
from tests.llm.brute import lower, table

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(lower(text or "")), None]


def brute(docs, held):
    c = Counter(w for i, t in docs if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {(i, k): (held(i), len(w), sum(c[x] > 0 for x in w), n,
                     sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
            for k, (i, t) in enumerate(docs) for w in [tokens(t)]}


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def test_whole_table(spark):
    docs = table(spark, FOLDER, "documents", "doc_id", "text")
    expected = {i: r for (i, _), r in brute(docs, held).items()}
    rows = op9_suffix_tree(spark, FOLDER).collect()
    assert len(rows) == len(docs)
    for r in rows:
        e = expected[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == e[:4]
        assert math.isclose(r.base_score, e[4], rel_tol=1e-9)


def test_beats_the_base_on_unseen_texts(spark):
    rows = op9_suffix_tree(spark, "/root/testdata/sf0.1").where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_distributions_sum_to_one(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    tree = fit(docs)[0].tree
    assert all(len(s[0]) for s in tree.states[1:])
    contexts = [b"\n\n\n\n\n\n", b" ation", b"zzzzzz", b" the t", "ción ".encode()]
    for context in contexts:
        code = int.from_bytes(context, "big") << 8
        codes = np.arange(code, code + 256, dtype=np.uint64)
        assert math.isclose((10 ** tree._walk(codes)).sum(), 1, rel_tol=1e-9)
        assert np.allclose(tree.log10(codes), tree._walk(codes), atol=1e-5)
    for depth in range(2, len(tree.states)):
        mask = np.uint64((1 << 8 * (depth - 1)) - 1)
        assert np.isin(tree.states[depth][0] & mask, tree.states[depth - 1][0]).all()


def test_codes():
    part = as_slice([b"Ab", None or b"", b" c\td "])
    head = b"\n" * op9.DEPTH
    assert bytes(part.stream) == head + b"ab\n" + head + b"\n" + head + b"c d\n"
    low = [bytes([int(c) & 255]) for c in part.codes()]
    assert low == [b"a", b"b", b"\n", b"\n", b"c", b" ", b"d", b"\n"]
    assert int(part.codes()[1]).to_bytes(7, "big") == b"\n\n\n\n\nab"


@pytest.mark.parametrize("share", [2e-7, 0.2])
def test_edges(spark, monkeypatch, share):
    """Frequent words are looked up, the others joined; both ways give the same."""
    monkeypatch.setattr(op9, "WORD_SHARE", share)
    docs = [(1, None), (2, ""), (3, "A a\x00b é É\n\n a"), (None, "a x"), (None, "a x"),
            (4, "new words " * 3000), (5, "a"), (6, "\x1c a\x0b")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs],
                               "doc_id long, text string, n_tokens int")
    train = df.where("doc_id <> 4")
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens,
                  round(r.base_score, 9)) for r in score(df, train).collect())
    expected = sorted((str(i), *r[1:4], round(r[4], 9)) for (i, _), r in
                      brute(docs, lambda i: i in (4, None)).items())
    assert got == expected
    untrained = score(df, df.limit(0)).collect()
    assert all(r.n_known == 0 and r.base_score == 0 for r in untrained)
    assert math.isclose(next(r.score for r in untrained if r.doc_id == 5),
                        2 * math.log10(1 / 256))
    assert score(df.limit(0), df).count() == 0


def scores(df, training):
    return sorted((r.doc_id, round(r.score, 6)) for r in score(df, training).collect())


def test_tree_in_parts_gives_the_same(spark, monkeypatch):
    """Beyond WHOLE grams parts are built in Spark and positions beyond HOT are joined."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(300)
    training = docs.where(~op9.held_out())
    expected = scores(docs, training)
    monkeypatch.setattr(op9, "WHOLE", 5000)
    monkeypatch.setattr(op9, "PART", 3000)
    monkeypatch.setattr(op9, "HOT", 2000)
    model = fit(training)[0]
    assert model.tree is None and 0 < len(model.known.codes) <= 2000
    assert scores(docs, training) == expected


def test_kept_grams_do_not_depend_on_the_corpus():
    """A context of 40 occurrences stays a state when other text is added."""
    stream = np.random.default_rng(1).integers(97, 123, (400_000, 7))
    codes = np.zeros(len(stream), np.uint64)
    for k in range(7):
        codes = codes << np.uint64(8) | stream[:, k].astype(np.uint64)
    own = int.from_bytes(b"qxzjkva", "big")
    keys, counts = op9.tally(np.append(codes, np.full(40, own, np.uint64)))
    # the other grams as often as in a corpus 1,000 times as large
    tree = op9.Tree(op9.levels_of(keys, np.where(keys == own, counts, counts * 1000), 0))
    names = [(own >> 8) & ((1 << 8 * d) - 1) for d in range(7)]
    assert any((tree.states[d][0] == names[d]).any() for d in (4, 5, 6))
    assert tree.log10(np.array([own], np.uint64))[0] > math.log10(0.5)
