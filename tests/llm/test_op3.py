import hashlib
import random

import numpy as np
import pytest

from llm import op3_suffixes as op3
from llm.op3_suffixes import (
    decoded, front_coded, merge, op3_suffixes, removed, shared_prefixes,
)
from tests.llm.brute import table

FOLDER = "/root/testdata/sf0.01"


def brute(docs, length=400):
    seen = {}
    data = [(t or "").encode() for _, t in docs]
    for b in data:
        for at in range(len(b) - length + 1):
            w = hash(b[at:at + length])
            seen[w] = seen.get(w, 0) + 1
    out = []
    for (i, _), b in zip(docs, data, strict=True):
        gone = bytearray(len(b))
        for at in range(len(b) - length + 1):
            if seen[hash(b[at:at + length])] > 1:
                gone[at:at + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not p for p, g in zip(b"\0" + gone, gone))
        out.append((str(i), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def test_whole_table(spark):
    expected = brute(table(spark, FOLDER, "documents", "doc_id", "text"))
    assert any(r[2] for r in expected)
    assert got(op3_suffixes(spark, FOLDER)) == expected


def test_merge_of_runs():
    draw = random.Random(3)
    strings = [bytes(draw.choices(b"ab\0", k=draw.randrange(1, 9))) for _ in range(500)]
    for n in (1, 2, 3, 7):
        runs = []
        for k in range(n):
            entries = {}
            for s in strings[k::n]:
                entries.setdefault((s, s[::-1]), []).append(s.ljust(20, b"x"))
            runs.append(decoded(*front_coded(entries)))
        out = list(merge(runs))
        assert sorted(p for e in out for p in [e[1]] * (len(e[3]) // 20)) == sorted(strings)
        before = b""
        for shared, after, back, _ in out:
            assert after >= before and back == after[::-1]
            same = 0
            while same < min(len(after), len(before)) and after[same] == before[same]:
                same += 1
            assert shared == same
            before = after


def test_shared_prefixes():
    assert shared_prefixes([b"", b""]).tolist() == [0, 0]
    assert shared_prefixes([b"", b"a", b"a\0", b"ab", b"ab"]).tolist() == [0, 0, 1, 1, 2]


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    draw = random.Random(seed)
    pool = ["".join(draw.choices("abé \n", k=draw.randrange(3, 60))) for _ in range(8)]
    docs = [(k, "".join(draw.choices(pool, k=draw.randrange(0, 12)))
             + "".join(draw.choices("abcdefgh", k=draw.randrange(0, 40))))
            for k in range(60)]
    docs += [(3, docs[3][1]), (None, docs[5][1]), (None, None), (70, ""), (71, "a" * 300),
             (72, "ab" * 100 + "x" + "ab" * 90), (73, pool[0] * 9), (74, "q" * 21)]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs],
                               "doc_id long, text string, size int")
    assert got(removed(df, 20, 9)) == brute(docs, 20)
    assert got(removed(df, 20, 9, hot=3)) == brute(docs, 20)


def test_long_and_empty(spark):
    draw = random.Random(9)
    long = "".join(draw.choices("abcdefghij", k=1_200_000))
    docs = [(1, long), (2, long[1_048_000:1_049_500] + "tail"), (3, "z" * 399)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r for r in removed(df).collect()}
    assert [(rows[k].n_removed, rows[k].n_spans) for k in (1, 2, 3)] == [
        (1500, 1), (1500, 1), (0, 0)]
    assert removed(df.limit(0)).count() == 0


def test_passages_of_over_50_words_go_by_their_bytes(spark):
    """60 words that stand in two documents go from both if they have 400 bytes."""
    draw = random.Random(60)
    docs, sizes = [], (310, 394, 399, 400, 401, 520)
    for k, size in enumerate(sizes):
        letters = draw.choices("abcdefgh", k=size)
        for at in sorted(draw.sample(range(1, size // 2), 59)):
            letters[2 * at] = " "
        passage = "".join(letters)
        assert len(passage.split()) == 60 and len(passage.encode()) == size
        docs += [(2 * k + j, f"{own * 90}{passage}{own * 70}")
                 for j, own in enumerate((f"x{k}x", f"y{k}y"))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(removed(df)) == brute(docs)
    cut = {r.doc_id: r.n_removed for r in removed(df).collect()}
    for k, size in enumerate(sizes):
        gone = size if size >= 400 else 0
        assert (cut[2 * k], cut[2 * k + 1]) == (gone, gone), size


def test_parts_grow_with_the_input(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert op3.parts_for(spark, 0) == op3.parts_for(spark, 10_000) == least
    assert op3.parts_for(spark, 10**8) == 400 and op3.parts_for(spark, 2 * 10**8) == 800


def test_parts_and_frequent_anchors_change_nothing(spark, monkeypatch):
    """Many small parts, and every anchor's rows broadcast or joined."""
    rng = np.random.default_rng(12)
    passage = "".join(rng.choice(list("abcdefgh "), 900))
    docs = [(i, "".join(rng.choice(list("ijklmnop "), rng.integers(0, 500)))
             + (passage if i % 3 else passage[200:700]) + f" {i}") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    plain = sorted(map(tuple, removed(df).collect()))
    for many, places in ((1, 5), (10**9, 50)):
        monkeypatch.setattr(op3, "MANY", many)
        monkeypatch.setattr(op3, "PART_PLACES", places)
        assert sorted(map(tuple, removed(df).collect())) == plain
    assert any(r[2] for r in plain)
