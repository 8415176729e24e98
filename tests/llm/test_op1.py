import hashlib
import re

import pytest

from llm.op1_decontaminate import clean, find_hits, op1_decontaminate
from tests.llm.brute import lower, table

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(lower(text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for at in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[at:at + 13]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for at in range(len(w) - size + 1):
                owners = windows.get(tuple(w[at:at + size]))
                if owners:
                    hit.update(range(at, at + size))
                    found |= {str(o) for o in owners if o is not None}
        out.append((doc_id, len(w), len(hit), len(found),
                    hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_whole_table(spark):
    found = op1_decontaminate(spark, FOLDER).collect()
    expected = brute(table(spark, FOLDER, "documents", "doc_id", "text"),
                     table(spark, FOLDER, "benchmark", "item_id", "text"))
    assert sorted(map(tuple, found), key=str) == expected
    assert any(r.contaminated for r in found)


@pytest.mark.parametrize("block_bytes", [1 << 19, 40])
def test_edges(spark, block_bytes):
    long = " ".join(f"w{i}" for i in range(20))
    items = [(1, long), (2, "Short, ITEM é"), (3, None), (4, "?!"), (None, "gone"), (None, "lost words"),
             (5, "w1 w2"), (5, "w1 w2"), (10, "short item é")]
    docs = [(1, None), (2, ""), (3, "..."), (4, "a short-item É."), (5, "a short item é"),
            (6, long.upper()), (6, long.upper()), (None, "x w1, w2 y " * 3),
            (7, "ä" * 50 + " w1\nw2 z\n" + " ".join(f"W{i}" for i in range(3, 16))),
            (8, "x " * 200 + "w1 w2"), (9, "some Lost words here"),
            (11, "w1 w2 lost words " + "z" * 100_000 + " y" * 300_000)]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs],
                              "doc_id long, text string, hits string")
    b = spark.createDataFrame(items, "item_id long, text string")
    hits = find_hits(d, b, block_bytes=block_bytes).collect()
    expected = brute(docs, items)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(
        ",".join(r["items"]).encode()).hexdigest(),
        r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in hits), key=str)
    assert got == expected
    for r in hits:
        text = dict(docs)[r.doc_id] or ""
        for span, hit in zip(r.spans, r.hits, strict=True):
            assert words(text[span.start:span.end]) == words(text)[hit.first:hit.last + 1]
    stay = clean(d, b).collect()
    bad = [r[0] for r in expected if r[5]]
    assert sorted(str(r.doc_id) for r in stay) == sorted(
        str(i) for i, _ in docs if i not in bad)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert find_hits(d, b).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert find_hits(one, b).first().n_words == 2


def test_clean_drops_hits_of_items_without_id(spark):
    words = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, words), (2, "free of it")], "doc_id long, text string")
    items = spark.createDataFrame([(None, words), ("a", "other words entirely")],
                                  "item_id string, text string")
    assert [r.doc_id for r in clean(docs, items).collect()] == [2]
