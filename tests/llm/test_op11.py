import random
import re
from collections import Counter

import pytest

from llm import op11_divergence as op11
from llm.op11_divergence import (
    group_totals,
    op11_divergence,
    pair_divergences,
    ranked,
    term_counts,
    term_divergences,
)
from tests.llm.brute import lower, table

FOLDER = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audited(rows):
    """The result for rows (lang, source, text), restated term by term."""
    groups, docs = {}, {}
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall(lower(text or ""))
        groups.setdefault(lang, {}).setdefault(source, Counter()).update(found)
        docs.setdefault(lang, Counter()).update(set(found))
    out = set()
    for lang, own in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= 3)
        whole = {s: {t: c[t] for t in kept} for s, c in own.items()}
        whole[None] = {t: sum(c[t] for c in own.values()) for t in kept}
        share = {s: {t: 1 + 10**9 * (n + 1) // (sum(c.values()) + len(kept))
                     for t, n in c.items()} for s, c in whole.items()}
        q = share.pop(None)
        for s, p in share.items():
            pairs = [(sum((p[t] - o[t]) ** 2 // o[t] for t in kept), other)
                     for other, o in share.items() if other != s]
            terms = [((p[t] - q[t]) ** 2 // q[t], t) for t in kept
                     if whole[s][t] > 0 and p[t] > q[t]]
            for part, values, top in (("pair", pairs, None), ("term", terms, 200)):
                order = sorted(values, key=lambda v: (-v[0], v[1].encode()))[:top]
                out |= {(lang, s, part, item, value, rank)
                        for rank, (value, item) in enumerate(order, 1)}
    return out


def result(df, **cells):
    counts = term_counts(df)
    groups = group_totals(counts)
    rows = ranked(pair_divergences(counts, groups, **cells), "pair").unionByName(
        ranked(term_divergences(counts, groups), "term", 200)).collect()
    found = {tuple(r) for r in rows}
    assert len(found) == len(rows)
    return found


def test_whole_table(spark):
    found = op11_divergence(spark, FOLDER).collect()
    wanted = audited(table(spark, FOLDER, "documents", "lang", "source", "text"))
    assert len(found) == len(wanted) and {tuple(r) for r in found} == wanted


def corpus(groups, docs, seed):
    rng = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)] + ["ß", "日本", "Ä"]
    return [("xx", f"s{rng.randrange(groups)}" if rng.random() < 0.7 else "s0",
             " ".join(rng.choices(words, k=rng.randrange(30)))) for _ in range(docs)]


def test_many_cells(spark):
    """Several blocks on all three axes, a hot source."""
    rows = corpus(17, 600, 3)
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert result(df.repartition(5), block=3, terms=50) == audited(rows)


def test_edges(spark):
    rows = [(None, None, None), ("", "", "a b c"), (None, "s", "a a"), ("", "s", "A,a-B"),
            ("de", None, ""), ("de", "x", "nur einmal"), ("one", "only", "t t t"),
            ("one", "only", "t"), ("one", "only", "T! u"), ("tie", "a", "k"),
            ("tie", "b", "k"), ("tie", "c", "k"), ("tie", "c", "k" * 9), ("tie", "d", "1 2"),
            ("long", "a", "lang " * 300_000), ("long", "b", "x" * 3_000_000),
            ("long", "c", "lang x"), ("long", "c", "lang x"), ("long", "c", "lang x")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows],
                               "lang string, source string, text string, term string, n int")
    assert result(df) == audited(rows)
    assert result(df.limit(0)) == set()
    assert result(df.union(df).union(df)) == audited(rows * 3)


def test_tables_of_bounded_size(monkeypatch):
    """A task passes its counts on and starts again; the sums stay the same."""
    import pyarrow as pa
    rows = corpus(4, 300, 8)
    batch = pa.RecordBatch.from_pylist(
        [dict(zip(("lang", "source", "text"), r, strict=True)) for r in rows])
    sums = []
    for held, step in ((10**9, 1 << 20), (40, 200)):
        monkeypatch.setattr(op11, "HELD", held)
        monkeypatch.setattr(op11, "STEP_BYTES", step)
        total, batches = Counter(), list(op11._count(iter([batch])))
        assert max(b.num_rows for b in batches) < 500 or held > 40
        for b in batches:
            for r in b.to_pylist():
                total[r["lang"], r["source"], r["term"]] += r["n"]
        sums.append((total, len(batches)))
    assert sums[0][0] == sums[1][0] and sums[0][1] == 1 and sums[1][1] > 10


@pytest.mark.parametrize("count", [0, 10**10, 10**12])
def test_shares_are_exact(spark, count):
    row = spark.createDataFrame([(count, 3 * 10**12, 7)], "n long, total long, v long").select(
        op11._share(op11.F.col("n"), "total", "v").alias("p")).first()
    assert row.p == 1 + 10**9 * (count + 1) // (3 * 10**12 + 7)
