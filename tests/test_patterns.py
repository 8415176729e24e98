import numpy as np
import pyarrow as pa
import pytest

from barweave.operators import patterns
from barweave.sources import library as stored
from barweave.sources.files import read_bar_files
from tests.helpers import GOLDEN, bars, frame, needs_golden, walk


def brute(closes, query, window, k):
    """The plain loop: every window, one global greedy pass."""
    rows = []
    for symbol, c in sorted(closes.items()):
        kept = 0
        for end in range(window, len(c) - 20, 5):
            w = np.asarray(c[end - window:end], float)
            if w.std() < 1e-9:
                continue
            z = (w - w.mean()) / w.std()
            rows.append((symbol, kept, z, np.asarray(c[end:end + 20]) / c[end - 1] - 1))
            kept += 1
    zq = (query - query.mean()) / query.std()
    sims = [float(z @ zq / window) for _, _, z, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (-sims[i], rows[i][0], -rows[i][1]))
    gap, chosen = max(1, window // 10), []
    for i in order:
        if len(chosen) < k and all(
                rows[i][0] != rows[j][0] or abs(rows[i][1] - rows[j][1]) >= gap
                for j in chosen):
            chosen.append(i)
    return [(rows[i][0], rows[i][1], round(sims[i], 9), round(rows[i][3][-1], 9))
            for i in chosen]


def test_search_equals_plain_loop(spark):
    """One symbol holds most windows, over several segments, partly flat."""
    hot = walk(1, 5000)
    hot[1000:1200] = hot[1000]
    closes = {"hot": hot, "b": walk(2, 300), "c": walk(3, 81), "d": walk(4, 80)}
    panel = bars(spark, *[frame(s, c) for s, c in closes.items()])
    library = patterns.build_library(panel)
    counts = {r.symbol: r["count"] for r in library.groupBy("symbol").count().collect()}
    assert counts["c"] == 1 and "d" not in counts
    query = walk(9, 45)
    shape = spark.createDataFrame([("q", query.tolist())], "query_id string, q array<double>")
    stretched = np.interp(np.linspace(0, 44, 60), np.arange(45), query)
    got = patterns.find_similar(library, shape, k=120).orderBy("rank").collect()
    want = brute(closes, stretched, 60, 120)
    assert [(r.symbol, r.widx, round(r.sim, 9), round(r.fut[-1], 9)) for r in got] == want


@needs_golden
def test_real_bars(spark):
    raw = read_bar_files(spark, str(GOLDEN / "raw"))
    library = patterns.build_library(raw)
    assert library.count() == 664
    chosen = patterns.find_similar(library, patterns.query_shape(raw, ["GEV"]), k=50)
    top = patterns.matches(chosen).orderBy("rank").limit(3).collect()
    assert [(r.symbol, r.end_date, r.similarity) for r in top] == [
        ("9023.T", "2025-01-29", 66.7), ("SOLV", "2025-12-03", 61.0),
        ("VLTO", "2025-05-15", 59.8)]
    stats = {r.h: r for r in patterns.horizon_stats(chosen).collect()}
    assert [round(stats[h].p_up, 2) for h in (5, 10, 20)] == [0.6, 0.7, 0.66]
    assert round(stats[20]["median"], 6) == 0.044967


def test_too_few_matches_or_flat_query_give_nothing(spark):
    library = patterns.build_library(bars(spark, frame("a", walk(1, 120))))
    shapes = spark.createDataFrame(
        [("few", walk(2, 60).tolist()), ("flat", [1.0] * 60)],
        "query_id string, q array<double>")
    assert patterns.find_similar(library, shapes).count() == 0


def test_many_queries(spark, monkeypatch):
    """Several lots and pieces give what each query gives alone."""
    monkeypatch.setattr(patterns, "LOT", 40)
    monkeypatch.setattr(patterns, "PIECE_ROWS", 900)
    panel = bars(spark, *[frame(f"s{i}", walk(i, 140)) for i in range(300)])
    library = patterns.build_library(panel)
    shapes = patterns.last_shapes(panel)
    assert shapes.count() == 300
    found = patterns.find_similar(library, shapes, k=12)
    got = {}
    for row in found.select("query_id", "rank", "symbol", "widx").collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.symbol, row.widx))
    assert len(got) == 300
    closes = {f"s{i}": walk(i, 140) for i in range(300)}
    for name in ("s0", "s7", "s299"):
        want = brute(closes, closes[name][-60:], 60, 12)
        assert [r[1:] for r in sorted(got[name])] == [w[:2] for w in want]


def test_few_pairs_are_compared_and_none_is_lost():
    """Bounds leave a small part of the pairs; the best ones are the brute-force ones."""
    rng = np.random.default_rng(4)
    paths = np.cumsum(rng.normal(size=(5040, 60)), axis=1)
    paths[100:110] = paths[90]  # ties
    x = (paths - paths.mean(1, keepdims=True)) / paths.std(1, keepdims=True)
    x, z = x[:5000], x[5000:]
    i, q, products, compared = patterns.nearest(x, z, 50)
    assert compared < 0.1 * len(x) * len(z)
    whole = np.array([(x * row).sum(1) for row in z])
    for k in range(len(z)):
        want = np.lexsort((np.arange(len(x)), -whole[k]))[:50]
        assert i[q == k].tolist() == want.tolist()
        assert products[q == k].tolist() == whole[k][want].tolist()
    barred = rng.random((len(x), len(z))) < 0.5
    i, q, _, _ = patterns.nearest(x, z, 50, barred)
    assert len(i) == 50 * len(z) and not barred[i, q].any()
    assert len(patterns.nearest(x[:7], z, 50)[0]) == 7 * len(z)
    assert len(patterns.nearest(x[:7], z, 50, barred[:7] | True)[0]) == 0


def test_own_windows_can_be_left_out(spark):
    closes = {"a": walk(1, 400), "b": walk(2, 400)}
    panel = bars(spark, *[frame(s, c) for s, c in closes.items()])
    library = patterns.build_library(panel)
    shapes = patterns.query_shape(panel, ["a"]).unionByName(spark.createDataFrame(
        [("drawn", walk(3, 60).tolist())], "query_id string, q array<double>"),
        allowMissingColumns=True)
    found = patterns.find_similar(library, shapes, k=30).collect()
    apart = patterns.find_similar(library, shapes, k=30, exclude_self=True).collect()
    first = shapes.where("query_id = 'a'").first().from_date
    own = {(r.symbol, r.widx) for r in library.collect()
           if r.symbol == "a" and r.end_date >= first}
    assert own and any((r.symbol, r.widx) in own for r in found if r.query_id == "a")
    assert not any((r.symbol, r.widx) in own for r in apart if r.query_id == "a")
    assert ([r for r in found if r.query_id == "drawn"]
            == [r for r in apart if r.query_id == "drawn"] != [])


def test_library_grows_to_the_full_build(spark, tmp_path, monkeypatch):
    """Bars come in steps: single days, new symbols, a symbol that stops."""
    flat = walk(1, 300)
    flat[100:180] = 7.0
    frames = {"a": frame("a", flat), "b": frame("b", walk(2, 150)),
              "new": frame("new", walk(3, 200), start="2020-06-01"),
              "short": frame("short", walk(4, 70))}
    panel = bars(spark, *frames.values())
    path = str(tmp_path / "library")
    days = ["2020-03-25", "2020-03-26", "2020-03-27", "2020-07-01", "2020-07-01", "2021-12-31"]
    for day in days:
        stored.grow_library(panel.where(f"date <= DATE'{day}'"), path)
    assert stored.generation(spark, path) == len(days)
    grown = {(r.symbol, r.widx): r for r in stored.read_library(spark, path).collect()}
    whole = {(r.symbol, r.widx): r for r in patterns.build_library(panel).collect()}
    assert grown.keys() == whole.keys() and len(whole) > 60
    for key, row in whole.items():
        assert (row.end_date, row.x, row.fut) == (
            grown[key].end_date, grown[key].x, grown[key].fut)
    with pytest.raises(ValueError, match="sizes"):
        stored.grow_library(panel, path, window=30)


def test_long_symbols_are_cut_once_in_order(spark, monkeypatch):
    """Several segments of one symbol: ordinals go on, flat windows are not counted."""
    closes = walk(5, 4700)
    closes[2000:2200] = closes[2000]
    rows = patterns.build_library(bars(spark, frame("s", closes))).orderBy("end_date").collect()
    assert [r.widx for r in rows] == list(range(len(rows)))


def test_long_shapes_are_scaled_once(spark):
    """The cost of a shape is that of its points, not of their cube."""
    q = walk(3, 2000)
    shapes = spark.createDataFrame(
        [("q", q.tolist()), ("flat", [1.0] * 2000)], "query_id string, q array<double>")
    (row,) = patterns.prepare_queries(shapes, 2000).collect()
    assert np.allclose(row.zq, (q - q.mean()) / q.std())


def test_few_queries_are_sent_to_the_library(spark, monkeypatch):
    """Windows stay where they lie and are read in batches; ties of different batches and
    parts are those of the dealt search."""
    closes = {f"s{i}": walk(i % 4, 260) for i in range(12)}
    panel = bars(spark, *[frame(s, c) for s, c in closes.items()])
    library = patterns.build_library(panel).repartition(3, "widx").cache()
    shapes = patterns.query_shape(panel, ["s1", "s5"]).unionByName(spark.createDataFrame(
        [("drawn", walk(77, 60).tolist())], "query_id string, q array<double>"),
        allowMissingColumns=True)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {}
        for way in ("sent", "dealt"):
            if way == "dealt":
                monkeypatch.setattr(patterns, "_few", lambda shapes: None)
            for apart in (False, True):
                best = patterns.best_windows(library, shapes, 60, 40, apart)
                plan = best._jdf.queryExecution().optimizedPlan().toString()
                assert ("CoGroup" in plan) == (way == "dealt")
                got[way, apart] = sorted(map(tuple, best.collect()))
                chosen = patterns.find_similar(library, shapes, k=12, exclude_self=apart)
                got[way, apart] += sorted(
                    (r.query_id, r["rank"], r.symbol, r.widx, r.sim, tuple(r.fut))
                    for r in chosen.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    for apart in (False, True):
        assert got["sent", apart] == got["dealt", apart]
        assert len(got["sent", apart]) > 3 * 40


def test_a_task_keeps_the_best_windows_only():
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(20_000, 60))
    x = (rows - rows.mean(1, keepdims=True)) / rows.std(1, keepdims=True)
    shapes = pa.table({"query_id": ["a", "b"], "zq": x[:2].tolist()})
    best, held = patterns._Best(shapes, 50), 0
    for at in range(0, len(x), 500):
        best.add(pa.table({
            "symbol": ["s"] * 500, "widx": np.arange(at, at + 500),
            "end_date": np.arange(at, at + 500), "x": x[at:at + 500].tolist()}))
        held = max(held, len(best.rows))
    assert held <= 3 * 2 * 50
    kept = best.settle().to_pydict()
    for k in (0, 1):
        want = np.argsort(-(x * x[k]).sum(1), kind="stable")[:50]
        assert [w for w, q in zip(kept["widx"], kept["q"]) if q == k] == want.tolist()
