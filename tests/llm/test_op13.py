import hashlib
import random
import zlib

import pytest

from llm import op13_prefix_trie as op13
from llm.op13_prefix_trie import op13_prefix_trie, prefix_trie, rebuilt
from tests.llm.brute import table

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"


def sequences(rows):
    """The rebuilt conversations of rows (conv_id, turn, role, text)."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", (text or "")
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(conv, []).append(
                ((turn is not None, turn or 0, role, digest), (role, text)))
    own = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = int(c - (abs(c) % 5) * (1 if c >= 0 else -1))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def trie(rebuilt_sequences):
    """All nodes, each worked out from the sequences that start with it."""
    members = {}
    for c, turns in rebuilt_sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), set()).add(c)
    below = {}
    for node in members:
        for d in range(len(node) + 1):
            below.setdefault(node[:d], []).append(node)
    kids = {}
    for node in members:
        if node:
            kids[node[:-1]] = kids.get(node[:-1], 0) + 1
    out = []
    for node, convs in members.items():
        ends = sorted(c for c in convs if len(rebuilt_sequences[c]) == len(node))
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below[node] if n)
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None,
                    len(convs), kids.get(node, 0),
                    sum(n not in kids for n in below[node]), saved,
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[1], r[0]))


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", pos int").repartition(5)
    assert found(prefix_trie(*rebuilt(df))) == trie(sequences(rows))


def test_whole_table(spark):
    rows = table(spark, FOLDER, "conversations", "conv_id", "turn", "role", "text")
    assert found(op13_prefix_trie(spark, FOLDER)) == trie(sequences(rows))


def test_random_conversations(spark):
    """Many shared prefixes, copies, gaps in the ids, lengths around powers of two."""
    rng, rows = random.Random(7), []
    for c in rng.sample(range(-40, 400), 120):
        n = rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 33])
        rows += [(c, t * 2, rng.choice(["user", "assistant"]) if rng.random() < 0.2 else "user",
                  rng.choice(["a", "b", "é"]) if rng.random() < 0.3 else "a")
                 for t in range(n)]
    check(spark, rows)


def test_one_hot_group(spark, monkeypatch):
    """A third of all conversations are the same: their names are broadcast."""
    monkeypatch.setattr(op13, "HOT", 20)
    monkeypatch.setattr(op13, "CHUNK", 16)
    rows = [(c, t, "user", f"same {t}") for c in range(90) for t in range(12)]
    rows += [(c, t, "user", f"{c % 70 if t else 0} {t}") for c in range(90, 270)
             for t in range(10)]
    check(spark, rows)


def test_a_long_conversation_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(op13, "CHUNK", 64)
    rows = [(5, t // 2, "user", "same") for t in range(700)]
    rows += [(6, t, None, "x" * (t % 3)) for t in range(300)] + [(9, 0, "user", "same")]
    check(spark, rows)


def test_edges(spark):
    long = "very long " * 300_000
    rows = [(None, 0, "user", "nobody"), (0, None, None, None), (0, 0, "", ""),
            (0, 0, "", ""), (0, 1, "user", long), (1, 1, "user", long), (2, 3, "a", "b"),
            (2, 3, "a", "b"), (4, None, "system", "x"), (-1, 0, "user", "neg"),
            (-3, 0, "user", "neg"), (10**15 + 3, 0, "user", "far"), (11, 7, "1:", "a"),
            (12, 7, "1", ":a")]
    check(spark, rows)
    check(spark, rows + rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie(*rebuilt(empty)).count() == 0


@pytest.mark.parametrize("conv", [3, 8, 14])
def test_turnless_conversations_are_members_of_the_root(spark, conv):
    """A conversation whose turns are all replaced by those of an absent one."""
    rows = [(conv, 0, "user", "only")]
    h = zlib.crc32(str(conv).encode()) % 9
    assert len(sequences(rows)[conv]) == (h == 0)
    check(spark, rows)
