import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm import op2_packing as op2_packing_module
from llm.op2_packing import Encoder, op2_packing, pack, sequences
from tests.llm.brute import table

FOLDER = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n", "It's, I'LL. don't...", "a.,b c.d, é, É. É, İ.", "1,2 3.",
       "x<|endoftext|>y <|ENDOFTEXT|>", "\x1ca\x1fb c　d", "日本語。テスト", "ΣΑΣ Σ.",
       "--- ... ,,, '' 's", "word " * 5000, "ſ K ﬁ½ ①.", "̈a ̈,",
       "a's's b.'s c'' d_ e». f½. g<| h> ñandú. ÑANDÚ, ǅ ŉ! x²", "ʼn ﬃ. Ａ, ªº."]


def whole(texts):
    found = Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts],
                                                   add_special_tokens=False)
    return [e.ids + [1] for e in found]


def test_encoder_equals_whole_texts(spark):
    texts = [t for t, in table(spark, FOLDER, "documents", "text")] + ODD
    own = Encoder(PATH, cached=1000)
    for at in range(0, len(texts), 50):
        part = texts[at:at + 50]
        found = [np.frombuffer(i, "<u4").tolist() + [1]
                 for i in own.encode([(t or "").encode() for t in part])]
        assert found == whole(part)


def check(rows, docs):
    """Every id once, sequences gapless; the pieces of a text give its ids."""
    ids = {i: e for (i, _), e in zip(docs, whole([t for _, t in docs]), strict=True)}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        own = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(own) and r.doc_tokens == len(ids[r.doc_id])
    assert by_doc.keys() == ids.keys()
    for i, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[i])
    for k, own in by_sequence.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == 2048 or k == max(by_sequence) and at < 2048


def test_whole_table(spark):
    check(op2_packing(spark, FOLDER).collect(),
          table(spark, FOLDER, "documents", "doc_id", "text"))


def test_edges(spark):
    docs = list(enumerate(ODD))
    df = spark.createDataFrame([(i, t, 1) for i, t in docs],
                               "doc_id long, text string, start int").repartition(5)
    pieces = pack(df)
    check(pieces.withColumn("ids_crc32", F.crc32("ids")).collect(), docs)
    packed = sequences(pieces).collect()
    assert sum(r.tokens for r in packed) == sum(map(len, whole(ODD)))
    for r in packed:
        n = len(r["ids"]) // 4
        assert n == 2048 or n == r.tokens and n & (n - 1) == 0
    assert pack(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (None, "a b")],
                                  "doc_id long, text string")
    assert pack(twice).agg(F.sum("length")).first()[0] == 2 * len(whole(["a b"])[0])


def test_other_tokenizers_encode_whole_texts(spark):
    """A byte-level tokenizer keeps white space and capitals."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not Encoder(path).plain and Encoder(PATH).plain
    own = Tokenizer.from_file(path)
    docs = [(i, t) for i, t in enumerate([*ODD, "Two  words\n\nand\tMORE"])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    pieces = {}
    for r in pack(df, tokenizer_path=path).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    for i, text in docs:
        ids = np.frombuffer(b"".join(p for _, p in sorted(pieces[i])), "<u4").tolist()
        assert ids == own.encode(text or "", add_special_tokens=False).ids + [1]


def test_forgetting_changes_nothing():
    """A cache that is always full, long words, digits, marks and capitals."""
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("aeinrstéüñÉÜßÿ×÷'.,A19<|-"), rng.integers(1, 12)))
             for _ in range(3000)] + ["long" * 40, "x" * 65, "y" * 64 + ".", "'s", "it's", "..'s"]
    small, large = Encoder(PATH, cached=50), Encoder(PATH)
    for _ in range(60):
        text = rng.choice([" ", "\n", "  "]).join(rng.choice(words, 200)).encode()
        assert small.encode([text]) == large.encode([text])
        found = np.frombuffer(large.encode([text])[0], "<u4").tolist()
        assert found == whole([text.decode()])[0][:-1]
    assert len(large) > len(small)
    small.trim()
    assert len(small) < 1500 and small.encode([text]) == large.encode([text])


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(op2_packing_module, "STEP_BYTES", 100)
    text = " ".join(f"word{i} É{i}, it's" for i in range(400))
    assert np.frombuffer(Encoder(PATH).encode([text.encode()])[0], "<u4").tolist() == whole(
        [text])[0][:-1]
    assert Encoder(PATH).encode([b"", b" \n", b"a"])[:2] == [b"", b""]
