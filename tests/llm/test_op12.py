import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from llm import op12_sentencepiece as op12
from llm.op12_sentencepiece import Vocabulary, decode, encode, op12_sentencepiece
from tests.llm.brute import table

FOLDER = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "   \n\t  ", "a\x00b<s>▁x </s><unk> <0x41>", "1234 56.7e-8",
       "▁▁", "naïve Ñandú ǅ ŉ ﬁ① 日本語。テスト 😀👩‍👩‍👧 \U0010ffff",
       "word " * 30000, "x" * 5000, "ab" * 3000 + " " * 3000 + "c", "é̈́" * 500,
       "\r\n\r\n", "aaaaaaaaaaaaaaaaa aaaa", "he the theta", "ſ K  　 end "]


def library():
    return SentencePieceProcessor(model_file=PATH)


def test_agenda_equals_library_on_random_texts():
    own, known, rng = Vocabulary(PATH, cached=500), library(), random.Random(5)
    pieces = [known.id_to_piece(i) for i in range(259, 32000)]
    for _ in range(60):
        texts = ["".join(rng.choice(pieces) if rng.random() < 0.7
                         else chr(rng.choice([32, 10, 39, 48, 233, 0x4E2D, 0x1F600]))
                         for _ in range(rng.randrange(60))) for _ in range(20)]
        found = [np.frombuffer(i, "<u4").tolist() for i in own.encode(texts)]
        assert found == known.encode(texts)


def test_agendas_side_by_side_give_what_each_gives_alone():
    own, rng = Vocabulary(PATH), random.Random(3)
    units = ["".join(rng.choices("▁▁abenrthsti.,é中\x00", k=rng.randrange(1, 33)))
             for _ in range(3000)]
    assert own.agendas(units) == [own.unit_ids(u) for u in units]
    assert own.agendas(["x"]) == [own.unit_ids("x")] and own.agendas(["\x00"])


def test_whole_units_give_the_same_as_cut_ones():
    own = Vocabulary(PATH)
    for text in ("▁the▁1900s▁were,▁as\nthey▁▁▁▁say", "▁a▁b", "▁▁▁"):
        whole = own.unit_ids(text)
        assert whole == b"".join(own.unit_ids(u) for u in own.units(text))
        assert "".join(own.units(text)) == text


def test_whole_table(spark):
    docs, known = dict(table(spark, FOLDER, "documents", "doc_id", "text")), library()
    rows = op12_sentencepiece(spark, FOLDER).collect()
    assert len(rows) == len(docs) and {r.doc_id for r in rows} == docs.keys()
    for r in rows:
        ids = known.encode(docs[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(known.decode(ids).encode()).hexdigest()


def test_edges(spark):
    known = library()
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(ODD)],
                               "doc_id long, text string, ids long").repartition(3)
    rows = {r.doc_id: r for r in encode(df, decoded=True).collect()}
    for i, text in enumerate(ODD):
        ids = known.encode(text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == ids
        assert rows[i].decoded == known.decode(ids) and rows[i].n_tokens == len(ids)
    plain = encode(df, begin=False, end=False)
    back = {r.doc_id: r.decoded for r in decode(plain).collect()}
    assert back[5] == ODD[5] and back[0] == ""
    assert encode(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert encode(twice).count() == 2


def test_a_difference_is_an_error(spark, monkeypatch):
    batches = spark.createDataFrame([(7, "the the")], "doc_id long, text string"
                                    ).toArrow().to_batches()
    own = Vocabulary(PATH)
    own["▁the"] = b"\x05\0\0\0"
    monkeypatch.setitem(op12._WORKER, PATH, own)
    with pytest.raises(ValueError, match="doc_id 7"):
        list(op12._round_trip(PATH, True, True, False)(iter(batches)))
