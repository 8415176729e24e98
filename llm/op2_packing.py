"""Packing by concatenating and cutting.

All texts form one long row of tokens, each text closed by `END`, and fixed windows of
`WIDTH` tokens are cut from it. Two passes give every token its place: the first encodes
each text once, stores the ids with the tokens that precede it in its partition, and
totals the tokens of each partition; the second adds the prefix sums of those totals (one
number per partition, held by the driver) and cuts. The boundary records say which piece
of a text lies where. Only the last sequence can need padding.

Encoding is the dear part. For a tokenizer of the `RECIPE`, texts are cut into the words
of its pre-tokenizer by numpy, each distinct word is looked up by hash among those that
the worker knows, and the words it doesn't know go through the tokenizer's merges
together. Runs for which the recipe's rules are not plain (other scripts, combining
marks, contractions, special tokens) go through the tokenizer. Any other tokenizer gets
whole texts.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.bytescan import LOWER, pieces, range_hashes, rows_of, sliced
from llm.common import stored
from llm.merging import Merges

WIDTH = 2048
END = 1
TOKENIZER = "word_bpe_49k.json"
#: Distinct words whose ids a worker keeps, about, and the longest that are merged together.
CACHED = 400_000
SHORT = 64
#: Text that a task encodes at a time.
STEP_BYTES = 1 << 21

#: What a tokenizer's file must say for runs to be encoded one by one.
RECIPE = {
    "truncation": None, "padding": None,
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|"
                                               "[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True,
         "use_regex": False}]},
    "post_processor": None,
    "model": {"type": "BPE", "dropout": None, "unk_token": None,
              "continuing_subword_prefix": None, "end_of_word_suffix": "</w>",
              "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}}

_WORKER: dict = {}


def _byte_letters() -> list[str]:
    """The character by which a byte-level tokenizer writes each byte: itself where it is
    printable Latin-1, else the next free one from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in seen else next(free)) for b in range(256)]


#: Classes of bytes: white space, letters, digits, marks, and what is not plain.
_WHITE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[[32, *range(9, 14)]] = _WHITE
_CLASS[48:58] = _DIGIT
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_SPACE = _CLASS == _WHITE


def words_of(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """The text in small letters, starts and ends of its words, and which are not plain.

    Plain words are runs of Latin letters (of one byte, or two that begin with C3),
    single digits, and runs of ASCII marks. A run of other characters without white
    space is kept whole and as it is.
    """
    kind, low = _CLASS[data], LOWER[data]
    two = np.flatnonzero(data[:-1] == 0xC3)
    second = data[two + 1]
    letter = (second != 0x97) & (second != 0xB7)  # not the signs for times and division
    kind[two[letter]] = kind[two[letter] + 1] = _LETTER
    low[two[letter & (second <= 0x9E)] + 1] += 0x20
    # A contraction, or what may be a special token.
    kind[np.flatnonzero((data[:-1] == 39) & (kind[1:] == _LETTER))] = _OTHER
    kind[np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))] = _OTHER
    edge = np.diff(np.concatenate(([0], (kind != _WHITE).view(np.int8), [0])))
    runs, run_ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(runs):
        return low, runs, runs, runs.astype(bool)
    begins = (kind == _DIGIT) | (kind != np.append(np.uint8(_WHITE), kind[:-1]))
    begins &= kind != _WHITE
    odd = np.logical_or.reduceat(kind == _OTHER, runs)
    change = np.zeros(len(data) + 1, np.int8)
    change[runs[odd]], change[run_ends[odd]] = 1, -1
    inside = np.cumsum(change[:-1], dtype=np.int8).view(bool)
    begins[inside] = False
    begins[runs] = True
    low[inside] = data[inside]
    starts = np.flatnonzero(begins)
    run = np.searchsorted(runs, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], len(data)), run_ends[run])
    return low, starts, ends, odd[run]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Ids of texts; what it has learnt about words are arrays sorted by their hashes."""

    def __init__(self, path: str, cached: int = CACHED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.cached, self.step = cached, 0
        self.hashes = np.zeros(0, np.uint64)
        self.first, self.count, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.ids = np.zeros(0, np.uint32)
        file = json.loads(self.tokenizer.to_str())
        model = file.get("model", {})
        vocab, merges = model.pop("vocab", {}), model.pop("merges", [])
        self.plain = all(file.get(k) == v for k, v in RECIPE.items())
        if self.plain:
            self._read_merges(vocab, merges)

    def _read_merges(self, vocab: dict[str, int], merges: list) -> None:
        letters, end = _byte_letters(), RECIPE["model"]["end_of_word_suffix"]
        self.inside = np.array([vocab[c] for c in letters])
        self.final = np.array([vocab[c + end] for c in letters])
        self.merges = Merges([(vocab[a], vocab[b], rank, vocab[a + b])
                              for rank, (a, b) in enumerate(merges)], max(vocab.values()) + 1)

    def __len__(self) -> int:
        return len(self.hashes)

    def _whole(self, text: bytes) -> array:
        return array("I", self.tokenizer.encode(text.decode(), add_special_tokens=False).ids)

    def _merged(self, low: np.ndarray, starts: np.ndarray, sizes: np.ndarray
                ) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words, and how many each has, by the tokenizer's merges."""
        data = low[_spread(starts, sizes)]
        symbols, ends = self.inside[data], np.cumsum(sizes) - 1
        symbols[ends] = self.final[data[ends]]
        return self.merges.run(symbols, sizes)

    def _learn(self, hashes: np.ndarray, low: np.ndarray, starts: np.ndarray,
               ends: np.ndarray, odd: np.ndarray) -> None:
        together = ~odd & (ends - starts <= SHORT)
        ids, counts = self._merged(low, starts[together], (ends - starts)[together])
        apart = [self._whole(low[a:b].tobytes()) for a, b in zip(
            starts[~together].tolist(), ends[~together].tolist(), strict=True)]
        counts = np.append(counts, [len(i) for i in apart]).astype(np.int64)
        ids = np.concatenate([ids, *[np.frombuffer(i, np.uint32) for i in apart]])
        hashes = np.append(hashes[together], hashes[~together])
        first = len(self.ids) + np.cumsum(counts) - counts
        self.ids = np.append(self.ids, ids.astype(np.uint32))
        order = np.argsort(np.append(self.hashes, hashes), kind="stable")
        self.hashes = np.append(self.hashes, hashes)[order]
        self.first = np.append(self.first, first)[order]
        self.count = np.append(self.count, counts)[order]
        self.used = np.append(self.used, np.full(len(hashes), self.step))[order]

    def trim(self) -> None:
        """If more is known than `cached` words, keep those of the last step."""
        if len(self) > self.cached:
            kept = self.used == self.step
            self.ids = self.ids[_spread(self.first[kept], self.count[kept])]
            self.hashes, self.count, self.used = (
                c[kept] for c in (self.hashes, self.count, self.used))
            self.first = np.cumsum(self.count) - self.count

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers, without the closing id."""
        if not self.plain:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(
                [text.decode() for text in texts], add_special_tokens=False)]
        if len(texts) == 1 and len(texts[0]) > 2 * STEP_BYTES:
            cut = pieces(np.frombuffer(texts[0], np.uint8), _SPACE, STEP_BYTES)
            return [b"".join(self._step([piece.tobytes()])[0] for piece in cut)]
        return self._step(texts)

    def _step(self, texts: list[bytes]) -> list[bytes]:
        self.trim()
        self.step += 1
        low, starts, ends, odd = words_of(np.frombuffer(b" ".join(texts), np.uint8))
        hashes = range_hashes(low, starts, ends)
        found, place, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, found)
        new = np.append(self.hashes, np.uint64(0))[at] != found
        new |= at == len(self.hashes)
        if new.any():
            self._learn(found[new], low, starts[place[new]], ends[place[new]],
                        odd[place[new]])
            at = np.searchsorted(self.hashes, found)
        self.used[at] = self.step
        at = at[which]
        ids = self.ids[_spread(self.first[at], self.count[at])].astype("<u4")
        rows = np.cumsum([0] + [len(t) + 1 for t in texts])
        words = np.searchsorted(starts, rows)
        bounds = (4 * np.append(0, np.cumsum(self.count[at]))[words]).tolist()
        whole = ids.tobytes()
        return [whole[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def encoder(path: str) -> Encoder:
    """The worker's encoder for this vocabulary."""
    if path not in _WORKER:
        _WORKER[path] = Encoder(path)
    return _WORKER[path]


def _encode(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        own = encoder(path or public_tokenizers.path(TOKENIZER))
        end = np.array([END], "<u4").tobytes()
        try:
            for whole in batches:
                for batch in sliced(whole, "text", STEP_BYTES):
                    ids = [i + end for i in own.encode(
                        [t.tobytes() for t in rows_of(batch.column("text"))])]
                    sizes = np.array([len(i) // 4 for i in ids], np.int64)
                    ends = before + np.cumsum(sizes)
                    before = int(ends[-1])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id"), pa.array(np.full(len(ids), part, np.int32)),
                         pa.array(ends - sizes), pa.array(sizes), pa.array(ids, pa.binary())],
                        ["doc_id", "part", "before", "doc_tokens", "ids"])
        finally:
            own.trim()
    return run


def pack(docs: DataFrame, width: int = WIDTH, tokenizer_path: str | None = None
         ) -> DataFrame:
    """The boundary records of `docs` (doc_id, text): one row per piece of a text.

    doc_id, start and length (of the piece in its text's ids), doc_tokens (with the
    closing id), sequence_id, offset (in the sequence), ids (binary, little-endian
    32-bit). Null and empty texts are the closing id alone. Repeated rows and rows
    without doc_id are packed like others. Other columns are ignored. Which row follows
    which depends on the partitions of the input alone. `tokenizer_path` is a file of
    the tokenizers library, on every machine.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    encoded = stored(docs.select("doc_id", "text").mapInArrow(
        _encode(tokenizer_path),
        f"doc_id {kind}, part int, before long, doc_tokens long, ids binary"))
    totals = sorted((r.part, r.total) for r in encoded.groupBy("part").agg(
        F.sum("doc_tokens").alias("total")).collect())
    starts = accumulate((t for _, t in totals), initial=0)
    bases = spark.createDataFrame(
        [(p, b) for (p, _), b in zip(totals, starts, strict=False)],
        "part int, base long")
    placed = encoded.join(F.broadcast(bases), "part").withColumn(
        "at", F.col("base") + F.col("before"))
    first = F.floor(F.col("at") / width)
    last = F.floor((F.col("at") + F.col("doc_tokens") - 1) / width)

    def piece(k):
        low = F.greatest(k * width - F.col("at"), F.lit(0))
        high = F.least((k + 1) * width - F.col("at"), F.col("doc_tokens"))
        return F.struct(
            low.alias("start"), (high - low).alias("length"), k.alias("sequence_id"),
            (F.col("at") + low - k * width).alias("offset"),
            F.substring("ids", (low * 4 + 1).cast("int"), ((high - low) * 4).cast("int"))
            .alias("ids"))

    return placed.select("doc_id", "doc_tokens", F.inline(
        F.transform(F.sequence(first, last), piece)))


def sequences(pieces: DataFrame, width: int = WIDTH, pad: int = 0) -> DataFrame:
    """sequence_id, tokens (used ones) and ids (binary) of the packed sequences.

    A sequence shorter than `width` is filled up with `pad` unless its length is a power
    of two. A sequence has at most `width` pieces.
    """
    whole = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("tokens"),
        F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
        .alias("parts"))
    fill = F.when((F.col("tokens") < width) & (F.col("tokens").bitwiseAND(
        F.col("tokens") - 1) != 0), width - F.col("tokens")).otherwise(0)
    padding = f"{pad & 0xFF:02X}{pad >> 8 & 0xFF:02X}{pad >> 16 & 0xFF:02X}{pad >> 24:02X}"
    return whole.select("sequence_id", "tokens", F.unhex(F.concat(
        F.array_join("parts.ids", ""), F.repeat(F.lit(padding), fill.cast("int"))))
        .alias("ids"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all `documents`, with a checksum of their ids."""
    return digests(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")
