"""Encoding and decoding with a merge-type SentencePiece vocabulary.

A normalised text starts as one symbol per character. An agenda holds the adjacent pairs
whose concatenation is a piece, best score first, then leftmost; the best pair becomes one
symbol and offers itself to its new neighbours, until the agenda is empty. Symbols that
are no pieces become the byte pieces of their UTF-8 form.

Pairs never cross a place that no piece of the vocabulary crosses: a space sign behind
another character, or two characters (letters and marks, say) that no chain of pieces
brings together. A text is cut there and each distinct unit goes through an agenda once
per worker, its ids kept in a cache of two generations of bounded size. The model's normaliser, and the
decoding, are the library's.

Every Arrow batch is compared with the library's own ids of the whole texts; a difference
is an error, so a vocabulary that this method doesn't cover is never encoded wrongly.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from llm.bytescan import sliced
from llm.merging import Merges

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Units whose ids a worker keeps in a generation, and the longest of them in characters.
CACHED = 250_000
CACHED_LENGTH = 64
#: Units up to this length are worked off side by side, longer ones with a heap each.
SHORT = 32
#: Text that a task encodes at a time.
STEP_BYTES = 1 << 20

_WORKER: dict = {}


class Vocabulary(dict):
    """A model's pieces, and the ids of units as little-endian 32-bit numbers."""

    def __init__(self, path: str, cached: int = CACHED):
        super().__init__()
        from sentencepiece import SentencePieceProcessor
        self.library = SentencePieceProcessor(model_file=path)
        self.cached = cached
        self.older: dict[str, bytes] = {}
        model = self.library
        size = model.get_piece_size()
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        falls_back = model.is_byte(self.bytes[0])
        self.unknown = None if falls_back else model.unk_id()
        self.ids = {}
        for i in range(size):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
                    or model.is_unused(i)):
                self.ids[model.id_to_piece(i)] = i
        # Better pieces have smaller ranks; equal scores share one.
        score = {p: model.get_score(i) for p, i in self.ids.items() if len(p) > 1}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in score.items()}
        self.units = _cutter(self.rank)
        self._number_pairs()

    def _number_pairs(self) -> None:
        """Numbers for symbols, and all pairs of symbols that make a piece, by number."""
        chars = sorted({c for piece in self.rank for c in piece})
        symbol = {s: k for k, s in enumerate([*chars, *self.rank])}
        self.chars = np.array([*map(ord, chars), 0], np.uint32)
        # Another character gets a number that is in no pair.
        self.other = len(symbol)
        self.symbol_ids = np.array([self.ids.get(s, -1) for s in symbol] + [-1])
        self.merges = Merges(
            [(left, right, rank, symbol[piece])
             for piece, rank in self.rank.items() for cut in range(1, len(piece))
             if (left := symbol.get(piece[:cut])) is not None
             and (right := symbol.get(piece[cut:])) is not None], len(symbol) + 1)

    def agenda(self, unit: str) -> list[str]:
        """The symbols of a unit after all merges."""
        symbols = list(unit)
        n, rank = len(symbols), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = []
        for i in range(n - 1):
            merged = symbols[i] + symbols[i + 1]
            if merged in rank:
                pairs.append((rank[merged], i, merged))
        heapq.heapify(pairs)
        while pairs:
            _, i, merged = heapq.heappop(pairs)
            left = symbols[i]
            right = after[i]
            if left is None or right >= n or left + symbols[right] != merged:
                continue  # one of its symbols has become part of another
            symbols[i], symbols[right] = merged, None
            follower = after[i] = after[right]
            if follower < n:
                before[follower] = i
                longer = merged + symbols[follower]
                if longer in rank:
                    heapq.heappush(pairs, (rank[longer], i, longer))
            leader = before[i]
            if leader >= 0:
                longer = symbols[leader] + merged
                if longer in rank:
                    heapq.heappush(pairs, (rank[longer], leader, longer))
        return [s for s in symbols if s is not None]

    def agendas(self, units: list[str]) -> list[bytes]:
        """The ids of short units, whose agendas are worked off side by side."""
        codes = np.frombuffer("".join(units).encode("utf-32-le"), "<u4")
        at = np.searchsorted(self.chars[:-1], codes)
        symbols, sizes = self.merges.run(
            np.where(self.chars[at] == codes, at, self.other),
            np.array([len(u) for u in units]))
        ids = self.symbol_ids[symbols]
        bounds = np.append(0, np.cumsum(sizes))
        whole = ids.astype("<u4").tobytes()
        # Characters that are no pieces have ids of their bytes.
        lost = set(np.repeat(np.arange(len(units)), sizes)[ids < 0].tolist())
        return [self.unit_ids(u) if k in lost else whole[4 * a:4 * b]
                for k, (u, a, b) in enumerate(zip(units, bounds, bounds[1:], strict=False))]

    def unit_ids(self, unit: str) -> bytes:
        found = array("I")
        for symbol in self.agenda(unit):
            own = self.ids.get(symbol, self.unknown)
            if own is not None:
                found.append(own)
            else:
                found.extend([self.bytes[b] for b in symbol.encode()])
        return found.tobytes()

    def __missing__(self, unit: str) -> bytes:
        ids = self.unit_ids(unit)
        if len(unit) <= CACHED_LENGTH:
            self[unit] = ids
        return ids

    def _learn(self, units: set[str]) -> None:
        """Keeps the ids of the short ones among units that are not known."""
        if len(self) > self.cached:  # units in use move on to the next generation
            self.older = dict(self)
            self.clear()
        short = []
        for unit in units:
            if unit not in self:
                ids = self.older.get(unit)
                if ids is not None:
                    self[unit] = ids
                elif len(unit) <= SHORT:
                    short.append(unit)
        if short:
            self.update(zip(short, self.agendas(short), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without begin and end."""
        cut = [self.units(text) for text in self.library.normalize(texts)]
        self._learn(set().union(*cut))
        found = [b"".join(map(self.__getitem__, units)) for units in cut]
        return found if self.unknown is None else list(map(self._one_unknown, found))

    def _one_unknown(self, ids: bytes) -> bytes:
        """A run of unknown symbols is one id."""
        numbers = np.frombuffer(ids, "<u4")
        again = (numbers[1:] == self.unknown) & (numbers[:-1] == self.unknown)
        return numbers[np.append(True, ~again)[:len(numbers)]].tobytes()


def _cutter(rank: dict[str, int]):
    """A function that cuts a normalised text where no piece can reach across.

    Characters that are neighbours in a piece belong together; a unit is a run of
    characters that belong together, with the space signs before it.
    """
    if any(SPACE in piece.lstrip(SPACE) for piece in rank):
        return lambda text: [text] if text else []
    leads: dict[str, str] = {}

    def leader(c: str) -> str:
        while leads.setdefault(c, c) != c:
            c = leads[c]
        return c

    for piece in rank:
        word = piece.lstrip(SPACE)
        for c in word:
            leads[leader(word[0])] = leader(c)
    classes: dict[str, str] = {}
    for c in sorted(leads):
        classes[leader(c)] = classes.get(leader(c), "") + re.escape(c)
    runs = [f"{SPACE}*[{c}]+" for c in sorted(classes.values(), key=len, reverse=True)]
    return re.compile("|".join([*runs, f"{SPACE}+", f"[^{SPACE}]"]), re.S).findall


def vocabulary(path: str) -> Vocabulary:
    """The worker's vocabulary of this model file."""
    if path not in _WORKER:
        _WORKER[path] = Vocabulary(path)
    return _WORKER[path]


def _round_trip(path: str | None, begin: bool, end: bool, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path or public_tokenizers.path(MODEL))
        library = own.library
        head = np.array([library.bos_id()] * begin, "<u4").tobytes()
        tail = np.array([library.eos_id()] * end, "<u4").tobytes()
        for whole in batches:
            for batch in sliced(whole, "text", STEP_BYTES):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                ids = [head + i + tail for i in own.encode(texts)]
                wanted = library.encode(texts, add_bos=begin, add_eos=end, num_threads=1)
                numbers = [np.frombuffer(i, "<u4").tolist() for i in ids]
                if numbers != wanted:
                    bad = next(k for k, w in enumerate(wanted) if w != numbers[k])
                    raise ValueError("the library encodes this row otherwise: doc_id "
                                     f"{batch.column('doc_id')[bad].as_py()}")
                columns = [batch.column("doc_id"),
                           pa.array([len(i) for i in numbers], pa.int64()),
                           pa.array(ids, pa.binary())]
                names = ["doc_id", "n_tokens", "ids"]
                if decoded:
                    columns.append(pa.array(library.decode(numbers, num_threads=1)
                                            if numbers else [], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)
    return run


def encode(docs: DataFrame, model_path: str | None = None, begin: bool = True,
           end: bool = True, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids (binary, little-endian 32-bit) of each row of `docs`
    (doc_id, text), with `decoded` also the text that the library makes of the ids.

    `begin` and `end` add the model's ids of that name. Null and empty texts have no other
    ids. Rows stay as they are, repeated ones and those without doc_id too; other columns
    are ignored. Texts are never cut short. `model_path` is a BPE model file of the
    sentencepiece library, on every machine; a model of another kind fails at the first
    batch in which its ids differ.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _round_trip(model_path, begin, end, decoded),
        f"doc_id {kind}, n_tokens long, ids binary" + ", decoded string" * decoded)


def decode(rows: DataFrame, model_path: str | None = None) -> DataFrame:
    """Adds `decoded` to rows that have `ids`; null ids give a null text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = vocabulary(model_path or public_tokenizers.path(MODEL)).library
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            texts = [None if i is None else library.decode(
                np.frombuffer(i, "<u4").tolist()) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    others = rows.drop("decoded")
    return others.mapInArrow(run, StructType(
        [*others.schema.fields, StructField("decoded", StringType())]))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all `documents` and of what they decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, decoded=True).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
