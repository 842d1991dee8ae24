"""Cost-balanced packing of tokenised documents into training sequences."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.common import small_batches

MAX_LEN = 4096
END_ID = 2
#: Tokens that one round of packing holds in memory.
BLOCK_TOKENS = 1 << 21
#: Attention cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Words whose ids a worker remembers before it starts anew.
CACHE_WORDS = 1_000_000

PIECE_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _byte_letters() -> dict[int, str]:
    """The printable character by which the vocabulary writes each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"


class WordTokenizer(dict):
    """Token ids of whole texts, as little-endian uint32 bytes, word by word.

    The vocabulary's pre-tokenizer never joins characters across white space,
    so the ids of a text are those of its words, and each distinct word is
    tokenised once (the mapping is that memory). Texts of Latin-1 characters
    need no composing and are lower-cased character by character, so their words
    are cut into the pre-tokenizer's pieces here and only the model is asked;
    others go through the whole tokenizer.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit = cache_words
        self.space = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
        self.cut = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+").findall
        self.letters = str.maketrans(_byte_letters())
        self.pieces: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if (text.isascii() or _latin1(text)) and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
            # The bound method finds words seen before without entering Python code.
            return b"".join(map(self.__getitem__, text.lower().split()))
        return b"".join([self._whole(w) for w in self.space.split(text) if w])

    def __missing__(self, word: str) -> bytes:
        if any(s in word for s in self.special):
            return self._whole(word)
        pieces = self.cut(word)
        ids = self._piece(word) if len(pieces) == 1 else b"".join([self.get(p) or self._mark(p) for p in pieces])
        if len(self) >= self.limit:
            self.clear()
            self.pieces.clear()
        self[word] = ids
        return ids

    def _mark(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.pieces[piece] = self._piece(piece)
        return ids

    def _piece(self, piece: str) -> bytes:
        shown = piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()


#: The last tokenizer of this worker, with the words of its tasks before.
_LAST: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    if path not in _LAST:
        _LAST.clear()
        _LAST[path] = WordTokenizer(path)
    return _LAST[path]


def _latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def cost(length):
    return LINEAR * length + QUADRATIC * length * length


def assign(lengths: list[int], max_len: int = MAX_LEN) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) and the number of sequences.

    Runs of ``max_len`` tokens fill sequences of their own. Of what remains, the
    documents go in descending length to the sequence of lowest cost that has
    room for them, out of as many sequences as they can fill; those that fit
    nowhere are cut over the lowest-cost gaps. The last tokens, too few for a
    sequence, are cut into sequences whose lengths are powers of two, which need
    no padding. Every other sequence is full.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    n = 0
    rest: list[tuple[int, int, int]] = []
    for d, length in enumerate(lengths):
        whole = length // max_len
        for k in range(whole):
            pieces.append((d, k * max_len, max_len, n, 0))
            n += 1
        if length % max_len:
            rest.append((length % max_len, d, whole * max_len))
    rest.sort(key=lambda x: (-x[0], x[1]))
    open_ = sum(r for r, _, _ in rest) // max_len
    loads, costs = np.zeros(open_, np.int64), np.zeros(open_)

    def put(d: int, start: int, length: int, s: int) -> None:
        pieces.append((d, start, length, n + s, int(loads[s])))
        loads[s] += length
        costs[s] += cost(length)

    uncut: list[tuple[int, int, int]] = []
    for r, d, start in rest:
        fits = loads <= max_len - r
        if fits.any():
            put(d, start, r, int(np.argmin(np.where(fits, costs, np.inf))))
        else:
            uncut.append((r, d, start))
    gaps = sorted((i for i in range(open_) if loads[i] < max_len), key=lambda i: (costs[i], i))
    at = 0
    tail: list[tuple[int, int, int]] = []
    for r, d, start in uncut:
        while r and at < len(gaps):
            s = gaps[at]
            k = min(r, int(max_len - loads[s]))
            put(d, start, k, s)
            start, r = start + k, r - k
            at += loads[s] == max_len
        if r:
            tail.append((r, d, start))
    n += open_
    left = sum(r for r, _, _ in tail)
    room = filled = 0
    for r, d, start in tail:
        while r:
            if filled == room:
                room, filled = 1 << (left.bit_length() - 1), 0
                left -= room
                n += 1
            k = min(r, room - filled)
            pieces.append((d, start, k, n - 1, filled))
            start, r, filled = start + k, r - k, filled + k
    return pieces, n


def _pack(path: str, max_len: int, end_id: int, block_tokens: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer_of(path)
        first = TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, bytes]] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first, held, tokens
            pieces, used = assign([len(b) // 4 for _, b in held], max_len)
            for at in range(0, len(pieces), 4000):
                some = pieces[at : at + 4000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([held[p[0]][0] for p in some], pa.int64()),
                        pa.array([p[1] for p in some], pa.int64()),
                        pa.array([p[2] for p in some], pa.int64()),
                        pa.array([held[p[0]][1][4 * p[1] : 4 * (p[1] + p[2])] for p in some], pa.binary()),
                        pa.array([len(held[p[0]][1]) // 4 for p in some], pa.int64()),
                        pa.array([first + p[3] for p in some], pa.int64()),
                        pa.array([p[4] for p in some], pa.int64()),
                    ],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
            first += used
            held, tokens = [], 0

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append((i, words.encode(text.as_py() or "") + end))
                tokens += len(held[-1][1]) // 4
                if tokens >= block_tokens:
                    yield from flush()
        if held:
            yield from flush()

    return run


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Packs the tokens of ``docs`` (doc_id, text) into sequences.

    One row per piece: doc_id, start (tokens of its document before it), length,
    ids (little-endian uint32), doc_tokens, sequence_id, offset. ``end_id``
    closes each document. A null or blank text is its end token alone; repeated
    rows are packed each; a null doc_id stays null; other columns are ignored;
    no rows in, none out. Packing needs no neighbour from another task, so
    documents are packed where they are read, a bounded block at a time, and
    nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pack(tokenizer_path, max_len, end_id, block_tokens), PIECE_SCHEMA)
