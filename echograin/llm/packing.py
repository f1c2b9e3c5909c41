"""Bounded-space online packing of tokenized documents into sequences.

Each partition keeps ``open_windows`` open windows. A document's ids come in online; full windows' worth of them leave
at once as sequences of their own, and what is left goes, uncut, to the open window that it fills best. Where it fits
none, the fullest window is topped up with the piece's head (documents may be cut freely; gaps under ``min_cut`` stay)
and emitted, and the rest opens a window of its own. Windows still open at a partition's end are leftovers: they are
merged whole, best-fit, in groups of ``MERGE`` partitions, of which each hands its ``open_windows`` emptiest windows on
to a group of ``MERGE`` groups, and so on up a tree, so no group holds more than ``MERGE`` times ``open_windows`` rows.

Tokenizing is the cost, so each Python worker keeps a bounded table of words it has met, in two generations: where the
younger is full, it becomes the older, and what is met again comes back from there. Lower-case runs of letters, with
the punctuation after them, go straight to the tokenizer's model, and stand in the table once,
whatever punctuation follows; any other word takes the tokenizer's whole pipeline. Words
never span white space and the tokenizer drops white space, so ids are those of the whole text. Control strings count
as such in their own spelling only, so words that hold one in any case go to the pipeline as they are written.

A piece's ``token_ids`` are its ids as little-endian unsigned 32-bit numbers.

Defined cases: a null or empty text has no ids but the end id; repeated rows and ids are packed each for itself (their
pieces carry equal ids); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import string
import sys
from array import array
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_tables, materialize, text_slices, utf8

WINDOW = 4096
OPEN_WINDOWS = 8
MIN_CUT = 16
MERGE = 64
END_ID = 2
CACHE_WORDS = 800_000
MAX_CACHED = 48
MAX_MARKS = 1000

_MARKS = string.punctuation.encode()
_worker: dict[str, WordEncoder] = {}


def _plain(word: bytes) -> bool:
    """Lower-case letters of Latin, all of them whole and one piece to the tokenizer."""
    if word.isalpha():
        return True
    text = word.decode()
    return text.isalpha() and max(text) < "ɐ" and text == text.lower()


class WordEncoder:
    """ids of a text, as unsigned 16- or 32-bit little-endian numbers, by way of a bounded table of words."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.letters = self.tokenizer.model
        self.punctuation: dict[bytes, bytes] = {}
        self.marks = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The byte-level alphabet: printable bytes stand for themselves, the rest for code points from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.alphabet = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}

    def _bytes(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _model(self, piece: str) -> bytes:
        symbols = piece if piece.isascii() else "".join(map(self.alphabet.__getitem__, piece.encode()))
        return self._bytes([t.id for t in self.letters.tokenize(symbols)])

    def _word(self, word: bytes) -> bytes:
        return self._model(word.decode()) if _plain(word) else self._bytes(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)

    def ids_of(self, word: bytes) -> bytes:
        """ids of a lower-case word, from the table or for it. Plain letters are there without the punctuation after them."""
        run = word.rstrip(_MARKS)
        if len(run) < len(word) and not _plain(run):
            run = word
        ids = self.words.get(run)
        if ids is None:
            ids = self.older.get(run)
            if ids is None:
                ids = self._word(run)
            if len(run) <= MAX_CACHED:
                if len(self.words) >= CACHE_WORDS // 2:
                    self.words, self.older = {}, self.words
                self.words[run] = ids
        if len(run) == len(word):
            return ids
        marks = word[len(run) :]
        after = self.punctuation.get(marks)
        if after is None:
            after = self._model(marks.decode())
            if len(marks) <= MAX_CACHED and len(self.punctuation) < MAX_MARKS:
                self.punctuation[marks] = after
        return ids + after

    def forget(self) -> None:
        self.words, self.older = {}, {}

    def encode(self, text: bytes) -> np.ndarray:
        parts, lower = [], text.lower()
        if any(mark in lower for mark in self.marks):
            for raw in text.split():
                w = raw.lower()
                if any(mark in w for mark in self.marks):
                    parts.append(self._bytes(self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids))
                else:
                    parts.append(self._word(w))
            return np.frombuffer(b"".join(parts), self.kind).astype("<u4")
        words = lower.split()
        parts = list(map(self.words.get, words))
        for k, ids in enumerate(parts):
            if ids is None:
                parts[k] = self.ids_of(words[k])
        return np.frombuffer(b"".join(parts), self.kind).astype("<u4")


def encoder(path: str) -> WordEncoder:
    if path not in _worker:
        _worker[path] = WordEncoder(path)
        kept_tables["packing"] = lambda: [e.forget() for e in _worker.values()]
    return _worker[path]


class Packer:
    """Online best-fit over a fixed number of open windows. A window is (used, number, [(piece, length), ...])."""

    def __init__(self, size: int, space: int, min_cut: int, number: int = 0) -> None:
        self.size, self.space, self.min_cut, self.number = size, space, min_cut, number
        self.open: list[tuple[int, int, list]] = []  # ascending by used; numbers are unique, so lists never compare
        self.closed: list[tuple[int, list]] = []

    def add(self, length: int, piece: Callable[[int, int], object]) -> None:
        """Place ``length`` items; ``piece(start, length)`` makes what stands for a part of them."""
        start = 0

        def cut(n: int) -> tuple[object, int]:
            nonlocal start, length
            made = piece(start, n)
            start, length = start + n, length - n
            return made, n

        while length >= self.size:
            self.number += 1
            self.closed.append((self.number, [cut(self.size)]))
        while length:
            at = bisect_right(self.open, self.size - length, key=lambda w: w[0]) - 1
            if at >= 0:
                used, number, held = self.open.pop(at)
                self._keep(used + length, number, [*held, cut(length)])
            elif len(self.open) < self.space:
                self.number += 1
                self._keep(length, self.number, [cut(length)])
            else:
                used, number, held = self.open.pop()
                if self.size - used >= self.min_cut:
                    held.append(cut(self.size - used))
                self.closed.append((number, held))

    def _keep(self, used: int, number: int, held: list) -> None:
        if used == self.size:
            self.closed.append((number, held))
        else:
            insort(self.open, (used, number, held))


_FIELDS = [*((n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens")), ("token_ids", pa.binary()), *((n, pa.int64()) for n in ("sequence_id", "offset")), ("full", pa.bool_()), ("part", pa.int64())]
_SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, token_ids binary, sequence_id bigint, offset bigint, full boolean, part bigint"


def _rows(windows: list[tuple[int, list]], full: bool, part: int) -> pa.RecordBatch:
    out = []
    for number, held in windows:
        offset = 0
        for piece, length in held:
            out.append((*piece, number, offset, full, part))
            offset += length
    columns = list(zip(*out, strict=True)) if out else [[] for _ in _FIELDS]
    schema = pa.schema(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _pack_batches(path: str, window: int, space: int, min_cut: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, encode = Packer(window, space, min_cut, part << 32), encoder(path).encode
        for batch in text_slices(batches, "text", 2 << 20, "packing"):
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                ids = np.append(encode(text), np.uint32(END_ID)).astype("<u4")

                def piece(start: int, n: int, ids: np.ndarray = ids, doc_id: int | None = doc_id) -> tuple:
                    return doc_id, start, n, len(ids), ids[start : start + n].tobytes()

                packer.add(len(ids), piece)
            yield _rows(packer.closed, True, part)
            packer.closed = []
        yield _rows([(number, held) for _, number, held in packer.open], False, part)

    return run


_MOVES = "g bigint, sequence_id bigint, into bigint, shift bigint, used bigint, open boolean"


def _merge(window: int, space: int):
    """Best-fit of whole leftover windows (g, sequence_id, used): which goes into which, and how far it moves there.

    The ``space`` emptiest of those that are not nearly full stay open, with what they hold.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["used", "sequence_id"], ascending=[False, True])
        open_, out = [], []  # ascending by room
        for number, used in zip(group["sequence_id"], group["used"], strict=True):
            at = bisect_right(open_, (window - used, float("inf"))) - 1
            if at >= 0:
                held, into = open_.pop(at)
            else:
                held, into = 0, number
            out.append((number, into, held))
            insort(open_, (held + used, into))
        held = {into: used for used, into in open_}
        short = {into for used, into in open_[:space] if used < window * 15 // 16}
        numbers, into, shift = zip(*out, strict=True)
        return pd.DataFrame({"g": group["g"].iloc[0], "sequence_id": numbers, "into": into, "shift": shift, "used": [held[x] for x in into], "open": [x in short and x == n for n, x in zip(numbers, into, strict=True)]})

    return run


def _moves(left: DataFrame, window: int, space: int) -> DataFrame:
    """sequence_id, to, by: where each leftover window (sequence_id, used, part) goes, and how far it moves there."""
    top = left.agg(F.max("part")).first()[0] or 0
    moves = left.select("sequence_id", F.col("sequence_id").alias("to"), F.lit(0).cast("long").alias("by"))
    open_ = left.select("sequence_id", "used", F.floor(F.col("part") / MERGE).alias("g"))
    while True:
        step = materialize(open_.groupBy("g").applyInPandas(_merge(window, space), _MOVES), "packed-merge")
        way = step.select(F.col("sequence_id").alias("to"), "into", "shift")
        moves = moves.join(way, "to", "left").select("sequence_id", F.coalesce("into", "to").alias("to"), (F.col("by") + F.coalesce("shift", F.lit(0))).alias("by"))
        if top < MERGE:
            return moves
        top //= MERGE
        open_ = step.where("open").select("sequence_id", "used", F.floor(F.col("g") / MERGE).alias("g"))


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, open_windows: int = OPEN_WINDOWS, min_cut: int = MIN_CUT) -> DataFrame:
    """One row a piece: doc_id, start, length, doc_tokens, token_ids, sequence_id, offset."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = materialize(own.mapInArrow(_pack_batches(tokenizer_path, window, open_windows, min_cut), _SCHEMA), "packed")
    left = materialize(pieces.where(~F.col("full")).groupBy("sequence_id").agg(F.sum("length").alias("used"), F.first("part").alias("part")), "packed-left")
    moves = materialize(_moves(left, window, open_windows), "packed-moves")
    columns = [F.col(c) for c in ("doc_id", "start", "length", "doc_tokens", "token_ids")]
    # Full windows never move; leftovers are a few windows a partition.
    stay = pieces.where("full").select(*columns, "sequence_id", "offset")
    moved = pieces.where(~F.col("full")).join(moves, "sequence_id").select(*columns, F.col("to").alias("sequence_id"), (F.col("offset") + F.col("by")).alias("offset"))
    return stay.unionByName(moved)
