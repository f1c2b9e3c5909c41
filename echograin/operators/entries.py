"""Corpus rows to entries: tokens, granules, winnowed fingerprints and sketches, in one Arrow pass.

Fingerprint extraction is the dearest stage, so a text is tokenized once and leaves as one row for each entry with its
distinct fingerprints and its sketch; everything after it is joins and aggregates in the JVM.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SLOTS, ScanOptions
from ..functions import slicing, tokens

#: Sketch slots are minima of (a x + b) mod P over fingerprints x; products stay under 2^62.
P = (1 << 31) - 1
SEED = "minhash-1"


def parameters(seed: str = SEED, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """a (odd, not 0) and b of each slot."""
    number = lambda what, k: int(hashlib.md5(f"{seed}:{what}:{k}".encode()).hexdigest()[:8], 16) % (P - 1)
    return [number("a", k) | 1 for k in range(slots)], [number("b", k) for k in range(slots)]


def hash60(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def gram_hashes(keys: list[str], k: int) -> np.ndarray:
    """Hash of each run of ``k`` token keys; none for fewer tokens or k = 0."""
    if not k or len(keys) < k:
        return np.zeros(0, np.int64)
    md5, runs = hashlib.md5, map(" ".join, zip(*(keys[i:] for i in range(k))))
    digests = b"".join([md5(x).digest()[:8] for x in map(str.encode, runs)])
    return (np.frombuffer(digests, ">u8") >> np.uint64(4)).astype(np.int64)


def winnowed(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the windows' minima, the rightmost among equals, each once."""
    n = len(hashes) - window + 1
    if window <= 0 or n <= 0:
        return np.zeros(0, np.int64)
    h = np.asarray(hashes, np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(h, window)
    at = np.arange(n) + window - 1 - rows[:, ::-1].argmin(axis=1)
    return at[np.append(True, at[1:] != at[:-1])]


def winnow(hashes: list[int] | np.ndarray, window: int) -> list[tuple[int, int]]:
    """(position, hash) of each window's minimum."""
    h = np.asarray(hashes, np.int64)
    at = winnowed(h, window)
    return list(zip(at.tolist(), h[at].tolist(), strict=True))


def sketch(fingerprints: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (fingerprints % P).astype(np.uint64)
    out = np.full(len(a), P, np.int64)
    for k in range(0, len(x), 4096):
        out = np.minimum(out, ((a[:, None] * x[None, k : k + 4096] + b[:, None]) % np.uint64(P)).min(axis=1).astype(np.int64))
    return out


_ENTRY = [("entry_id", pa.int64()), ("path", pa.string()), ("lang", pa.string()), ("fn_name", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("unique_fps", pa.int64()), ("fps", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())), ("idents", pa.list_(pa.string()))]
ENTRY_DDL = "entry_id bigint, path string, lang string, fn_name string, line_start int, line_end int, unique_fps bigint, fps array<bigint>, sketch array<bigint>, idents array<string>"


def entry_id(file_id: int, number: int) -> int:
    return file_id if number < 0 else hash60(f"{file_id}:{number}")


def _entries(options: ScanOptions, with_idents: bool):
    schema = pa.schema(_ENTRY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = (np.array(x, np.uint64) for x in parameters())
        for batch in batches:
            out = []
            for file_id, path, lang, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (content or "").encode()
                if options.granularity == "file":
                    idents = [t for kind, t in tokens.pairs(raw, lang) if kind == tokens.IDENT] if with_idents else None
                    granules = [(-1, None, tokens.keys(raw, lang, options.blind), idents)]
                else:
                    found = tokens.process(raw, lang)[0]
                    keys, starts = [tokens.key(t, options.blind) for t in found], [t.start for t in found]
                    granules = []
                    for k, g in enumerate(slicing.slice_functions(raw, lang)):
                        first, end = bisect_left(starts, g.byte_start), bisect_left(starts, g.byte_end)
                        idents = [t.text for t in found[first:end] if t.kind == tokens.IDENT] if with_idents else None
                        granules.append((k, g, keys[first:end], idents))
                for number, g, keys, idents in granules:
                    h = gram_hashes(keys, options.k)
                    fps = np.unique(h[winnowed(h, options.window)])
                    if len(fps):
                        out.append((entry_id(file_id, number), path, lang, g and g.name, g and g.line_start, g and g.line_end, len(fps), fps.tolist(), sketch(fps, a, b).tolist(), idents))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(_ENTRY)], schema=schema)

    return run


def entries(corpus: DataFrame, options: ScanOptions = ScanOptions(), with_idents: bool = False) -> DataFrame:
    """One row a file or function of ``corpus`` (entry_id, path, lang, content) that has a fingerprint."""
    rows = corpus
    if options.only_lang:
        rows = rows.where(F.lower("lang") == options.only_lang.lower())
    if options.granularity == "function":
        rows = rows.where(F.col("lang").isin(*slicing.SUPPORTED))
    return rows.select("entry_id", "path", "lang", "content").mapInArrow(_entries(options, with_idents), ENTRY_DDL)


_TOKENS = [("entry_id", pa.int64()), ("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), *((n, pa.int32()) for n in ("byte_start", "byte_end", "line", "col"))]
_TOKEN_DDL = "entry_id bigint, pos int, kind string, text string, byte_start int, byte_end int, line int, col int"


def token_rows(corpus: DataFrame, blind: str = "strict", places: bool = True) -> DataFrame:
    """The token table: one row a token, with what blinding leaves of its text; ``places=False`` leaves out offsets,
    line and column, which cost as much as the tokens."""
    schema = pa.schema(_TOKENS if places else _TOKENS[:4])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part, out, sizes = batch.slice(k, 64), [[] for _ in range(6)], []
                for lang, content in zip(*(c.to_pylist() for c in part.columns[1:]), strict=True):
                    raw = (content or "").encode()
                    if places:
                        found = [(t.kind, tokens.blind(t.kind, t.text, blind), t.start, t.end, t.line, t.col) for t in tokens.process(raw, lang)[0]]
                    else:
                        found = [(kind, tokens.blind(kind, t, blind)) for kind, t in tokens.pairs(raw, lang)]
                    sizes.append(len(found))
                    for column, values in zip(out, zip(*found, strict=True), strict=False):
                        column += values
                ids = pa.array(np.repeat(np.arange(part.num_rows), sizes))
                pos = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
                yield pa.RecordBatch.from_arrays([part.column(0).take(ids), pa.array(pos), *(pa.array(c, f.type) for c, f in zip(out, list(schema)[2:], strict=False))], schema=schema)

    ddl = _TOKEN_DDL if places else "entry_id bigint, pos int, kind string, text string"
    return corpus.select("entry_id", "lang", "content").mapInArrow(run, ddl)


def kind_counts(corpus: DataFrame) -> DataFrame:
    """entry_id, kind, n: tokens of each kind, counted where they are found."""
    schema = pa.schema([("entry_id", pa.int64()), ("kind", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file_id, lang, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = Counter(kind for kind, _ in tokens.pairs((content or "").encode(), lang))
                out += [(file_id, kind, n) for kind, n in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return corpus.select("entry_id", "lang", "content").mapInArrow(run, "entry_id bigint, kind string, n bigint")


def fingerprint_rows(corpus: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """entry_id, pos, hash: winnowed fingerprints of whole files, by position."""
    schema = pa.schema([("entry_id", pa.int64()), ("pos", pa.int32()), ("hash", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lang, content in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                h = gram_hashes(tokens.keys((content or "").encode(), lang, options.blind), options.k)
                at.append(winnowed(h, options.window))
                hashes.append(h[at[-1]])
            ids = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in at[1:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(ids), pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(hashes))], schema=schema)

    return corpus.select("entry_id", "lang", "content").mapInArrow(run, "entry_id bigint, pos int, hash bigint")


def line_counts(corpus: DataFrame) -> DataFrame:
    """entry_id, lang, code, comment, blank."""
    schema = pa.schema([("entry_id", pa.int64()), ("lang", pa.string()), *((n, pa.int64()) for n in ("code", "comment", "blank"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, g, *tokens.counts((c or "").encode(), g)) for i, g, c in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return corpus.select("entry_id", "lang", "content").mapInArrow(run, "entry_id bigint, lang string, code bigint, comment bigint, blank bigint")


def granule_rows(corpus: DataFrame) -> DataFrame:
    """entry_id, path, fn_name, byte and line range of each function."""

    schema = pa.schema([("entry_id", pa.int64()), ("path", pa.string()), ("fn_name", pa.string()), *((n, pa.int32()) for n in ("byte_start", "byte_end", "line_start", "line_end"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, p, *g) for i, p, lang, c in zip(*(c.to_pylist() for c in batch.columns), strict=True) for g in slicing.slice_functions((c or "").encode(), lang)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return corpus.select("entry_id", "path", "lang", "content").mapInArrow(run, "entry_id bigint, path string, fn_name string, byte_start int, byte_end int, line_start int, line_end int")


def sketch_similarity(a: Column, b: Column) -> Column:
    """Share of equal slots."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(SLOTS))


def pad_sketch(slots: Column) -> Column:
    """A stored sketch brought to its full number of slots."""
    return F.slice(F.concat(slots, F.array_repeat(F.lit(P).cast("bigint"), SLOTS)), 1, SLOTS)
