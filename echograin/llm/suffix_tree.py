"""Language-model scoring with a probabilistic suffix tree over words.

States are contexts of preceding words, of any length; a text is scored word by word in the longest state that is a
suffix of what went before. The tree grows level by level. A context is a candidate if it was seen ``min_count`` times
in training, however large the corpus, and the context without its first word, its parent, is a state; it is retained
where its next-symbol distribution diverges from its parent's: the likelihood gain of its counts (a Kullback-Leibler
divergence times its count) has to pay for its parameters, ``test`` times half a logarithm of the corpus size each. The
tree is finished when a level retains nothing; there is no other bound on depth. Distributions are smoothed by
interpolation with the parent's (Witten-Bell; counts below the limit join the parent's share), down to add-one unigrams
over all training tokens.

Words, grams, states and weights are tables in the shared folder, keyed by 64-bit hashes, and grow with the corpus.
Texts' words are hashed once; counts and look-ups move as buckets of keys, a row each, instead of a row a gram. A text's
log score is a sum over its grams of all orders: a gram adds what it changes against its parent's share, and,
as a context, its share. So one join of a text's grams with one table of weights scores it. Two broadcasts of bounded
size spare rows but decide nothing: the weights of the most frequent grams, and a bitmap of hashes, which leaves out
only keys that are surely not in the table. Each goes as soon as its job is done.

The places below a level's states hold those of all deeper levels. Once they are few, they are written with the words
before them, and the deeper levels count there instead of in all texts. What is below a state lies at its own places,
so all levels that the windows reach are worked on in one job, states parted into buckets; places that reach further get
longer windows and another job. Only below a state with more places than a task may hold, levels stay tables.

Defined cases: null text is empty and scores as its end alone; a table without training rows gives N = V = 0, so every
token has the probability 1; repeated rows count each time; a null id counts as remainder 0, so for training; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, give_back, materialize, release, sweeping, text_slices
from .hashing import word_hashes

MIN_COUNT = 2
TEST = 1.0
MODULUS, HELD_OUT = 7, 2
#: Weights that are broadcast, and bits of the bitmap of keys, at any corpus size.
CACHE, BITS = 400_000, 27
#: Places are written with so many words before them (or more, at greater depth) once at most one token in FEW is one.
WINDOW, FEW = 16, 64
#: Words in a state's windows from which levels are tables; states with fewer are worked on in buckets of BUCKET words.
IN_PIECE, BUCKET = 4_000_000, 500_000
#: The longest windows, and states' keys that are broadcast sorted, beside their bitmap.
WIDEST, EXACT = 4096, 250_000
#: Grams of a bucket of counts, and weights of a bucket that texts' grams are looked up in.
COUNTED, WEIGHED = 1 << 19, 1 << 18
#: Grams of a bucket that meets those of the level above, bytes of text that are packed together, and of packed texts that
#: are worked on at a time (one pack at least).
MET, PACKED, SLICE = 1 << 17, 4 << 20, 1 << 20
END = np.uint64(0x5EED5EED5EED5EED)


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted ``keys``, and which are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def ranks(key: np.ndarray) -> np.ndarray:
    """Places of 64-bit hashes in their order. Sorting takes a fraction of the time if no places are asked for, so these
    stand in the hashes' last bits; where the bits left do not tell two hashes apart, that order may be wrong, and the
    usual one is taken."""
    bits = max(len(key) - 1, 0).bit_length()
    if bits <= 21 and key.dtype == np.uint64:
        mask = np.uint64((1 << bits) - 1)
        rank = (np.sort((key & ~mask) | np.arange(len(key), dtype=np.uint64)) & mask).view(np.int64)
        own = key[rank]
        if (own[1:] >= own[:-1]).all():
            return rank
    return np.argsort(key)


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes, and each one's place among them."""
    rank = ranks(key)
    own = key[rank]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    at = np.empty(len(key), np.int64)
    at[rank] = np.cumsum(new) - 1
    return own[new], at


def gram_key(context: np.ndarray, shorter: np.ndarray, order: int) -> np.ndarray:
    """Key of a gram by those of its context (without the last word) and of the gram without its first word."""
    x = context * np.uint64(0x9E3779B97F4A7C15) + shorter + np.uint64(order)
    for factor in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def pack(words: np.ndarray, bounds: np.ndarray) -> bytes:
    """Texts' words as numbers in the pack's own list of words, the most frequent first, byte by byte and compressed: an
    eighth to a third of their hashes."""
    own, code = distinct(words)
    rank = np.argsort(-np.bincount(code, minlength=len(own)), kind="stable")
    place = np.empty(len(own), "<u4")
    place[rank] = np.arange(len(own), dtype=np.uint32)
    planes = np.ascontiguousarray(place[code].view(np.uint8).reshape(-1, 4).T)
    raw = b"".join(x.tobytes() for x in (np.array([len(own), len(bounds) - 1], "<u8"), own[rank], np.diff(bounds).astype("<u4"), planes))
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(value: pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The list of words, the numbers of all texts' words in it, and how many each text has."""
    raw = pa.decompress(value[8:], int.from_bytes(value[:8].to_pybytes(), "little"), "zstd")
    n, rows = np.frombuffer(raw, "<u8", 2).tolist()
    own, sizes = np.frombuffer(raw, "<u8", n, 16), np.frombuffer(raw, "<u4", rows, 16 + 8 * n)
    code = np.zeros(int(sizes.sum()), np.uint32)
    for k, plane in enumerate(np.frombuffer(raw, np.uint8, 4 * len(code), 16 + 8 * n + 4 * rows).reshape(4, -1)):
        if plane.any():
            code |= plane.astype(np.uint32) << np.uint32(8 * k)
    return own, code, sizes


def is_text(column: pa.Array) -> bool:
    return pa.types.is_string(column.type) or pa.types.is_large_string(column.type)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the texts with their ends, keys of all their tokens, and the tokens' places in their texts. A binary
    column has packs of texts."""
    if is_text(column):
        words, bounds = word_hashes(column)
        sizes = np.diff(bounds) + 1
    else:
        packs = [unpack(x.as_buffer()) for x in column]
        words = np.concatenate([np.zeros(0, np.uint64), *(own[code] for own, code, _ in packs)])
        sizes = np.concatenate([np.zeros(0, np.int64), *(n for _, _, n in packs)]) + 1
    first = np.full(len(words) + len(sizes), END)
    ends = np.cumsum(sizes) - 1
    inner = np.ones(len(first), bool)
    inner[ends] = False
    first[inner] = words
    return sizes, first, np.arange(len(first)) - np.repeat(ends + 1 - sizes, sizes)


def word_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct tokens and their counts."""
    if is_text(column):
        return np.unique(tokens(column)[1], return_counts=True)
    packs = [unpack(x.as_buffer()) for x in column]
    key = np.concatenate([[END], *(own for own, _, _ in packs)])
    key, _, n = sums_by(key, np.concatenate([[sum(len(x) for _, _, x in packs)], *(np.bincount(code, minlength=len(own)) for own, code, _ in packs)]))
    return key, n


def longer(keys: np.ndarray, order: int) -> np.ndarray:
    """Keys of the grams of ``order`` that end at each token, by those of one word less (a gram of order k is one from
    place k - 1 on)."""
    return gram_key(np.concatenate([keys[:1], keys[:-1]]), keys, order)


def hashed(column: pa.Array, orders: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Lengths of the texts, keys of the grams of each order that end at each token, and the tokens' places."""
    sizes, first, place = tokens(column)
    keys = [first]
    for order in range(2, orders + 1):
        keys.append(longer(keys[-1], order))
    return sizes, [k.view(np.int64) for k in keys], place


def bitmap(keys: DataFrame, rows: int | None = None) -> np.ndarray:
    """Bits of the column ``key``, 64 for each key and 2 ** BITS at most: a key whose bit is not set is not in the
    column. A binary column has buckets of keys, ``rows`` of them."""
    n_bits = min(BITS, max(20, (64 * (keys.count() if rows is None else rows)).bit_length()))
    share = max(0, min(6, n_bits - 6))  # bits of the map's parts

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in gathered(batches):
            key = held.column("key")
            at = np.unique((spread(key, "<u8") if pa.types.is_binary(key.type) else key.to_numpy().view(np.uint64)) >> np.uint64(64 - n_bits))
            yield pa.RecordBatch.from_arrays(in_buckets(at << np.uint64(64 - n_bits), share, at.astype("<u4")), ["bucket", "at"])

    def fill(group: pa.Table) -> pa.Table:
        own = np.zeros(1 << (n_bits - share), np.uint8)
        own[numbers(group.column("at"), "<u4") & np.uint32(len(own) - 1)] = 1
        return pa.table({"bucket": group.column("bucket")[:1], "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    with sweeping(keys.sparkSession):
        found = keys.select("key").mapInArrow(gather, "bucket int, at binary").groupBy("bucket").applyInArrow(fill, "bucket int, bits binary").toArrow()
    out = np.zeros((1 << share, 1 << (n_bits - share - 6)), np.uint64)
    for bucket, bits in zip(found.column("bucket").to_pylist(), found.column("bits").to_pylist(), strict=True):
        out[bucket] = np.frombuffer(bits, "<u8")
    return out.reshape(-1)


def maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.view(np.uint64) >> np.uint64(64 - 5 - len(bits).bit_length())
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def bits_of(rows: int, size: int) -> int:
    """So many first bits of a key part ``rows`` rows into buckets of ``size``."""
    return min(16, max(0, (rows - 1) // size).bit_length())


def squeeze(x: np.ndarray) -> bytes:
    """Numbers byte by byte and compressed: first bytes of sorted keys, and most of small numbers, take no room."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T)
    return planes.size.to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unsqueeze(value: pa.Buffer, kind: str) -> np.ndarray:
    raw = pa.decompress(value[8:], int.from_bytes(value[:8].to_pybytes(), "little"), "zstd")
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def in_buckets(key: np.ndarray, bits: int, *columns: np.ndarray, squeezed: bool = False) -> list[pa.Array]:
    """Buckets by the first ``bits`` bits of the sorted ``key``, and each one's part of the columns as bytes: a row is a
    bucket, so what a row costs is not paid for every number. ``squeezed``: as those of :func:`squeeze`."""
    return in_groups((key >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int32), *columns, squeezed=squeezed)


def in_groups(bucket: np.ndarray, *columns: np.ndarray, squeezed: bool = False) -> list[pa.Array]:
    """The same by sorted buckets."""
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(first, len(bucket))
    out = [pa.array(bucket[first])]
    if squeezed:
        return out + [pa.array([squeeze(x[a:z]) for a, z in zip(first.tolist(), ends[1:].tolist() if len(first) else [])], pa.binary()) for x in columns]
    for x in columns:
        x = np.ascontiguousarray(x)
        out.append(pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)]))
    return out


def numbers(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """The numbers of all buckets in a column."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def spread(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """The same, of squeezed buckets."""
    return np.concatenate([np.zeros(0, kind), *(unsqueeze(x.as_buffer(), kind) for x in column)])


def sums_by(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The sorted distinct keys, the place of one row of each, and each column's sums."""
    rank = ranks(key)
    key = key[rank]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return key[first], rank[first], *(np.add.reduceat(c[rank], first) if len(first) else c for c in columns)


_GRAMS = "kind int, bucket int, context binary, shorter binary, n binary"
GRAM, TOTAL = range(2)


def _gram_counts(parent: np.ndarray | None, context: np.ndarray, shorter: np.ndarray, order: int, above: np.ndarray | None, below: np.ndarray | None, bits: int, part: int | None) -> Iterator[pa.RecordBatch]:
    """Counts of the grams whose context may be a candidate, and, where not all are counted, of their contexts.
    ``part``: the first bit of the grams' keys, if only one half of them is asked for."""
    if above is not None:
        may = maybe(above, parent)
        context, shorter = context[may], shorter[may]
    if below is not None:
        may = maybe(below, context) & maybe(below, shorter)
        context, shorter = context[may], shorter[may]
    names = [x.split()[0] for x in _GRAMS.split(", ")]
    key = gram_key(context, shorter, order)
    if part is not None:
        own = key >> np.uint64(63) == part
        key, context, shorter = key[own], context[own], shorter[own]
    key, at, n = sums_by(key, np.ones(len(context), np.uint32))
    bucket, *columns = in_buckets(key, bits, context[at], shorter[at], n.astype("<u4"))
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), GRAM, np.int32)), bucket, *columns], names)
    if below is None and order > 2:
        key, _, n = sums_by(context, np.ones(len(context), np.uint32))
        bucket, *columns = in_buckets(key, bits, key, n.astype("<u4"))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), TOTAL, np.int32)), bucket, columns[0], pa.nulls(len(bucket), pa.binary()), columns[1]], names)


def _word_batches(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            key, n = word_counts(batch.column(0))
            bucket, *columns = in_buckets(key, bits, key, n.astype("<u4"))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), TOTAL, np.int32)), bucket, columns[0], pa.nulls(len(bucket), pa.binary()), columns[1]], [x.split()[0] for x in _GRAMS.split(", ")])

    return run


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 19) -> Iterator[pa.Table]:
    """Batches put together to so many rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


_COUNTS = "key bigint, context bigint, shorter bigint, n bigint"


def _bucket_counts(order: int, min_count: int):
    """Frequent grams of a bucket, or frequent contexts (shorter is null)."""

    def run(group: pa.Table) -> pa.Table:
        kind = group.column("kind")[0].as_py()
        context, n = numbers(group.column("context"), "<u8"), numbers(group.column("n"), "<u4").astype(np.int64)
        shorter = numbers(group.column("shorter"), "<u8") if kind == GRAM else None
        key, at, n = sums_by(gram_key(context, shorter, order) if kind == GRAM else context, n)
        kept = n >= min_count
        columns = [pa.array(x[kept].view(np.int64)) for x in (key, context[at], *([shorter[at]] if kind == GRAM else []), n)]
        if kind == TOTAL:
            columns.insert(2, pa.nulls(len(columns[0]), pa.int64()))
        return pa.table(columns, [x.split()[0] for x in _COUNTS.split(", ")])

    return run


def bucketed(frame: DataFrame, bits: int) -> DataFrame:
    """The rows of ``frame`` as buckets by the first bits of its first column, each column as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in gathered(batches):
            key, *others = (c.to_numpy() for c in held.columns)
            rank = ranks(key.view(np.uint64))
            yield pa.RecordBatch.from_arrays(in_buckets(key.view(np.uint64)[rank], bits, key[rank], *(x[rank] for x in others), squeezed=True), ["bucket", *held.column_names])
        give_back()

    return frame.mapInArrow(run, "bucket int, " + ", ".join(f"{c} binary" for c in frame.columns))


def _with_parents(order: int, bits: int):
    """The counted grams of a bucket of shorter grams whose shorter gram is under a state, with its share, as buckets of
    contexts."""

    def run(grams: pa.Table, parents: pa.Table) -> pa.Table:
        known = spread(parents.column("key"), "<u8")
        at = ranks(known)
        known = known[at]
        shorter, context = spread(grams.column("shorter"), "<u8"), spread(grams.column("context"), "<u8")
        where, there = find(known, shorter)
        rank = np.flatnonzero(there)
        rank = rank[ranks(context[rank])]
        context, key = context[rank], gram_key(context[rank], shorter[rank], order)
        p = spread(parents.column("p"), "<f8")[at[where[rank]]] if len(at) else np.zeros(0)
        give_back()
        return pa.table(in_buckets(context, bits, context, key, spread(grams.column("n"), "<i8")[rank], p, squeezed=True), ["bucket", "context", "key", "n", "p"])

    return run


_LEVEL = "kind int, key bigint, n bigint, p double, w double, g bigint"
UNDER, ALONE, STATE = range(3)


def _level(order: int, size: int, test: float):
    """States among a bucket's contexts (n: their tokens, w: the share they leave to their parents), and the grams under
    them; pairs are asked for their counts, so those under no state stay, too."""

    def run(grams: pa.Table, totals: pa.Table) -> pa.Table:
        context, key = (spread(grams.column(c), "<u8") for c in ("context", "key"))
        n, p = spread(grams.column("n"), "<i8"), spread(grams.column("p"), "<f8")
        contexts, of = distinct(context)
        known = spread(totals.column("key"), "<u8")
        at = ranks(known)
        known = known[at]
        where, there = find(known, contexts)
        total = np.where(there, spread(totals.column("n"), "<i8")[at[where]], 1) if len(at) else np.ones(len(contexts), np.int64)
        per = lambda x: np.bincount(of, x, len(contexts))
        kinds, kept, mass = per(np.ones(len(n))), per(n), per(p)
        rest, gain = total - kept, per(n * np.log(n / p)) - kept * np.log(total)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain += np.where(rest > 0, rest * np.log(rest / total / np.maximum(1 - mass, 1e-12)), 0)
        good = there & (gain >= test * np.log(max(size, 2)) / 2 * kinds)
        share, sum_, own = rest + kinds, total + kinds, good[of]
        alone = ~own & there[of] if order == 2 else np.zeros(len(of), bool)
        key_, of, n_, p = key[own], of[own], n[own], p[own]
        new = (n_ + share[of] * p) / sum_[of]
        change = np.log10(new) - np.log10(share[of] / sum_[of]) - np.log10(p)
        rows, zeros = (len(key_), int(alone.sum()), int(good.sum())), lambda k, kind=np.float64: np.zeros(rows[k], kind)
        columns = (
            np.repeat(np.arange(3, dtype=np.int32), rows),
            np.concatenate([key_, key[alone], contexts[good]]).view(np.int64),
            np.concatenate([n_, n[alone], total[good]]),
            np.concatenate([new, zeros(ALONE), zeros(STATE)]),
            np.concatenate([change, zeros(ALONE), np.log10(share[good] / sum_[good])]),
            np.concatenate([context[own], zeros(ALONE, np.uint64), zeros(STATE, np.uint64)]).view(np.int64),
        )
        give_back()
        return pa.table(list(map(pa.array, columns)), [x.split()[0] for x in _LEVEL.split(", ")])

    return run


def _keys_before(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """Keys and places of all tokens, and for the places with a gram of ``order``: their numbers, the key of the context
    without its first word (none in pairs), and those of context and shorter gram."""
    _, first, place = tokens(column)
    keys = before = first
    for k in range(2, order):
        before, keys = keys, longer(keys, k)
    at = np.flatnonzero(place >= order - 1)
    return first, place, at, before[at - 1] if order > 2 else None, keys[at - 1], keys[at]


def _gram_batches(shared, order: int, bits: int, part: int | None):
    """Counts of the grams of ``order`` words whose context may be a candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            yield from _gram_counts(*_keys_before(batch.column(0), order)[3:], order, *shared.value, bits, part)

    return run


_BASE = 0x9E3779B97F4A7C15


def runs(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Keys of the ``length`` words that end at each of the places ``at``: polynomials of the words, from running sums,
    whose cost does not depend on the length."""
    up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(words), x, np.uint64)])) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * down[:-1])])
    return (sums[at + 1] - sums[at + 1 - length]) * up[at]


def _window_batches(shared, order: int, width: int, by_runs: bool):
    """The last ``width`` words, or as many as there are, at the places whose context may be a candidate, and the key of
    the context without its first word; ``by_runs``: that of :func:`runs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            if by_runs:
                _, first, place = tokens(batch.column(0))
                at = np.flatnonzero(place >= order - 1)
                parent = runs(first, at - 1, order - 2)
            else:
                first, place, at, parent, _, _ = _keys_before(batch.column(0), order)
            above, exact = shared.value
            may = np.flatnonzero(maybe(above, parent))
            if exact is not None:
                may = may[find(exact, parent.view(np.int64)[may])[1]]
            at, parent = at[may], parent[may]
            sizes = np.minimum(place[at] + 1, width)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            each = np.arange(ends[-1]) - np.repeat(ends[1:] - 1 - at, sizes)
            words = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(first[each].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(parent.view(np.int64)), words], ["g", "words"])

    return run


def _windowed(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows with a gram of ``order`` at their end; keys of the context without its first word, context and shorter gram."""
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes >= order)
    words = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    keys = before = words[np.cumsum(sizes)[at][:, None] + np.arange(-order, 0)[None, :]]
    for k in range(2, order):
        before, keys = keys, gram_key(keys[:, :-1], keys[:, 1:], k)
    return at, before[:, 1], keys[:, 0], keys[:, 1]


_DEEP = "kind int, depth int, key bigint, w double, n bigint, g bigint, context bigint, p double"
WEIGHT, OPEN_GRAM, OPEN_STATE = range(3)


def extended(keys: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row j of ``keys`` has the keys of grams that end j words before the windows' ends and all begin with the same word.
    The same with all grams that begin with the last of ``words``, the next ones before; and for each of those words the
    grams that begin there, whole and without the last word. Works gram length by gram length, on all words at once."""
    k, b = len(keys), len(words)
    out, ends, here = np.empty((k + b, words.shape[1]), np.uint64), np.empty((b, 2, words.shape[1]), np.uint64), words
    for length in range(1, k + b + 1):
        low = max(0, length - k - 1)  # the first word with so long a gram
        if length > 1:
            before = np.concatenate([keys[k - length + 1][None], here[:-1]]) if length <= k + 1 else here[low - 1 - skipped : -1]
            here = gram_key(here[low - skipped :], before, length)
        skipped = low
        for last in (0, 1):
            i = length + last - 1 - k
            if 0 <= i < b:
                ends[i, last] = here[i - low]
        out[k + b - length] = here[-1]
    return out, ends


def deep_levels(windows: pa.Table, grams: pa.Table, order: int, width: int, size: int, min_count: int, test: float, depth: int) -> pa.Table:
    """The levels from ``order`` on, as far as the windows (g, words) reach, below the states g of the last level's
    ``grams`` (g, key, p): weights (key, w, n), and, where the windows end before the tree, the last level's grams (key,
    n, p, g, context) and states (context, g, and their places as n)."""
    parts = []

    def put(kind: int, at: int, rows: int, **columns: np.ndarray) -> None:
        columns |= {"kind": np.full(rows, kind, np.int32), "depth": np.full(rows, at, np.int32)}
        columns = {c: x.astype(np.int64) if c == "n" else x.view(np.int64) if x.dtype == np.uint64 else x for c, x in columns.items()}
        types = {"kind": pa.int32(), "depth": pa.int32(), "w": pa.float64(), "p": pa.float64()}
        names = [x.split()[0] for x in _DEEP.split(", ")]
        parts.append(pa.table({c: pa.array(columns[c], types.get(c, pa.int64())) if c in columns else pa.nulls(rows, types.get(c, pa.int64())) for c in names}))

    put(WEIGHT, 0, 0)
    list_ = windows.column("words").combine_chunks()
    sizes = pa.compute.list_value_length(list_).to_numpy(zero_copy_only=False)
    ends, flat = np.cumsum(sizes), list_.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    to_numpy = lambda t, c: t.column(c).to_numpy()
    here = np.flatnonzero((sizes >= order) & find(np.unique(to_numpy(grams, "g")), to_numpy(windows, "g"))[1])
    rank = np.argsort(to_numpy(grams, "key"))
    known, probability = to_numpy(grams, "key")[rank], to_numpy(grams, "p")[rank]
    sizes, last = sizes[here], ends[here] - 1
    word = lambda k: flat[last - k]
    keys, above = word(0)[None, :], None
    words = lambda k, z: flat[np.maximum(last - np.arange(k, z)[:, None], 0)]
    if order > 2:
        keys, _ = extended(keys, words(1, order - 1))
    ahead, shorter = [], keys[0]  # grams that end the windows, whole and without the last word, of the next orders
    while order <= min(width, depth):
        on = sizes >= order
        if above is not None:
            on &= find(above, context)[1]
        if not on.all():
            sizes, last, keys, shorter, ahead = sizes[on], last[on], keys[:, on], shorter[on], [x[:, on] for x in ahead]
        if not ahead:
            keys, ends_ = extended(keys, words(order - 1, order - 1 + min(max(1, order // 8), 64, min(width, depth) - order + 1)))
            ahead = list(ends_)
        gram, context = ahead.pop(0)
        context = context.view(np.int64)
        key, first, n = np.unique(gram.view(np.int64), return_index=True, return_counts=True)
        contexts, of = np.unique(context[first], return_inverse=True)
        total = np.bincount(of, n, len(contexts))
        where, there = find(known, shorter[first].view(np.int64))
        shorter = gram
        kept = there & (n >= min_count)
        key, n, of, p = key[kept], n[kept], of[kept], probability[where[kept]] if len(known) else np.zeros(0)
        per = lambda x: np.bincount(of, x, len(contexts))  # noqa: E731, B023
        kinds, counted, mass = per(np.ones(len(n))), per(n), per(p)
        rest, gain = total - counted, per(n * np.log(n / p))
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = gain - counted * np.log(total) + np.where(rest > 0, rest * np.log(rest / total / np.maximum(1 - mass, 1e-12)), 0)
        good = (kinds > 0) & (gain >= test * np.log(max(size, 2)) / 2 * kinds)
        if not good.any():
            return pa.concat_tables(parts)
        share, sum_ = rest + kinds, total + kinds
        own = good[of]
        key, n, of, p = key[own], n[own], of[own], p[own]
        above, known = contexts[good], key
        probability = (n + share[of] * p) / sum_[of]
        change = np.log10(probability) - np.log10(share[of] / sum_[of]) - np.log10(p)
        put(WEIGHT, order, len(key), key=key, w=change, n=n)
        put(WEIGHT, order, len(above), key=above, w=np.log10(share[good] / sum_[good]), n=np.zeros(len(above), np.int64))
        order += 1
    if above is not None:
        one, at = np.unique(context, return_index=True)
        at = at[find(one, contexts)[0]]
        g, power = np.zeros(len(contexts), np.uint64), np.uint64(1)
        for k in range(1, order - 1):
            g += flat[last[at] - k] * power
            power = np.uint64(int(power) * _BASE % (1 << 64))
        put(OPEN_GRAM, order - 1, len(key), key=key, n=n, p=probability, g=g[of], context=contexts[of])
        put(OPEN_STATE, order - 1, len(above), n=total[good], g=g[good], context=above)
    return pa.concat_tables(parts)


def deep_job(train: DataFrame, states: DataFrame, level: DataFrame, order: int, width: int, words: int, by_runs: bool, *rest) -> DataFrame:
    """:func:`deep_levels` in buckets of states. ``words``: about how many there are in all windows."""
    keys = states.select(F.col("g" if by_runs else "context").alias("key"))
    exact = keys.limit(EXACT + 1).toArrow().column(0).to_numpy()
    windows = windows_of(train, order, bitmap(keys), np.sort(exact) if len(exact) <= EXACT else None, width, by_runs)
    bucket = F.pmod("g", F.lit(1 + words // BUCKET)).alias("bucket")
    grams = level.where("w IS NOT NULL").select("g", "key", "p", bucket)
    work = lambda a, b: deep_levels(a, b, order, width, *rest)
    found = windows.select("g", "words", bucket).groupBy("bucket").cogroup(grams.groupBy("bucket")).applyInArrow(work, _DEEP)
    found = materialize(found, f"pst-deep-{order}")
    release(windows)
    return found


def _windowed_gram_batches(shared, order: int, bits: int, part: int | None):
    """The same counts as those of :func:`_gram_batches`, of the grams that end windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1 << 16):
                column = batch.column(0).slice(k, 1 << 16)
                yield from _gram_counts(*_windowed(column, order)[1:], order, *shared.value, bits, part)

    return run


def counted_grams(train: DataFrame, order: int, above: np.ndarray | None, below: np.ndarray | None, windows: bool = False, min_count: int = MIN_COUNT, rows: int = 0, part: int | None = None):
    """key, context, shorter, n of the frequent grams, and the broadcast to drop once that is written; rows without
    ``shorter`` have the counts of frequent contexts, if ``below`` does not leave any grams out. ``above``: bits of the
    states that a context's parent must be one of (pairs have no parent to look for). ``below``: bits of the frequent
    grams that context and shorter gram must be two of. ``windows``: whether ``train`` has windows instead of texts.
    ``rows``: about how many grams there are. ``part``: which half of the grams, if ``below`` is given."""
    shared, bits = train.sparkSession.sparkContext.broadcast((above, below)), bits_of(rows, COUNTED)
    run = _windowed_gram_batches(shared, order, bits, part) if windows else _gram_batches(shared, order, bits, part)
    found = train.select("words" if windows else "text").mapInArrow(run, _GRAMS)
    return found.groupBy("kind", "bucket").applyInArrow(_bucket_counts(order, min_count), _COUNTS), shared


def windows_of(train: DataFrame, order: int, above: np.ndarray, exact: np.ndarray | None, width: int, by_runs: bool = False) -> DataFrame:
    """g, words: windows at the places of ``train`` whose context may be a candidate for ``order``; is one, if ``exact``
    has the states' sorted keys. g: the key of the state, that of :func:`runs` if ``by_runs``."""
    shared = train.sparkSession.sparkContext.broadcast((above, exact))
    found = materialize(train.select("text").mapInArrow(_window_batches(shared, order, width, by_runs), "g bigint, words array<bigint>"), f"pst-windows-{order}")
    shared.destroy()
    return found


def fit_tables(train: DataFrame, min_count: int = MIN_COUNT, test: float = TEST, depth: int | None = None) -> tuple[DataFrame, int, int, int]:
    """The tree as weights (key, w, base, known, n; they add up where a key is a gram's and a state's; the tables they are
    read from are in ``_held``), training tokens, distinct words, and the tree's depth.

    ``depth`` ends the tree early, for comparisons.
    """
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    words = train.select("text").mapInArrow(_word_batches(bits_of(size >> 3, COUNTED)), _GRAMS)
    words = materialize(words.groupBy("kind", "bucket").applyInArrow(_bucket_counts(1, 1), _COUNTS).select("key", "n"), "pst-words")
    n, v = (x or 0 for x in words.agg(F.sum("n"), F.count("*")).first())
    nothing = F.lit(0.0)
    parts = [words.select("key", F.log10(F.col("n") + 1).alias("w"), F.log10(F.col("n") + 1).alias("base"), F.lit(1).alias("known"), "n")]
    # Weight null: the gram's context is no state, so none of its extensions has one as parent.
    level = words.select("key", "n", ((F.col("n") + 1) / F.lit(float(n + v + 1))).alias("p"), nothing.alias("w")).where(F.col("n") >= min_count)
    states, order, held, covered, hottest, windows, width, by_runs = None, 1, [words], n, n, None, 0, False
    while depth is None or order <= depth:
        reached, order = order, order + 1
        # Words and pairs are all counted, so what is not among the frequent ones can be left out, and a context's count
        # is known. Later levels count the grams of candidates only, so a context's count is that of all its grams: the
        # rare ones are counted too (every context is followed by a token).
        whole = order <= 3
        few = not whole and covered * FEW <= n
        wide = min(max(WINDOW, n // (4 * max(covered, 1)), 2 * order), max(WIDEST, 2 * order))
        if few and hottest * 2 * order <= IN_PIECE:
            wide = max(2 * order, min(wide, IN_PIECE // hottest))
            deep = deep_job(train, states, level, order, wide, covered * wide, by_runs, n, min_count, test, depth + 1 if depth else 1 << 62)
            held.append(deep)
            parts.append(deep.where(F.col("kind") == WEIGHT).select("key", "w", nothing.alias("base"), F.lit(0).alias("known"), "n"))
            level = deep.where(F.col("kind") == OPEN_GRAM).select("key", "n", "p", nothing.alias("w"), "g")
            states = deep.where(F.col("kind") == OPEN_STATE).select("context", "g", F.col("n").alias("total"))
            places = F.when(F.col("kind") == OPEN_STATE, F.col("n"))
            order, covered, hottest = deep.agg(F.coalesce(F.max("depth"), F.lit(reached)), F.sum(places), F.max(places)).first()
            by_runs = True
            if covered is None:
                break
            continue
        above = bitmap(states.select(F.col("context").alias("key"))) if states is not None else None
        if few and order > width:
            release(windows)
            width = max(WINDOW, 4 * order)
            windows = windows_of(train, order, above, None, width)
        below = bitmap(level.select("key")) if whole else None
        # Written before they meet the level above, so that the counts' shuffle, the largest, is gone before others come;
        # that of all pairs and triples goes in halves, one on disk at a time.
        halves, counts = [], None
        for part in (0, 1) if whole else (None,):
            grams_, shared = counted_grams(windows or train, order, above, below, windows is not None, min_count, covered, part)
            halves.append(materialize(grams_.drop("key"), f"pst-counts-{order}"))
            shared.destroy()
            counts = halves[-1] if counts is None else counts.unionByName(halves[-1])
        # Only parents under a state, so what the bitmap let by in excess goes here.
        bits = bits_of(counts.count(), MET)
        grams = bucketed(counts.where("shorter IS NOT NULL").select("shorter", "context", "n"), bits)
        parents = bucketed(level.where("w IS NOT NULL").select("key", "p"), bits)
        counted = grams.groupBy("bucket").cogroup(parents.groupBy("bucket")).applyInArrow(_with_parents(order, bits), "bucket int, context binary, key binary, n binary, p binary")
        counted = materialize(counted, f"pst-parents-{order}")
        if whole:
            release(*halves)
        totals = bucketed(level.select("key", "n") if whole else counts.where("shorter IS NULL").select(F.col("context").alias("key"), "n"), bits)
        grown = counted.groupBy("bucket").cogroup(totals.groupBy("bucket")).applyInArrow(_level(order, n, test), _LEVEL)
        grown = materialize(grown, f"pst-level-{order}")
        release(counted, *([] if whole else halves))
        by_runs = False
        states = grown.where(F.col("kind") == STATE).select(F.col("key").alias("context"), F.col("n").alias("total"), "w")
        covered, hottest = states.agg(F.sum("total"), F.max("total")).first()  # tokens after a state
        if covered is None:
            order -= 1
            release(grown)
            break
        level = grown.where(F.col("kind") != STATE).select("key", "n", "p", F.when(F.col("kind") == UNDER, F.col("w")).alias("w"), "g")
        parts.append(grown.where(F.col("kind") != ALONE).select("key", "w", nothing.alias("base"), F.lit(0).alias("known"), F.when(F.col("kind") == UNDER, F.col("n")).otherwise(F.lit(0)).cast("long").alias("n")))
        held.append(grown)
    every = parts[0]
    release(windows)
    for part in parts[1:]:
        every = every.unionByName(part)
    every._held = held
    return every, n, v, order


#: Texts' other grams are looked up by the first bits of their keys, part after part, so that one part's shuffle is on disk.
PART_BITS = 2
RARE = [f"rare{k}" for k in range(1 << PART_BITS)]
_SCORES = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, tree double, " + ", ".join(f"{c} struct<bucket: int, first: bigint, key: binary, owner: binary>" for c in RARE)
_BUCKET = [("bucket", pa.int32()), ("first", pa.int64()), ("key", pa.binary()), ("owner", pa.binary())]
#: Bits of the table that leads to the broadcast weights.
SLOTS = 22


def slots_of(keys: np.ndarray) -> np.ndarray:
    """For the first bits of a key, the place in ``keys`` of one that begins with them."""
    out = np.zeros(1 << SLOTS, np.int32)
    out[(keys.view(np.uint64) >> np.uint64(64 - SLOTS)).astype(np.int64)] = np.arange(len(keys), dtype=np.int32)
    return out


def _score_batches(shared, depth: int, n_bits: int):
    """Sums of the broadcast weights of each text; keys of its other grams that may have one."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("tree", pa.float64()), *((c, pa.struct(_BUCKET)) for c in RARE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (cached, w, base, known, bits), row = shared.value, TaskContext.get().partitionId() << 40
        slots, cached = slots_of(cached), cached.view(np.uint64)
        for batch in text_slices(batches, "text", 1):  # a pack, so texts have short numbers
            sizes, key, place = tokens(batch.column(1))
            rows, of = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
            sums, owners, rare, open_ = np.zeros((3, rows)), [], [], np.arange(len(key))
            for order in range(1, depth + 1):
                # A gram has a weight only if the one without its first word has.
                if order > 1:
                    key, open_ = longer(key, order), open_[place[open_] >= order - 1]
                mine = key[open_]
                # Those that share their first bits with another one are looked up like all others.
                at = slots[(mine >> np.uint64(64 - SLOTS)).view(np.int64)]
                hit = cached[at] == mine if len(cached) else np.zeros(len(mine), bool)
                own, at, other = of[open_[hit]], at[hit], np.flatnonzero(~hit)
                for i, column in enumerate((w, base, known) if order == 1 else (w,)):
                    sums[i] += np.bincount(own, column[at], rows)
                other = other[maybe(bits, mine[other])]
                owners.append(of[open_[other]])
                rare.append(mine[other])
                hit[other] = True
                open_ = open_[hit]
                if not len(open_):
                    break
                left = np.bincount(of[open_], minlength=rows) > 0
                if 2 * sizes[left].sum() < len(key):  # the others' tokens are done
                    there = left[of]
                    open_ = (np.cumsum(there) - 1)[open_]
                    key, place, of = key[there], place[there], of[there]
            owner, key = np.concatenate(owners), np.concatenate(rare)
            rank = ranks(key)
            key, owner = key[rank], owner[rank].astype("<u2")
            own = [pa.array(np.arange(row, row + rows)), _ids(batch.column(0)[0].as_buffer()), pa.repeat(batch.column(2)[0], rows), *(pa.array(x) for x in (sizes, np.rint(sums[2]).astype(np.int64), sums[1], sums[0]))]
            yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(rows, f.type) for f in list(schema)[len(own):])], schema=schema)
            cuts = [0, *np.searchsorted(key >> np.uint64(64 - PART_BITS), np.arange(1, len(RARE))).tolist(), len(key)]
            for k, (a, z) in enumerate(zip(cuts, cuts[1:])):  # a part is a column, so it is read alone
                bucket, *others = in_buckets(key[a:z], n_bits, key[a:z], owner[a:z], squeezed=True)
                buckets = pa.StructArray.from_arrays([bucket, pa.array(np.full(len(bucket), row)), *others], [c for c, _ in _BUCKET])
                columns = [pa.nulls(len(buckets), f.type) for f in schema]
                columns[len(own) + k] = buckets
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
            row += rows

    return run


def _chosen(batches: Iterator[pa.RecordBatch], choose) -> Iterator[pa.RecordBatch]:
    """Weights (key, w, base, known) of the rows of buckets that ``choose`` picks by their keys and counts."""
    for batch in batches:
        columns = [spread(batch.column(c), t) for c, t in _WEIGHT]
        own = choose(columns[0], columns[-1])
        yield pa.RecordBatch.from_arrays([pa.array(x[own]) for x in columns[:-1]], [c for c, _ in _WEIGHT[:-1]])


_WEIGHT = [("key", "<i8"), ("w", "<f8"), ("base", "<f8"), ("known", "<i4"), ("n", "<i8")]


def most_frequent(table: DataFrame) -> list[np.ndarray]:
    """Key, w, base and known of the most frequent grams of the buckets in ``table``, CACHE at most, sorted by key."""

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in gathered(batches):
            n, count = np.unique(spread(held.column("n"), "<i8"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n[n > 0]), pa.array(count[n > 0])], ["n", "rows"])

    schema = "key bigint, w double, base double, known int"
    counts = table.select("n").mapInArrow(histogram, "n bigint, rows bigint").groupBy("n").agg(F.sum("rows").alias("rows")).toArrow().sort_by([("n", "descending")])
    least = counts.column("n").to_numpy()[np.cumsum(counts.column("rows").to_numpy()) <= CACHE]
    least = int(least[-1]) if len(least) else 1 << 62
    table = table.drop("bucket")
    keys = np.unique(table.mapInArrow(lambda batches: _chosen(batches, lambda _, n: n >= least), schema).select("key").toArrow().column(0).to_numpy())
    # Where a gram is a state, too, that weight has a row of its own.
    shared = table.sparkSession.sparkContext.broadcast(keys)
    top = table.mapInArrow(lambda batches: _chosen(batches, lambda key, _: find(shared.value, key)[1]), schema).toArrow()
    shared.destroy()
    key, _, *sums = sums_by(*(top.column(c).to_numpy() for c, _ in _WEIGHT[:-1]))
    return [key, *sums]


#: Bits of the texts' numbers that are one bucket's, when their sums are added up.
ROWS = 12
_SUMS = ["bucket", "row", "w", "base", "known"]


def _looked_up(wanted: pa.Table, weights: pa.Table) -> pa.Table:
    """Sums of a bucket's weights for each row that has grams there, as buckets of rows: a text may have grams in any
    number of buckets."""
    key, firsts = spread(wanted.column("key"), "<u8"), wanted.column("first").to_pylist()
    owner = np.concatenate([np.zeros(0, np.int64), *(unsqueeze(x.as_buffer(), "<u2") + np.int64(first) for x, first in zip(wanted.column("owner"), firsts))])
    columns = [spread(weights.column(c), t) for c, t in (("w", "<f8"), ("base", "<f8"), ("known", "<i4"))]
    known, _, *columns = sums_by(spread(weights.column("key"), "<u8"), *columns)
    at, hit = find(known, key)
    row, _, *sums = sums_by(owner[hit], *(c[at[hit]] for c in columns))
    give_back()
    return pa.table(in_groups(row >> ROWS, row, *sums[:2], sums[2].astype(np.int64), squeezed=True), _SUMS)


def _summed(parts: pa.Table) -> pa.Table:
    """Sums of all buckets for a bucket of texts."""
    row, _, *sums = sums_by(*(spread(parts.column(c), t) for c, t in zip(_SUMS[1:], ("<i8", "<f8", "<f8", "<i8"))))
    return pa.table([pa.array(x) for x in (row, *sums)], ["row", *(f"rare_{c}" for c in _SUMS[2:])])


def score(docs: DataFrame, weights: DataFrame, n: int, v: int, depth: int) -> DataFrame:
    """Scores of the texts in the packs of ``docs`` (doc_id, text, held_out); ``depth`` is the longest gram's order. Tables
    written for it are deleted as soon as they are read."""
    rows = weights.count()
    bits = PART_BITS + bits_of(rows >> PART_BITS, WEIGHED)
    table = materialize(bucketed(weights.select(*(c for c, _ in _WEIGHT)), bits), "pst-buckets")
    release(*weights._held)
    shared = docs.sparkSession.sparkContext.broadcast((*most_frequent(table), bitmap(table.select("key"), rows)))
    found = materialize(docs.select("doc_id", "text", "held_out").mapInArrow(_score_batches(shared, depth, bits), _SCORES), "pst-scores")
    shared.destroy()
    release(docs)
    rare = None
    for k, column in enumerate(RARE):
        own = table.where(F.shiftright("bucket", bits - PART_BITS) == k).drop("n")
        wanted = found.select(column + ".*").where("bucket IS NOT NULL")
        part = wanted.groupBy("bucket").cogroup(own.groupBy("bucket")).applyInArrow(_looked_up, "bucket bigint, row binary, w binary, base binary, known binary")
        part = materialize(part, f"pst-rare-{k}")
        rare = part if rare is None else rare.unionByName(part)
    release(table)
    found = found.where("row IS NOT NULL").drop(*RARE)
    rare = rare.groupBy("bucket").applyInArrow(_summed, "row bigint, rare_w double, rare_base double, rare_known bigint")
    unseen = F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    return found.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - unseen).alias("base_score"), (F.col("tree") + F.coalesce("rare_w", F.lit(0.0)) - unseen).alias("score"),
    )


def _ids(value: pa.Buffer) -> pa.Array:
    """The numbers of a pack's texts, null where their last byte is 0."""
    rows = value.size // 9
    return pa.array(np.frombuffer(value, "<i8", rows), mask=np.frombuffer(value, np.uint8, rows, 8 * rows) == 0)


def _pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text", PACKED):
        for held in (False, True):
            every = batch.filter(pa.compute.equal(batch.column(2), held))
            for own in (every.slice(k, 1 << 16) for k in range(0, every.num_rows, 1 << 16)):
                ids = own.column(0).fill_null(0).to_numpy().tobytes() + own.column(0).is_valid().to_numpy(zero_copy_only=False).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([ids], pa.binary()), pa.array([pack(*word_hashes(own.column(1)))], pa.binary()), pa.array([held])], ["doc_id", "text", "held_out"])


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_count: int = MIN_COUNT, test: float = TEST) -> DataFrame:
    """Fits on the rows whose id's crc32 leaves another remainder than the held-out one, and scores all rows."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), (crc_mod(F.col(doc_id), MODULUS) == HELD_OUT).alias("held_out"))
    # Every level reads all texts again, so their words are hashed once. Rows are packs of training or of held-out texts.
    own = materialize(own.mapInArrow(_pack_batches, "doc_id binary, text binary, held_out boolean"), "pst-tokens")
    return score(own, *fit_tables(own.where(~F.col("held_out")), min_count, test))
