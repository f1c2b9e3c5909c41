"""Hashes of the words of a column of texts, computed in arrays over the texts' bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time.
PART = 1 << 16

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply and shift), one to one."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_values() -> np.ndarray:
    values = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


def _one_of(characters: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(characters))


_BYTES = _byte_values()
#: What parts words: white space, or all ASCII but letters and digits.
SPACE = _one_of(b" \t\n\x0b\x0c\r")
NO_LETTERS = _one_of(bytes(c for c in range(128) if not chr(c).isalnum()))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 16)
        _powers[:] = [np.cumprod(np.full(n, x, np.uint64)) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers


def _part_hashes(data: np.ndarray, edges: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of UTF-8 bytes, and where each begins; ``edges`` (the first bytes of texts)
    begin a word too. A word's hash is a polynomial of values of its bytes, from running sums."""
    gap = space[data]
    first = np.ones(len(data), bool)
    first[1:] = gap[:-1]
    first[edges[edges < len(data)]] = True
    last = np.ones(len(data), bool)
    last[:-1] = gap[1:] | first[1:]
    starts, ends = np.flatnonzero(first & ~gap), np.flatnonzero(last & ~gap)
    up, down = _power_tables(len(data))
    terms = _BYTES[data] * up[: len(data)]
    sums = np.cumsum(terms)
    h = (sums[ends] - sums[starts] + terms[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93)), starts


def word_hashes(column: pa.Array, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased (A-Z) words of all texts, and bounds: those of text k are at
    bounds[k]:bounds[k + 1]. Null texts have none."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    hashes, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(data):  # parts, cut behind white space
        to = min(at + PART, len(data))
        while to < len(data) and not space[data[to - 1]]:
            more = np.flatnonzero(space[data[to : to + PART]])
            to = min(len(data), to + (int(more[0]) + 1 if len(more) else PART))
        h, own = _part_hashes(data[at:to], ends[(ends >= at) & (ends < to)] - at, space)
        hashes.append(h)
        starts.append(own + at)
        at = to
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), ends)
