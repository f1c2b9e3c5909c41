"""N-gram Jaccard join in metric space.

Jaccard distance is a metric, and the join works by pivots, regions and windows:

0. *Sets.* Every text is one pass away from its set; a set leaves a digest, its prefix and a signature (below).
1. *Pivots and their regions.* Distances between whole documents are nearly all close to 1, where a window of two radii
   around any pivot holds almost the whole corpus (README has figures), so a document must first learn which pivots are
   not in its far cell. Every set is ordered by one total order of shingles, rare ones first; of a set of n, the first
   n - ceil(t n) + 1 are its prefix, and two linked sets share a shingle of both prefixes. The pivot of a shingle is the
   document that has it in its prefix (among sets of nearly its size, where they are many) and whose mixed id is
   smallest; the region of a pivot is all documents that meet
   it so. Linked documents therefore lie together in a region at least, and a document that meets nobody leaves at once.
   Mixed ids are one order for all shingles, so a group of near copies makes a few regions, not one for every shingle.
2. *Small regions* (``CAPACITY`` of shingles and documents) are first parted by signatures, which bound distances from
   below: a byte for each part of the universe of shingles, and sets that differ in more parts than linked sets can in
   elements are not linked. What is left is compared whole, in one task each: exact intersections, from which a spanning
   forest of the links is returned, never the links themselves.
3. *Large regions* are cut by Voronoi cells: ``PIVOTS`` members of theirs are new pivots, every member's distance to
   them is measured, a member goes to the cell of its nearest pivot and, by the triangle inequality, into the window of
   each pivot that is at most two radii farther (a linked document may have that one as its nearest). Pivots have met
   everybody and leave; cells are regions again, recursively.
4. A region that cells do not separate (all members as near to each other as to the pivots) is compared in blocks: what
   is one component already is not compared again, so documents outside a region's largest component, in chunks, meet
   all chunks. Its work grows with the product of the two, which is what exactness takes; no pair leaves a block.

Equal sets are collapsed: a task hands on the first of them that it meets, and those are mapped to the smallest id before
any set moves. Texts never move; sets of documents in regions are computed where their texts are, picked by a bit filter
of bounded size (what it lets by in excess is not used). The order of shingles never changes a result: the list of
frequent ones is bounded (``FREQUENT``) and counted over all documents.

Shingles are 64-bit hashes, set identities 128-bit.

Defined cases: null, empty or word-free text has no shingles, is in no region and its own component; fewer words than
the shingle length make one shingle; rows with the same id are one document that stands for each of its texts, and each
row keeps its own count; a null id is a component of its own (null); an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import groups_of, materialize, release, spanning, text_slices
from .graph import components
from .hashing import mix, word_hashes

SHINGLE = 3
THRESHOLD = Fraction(9, 10)
#: What a task compares at once: shingles, with MEMBER more for each document.
CAPACITY = 1 << 22
MEMBER = 1 << 10
PIVOTS = 16
#: Cells may hold this many times their region together before they count as no separation, and nest so deep.
REPLICAS, LEVELS = 2.0, 8
#: Shingles that come last in the order of prefixes, the most frequent ones; it decides work, never results.
FREQUENT = 1 << 21
FREQUENT_IN_SLICE = 2
CACHE_WORDS = 300_000
FILTER_BITS = 1 << 27
SLICE = 8 << 20
STEP = 1 << 14

_U = np.uint64


def key_of(ids: np.ndarray) -> np.ndarray:
    """Mixed ids, one to one: the order in which documents are pivots."""
    return mix(ids.astype(np.int64).view(np.uint64) + _U(0x9E3779B97F4A7C15)).view(np.int64)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n``-grams of words, some at a time."""
    out = np.full(max(0, len(h) - n + 1), n, np.uint64)
    for at in range(0, len(out), STEP):
        part = out[at : at + STEP]
        for k in range(n):
            part = mix(part * _U(0x9E3779B97F4A7C15) + h[at + k : at + k + len(part)])
        out[at : at + STEP] = part
    return out


def text_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of each text (none for null), in the column's order."""
    h, bounds = word_hashes(column)
    every = grams(h, width)
    for a, z in zip(bounds.tolist(), bounds[1:].tolist()):
        yield np.unique(every[a : z - width + 1] if z - a >= width else grams(h[a:z], z - a) if z > a else h[:0])


def shingles(text: bytes, width: int) -> np.ndarray:
    return next(text_sets(pa.array([text], pa.binary()), width))


def digest(s: np.ndarray) -> tuple[int, int]:
    return tuple(mix(s ^ _U(a)).sum(dtype=np.uint64).view(np.int64) for a in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


def ints(column: pa.Array) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _digest_batches(width: int):
    """A row a text (digest and size), and rows without id for shingles that several new texts of a slice share."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("shingle", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in text_slices(batches, "text", SLICE):
            rows, out, found = batch.num_rows, np.zeros((3, batch.num_rows), np.int64), []
            for i, s in enumerate(text_sets(batch.column(1), width)):
                out[:, i] = len(s), *digest(s)
                if len(s) and (name := tuple(out[:, i].tolist())) not in seen:
                    if len(seen) >= CACHE_WORDS:
                        seen.clear()
                    seen.add(name)
                    found.append(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key_of(ints(batch.column(0)))), *map(pa.array, out), pa.array(np.zeros(rows, bool))], schema=schema)
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, _U), np.zeros(0, np.int64))
            h, n = h[n >= FREQUENT_IN_SLICE].view(np.int64), n[n >= FREQUENT_IN_SLICE]
            none = np.zeros(len(h), np.int64)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(h), pa.int64()), pa.array(h), pa.array(n), pa.array(none), pa.array(none), pa.array(np.ones(len(h), bool))], schema=schema)

    return run


def order_of(hashes: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of ``hashes`` in the order of shingles: by rank of frequency (0 for all that are not listed), then hash."""
    if not len(frequent):
        return np.arange(len(hashes))
    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
    last = np.where(frequent[at] == hashes, rank[at], 0).astype(np.uint64)
    return np.argsort((last << _U(58)) | (hashes >> _U(6)), kind="stable")


def prefix_length(n: int, t: Fraction) -> int:
    return n + 1 - -(-n * t.numerator // t.denominator) if n else 0


def parts_of(n: int, t: Fraction) -> int:
    """Parts of a signature, a power of two at least twice the elements in which a set of ``n`` and one linked to it
    can differ."""
    return 1 << max(3, (2 * int((1 - t) / t * n)).bit_length())


def signature(s: np.ndarray, t: Fraction) -> bytes:
    """A byte for each part of the universe of shingles, the sum of the hashes that the sorted set ``s`` has there.

    Two sets differ in as many elements at least as their signatures do in parts; a signature of half the parts is the
    sum of neighbours.
    """
    parts = parts_of(len(s), t)
    part = (s >> _U(64 - parts.bit_length() + 1)).astype(np.int64)
    return np.bincount(part, (s & _U(0xFF)).astype(np.float64), parts).astype(np.int64).astype(np.uint8).tobytes()


def plausible(sizes: np.ndarray, signatures: list[bytes], t: Fraction) -> np.ndarray:
    """Root (a place, the smallest) of each set among those that sizes and signatures let be linked, by chains."""
    m, root = len(sizes), np.arange(len(sizes))
    length = np.array([len(x) for x in signatures])
    num, den = t.numerator, t.denominator
    a_, b_ = [], []
    for parts in np.unique(length):
        own, double = np.flatnonzero(length == parts), np.flatnonzero(length == 2 * parts)
        rows = [np.frombuffer(b"".join(signatures[k] for k in own), np.uint8).reshape(-1, parts)]
        if len(double):
            fine = np.frombuffer(b"".join(signatures[k] for k in double), np.uint8).reshape(-1, 2 * parts)
            rows.append(fine[:, ::2] + fine[:, 1::2])
        matrix, at = np.concatenate(rows), np.concatenate([own, double])
        for i in range(len(own)):
            rest = at[i + 1 :]
            if not len(rest):
                continue
            n, others = sizes[own[i]], sizes[rest]
            near = np.minimum(n, others) * den >= np.maximum(n, others) * num
            j = np.flatnonzero(near)
            differ = (matrix[i + 1 + j] != matrix[i]).sum(axis=1) if len(j) else j
            total = n + others[j]
            j = j[(total - differ) * den >= (total + differ) * num]
            a_.append(np.full(len(j), own[i]))
            b_.append(rest[j])
    if a_:
        a, b = np.concatenate(a_), np.concatenate(b_)
        while len(a):
            before = root.copy()
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            root = root[root]
            if (before == root).all():
                break
    return root


_LISTS = "shingle bigint, key bigint, n int, rest int, signature binary"


def _list_batches(width: int, t: Fraction, shared):
    """The prefix of each text that a task has not met before (shingle, key, size, shingles from there on), and a row
    without shingle for its signature."""
    schema = pa.schema([("shingle", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("rest", pa.int32()), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rank = shared.value
        seen: set = set()
        for batch in text_slices(batches, "text"):
            heads, owners, sizes, rests, signatures = [], [], [], [], []
            for key, s in zip(key_of(ints(batch.column(0))).tolist(), text_sets(batch.column(1), width), strict=True):
                if not len(s) or (name := (len(s), *digest(s))) in seen:
                    continue
                if len(seen) >= CACHE_WORDS:
                    seen.clear()
                seen.add(name)
                head = s[order_of(s, frequent, rank)[: prefix_length(len(s), t)]]
                heads.append(head)
                owners.append(key)
                sizes.append(len(s))
                rests.append(len(s) - np.arange(len(head)))
                signatures.append(signature(s, t))
            if heads:
                counts, none = [len(x) for x in heads], len(heads)
                keys, sizes = np.array(owners, np.int64), np.array(sizes, np.int32)
                columns = np.concatenate(heads).view(np.int64), np.repeat(keys, counts), np.repeat(sizes, counts), np.concatenate(rests).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(sum(counts), pa.binary())], schema=schema)
                yield pa.RecordBatch.from_arrays([pa.nulls(none, pa.int64()), pa.array(keys), pa.array(sizes), pa.nulls(none, pa.int32()), pa.array(signatures, pa.binary())], schema=schema)

    return run


def _plausible_batches(t: Fraction):
    """Regions (region, key, n, signature) parted by what signatures exclude; each part is named by its smallest key."""
    schema = pa.schema([("region", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        for group in groups_of(batches, ["region"]):
            if group.num_rows < 2:
                continue
            group = group.sort_by("key")
            key, n = group.column("key").to_numpy(), group.column("n").to_numpy().astype(np.int64)
            root = plausible(n, group.column("signature").to_pylist(), t)
            some = np.bincount(root, minlength=len(root))[root] > 1
            out.append(np.stack([key[root][some], key[some], n[some]]))
            if sum(x.shape[1] for x in out) > 20_000:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, np.concatenate(out, axis=1))), schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, np.concatenate(out, axis=1))), schema=schema)

    return run


def _bits(keys: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = keys.view(np.uint64)
    return (h % _U(n_bits)).astype(np.int64), ((h >> _U(32)) % _U(n_bits)).astype(np.int64)


def key_filter(keys: DataFrame, n: int) -> np.ndarray:
    """Bits that the column ``key`` sets: at most FILTER_BITS, whatever their number."""
    n_bits = min(FILTER_BITS, max(1 << 13, 1 << (16 * max(n, 1) - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.int64()), ("bits", pa.int64())])
        for batch in batches:
            at = np.concatenate(_bits(batch.column(0).to_numpy(), n_bits))
            bits = (np.uint64(1) << (at % 64).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // 64), pa.array(bits)], schema=schema)

    words = keys.select("key").mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(n_bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    hit = np.ones(len(keys), bool)
    for at in _bits(keys, len(bits) * 64):
        hit &= (bits[at // 64] >> (at % 64).astype(np.uint64)) & _U(1) == 1
    return hit


def _set_batches(width: int, shared):
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("items", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            key = key_of(ints(batch.column(0)))
            hit = may_hold(shared.value, key)
            batch, key = batch.filter(pa.array(hit)), key[hit]
            found = [s.view(np.int64) for s in text_sets(batch.column(1), width)]
            sizes = np.array([len(x) for x in found], np.int64)
            items = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0), pa.array(sizes), items], schema=schema)

    return run


def intersections(items: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, a matrix. Shingles of many sets are counted by a product of dense slices, the others
    by the pairs of sets that hold them."""
    m = len(items)
    _, code, count = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), [len(x) for x in items])
    out = np.zeros((m, m), np.float32)
    often = count > max(2, m // 12)
    for which, dense in ((often, True), ((count >= 2) & ~often, False)):
        at = which[code]
        own, of = code[at], row[at]
        if not len(own):
            continue
        rank = np.argsort(own, kind="stable")
        own, of = own[rank], of[rank]
        if dense:
            column = np.cumsum(np.append(0, own[1:] != own[:-1]))
            cuts = np.searchsorted(column, np.arange(0, column[-1] + 2048, 2048))
            for a, z in zip(cuts, np.append(cuts[1:], len(column))):
                if z > a:
                    x = np.zeros((m, 2048 if m > 64 else column[z - 1] - column[a] + 1), np.float32)
                    x[of[a:z], column[a:z] - column[a]] = 1
                    out += x @ x.T
        else:
            held = count[own]
            pairs, waiting = [], 0
            flat = out.reshape(-1)
            for c in np.unique(held).tolist():
                sets = of[held == c].reshape(-1, c)
                i, j = np.triu_indices(c, 1)
                step = max(1, (1 << 21) // len(i))
                for k in range(0, len(sets), step):
                    part = sets[k : k + step]
                    pairs += [(part[:, i] * m + part[:, j]).ravel(), (part[:, j] * m + part[:, i]).ravel()]
                    waiting += 2 * part.shape[0] * len(i)
                    if waiting > 1 << 22:
                        flat += np.bincount(np.concatenate(pairs), minlength=m * m).astype(np.float32)
                        pairs, waiting = [], 0
            if pairs:
                at, n = np.unique(np.concatenate(pairs), return_counts=True)
                flat[at] += n.astype(np.float32)
    return out


def forest(ids: np.ndarray, items: list[np.ndarray], t: Fraction) -> list[tuple[int, int]]:
    """(id, smallest id of its component) for each document of ``ids`` that is linked with another."""
    m, sizes = len(items), np.array([len(x) for x in items], np.int64)
    num, both = t.numerator, t.numerator + t.denominator
    if m == 2:
        shared = len(np.intersect1d(*items, assume_unique=True))
        return [(int(ids.max()), int(ids.min()))] if ids[0] != ids[1] and shared * both >= num * int(sizes.sum()) else []
    shared = intersections(items)
    linked = np.zeros((m, m), bool)
    for k in range(0, m, 512):
        linked[k : k + 512] = shared[k : k + 512].astype(np.int64) * both >= num * (sizes[k : k + 512, None] + sizes[None, :])
    return spanning(ids, linked)


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for chunk in column.chunks:
        values, ends = chunk.flatten().to_numpy(), np.append(0, np.cumsum(chunk.value_lengths().to_numpy(zero_copy_only=False)))
        out += [values[a:z] for a, z in zip(ends, ends[1:])]
    return out


def _block_batches(t: Fraction, names: list[str]):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in groups_of(batches, names):
            if group.num_rows > 1:
                out += forest(group.column("doc_id").to_numpy(), _sets(group.column("items")), t)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], schema=schema)
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], schema=schema)

    return run


_CELLS = "region bigint, key bigint, doc_id bigint, n bigint, cells array<bigint>, linked array<bigint>"


def _cell_batches(t: Fraction):
    """Rows (region, salt, pivot first, ...): each member's cells (pivots within two radii of its nearest) and links."""
    lists = pa.list_(pa.int64())
    schema = pa.schema([("region", pa.int64()), ("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("cells", lists), ("linked", lists)])
    window = 2 * float(1 - t) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, pivots, table = None, [], None
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("region", "salt", "member", "key", "doc_id")]
            for region, salt, member, key, doc, s in zip(*columns, _sets(pa.chunked_array([batch.column(batch.schema.get_field_index("items"))])), strict=True):
                if (region, salt) != here:
                    here, pivots, table = (region, salt), [], None
                if not member:
                    pivots.append((key, doc, s))
                    continue
                if table is None:
                    every = np.unique(np.concatenate([p[2] for p in pivots]))
                    table = np.zeros((len(every), len(pivots)), np.int32)
                    for j, p in enumerate(pivots):
                        table[np.searchsorted(every, p[2]), j] = 1
                    sizes = np.array([len(p[2]) for p in pivots])
                at = np.minimum(np.searchsorted(every, s), len(every) - 1)
                shared = table[at[every[at] == s]].sum(axis=0)
                either = len(s) + sizes - shared
                far = 1 - shared / either
                linked = shared * t.denominator >= either * t.numerator
                cells = np.flatnonzero(far <= far.min() + window)
                for column, x in zip(out, (region, key, doc, len(s), [pivots[j][0] for j in cells], [pivots[j][1] for j in np.flatnonzero(linked)]), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def _weight() -> Column:
    return F.sum(F.col("n") + MEMBER)


class Join:
    """One run over ``docs``: digests, lists, regions, links, components."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, t: Fraction = THRESHOLD, capacity: int = CAPACITY) -> None:
        self.t, self.width, self.capacity = Fraction(t), width, capacity
        self.docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        self.known = self.docs.where(F.col("doc_id").isNotNull())
        self.spark = docs.sparkSession
        self.links: list[DataFrame] = []

    def _order(self, found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The most frequent shingles, sorted, with the logarithm of their counts."""
        counts = found.where("shingle").groupBy("key").agg(F.sum("n_shingles").alias("n")).orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
        h = counts.column("key").to_numpy().view(np.uint64)
        rank = np.minimum(np.log2(np.maximum(counts.column("n").to_numpy(), 1)) * 2, 62).astype(np.uint64)
        by = np.argsort(h)
        return h[by], rank[by].astype(np.uint8)

    def _regions(self, lists: DataFrame) -> DataFrame:
        """region (key of its pivot), key: distinct members of regions, pivots aside."""
        num, den = self.t.numerator, self.t.denominator

        def summed(rows: DataFrame, names: list[str]) -> DataFrame:
            sums = rows.groupBy(*names).agg(
                F.count("*").alias("c"), F.min("key").alias("first"), F.max("key").alias("last"), F.bit_xor("key").alias("x"), F.min("rest").alias("rest"), F.max("rest").alias("most"), F.min("n").alias("low"), F.max("n").alias("high")
            )
            # Of two sets whose first common shingle this is, the smaller has so many shingles left from here on.
            near = (F.col("most") * F.lit(num + den) >= F.col("low") * F.lit(2 * num)) & (F.col("first") < F.col("last"))
            two = (F.col("low") * F.lit(den) >= F.col("high") * F.lit(num)) & (F.col("rest") * F.lit(num + den) >= (F.col("low") + F.col("high")) * F.lit(num))
            return sums.where(near & ((F.col("c") > 2) | (two & (F.col("c") == 2))))

        # Lists of two and three are known by their aggregates: keys are numbers, and the third is what is left of them.
        def few(sums: DataFrame, most: int) -> DataFrame:
            third = F.col("x").bitwiseXOR(F.col("first")).bitwiseXOR(F.col("last"))
            keys = F.when(F.col("c") == 2, F.array("last")).otherwise(F.array("last", third))
            return sums.where(F.col("c") <= most).select(F.col("first").alias("region"), F.explode(keys).alias("key"))

        sums = materialize(summed(lists, ["shingle"]), "jaccard-lists-shared")
        # Longer lists are parted by size: linked sizes lie in one class of the ratio 1 / t or in two neighbouring ones.
        class_ = F.floor(F.log("n") / F.lit(float(np.log(den / num)))).cast("int")
        longer = lists.join(sums.where("c > 2").select("shingle"), "shingle")
        classed = materialize(longer.select("shingle", "key", "n", "rest", F.explode(F.array(class_, class_ + 1)).alias("class")), "jaccard-lists-classed")
        own = materialize(summed(classed, ["shingle", "class"]), "jaccard-lists-classes")
        more = classed.join(own.where("c > 3").select("shingle", "class", "first"), ["shingle", "class"]).select(F.col("first").alias("region"), "key")
        every = few(sums, 2).unionByName(few(own, 3)).unionByName(more)
        out = materialize(every.where("region <> key").distinct(), "jaccard-regions")
        release(sums, classed, own)
        return out

    def run(self) -> DataFrame:
        """doc_id, n_shingles, component_id for each row."""
        ddl = "doc_id bigint, key bigint, n_shingles bigint, h1 bigint, h2 bigint, shingle boolean"
        found = materialize(self.docs.mapInArrow(_digest_batches(self.width), ddl), "jaccard-digests")
        digests = found.where("NOT shingle")
        sets = digests.where("n_shingles > 0 AND doc_id IS NOT NULL")
        same = sets.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("first"), F.min_by("key", "doc_id").alias("first_key"), F.count("*").alias("c")).where("c > 1")
        of = materialize(sets.join(same, ["h1", "h2", "n_shingles"]).select("doc_id", "key", "first", "first_key").distinct(), "jaccard-copies")
        self.links.append(of.where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")))

        shared = self.spark.sparkContext.broadcast(self._order(found))
        lists = materialize(self.known.mapInArrow(_list_batches(self.width, self.t, shared), _LISTS), "jaccard-lists")
        regions = self._regions(lists.where("shingle IS NOT NULL").select("shingle", "key", "n", "rest"))
        # Copies stand for their smallest id; ids with several rows stand for themselves.
        several = sets.groupBy("key").count().where("count > 1").select("key")
        moved = of.where("key <> first_key").join(several, "key", "left_anti").select("key", "first_key").distinct()

        def known_as(rows: DataFrame, column: str) -> DataFrame:
            to = moved.select(F.col("key").alias(column), F.col("first_key").alias("to"))
            return rows.join(to, column, "left").withColumn(column, F.coalesce("to", column)).drop("to")

        regions = known_as(known_as(regions, "region"), "key")
        whole = regions.where("region <> key").distinct()
        members = materialize(whole.unionByName(whole.select("region", F.col("region").alias("key"))).distinct(), "jaccard-members")

        signatures = known_as(lists.where("shingle IS NULL").select("key", "n", "signature"), "key")
        members = self._parted(members, materialize(signatures.select("key", "n", "signature").dropDuplicates(["key", "n", "signature"]), "jaccard-signatures"))
        ids = members.select("key").distinct()
        bits = self.spark.sparkContext.broadcast(key_filter(ids, ids.count()))
        texts = self.known.mapInArrow(_set_batches(self.width, bits), "key bigint, doc_id bigint, n bigint, items array<bigint>")
        self.sets = materialize(texts, "jaccard-sets")
        release(lists)
        self._join(members)
        labels = components(self._all_links())
        rows = digests.join(labels, digests["doc_id"] == labels["v"], "left")
        return rows.select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))

    def _parted(self, members: DataFrame, signatures: DataFrame) -> DataFrame:
        """region, key, n: regions of a task's size without the members that signatures leave alone there, others whole.

        A signature is a fortieth of its set, and most documents that meet by a shingle have no more in common."""
        # An id with several texts has several signatures.
        single = signatures.groupBy("key").agg(F.count("*").alias("rows"), F.max("n").alias("n"))
        sized = materialize(members.join(single, "key").select("region", "key", "n", "rows"), "jaccard-sized")
        weights = sized.groupBy("region").agg(_weight().alias("w"), F.max("rows").alias("rows"))
        whole = weights.where((F.col("w") > self.capacity) | (F.col("rows") > 1)).select("region")
        large = sized.join(whole, "region", "left_semi").select("region", "key", F.col("n").cast("long").alias("n"))
        filled = sized.join(whole, "region", "left_anti").select("region", "key").join(signatures, "key").select("region", "key", "n", "signature")
        dealt = filled.repartition("region").sortWithinPartitions("region")
        parted = dealt.mapInArrow(_plausible_batches(self.t), "region bigint, key bigint, n bigint")
        out = materialize(parted.unionByName(large).distinct(), "jaccard-parted")
        release(members, sized)
        return out

    def _all_links(self) -> DataFrame:
        out = self.links[0]
        for x in self.links[1:]:
            out = out.unionByName(x)
        return out

    def _blocks(self, rows: DataFrame, names: list[str]) -> None:
        """Links within each group of ``rows`` (names, key), as a spanning forest."""
        filled = rows.join(self.sets.select("key", "doc_id", "items"), "key").select(*names, "doc_id", "items")
        dealt = filled.repartition(*names).sortWithinPartitions(*names)
        self.links.append(materialize(dealt.mapInArrow(_block_batches(self.t, names), "a bigint, b bigint"), "jaccard-links"))

    def _join(self, members: DataFrame) -> None:
        """Compare regions (region, key, n): small ones whole, large ones by cells or, at last, in blocks."""
        hard: list[DataFrame] = []
        level = 0
        while True:
            weights = materialize(members.groupBy("region").agg(_weight().alias("w"), F.count("*").alias("m")).where("m > 1"), "jaccard-weights")
            large = weights.where(F.col("w") > self.capacity).select("region", "w")
            if large.isEmpty():
                self._blocks(members.select("region", "key"), ["region"])
                break
            small = weights.where(F.col("w") <= self.capacity).select("region")
            self._blocks(members.join(small, "region", "left_semi").select("region", "key"), ["region"])
            rest = members.join(large, "region")
            if level == LEVELS:
                hard.append(rest.select("region", "key", "n"))
                break
            members, stalled = self._cells(rest, level)
            hard.append(stalled)
            level += 1
        for rows in hard:
            if not rows.isEmpty():
                self._chunks(rows)

    def _cells(self, rest: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
        """Regions of the next level, and members of regions that cells do not separate. ``rest``: region, key, n, w."""
        salts = F.ceil(F.col("w") / self.capacity).cast("int")
        pick = F.pmod(F.xxhash64("key", F.lit(level)), F.lit(PIVOTS))
        pivots = materialize(rest.groupBy("region", pick.alias("pick")).agg(F.min("key").alias("key"), F.first("w").alias("w")).select("region", "key", "w"), "jaccard-pivots")
        each = pivots.select("region", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(False).alias("member"), "key")
        others = rest.join(pivots.select("region", "key"), ["region", "key"], "left_anti")
        rows = each.unionByName(others.select("region", F.pmod(F.xxhash64("key"), salts).cast("int").alias("salt"), F.lit(True).alias("member"), "key"))
        filled = rows.join(self.sets.select("key", "doc_id", "items"), "key").select("region", "salt", "member", "key", "doc_id", "items")
        dealt = filled.repartition("region", "salt").sortWithinPartitions("region", "salt", "member")
        found = materialize(dealt.mapInArrow(_cell_batches(self.t), _CELLS), "jaccard-cells")
        between = pivots.select("region", "key")
        self.links.append(found.select(F.col("doc_id").alias("a"), F.explode("linked").alias("b")).where("a <> b"))
        self._blocks(between, ["region"])  # pivots with each other
        cost = found.groupBy("region").agg(_weight().alias("w"), F.sum((F.col("n") + MEMBER) * F.size("cells")).alias("spread"))
        bad = materialize(cost.where(F.col("spread") > REPLICAS * F.col("w")).select("region"), "jaccard-stalled")
        stalled = found.join(bad, "region", "left_semi").select("region", "key", "n")
        cells = found.join(bad, "region", "left_anti").select("region", "key", "n", F.explode("cells").alias("cell"))
        return materialize(cells.select(F.xxhash64("region", "cell", F.lit(level)).alias("region"), "key", "n").distinct(), "jaccard-sized"), materialize(stalled.distinct(), "jaccard-hard")

    def _chunks(self, rows: DataFrame) -> None:
        """Blocks of chunks: members outside a region's largest component meet all others."""
        labels = components(self._all_links())
        named = rows.join(self.sets.select("key", "doc_id"), "key").join(labels.withColumnRenamed("v", "doc_id"), "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))
        named = materialize(named.select("region", "key", "n", "c").distinct(), "jaccard-named")
        parts = named.groupBy("region", "c").agg(_weight().alias("w"))
        main = parts.groupBy("region").agg(F.max_by("c", F.struct("w", "c")).alias("main"), F.max("w").alias("most"), F.sum("w").alias("w"), F.count("*").alias("parts")).where("parts > 1")
        chunks = lambda w: F.greatest(F.lit(1), F.ceil(w / (self.capacity / 2))).cast("int")
        main = main.select("region", "main", chunks(F.col("most")).alias("inner"), chunks(F.col("w") - F.col("most")).alias("outer"))
        open_ = named.join(main, "region")
        out = open_.where("c <> main").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("outer")).cast("int"))
        out = out.select("region", "key", "chunk", F.explode(F.sequence(F.lit(0), F.col("outer") + F.col("inner") - 1)).alias("other"))
        ins = open_.where("c = main").withColumn("chunk", (F.col("outer") + F.pmod(F.xxhash64("key"), F.col("inner"))).cast("int"))
        ins = ins.select("region", "key", "chunk", F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("other"))
        pairs = out.unionByName(ins).select("region", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "key")
        self._blocks(pairs.distinct(), ["region", "i", "j"])


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, t: Fraction | float = THRESHOLD, capacity: int = CAPACITY) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id (the smallest id reachable by links)."""
    return Join(docs, doc_id, text, width, Fraction(t).limit_denominator(1000), capacity).run()


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, t: Fraction | float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` but those whose component has a smaller id; of equal rows with one id, or without id, one.

    Ids to look at again set bits of a filter of bounded size; rows that it lets by stay where they are, and only the
    others meet the ids in an exact join. A row without id belongs to no component, so only its equals go.
    """
    found = jaccard_join(docs, doc_id, text, width, t)
    key = F.xxhash64("doc_id")
    twice = docs.groupBy(F.col(doc_id).cast("long").alias("doc_id")).count().where("doc_id IS NOT NULL AND count > 1").select("doc_id", F.lit(False).alias("gone"))
    out = found.where("component_id < doc_id").select("doc_id", F.lit(True).alias("gone")).unionByName(twice)
    out = materialize(out.groupBy("doc_id").agg(F.max("gone").alias("gone")).withColumn("key", key), "jaccard-dropped")
    shared = docs.sparkSession.sparkContext.broadcast(key_filter(out, out.count()))

    @F.arrow_udf("boolean")
    def maybe(keys: pa.Array) -> pa.Array:
        return pa.array(may_hold(shared.value, ints(keys)))

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    id_ = F.col(doc_id).cast("long")
    flagged = docs.select(row, id_.alias("id"), (id_.isNull() | maybe(F.xxhash64(id_))).alias("maybe"))
    rest = flagged.where("maybe").join(out.select(F.col("doc_id").alias("out"), "gone"), F.col("id") == F.col("out"), "left").where("gone IS NULL OR NOT gone")
    again = F.col("id").isNull() | F.col("gone").isNotNull()
    twins = rest.where(again).withColumn("digest", F.md5(F.coalesce(F.to_json("row"), F.lit("")))).dropDuplicates(["id", "digest"])
    return flagged.where("NOT maybe").select("row.*").unionByName(rest.where(~again).select("row.*")).unionByName(twins.select("row.*"))
