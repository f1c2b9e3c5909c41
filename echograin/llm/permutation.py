"""Embedding near-duplicates through a pivot-permutation index.

Reference points are a bounded, documented sample (the first ``pivot_count`` distinct vectors of a length by hash of the
id: eight times the root of their number, 64 at least, ``PIVOT_BYTES`` of memory at most). A vector is described by the
permutation of its ``PREFIX`` nearest reference points, nearest first. The index is an inverted list for each reference
point, of the vectors that have it in their prefix. Two vectors that share ``SHARED`` points or more are candidates; as
they meet in the lists of all but the last ``SHARED - 1`` of their points (by number) anyway, only those are written.

1. *Retrieval.* Within a list, shared points are counted for pairs whose sketches (``BITS`` signs of random projections)
   and ranks agree: a sketch farther away than pairs at the threshold ever are (``SIGMA`` standard deviations) or ranks
   that differ too much leave a pair out. What is left, as a spanning forest, makes groups of candidates.
2. *Verification.* Only members of groups bring their vectors along; a group is compared in blocks of chunks by cosines
   in double precision, each pair in one block. A block returns, for each member with links, their number and its
   component's smallest id; links themselves are never rows.

Equal vectors are collapsed first, by 128-bit digests. Lists and groups of any length are cut into chunks, and every two
chunks meet in a block, so a task never holds more than two. Every vector of every length is indexed, each length as a
space of its own. Recall against brute force is measured in the tests, and given in the README.

Defined cases: null, empty and zero vectors, and those with null or non-finite components, link with nothing and are
their own component; vectors of different lengths link with nothing of each other; repeated ids are one vector if they
are equal, and else share a component; ties among reference points go to the smaller number; an empty table gives an
empty result; labels and other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import groups_of, materialize, release, spanning
from .graph import components

THRESHOLD = 0.9
PREFIX, SHARED = 12, 3
PIVOT_BYTES = 64 << 20
BITS, SIGMA = 256, 4.0
#: Mean difference of the ranks of shared points, in places, beyond which a pair is none.
RANK_DIFFERENCE = 8.0
CHUNK = 1024


def pivot_count(n: int, dim: int) -> int:
    return min(max(64, math.ceil(8 * math.sqrt(n))), max(64, PIVOT_BYTES // (8 * max(dim, 1))))


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    scale = np.abs(x).max(axis=1, keepdims=True)  # keeps squares of very large and very small components finite
    x = x / np.where(scale > 0, scale, 1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the nearest pivots, nearest first, ties by number."""
    near = x @ pivots.T
    k = min(prefix, len(pivots))
    if len(pivots) > 4 * k:  # those that beat the k-th or tie with it, then sorted
        least = np.partition(near, len(pivots) - k, axis=1)[:, [len(pivots) - k]]
        wide = int((near >= least).sum(axis=1).max())
        some = np.sort(np.argpartition(-near, min(wide, len(pivots) - 1), axis=1)[:, :wide], axis=1)
        return np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable")[:, :k], 1)
    return np.argsort(-near, axis=1, kind="stable")[:, :k]


def planes(dim: int) -> np.ndarray:
    return np.random.default_rng(dim).normal(size=(dim, BITS))


def farthest(threshold: float) -> float:
    """Signs in which sketches of a pair at the threshold differ at most."""
    p = math.acos(threshold) / math.pi
    return BITS * p + SIGMA * math.sqrt(BITS * p * (1 - p))


def _rows(batch: pa.RecordBatch, dim_of: str, embedding: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the batch, matrix of unit vectors) for each length of vector in the batch."""
    dims = batch.column(batch.schema.get_field_index(dim_of)).to_numpy(zero_copy_only=False)
    column = batch.column(batch.schema.get_field_index(embedding))
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, unit(column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim))


_INDEX = "dim int, vec_id bigint, prefix binary, sketch binary, lists array<int>"


def _describe_batches(shared):
    """The permutation prefix and sketch of each vector, and the lists that it goes into."""
    schema = pa.schema([("dim", pa.int32()), ("vec_id", pa.int64()), ("prefix", pa.binary()), ("sketch", pa.binary()), ("lists", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                for dim, at, x in _rows(part, "dim", "embedding"):
                    pivots = shared.value[dim]
                    near = nearest(x, pivots, PREFIX).astype(np.int32)
                    signs = np.packbits(x @ planes(dim) >= 0, axis=1)
                    lists = np.sort(near, axis=1)[:, : near.shape[1] - min(SHARED, near.shape[1]) + 1]
                    ids = part.column(part.schema.get_field_index("vec_id")).take(pa.array(at))
                    columns = [pa.array(np.full(len(at), dim, np.int32)), ids, pa.array([r.tobytes() for r in near], pa.binary()), pa.array([r.tobytes() for r in signs], pa.binary()), pa.array(list(lists), pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def candidates(prefix: np.ndarray, sketch: np.ndarray, limit: float) -> np.ndarray:
    """Matrix of candidate pairs among vectors by prefixes (ordered pivot numbers) and sketches (0 and 1)."""
    signs = sketch.astype(np.float32) * 2 - 1
    near = (signs @ signs.T) >= BITS - 2 * limit
    near &= ~np.eye(len(near), dtype=bool)
    one, two = np.nonzero(np.triu(near))
    for k in range(0, len(one), 50_000):
        a, b = one[k : k + 50_000], two[k : k + 50_000]
        same = prefix[a][:, :, None] == prefix[b][:, None, :]
        count = same.sum(axis=(1, 2))
        places = np.arange(prefix.shape[1])
        apart = (same * np.abs(places[:, None] - places[None, :])).sum(axis=(1, 2))
        out = (count < min(SHARED, prefix.shape[1])) | (apart > RANK_DIFFERENCE * count)
        near[a[out], b[out]] = near[b[out], a[out]] = False
    return near


def _candidate_batches(limit: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["dim", "list", "i", "j"]):
            if group.num_rows < 2:
                continue
            prefix = np.frombuffer(b"".join(group.column("prefix").to_pylist()), np.int32).reshape(group.num_rows, -1)
            sketch = np.unpackbits(np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(group.num_rows, -1), axis=1)
            links = spanning(group.column("vec_id").to_numpy(), candidates(prefix, sketch, limit))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], schema=schema)

    return run


def _verify_batches(threshold: float):
    schema = pa.schema([("vec_id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["dim", "group", "i", "j"]):
            if group.num_rows < 2:
                continue
            ids, copies, chunk = (group.column(c).to_numpy() for c in ("vec_id", "copies", "chunk"))
            (_, _, x), *_ = _rows(group.combine_chunks().to_batches()[0], "dim", "embedding")
            linked = x @ x.T >= threshold
            np.fill_diagonal(linked, False)
            if group.column("i")[0].as_py() != group.column("j")[0].as_py():
                linked &= chunk[:, None] != chunk[None, :]
            n = linked @ copies
            roots = dict(spanning(ids, linked))
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n[some]), pa.array([roots.get(v, v) for v in ids[some].tolist()], pa.int64())], schema=schema)

    return run


def _in_blocks(rows: DataFrame, names: list[str], chunk: int) -> DataFrame:
    """``rows`` with chunk and the blocks (i, j) in which their chunk meets each other one of its list or group."""
    counts = rows.groupBy(*names).count().where("count > 1").select(*names, F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    placed = rows.join(counts, names).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return placed.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")}).drop("chunks", "other")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``vectors``."""
    spark = vectors.sparkSession
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    own = rows.where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))
    own = own.withColumns({"dim": F.size("embedding"), "h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(7), "embedding")})
    reps = own.groupBy("dim", "h1", "h2").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    reps = materialize(reps, "vectors")

    # An id may stand for several different vectors: a number of the vector's own keeps them apart.
    own_id = F.xxhash64("first", "h1", "h2")
    sizes = {r.dim: r.n for r in reps.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    wanted = {dim: pivot_count(n, dim) for dim, n in sizes.items()}
    rank = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("first"), "h1", "h2"))
    sample = reps.select("dim", "embedding", rank.alias("rank")).where(F.col("rank") <= max(wanted.values(), default=0)).collect()
    pivots = {dim: unit(np.array([r.embedding for r in sorted(sample, key=lambda r: r.rank) if r.dim == dim and r.rank <= n], np.float64)) for dim, n in wanted.items()}

    base = reps.select("dim", own_id.alias("vec_id"), "first", "copies", "embedding")
    described = base.select("dim", "vec_id", "embedding").mapInArrow(_describe_batches(spark.sparkContext.broadcast(pivots)), _INDEX)
    index = materialize(described, "permutation-index")
    posted = index.select("dim", F.explode("lists").alias("list"), "vec_id")
    placed = _in_blocks(posted, ["dim", "list"], chunk).join(index.select("vec_id", "prefix", "sketch"), "vec_id")
    blocks = placed.select("dim", "list", "i", "j", "vec_id", "prefix", "sketch").repartition("dim", "list", "i", "j").sortWithinPartitions("dim", "list", "i", "j")
    plausible = materialize(blocks.mapInArrow(_candidate_batches(farthest(threshold)), "a bigint, b bigint"), "permutation-candidates")
    groups = components(plausible)

    members = _in_blocks(groups.select(F.col("c").alias("group"), F.col("v").alias("vec_id")), ["group"], chunk).join(base, "vec_id")
    blocks = members.select("dim", "group", "i", "j", "chunk", "vec_id", "copies", "embedding").repartition("dim", "group", "i", "j").sortWithinPartitions("dim", "group", "i", "j")
    found = materialize(blocks.mapInArrow(_verify_batches(threshold), "vec_id bigint, n bigint, root bigint"), "permutation-links")

    names = base.select(F.col("vec_id").alias("own"), "first")
    named = found.join(names, F.col("vec_id") == F.col("own")).select("vec_id", "n", "root", F.col("first").alias("a"))
    named = named.join(names.select(F.col("own").alias("root"), F.col("first").alias("b")), "root")
    same = own.select("vec_id", "dim", "h1", "h2").join(reps.select("dim", "h1", "h2", "first", "copies", own_id.alias("own")), ["dim", "h1", "h2"])
    same = materialize(same.select("vec_id", "first", "copies", "own"), "vector-copies")
    labels = components(named.select("a", "b").unionByName(same.select(F.col("vec_id").alias("a"), F.col("first").alias("b"))))
    linked = found.groupBy(F.col("vec_id").alias("own")).agg(F.sum("n").alias("n"))
    counts = same.join(linked, "own", "left").groupBy("vec_id").agg(F.max(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    out = rows.select("vec_id").join(counts, "vec_id", "left").join(labels.withColumnRenamed("v", "vec_id"), "vec_id", "left")
    component = F.coalesce("c", "vec_id")
    out = materialize(out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")), "vectors-labelled")
    release(reps, index, plausible, groups, found, same, labels)
    return out
