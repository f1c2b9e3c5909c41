"""Shared pieces of the training-data operators: table reading, shared-folder tables, bounded batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in every operator here: a run of characters that are none of space, \t, \n, \v, \f, \r.
WORD = r"[^\x20\x09-\x0D]+"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where that is unset, one of our own in local mode (tests), where driver and executors are one machine; on a cluster
    a machine's own folder would lose results, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        folder = "file:///tmp/echograin-shared"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    sc = spark.sparkContext
    hadoop_path = sc._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(sc._jsc.hadoopConfiguration())


@contextmanager
def sweeping(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of jobs in here as soon as each ends."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut, lost executors cost no rework.

    The table goes with :func:`release`, or else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/echograin/{tag}-{uuid.uuid4().hex}"
    with sweeping(spark):  # once the table is there, the shuffles that made it are of no use
        df.write.parquet(path)
    hadoop_path, fs = _hadoop_path(spark, path)
    fs.deleteOnExit(hadoop_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._echograin_path = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Delete tables that :func:`materialize` wrote and that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_echograin_path", None)
        if path:
            hadoop_path, fs = _hadoop_path(df.sparkSession, path)
            fs.delete(hadoop_path, True)
            fs.cancelDeleteOnExit(hadoop_path)


def n_words(text: Column) -> Column:
    """Words of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (a null id counts as 0)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0).cast("long"))


def _trimmer():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library, which has its own ways
        return lambda _: None


_trim = _trimmer()


def give_back() -> None:
    """Return freed memory to the machine: workers are reused, and what one stage has freed is not the next one's."""
    pa.default_memory_pool().release_unused()
    _trim(0)


#: Tables that an operator keeps in a worker from task to task, by operator: how to empty them.
kept_tables: dict[str, Callable[[], None]] = {}


def text_slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 4 << 20, operator: str = "") -> Iterator[pa.RecordBatch]:
    """Re-slice Arrow batches so that a slice holds about ``max_bytes`` of the text column, one row at least.

    Tables that other operators than ``operator`` have kept in this worker are emptied first.
    """
    for name, empty in kept_tables.items():
        if name != operator:
            empty()
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        start = held = 0
        for i, size in enumerate(pa.compute.binary_length(column).to_pylist()):
            held += size or 0
            if held >= max_bytes:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)
        del batch, column
    give_back()


def utf8(column: pa.Array) -> list[bytes]:
    """The column's values as UTF-8 bytes, nulls as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def rows_of(schema: pa.Schema, columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def groups_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal values in ``names`` (numbers), which are sorted; one run is held at a time."""
    here, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            name = tuple(keys[:, a].tolist())
            if name != here and held:
                yield pa.Table.from_batches(held)
                held = []
            here = name
            held.append(batch.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)
    give_back()


def spanning(ids: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """(id, smallest id of its component) for each other document of a component, by a symmetric matrix of links."""
    out, open_ = [], np.ones(len(ids), bool)
    for k in range(len(ids)):
        if open_[k]:
            open_[k] = False
            members = front = np.array([k])
            while len(front):
                front = np.flatnonzero(linked[front].any(axis=0) & open_)
                open_[front] = False
                members = np.concatenate([members, front])
            own = np.unique(ids[members])
            out += [(x, int(own[0])) for x in own[1:].tolist()]
    return out
