"""Incremental upkeep: state tables of entries and findings, changed by micro-batches, and a change feed.

State lives in Parquet generations under one folder: ``entries``, ``findings`` and ``hashes`` (path and content hash),
each batch writing the next generation and then a one-row pointer, so a batch that fails or is repeated leaves the last
whole state (the pointer carries the batch id, and a batch that it has already seen is skipped). Renames become a
removal and a creation, and changes that leave a file's content as it was are dropped before any work; a batch of none
but those writes its pointer only. Compaction is what every rewrite does, and generations older than the one that
readers may still hold are deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import ScanOptions
from ..functions.text import DEFAULT_EXCLUDES, is_excluded
from ..operators import pairs
from ..operators.entries import ENTRY_DDL, entries

EPSILON = 1e-4
CHANGES_DDL = "path string, version bigint, op string, content string, lang string"
KEY = ["path", "fn_name", "line_start", "line_end"]
COMPACT_ABOVE = 0.25
HASHES_DDL = "path string, hash string"
#: Generations that stay: the last, and the one before for readers that have just opened it.
KEPT_GENERATIONS = 2


def coalesce_changes(changes: DataFrame) -> DataFrame:
    """The last change of each path: highest version, partial aggregates before the shuffle."""
    columns = [c for c in changes.columns if c not in ("path", "version")]
    best = changes.groupBy("path").agg(F.max("version").alias("version"), F.max_by(F.struct(*columns), "version").alias("last"))
    return best.select("path", "version", "last.*")


def interesting(changes: DataFrame) -> DataFrame:
    """Creations, changes and removals of paths outside excluded folders; a rename is a removal and a creation."""
    return changes.where(F.col("op").isin("create", "modify", "remove") & ~is_excluded(F.col("path"), DEFAULT_EXCLUDES))


def expand_renames(events: DataFrame) -> DataFrame:
    """Renames (path, new_path) as the removal of the old path and the creation of the new one."""
    both = F.when(F.col("op") == "rename", F.array(F.struct(F.col("path"), F.lit("remove").alias("op")), F.struct(F.col("new_path").alias("path"), F.lit("create").alias("op"))))
    each = F.explode(F.coalesce(both, F.array(F.struct("path", "op"))))
    return events.select(each.alias("e"), *[c for c in events.columns if c not in ("path", "op", "new_path")]).select("e.*", *[c for c in events.columns if c not in ("path", "op", "new_path")])


def unchanged_suppressed(changes: DataFrame, hashes: DataFrame) -> DataFrame:
    """Removals, and changes whose content differs from the last hash known; no content counts as a removal. hashes:
    path, hash."""
    kept = changes.join(hashes, "path", "left").where((F.col("op") == "remove") | F.col("content").isNull() | ~F.md5(F.col("content").cast("binary")).eqNullSafe(F.col("hash")))
    return kept.withColumn("op", F.when(F.col("content").isNull(), "remove").otherwise(F.col("op"))).drop("hash")


def content_hashes(files: DataFrame) -> DataFrame:
    """path, hash of the files (path, content) that have content."""
    return files.where(F.col("content").isNotNull()).select("path", F.md5(F.col("content").cast("binary")).alias("hash"))


def tombstone_ratio(entries_: DataFrame) -> DataFrame:
    """ratio of dead entries, and whether it calls for compaction."""
    return entries_.agg(F.coalesce(F.avg((~F.col("alive")).cast("double")), F.lit(0.0)).alias("ratio")).withColumn("compact", F.col("ratio") > COMPACT_ABOVE)


def pair_key(finding: Column | None = None) -> Column:
    """Endpoints by path and granule, the smaller first: pairs are the same whatever ids they had."""
    end = lambda n: F.struct(*[F.col(f"{n}.{c}") for c in KEY])
    return F.when(end("a") <= end("b"), F.struct(end("a").alias("x"), end("b").alias("y"))).otherwise(F.struct(end("b").alias("x"), end("a").alias("y")))


def changed(old: str, new: str) -> Column:
    """Whether two versions of a finding differ: score or exact Jaccard by more than 1e-4, shared count, or tags."""
    far = lambda c: F.abs(F.col(f"{old}.{c}") - F.col(f"{new}.{c}")) > EPSILON
    return far("score") | far("exact_jaccard") | (F.col(f"{old}.shared") != F.col(f"{new}.shared")) | (F.array_sort(F.col(f"{old}.tags")) != F.array_sort(F.col(f"{new}.tags")))


def diff_findings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Change feed (op, finding) between two tables of findings: added, removed, updated."""
    side = lambda df, n: df.select(pair_key().alias("key"), F.struct(*df.columns).alias(n))
    both = side(old, "old").join(side(new, "new"), "key", "full_outer")
    op = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(changed("old", "new"), "updated")
    return both.select(op.alias("op"), F.coalesce("new", "old").alias("finding")).where("op IS NOT NULL")


def touched_paths(batch: DataFrame) -> DataFrame:
    """path: those that a batch changes, found without their contents."""
    return interesting(coalesce_changes(batch.select("path", "version", "op"))).select("path")


def touched_findings(state: DataFrame, batch: DataFrame, options: ScanOptions = ScanOptions(), root: str | None = None) -> DataFrame:
    """The findings among the entries ``state`` that a batch can change: all that :func:`apply_batch` needs for its feed."""
    return pairs.findings_of(pairs.picked(state, touched_paths(batch)), state, options, root)


def apply_batch(state: DataFrame, findings: DataFrame, batch: DataFrame, options: ScanOptions = ScanOptions(), root: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, findings, feed) after a batch of changes (path, version, op, content, lang).

    Only pairs with an endpoint in a touched path are computed anew: the changed entries' bands meet all bands. The
    others are the same before and after, so the feed is that of the touched ones.
    """
    last = interesting(coalesce_changes(batch))
    touched = touched_paths(batch)
    fresh = last.where((F.col("op") != "remove") & F.col("content").isNotNull())
    new = entries(fresh.select(F.conv(F.substring(F.md5(F.col("path").cast("binary")), 1, 15), 16, 10).cast("bigint").alias("entry_id"), "path", "lang", "content"), options)
    after = pairs.picked(state, touched, "left_anti").unionByName(new)
    found = pairs.findings_of(new, after, options, root)
    flag = lambda n: touched.select(F.col("path").alias(f"_{n}"))
    marked = findings.join(flag("a"), F.col("a.path") == F.col("_a"), "left").join(flag("b"), F.col("b.path") == F.col("_b"), "left")
    is_touched = F.col("_a").isNotNull() | F.col("_b").isNotNull()
    kept, old = (marked.where(c).select(*findings.columns) for c in (~is_touched, is_touched))
    return after, kept.unionByName(found), diff_findings(old, found)


class Upkeep:
    """State under ``folder``; ``bootstrap`` fills it, ``apply`` is a foreachBatch body, ``start`` runs a stream."""

    def __init__(self, spark: SparkSession, folder: str, options: ScanOptions = ScanOptions(), root: str | None = None, publish: Callable[[DataFrame, int], None] | None = None) -> None:
        self.spark, self.folder, self.options, self.root, self.publish = spark, folder.rstrip("/"), options, root, publish

    def _pointer(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/pointer")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        done = [n for n in names if n.startswith("generation=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/pointer/{n}/_SUCCESS"))]
        last = max((int(n.partition("=")[2]) for n in done), default=None)
        return None if last is None else (last, self.spark.read.parquet(f"{self.folder}/pointer/generation={last}").first().batch_id)

    def _table(self, name: str, generation: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/generation={generation}")

    def state(self) -> DataFrame:
        found = self._pointer()
        return self._table("entries", found[0]) if found else self.spark.createDataFrame([], ENTRY_DDL)

    def findings(self) -> DataFrame:
        found = self._pointer()
        return self._table("findings", found[0]) if found else pairs.scan_entries(self.spark.createDataFrame([], ENTRY_DDL), self.options)

    def hashes(self) -> DataFrame:
        """path, hash of the files whose content is known."""
        found = self._pointer()
        return self._table("hashes", found[0]) if found else self.spark.createDataFrame([], HASHES_DDL)

    def _commit(self, generation: int, batch_id: int, **tables: DataFrame) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}/generation={generation}")
        self._point(generation, batch_id)
        for name in ("pointer", *tables):
            for old in range(generation - KEPT_GENERATIONS, -1, -1):
                if not self._delete(f"{self.folder}/{name}/generation={old}"):
                    break

    def _point(self, generation: int, batch_id: int) -> None:
        self.spark.createDataFrame([(batch_id,)], "batch_id bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/pointer/generation={generation}")

    def _delete(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def bootstrap(self, corpus: DataFrame) -> None:
        """Full scan into the first generation."""
        state = entries(corpus, self.options)
        self._commit(0, -1, entries=state, findings=pairs.scan_entries(state, self.options, self.root), hashes=content_hashes(corpus))

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        found = self._pointer()
        if found and batch_id <= found[1]:
            return
        generation = found[0] + 1 if found else 0
        old, hashes = self.findings(), self.hashes()
        if "new_path" in batch.columns:
            batch = expand_renames(batch)
        last = unchanged_suppressed(interesting(coalesce_changes(batch)), hashes).persist()
        if found and last.isEmpty():
            self._point(found[0], batch_id)
            feed = diff_findings(old, old)
        else:
            state, new, _ = apply_batch(self.state(), old, last, self.options, self.root)
            gone = hashes.join(last.select("path"), "path", "left_anti")
            self._commit(generation, batch_id, entries=state, findings=new, hashes=gone.unionByName(content_hashes(last.where("op <> 'remove'"))))
            feed = diff_findings(old, self._table("findings", generation))
        last.unpersist()
        if self.publish:
            self.publish(feed, batch_id)
        else:
            feed.write.mode("overwrite").parquet(f"{self.folder}/feed/batch={batch_id}")

    def start(self, changes: DataFrame, checkpoint: str, interval: str = "500 milliseconds", available_now: bool = False) -> StreamingQuery:
        """Processing-time micro-batches: changes within an interval are taken together, the last of a path wins."""
        writer = changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def change_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Change log files (JSON lines) as a stream: path, version, op, content, lang."""
    return spark.readStream.schema(CHANGES_DDL).json(folder)


def last_versions(changes: DataFrame) -> DataFrame:
    """Window form of :func:`coalesce_changes`, for tables where every column is wanted in place."""
    order = Window.partitionBy("path").orderBy(F.col("version").desc())
    return changes.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
