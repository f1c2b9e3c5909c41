"""Source trees as corpus tables: recursive scan, exclusion rules, UTF-8 only, language by extension."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import WalkOptions
from ..functions import languages, text


def glob_regex(pattern: str) -> str | None:
    """A git-style pattern as a regular expression on a relative path; null for a blank or broken one."""
    p = pattern.strip().removeprefix("!").strip()
    if not p or p.startswith("#"):
        return None
    only_dir, anchored = p.endswith("/"), "/" in p.rstrip("/")
    p, out, i = p.strip("/"), "", 0
    while i < len(p):
        c = p[i]
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[":
            end = p.find("]", i + 2)
            if end < 0:
                return None
            inside = p[i + 1 : end]
            out, i = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if only_dir else "(?:/|$)")


def _kept(path: str, options: WalkOptions, rules: list[tuple[str, list[tuple[bool, str]]]], is_dir: bool) -> bool:
    """Whether the walk takes a relative path (a directory: goes into it). The last matching ignore rule decides."""
    name = posixpath.basename(path)
    shown = path + "/" if is_dir else path
    if options.use_default_excludes and name in text.DEFAULT_EXCLUDES:
        return False
    if any((regex := glob_regex(p)) and re.search(regex, shown) for p in options.excludes):
        return False
    if not options.respect_ignore_files:
        return True
    if name.startswith("."):
        return False
    ignored = False
    for folder, own in rules:
        inside = shown[len(folder) + 1 :] if folder else shown
        for exception, regex in own:
            if re.search(regex, inside):
                ignored = not exception
    return not ignored


class _Tree:
    """Directory listings and small files through the cluster's file systems. Names alone pass the driver, and
    directories that are left out are never opened. (Spark's own file sources skip names with a leading underscore.)"""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.base = self.path(root.rstrip("/") or "/")
        self.fs = self.base.getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, rel: str):
        return self.path(self.base, rel) if rel else self.base

    def exists(self, rel: str) -> bool:
        return self.fs.exists(self.at(rel))

    def read(self, rel: str) -> str:
        stream = self.fs.open(self.at(rel))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8", "replace")
        finally:
            stream.close()

    def list(self, rel: str) -> list[tuple[str, bool, str]]:
        try:
            found = [(x.getPath().getName(), x.isDirectory(), x.getPath().toString()) for x in self.fs.listStatus(self.at(rel))]
        except Exception:  # a folder that cannot be read is left out, as unreadable entries are
            return []
        return sorted(found)

    def rules(self, rel: str, names: set[str], in_git: bool) -> list[tuple[bool, str]]:
        out = []
        for name in (".gitignore", ".ignore"):
            if name in names and (in_git or name == ".ignore"):
                lines = self.read(posixpath.join(rel, name)).splitlines()
                out += [(line.lstrip().startswith("!"), regex) for line in lines if (regex := glob_regex(line))]
        return out


def walk(spark: SparkSession, root: str, options: WalkOptions = WalkOptions()) -> list[tuple[str, str]]:
    """(relative path, address) of the files that the walk takes."""
    tree, found = _Tree(spark, root), []
    in_git = options.respect_ignore_files and tree.exists(".git")
    stack: list[tuple[str, list]] = [("", [])]
    while stack:
        rel, rules = stack.pop()
        entries = tree.list(rel)
        if options.respect_ignore_files and (own := tree.rules(rel, {n for n, _, _ in entries}, in_git)):
            rules = [*rules, (rel, own)]
        for name, is_dir, address in entries:
            path = posixpath.join(rel, name)
            if _kept(path, options, rules, is_dir):
                (stack if is_dir else found).append((path, rules if is_dir else address))
    return sorted(found)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("lang", pa.string()), ("content", pa.binary())])
    for batch in batches:
        for path, lang, address in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            local = re.fullmatch(r"file:/*(/.*)", address)
            try:
                fs, at = (pa.fs.LocalFileSystem(), local[1]) if local else pa.fs.FileSystem.from_uri(address)
                with fs.open_input_stream(at) as stream:
                    content = stream.read()
            except OSError:
                continue
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([lang]), pa.array([content], pa.binary())], schema=schema)


def listing(spark: SparkSession, root: str, options: WalkOptions = WalkOptions()) -> DataFrame:
    """path, ext, lang, address of files whose language is known. The language table is a bounded dimension."""
    rows = spark.createDataFrame(walk(spark, root, options), "path string, address string")
    return rows.withColumn("ext", text.extension(F.col("path"))).join(F.broadcast(languages.extensions(spark)), "ext")


def files(spark: SparkSession, root: str, options: WalkOptions = WalkOptions(), only_lang: str | None = None) -> DataFrame:
    """path, lang, content (binary): contents are read where the tasks run, after every filter on paths."""
    rows = listing(spark, root, options)
    if only_lang:
        rows = rows.where(F.lower("lang") == only_lang.lower())
    spread = rows.select("path", "lang", "address").repartition(spark.sparkContext.defaultParallelism * 2)
    return spread.mapInArrow(_read, "path string, lang string, content binary")


def directories(spark: SparkSession, root: str, options: WalkOptions = WalkOptions()) -> DataFrame:
    """Directories that hold a file the walk takes."""
    rows = spark.createDataFrame(walk(spark, root, options), "path string, address string")
    return rows.select(F.regexp_replace("path", "/?[^/]*$", "").alias("path")).distinct()


def corpus(spark: SparkSession, root: str, options: WalkOptions = WalkOptions(), only_lang: str | None = None) -> DataFrame:
    """entry_id, path, lang, content; files that are not valid UTF-8 are dropped."""
    found = files(spark, root, options, only_lang)
    decoded = F.try_validate_utf8(F.col("content").cast("string"))
    return found.select(text.md5_60(F.col("path")).alias("entry_id"), "path", "lang", decoded.alias("content")).where("content IS NOT NULL")
