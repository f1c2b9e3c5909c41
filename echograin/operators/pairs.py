"""Candidate pairs, verification and ranking: equi-joins on hashes, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BANDS, ROWS, ScanOptions, check_bands
from ..functions import text as T
from .entries import sketch_similarity

ENDPOINT = ["path", "lang", "fn_name", "line_start", "line_end", "unique_fps"]


def fps(entries: DataFrame) -> DataFrame:
    return entries.select("entry_id", F.explode("fps").alias("hash"))


def bucket_sizes(fingerprints: DataFrame) -> DataFrame:
    return fingerprints.groupBy("hash").agg(F.count("*").alias("size"))


def bucket_histogram(fingerprints: DataFrame) -> DataFrame:
    """size, buckets: how many hashes are shared by how many entries, largest first."""
    return bucket_sizes(fingerprints).groupBy("size").agg(F.count("*").alias("buckets")).orderBy(F.col("size").desc())


def capped(fingerprints: DataFrame, max_bucket: int) -> DataFrame:
    """Fingerprints of hashes that 2 to ``max_bucket`` entries share: the cap comes before the join it keeps linear."""
    ok = bucket_sizes(fingerprints).where(F.col("size").between(2, max_bucket)).select("hash")
    return fingerprints.join(ok, "hash", "left_semi")


def naive_pairs(entries: DataFrame, max_bucket: int = 50, min_shared: int = 10) -> DataFrame:
    """a, b, shared, a_total, b_total, jaccard of entries sharing ``min_shared`` hashes of capped buckets."""
    f = capped(fps(entries), max_bucket)
    left, right = f.withColumnRenamed("entry_id", "a"), f.withColumnRenamed("entry_id", "b")
    shared = left.join(right, "hash").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= min_shared)
    size = lambda n: entries.select(F.col("entry_id").alias(n), F.col("unique_fps").alias(f"{n}_total"))
    out = shared.join(size("a"), "a").join(size("b"), "b")
    return out.withColumn("jaccard", jaccard(F.col("shared"), F.col("a_total"), F.col("b_total"))).select("a", "b", "shared", "a_total", "b_total", "jaccard")


def jaccard(shared: Column, a: Column, b: Column) -> Column:
    union = a + b - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def estimated_shared(j: Column, a: Column, b: Column) -> Column:
    return F.round(j * (a + b) / (1 + j)).cast("bigint")


def bands(entries: DataFrame, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """entry_id, band, key."""
    check_bands(n_bands, rows)
    slots = F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda k: F.md5(F.concat_ws(",", k.cast("string"), F.array_join(F.slice("sketch", k * rows + 1, rows), ",")).cast("binary")))
    return entries.select("entry_id", F.posexplode(slots).alias("band", "key"))


def band_keys(entries: DataFrame, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """entry_id, key: :func:`bands` with the band inside a key of 16 bytes, for joins of large tables."""
    return bands(entries, n_bands, rows).select("entry_id", F.unhex("key").alias("key"))


def candidates_of(some: DataFrame, entries: DataFrame) -> DataFrame:
    """a < b sharing a band, once each, one of them at least in ``some``, whose rows are among ``entries``. Only the
    bands of ``some`` meet those of all."""
    met = band_keys(some).withColumnRenamed("entry_id", "id").join(band_keys(entries), "key").where("id <> entry_id")
    return met.select(F.least("id", "entry_id").alias("a"), F.greatest("id", "entry_id").alias("b")).distinct()


def candidates(banded: DataFrame) -> DataFrame:
    """a < b sharing a band, once each."""
    left, right = banded.withColumnRenamed("entry_id", "a"), banded.withColumnRenamed("entry_id", "b")
    return left.join(right, ["band", "key"]).where("a < b").select("a", "b").distinct()


def _sides(pairs: DataFrame, entries: DataFrame, *columns: str) -> DataFrame:
    side = lambda n: entries.select(F.col("entry_id").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in columns])
    return pairs.join(side("a"), "a").join(side("b"), "b")


def estimate(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs with the sketches' similarity in ``estimated``."""
    return _sides(pairs, entries, "sketch").withColumn("estimated", sketch_similarity(F.col("a_sketch"), F.col("b_sketch"))).drop("a_sketch", "b_sketch")


def verify(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs with shared, union_size and exact of their fingerprint sets."""
    wide = _sides(pairs, entries, "fps").withColumn("shared", F.size(F.array_intersect("a_fps", "b_fps")).cast("bigint"))
    wide = wide.withColumn("union_size", F.size("a_fps") + F.size("b_fps") - F.col("shared"))
    return wide.withColumn("exact", F.when(F.col("union_size") > 0, F.col("shared") / F.col("union_size")).otherwise(F.lit(0.0))).drop("a_fps", "b_fps")


def partners(banded: DataFrame, ids: DataFrame, alive: DataFrame | None = None) -> DataFrame:
    """id, partner: entries that share a band with an id of ``ids``, itself and dead ones left out."""
    hit = banded.join(ids.select(F.col("entry_id").alias("id")), F.col("entry_id") == F.col("id")).select("id", "band", "key")
    out = hit.join(banded.withColumnRenamed("entry_id", "partner"), ["band", "key"]).where("id <> partner").select("id", "partner").distinct()
    return out if alive is None else out.join(alive.select(F.col("entry_id").alias("partner")), "partner", "left_semi")


def tags_and_score(exact: Column, a: dict[str, Column], b: dict[str, Column], shared: Column, root: str | None = None) -> tuple[Column, Column]:
    """Tags in their fixed order, and the score that the tags weigh. ``a``/``b``: path, fn_name, unique_fps."""
    pa_, pb = T.strip_root(a["path"], root), T.strip_root(b["path"], root)
    test = T.is_test_path(pa_) & T.is_test_path(pb)
    generic = T.is_generic_name(a["fn_name"]) | T.is_generic_name(b["fn_name"])
    tiny = (a["unique_fps"] < 15) & (b["unique_fps"] < 15)
    cross = ~T.top_module(pa_).eqNullSafe(T.top_module(pb))
    small, large = F.least(a["unique_fps"], b["unique_fps"]), F.greatest(a["unique_fps"], b["unique_fps"])
    subset = (small > 0) & (large > small) & (20 * shared > 19 * small)
    named = zip(("test-only", "generic-name", "tiny", "cross-module", "subset"), (test, generic, tiny, cross, subset), strict=True)
    tags = F.filter(F.array(*[F.when(c, n) for n, c in named]), lambda t: t.isNotNull())
    score = exact.cast("double")
    for condition, factor in ((test, 0.4), (generic, 0.6), (tiny, 0.5)):
        score = F.when(condition, score * factor).otherwise(score)
    score = F.when(cross, F.least(score * 1.4, F.lit(1.0))).otherwise(score)
    return tags, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


#: Keys that are broadcast to pick rows; more are joined.
FEW_KEYS = 400_000


def picked(rows: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """The ``rows`` with (or, left_anti, without) one of ``keys``, by the keys' column. The keys are counted, since few
    of them can be broadcast: then rows with long sets stay where they are."""
    few = keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    return rows.join(F.broadcast(keys) if few else keys, keys.columns, how)


def findings_of(some: DataFrame, entries: DataFrame, options: ScanOptions = ScanOptions(), root: str | None = None) -> DataFrame:
    """Those of :func:`scan_entries`' findings by sketches that have an endpoint in ``some``, rows of ``entries``. The
    candidates, two numbers each, are persisted."""
    near = candidates_of(some, entries).persist()
    own = picked(entries, near.select(F.explode(F.array("a", "b")).alias("entry_id")).distinct())
    close = estimate(near, own).where(F.col("estimated") >= options.min_jaccard)
    return classify(verify(close, own).where(F.col("exact") >= options.min_jaccard), own, root)


def classify(verified: DataFrame, entries: DataFrame, root: str | None = None) -> DataFrame:
    """Findings: endpoints a and b (structs), exact_jaccard, estimated_jaccard, shared, tags, score."""
    wide = _sides(verified.select("a", "b", "exact", "estimated", "shared"), entries, *ENDPOINT)
    sides = [{c: F.col(f"{n}_{c}") for c in ENDPOINT} for n in "ab"]
    tags, score = tags_and_score(F.col("exact"), *sides, F.col("shared"), root)
    ends = [F.struct(F.col(n).alias("entry_id"), *[c.alias(k) for k, c in side.items()]).alias(n) for n, side in zip("ab", sides, strict=True)]
    out = wide.select(*ends, F.col("exact").alias("exact_jaccard"), F.col("estimated").alias("estimated_jaccard"), "shared", tags.alias("tags"), score.alias("score"))
    same = (F.col("a.path") == F.col("b.path")) & F.col("a.fn_name").eqNullSafe(F.col("b.fn_name")) & F.col("a.line_start").eqNullSafe(F.col("b.line_start")) & F.col("a.line_end").eqNullSafe(F.col("b.line_end"))
    return out.where(~same)



def order() -> list[Column]:
    """Total order of findings: score, shared, then the endpoints."""
    return [F.col("score").desc(), F.col("shared").desc(), F.col("a.path"), F.col("a.line_start"), F.col("b.path"), F.col("b.line_start"), F.col("a.entry_id"), F.col("b.entry_id")]


def top(findings: DataFrame, n: int) -> DataFrame:
    """The best ``n`` with their rank: a top-k first, so the rank's window sees n rows."""
    best = findings.orderBy(*order()).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order())))


def scan_entries(entries: DataFrame, options: ScanOptions = ScanOptions(), root: str | None = None) -> DataFrame:
    """Findings among ``entries``: banded sketches, or the inverted index if ``use_naive`` (it ignores min_jaccard)."""
    if options.use_naive:
        found = naive_pairs(entries, options.max_bucket, options.min_shared).select("a", "b", F.col("jaccard").alias("exact"), F.col("jaccard").alias("estimated"), "shared")
    else:
        near = estimate(candidates(bands(entries)), entries).where(F.col("estimated") >= options.min_jaccard)
        found = verify(near, entries).where(F.col("exact") >= options.min_jaccard)
    return classify(found, entries, root)
