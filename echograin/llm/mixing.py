"""Mixing sources to target weights by Pareto order sampling.

Sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all words by weight; a target stops at
``MAX_COPIES`` times its source's words and the excess is shared anew by weight among the rest (the level is found in
closed form from running sums over sources sorted by where they saturate).

Within a source a document's share grows with the logarithm of its size: its weight g is one more than the binary digits
of its size, and it is wanted min(``MAX_COPIES``, c g) times, with the one c that makes the wanted words the target (found
in closed form over the source's classes of size). The whole part of that are certain copies; the fraction left over is
the document's inclusion probability pi, which so differs between sources and between documents of one source. Documents
are ranked by the ratio of their random odds u/(1-u) to their inclusion odds pi/(1-pi) (Rosen's Pareto order), and each
source takes its lowest ranks up to the fixed size that is left of its target, the last one where that brings the sum
nearer. u is a keyed hash of the id, so reruns agree.

Only DataFrame functions are used. A source may hold a third of all rows, so ranks are not sorted within a source as a
whole: documents fall into ``CELLS`` cells by rank, words are summed per (source, cell) with partial aggregates, running
sums over those bounded rows find the one cell in which the fixed size ends, and only that cell's ids and sizes are
sorted, for the last rank that is taken. A document then learns its copies from its source's row alone; texts never move.

Defined cases: null or empty text has size 0 and is taken 0 words; a null source is a source of its own, last in order;
repeated ids are separate rows, ordered by size; rows with equal id and size are taken or left together; an empty table
gives an empty result; other columns of the caller's table are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_words

MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
CELLS = 4096
SEED = "mix-1"


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from the md5 of seed and id: 48 bits, so that equal values in SQL are exact."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, target: one row a source, so its windows hold as many rows as there are sources."""
    per_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("long")
    full = per_source.withColumn("weight", weight).withColumn("most", F.lit(max_copies).cast("long") * F.col("source_size"))
    # Sources saturate in the order of most/weight. Up to a source, the level that shares what the ones before leave is
    # (total - most of those before) / (weights from it on); the sources whose most lies below that level are capped.
    rising = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    still = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    level = full.withColumns({"left": left, "still": still}).withColumn("open", F.col("most") * F.col("still") >= F.col("left") * F.col("weight"))
    first = level.withColumn("level", F.first(F.when(F.col("open"), F.col("left") / F.col("still")), ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    capped = F.col("level").isNull() | (F.col("most").cast("double") <= F.col("level") * F.col("weight"))
    return first.select("source", "source_size", F.when(capped, F.col("most").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def size_class(size: Column) -> Column:
    """Binary digits of the size: 0 for 0, else the whole logarithm and one."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0)


def rank_of(u: Column, pi: Column) -> Column:
    """Pareto's ranking variable: random odds by inclusion odds; null where a document can't be drawn."""
    return F.when(pi > 0, (u / (1 - u)) / (pi / (1 - pi)))


def _cell(rank: Column) -> Column:
    return F.least(F.lit(CELLS - 1), F.floor(rank / (1 + rank) * CELLS)).cast("int")


def classes(sizes: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """s, class, source_size, target, whole, pi, rest: one row a source and class of size.

    Classes saturate in the order of their weights, the heaviest first. Up to a class, the c that shares what the ones
    before leave is (target - most of those before) / (weighted words from it on).
    """
    per_class = sizes.groupBy("source", size_class(F.col("size")).alias("class")).agg(F.sum("size").alias("words"))
    want = per_class.join(targets(sizes).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("source")
    g = F.col("class") + 1
    falling = Window.partitionBy("s").orderBy(F.col("class").desc())
    left = F.col("target") - max_copies * F.coalesce(F.sum("words").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    still = F.sum(g * F.col("words")).over(falling.rowsBetween(0, Window.unboundedFollowing))
    shared = want.withColumns({"left": left, "still": still}).withColumn("open", (max_copies * F.col("still") >= F.col("left") * g) & (F.col("still") > 0))
    c = F.first(F.when(F.col("open"), F.col("left") / F.col("still")), ignorenulls=True).over(falling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    copies = F.when(c.isNull() | (c * g >= max_copies), F.lit(float(max_copies))).otherwise(F.greatest(F.lit(0.0), c * g))
    found = shared.withColumn("copies", copies).withColumn("whole", F.floor("copies")).withColumn("pi", F.col("copies") - F.col("whole"))
    rest = F.greatest(F.lit(0.0), F.col("target") - F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("s")))
    return found.withColumn("rest", rest).select("s", "class", "source_size", "target", "whole", "pi", "rest")


def _ranked(rows: DataFrame, wanted: DataFrame, seed: str) -> DataFrame:
    """``rows`` (doc_id, source, size and any others) with their class's plan and their rank and cell."""
    wide = rows.withColumn("class_", size_class(F.col("size"))).join(wanted, F.col("source").eqNullSafe(F.col("s")) & (F.col("class_") == F.col("class")), "left")
    wide = wide.withColumn("rank", rank_of(uniform(F.col("doc_id"), seed), F.col("pi")))
    return wide.withColumn("cell", _cell(F.col("rank"))).drop("s", "class_", "class")


def plan(sizes: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows of :func:`classes`, with the last rank that the source takes as cut (rank, doc_id, size)."""
    wanted = materialize(classes(sizes), "mix-classes")
    ranked = _ranked(sizes, wanted, seed).where("rank IS NOT NULL").select("source", "doc_id", "size", "rest", "rank", "cell")
    cells = ranked.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    reach = cells.withColumn("before", before).where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
    reach = reach.groupBy(F.col("source").alias("s")).agg(F.min("cell").alias("end_cell"), F.min_by("before", "cell").alias("end_before"))
    ends = materialize(reach, "mix-ends")
    at_end = ranked.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("end_cell")))
    order = Window.partitionBy("s").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("end_before") + F.sum("size").over(order)
    taken = at_end.withColumn("upto", upto).where(F.col("upto") - F.col("size") / 2 <= F.col("rest"))
    cuts = taken.groupBy("s").agg(F.max(F.struct("rank", "doc_id", "size")).alias("cut"))
    cuts = ends.select(F.col("s").alias("t"), "end_cell").join(cuts, F.col("t").eqNullSafe(F.col("s")), "left").drop("s")
    # A row a source and class, and written, so that Spark knows its size and broadcasts it only under its limit.
    return materialize(wanted.join(cuts, F.col("s").eqNullSafe(F.col("t")), "left").drop("t"), "mix-plan")


def with_copies(rows: DataFrame, planned: DataFrame, seed: str = SEED) -> DataFrame:
    """``rows`` (doc_id, source, size and any others) with source_size, target and copies."""
    wide = _ranked(rows, planned, seed)
    first = F.col("end_cell").isNull() | (F.col("cell") < F.col("end_cell"))
    last = (F.col("cell") == F.col("end_cell")) & (F.struct("rank", "doc_id", "size") <= F.col("cut"))
    extra = F.coalesce((F.col("rank").isNotNull() & (first | F.coalesce(last, F.lit(False)))).cast("int"), F.lit(0))
    return wide.withColumn("copies", (F.col("whole") + extra).cast("long")).drop("whole", "pi", "rest", "end_cell", "cut", "rank", "cell")


def _sizes(docs: DataFrame, doc_id: str, text: str, source: str) -> list[Column]:
    return [F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size")]


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for each row of ``docs``; ``copies`` is how often it is taken."""
    sizes = materialize(docs.select(*_sizes(docs, doc_id, text, source)), "mix-sizes")
    out = with_copies(sizes, plan(sizes, seed), seed)
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix` takes it. No row is moved."""
    sizes = materialize(docs.select(*_sizes(docs, doc_id, text, source)), "mix-sizes")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    taken = with_copies(docs.select(row, *_sizes(docs, doc_id, text, source)), plan(sizes, seed), seed).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


ORACLE_SQL = rf"""
WITH sizes AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
weighted AS (SELECT source, source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS most FROM per),
rising AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
         sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS still
  FROM weighted WINDOW w AS (ORDER BY most::DOUBLE / weight, source NULLS LAST)),
lev AS (SELECT arg_min(left_::DOUBLE / still, most::DOUBLE / weight) AS level FROM rising WHERE most * still >= left_ * weight),
tgt AS (SELECT source, source_size, CASE WHEN level IS NULL OR most <= level * weight THEN most::DOUBLE ELSE level * weight END AS target FROM rising, lev),
per_class AS (SELECT source, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS class, sum(size)::BIGINT AS words FROM sizes GROUP BY 1, 2),
falling AS (
  SELECT c.*, t.source_size, t.target,
         t.target - 3 * coalesce(sum(words) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS left_,
         (sum((class + 1) * words) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS still
  FROM per_class c JOIN tgt t ON c.source IS NOT DISTINCT FROM t.source
  WINDOW w AS (PARTITION BY c.source ORDER BY class DESC)),
factor AS (SELECT source, arg_max(left_ / still, class) AS c FROM falling WHERE still > 0 AND 3 * still >= left_ * (class + 1) GROUP BY 1),
copied AS (
  SELECT f.*, CASE WHEN c IS NULL OR c * (class + 1) >= 3 THEN 3.0::DOUBLE ELSE greatest(0, c * (class + 1)) END AS copies
  FROM falling f LEFT JOIN factor x ON f.source IS NOT DISTINCT FROM x.source),
parts AS (SELECT *, floor(copies) AS whole, copies - floor(copies) AS pi, greatest(0, target - sum(floor(copies) * words) OVER (PARTITION BY source)) AS rest FROM copied),
u AS (SELECT s.*, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS class, (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u FROM sizes s),
ranked AS (
  SELECT u.doc_id, u.size, u.source, p.source_size, p.target, p.whole, p.pi, p.rest, CASE WHEN p.pi > 0 THEN (u.u / (1 - u.u)) / (p.pi / (1 - p.pi)) END AS q
  FROM u JOIN parts p ON u.source IS NOT DISTINCT FROM p.source AND u.class = p.class),
summed AS (SELECT *, sum(CASE WHEN pi > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM ranked)
SELECT doc_id, size, source_size, target,
       (whole + CASE WHEN pi > 0 AND bool_or(upto - size / 2.0 <= rest) OVER (PARTITION BY source, q, doc_id, size) THEN 1 ELSE 0 END)::BIGINT * size AS taken
FROM summed
"""
