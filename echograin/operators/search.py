"""Query by example and keyword search over a table of entries."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ScanOptions, SearchOptions
from ..functions import languages, text
from .entries import entries, pad_sketch, sketch_similarity
from .pairs import bands, fps

K1, B = 1.2, 0.75
#: Above so many entries, and for snippets of so many fingerprints, candidates come from shared bands.
BANDS_ABOVE_ENTRIES, BANDS_FROM_FINGERPRINTS = 5_000, 20
RESULT = ["path", "lang", "fn_name", "line_start", "line_end", "unique_fps"]


def build_index(corpus: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Entries with fingerprints, sketches and identifier parts."""
    found = entries(corpus, options, with_idents=True)
    parts = F.flatten(F.transform("idents", text.split_identifier))
    return found.select("entry_id", *RESULT, "sketch", "fps", parts.alias("ident_tokens"))


def save_index(index: DataFrame, path: str, options: SearchOptions = SearchOptions()) -> None:
    """Parquet; the options go along as columns of a one-row table beside it."""
    index.write.mode("overwrite").parquet(f"{path.rstrip('/')}/entries")
    spark = index.sparkSession
    spark.createDataFrame([(options.blind, options.granularity, options.k, options.window)], "blind string, granularity string, k int, window int").coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/options")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, SearchOptions]:
    """A saved index with the options it was built with, which queries then use."""
    o = spark.read.parquet(f"{path.rstrip('/')}/options").first()
    index = spark.read.parquet(f"{path.rstrip('/')}/entries").withColumn("sketch", pad_sketch(F.col("sketch")))
    return index, SearchOptions(blind=o.blind, granularity=o.granularity, k=o.k, window=o.window)


def snippet_entry(spark: SparkSession, snippet: str, options: ScanOptions, lang: str | None = None) -> DataFrame:
    """The snippet as one entry: a whole text, in the hinted language or the one that its wording suggests."""
    key = languages.resolve(lang) if lang else None
    if key is None:
        key = spark.range(1).select(text.guess_language(F.lit(snippet))).first()[0]
    corpus = spark.createDataFrame([(0, "<snippet>", key, snippet)], "entry_id bigint, path string, lang string, content string")
    return entries(corpus, ScanOptions(blind=options.blind, k=options.k, window=options.window))


def sharing(index: DataFrame, query: DataFrame, min_jaccard: float) -> DataFrame:
    """query_id, entry_id: every pair that can reach ``min_jaccard`` (over 0).

    Sets with that similarity share ``min_jaccard`` times the query's fingerprints or more, so of any larger choice
    than the rest of them they share one: the choice is those that the fewest entries have.
    """
    own = query.select(F.col("entry_id").alias("query_id"), F.size("fps").alias("size"), F.explode("fps").alias("hash"))
    postings = fps(index)
    df = postings.join(own.select("hash").distinct(), "hash", "left_semi").groupBy("hash").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("query_id").orderBy(F.coalesce("df", F.lit(0)), "hash")
    # Shared ones are a whole number; what a product in floating point may be too large by must not raise it.
    needed = F.greatest(F.ceil(F.col("size") * F.lit(min_jaccard) - 1e-6), F.lit(1))
    chosen = own.join(df, "hash", "left").withColumn("n", F.row_number().over(rarest)).where(F.col("n") <= F.col("size") - needed + 1)
    return chosen.select("query_id", "hash").join(postings, "hash").select("query_id", "entry_id").distinct()


def rank_matches(index: DataFrame, query: DataFrame, min_jaccard: float, top: int, use_bands: bool = False, many: bool = False) -> DataFrame:
    """Entries similar to the query entries, ranked for each query.

    Brute force compares all sketches and verifies those with half the threshold or more; with ``use_bands`` only
    entries that share a band are compared. The query side is a stated, small set and the index side streams by it.
    With ``many`` queries, brute force leaves out pairs that cannot reach the threshold by their shared fingerprints;
    its results are the same.
    """
    q = query.select(F.col("entry_id").alias("query_id"), F.col("sketch").alias("q_sketch"), F.col("fps").alias("q_fps"))
    if use_bands:
        hit = bands(query).withColumnRenamed("entry_id", "query_id").join(bands(index), ["band", "key"]).select("query_id", "entry_id").distinct()
        both = hit.join(q, "query_id").join(index, "entry_id")
    else:
        # Pairs meet an entry's sets where that is and the queries' there, so that no pair's sets move.
        both = sharing(index, query, min_jaccard).join(index, "entry_id").join(F.broadcast(q), "query_id") if many and min_jaccard > 0 else index.join(q, F.lit(True))
        both = both.where(sketch_similarity(F.col("sketch"), F.col("q_sketch")) >= 0.5 * min_jaccard)
    shared = F.size(F.array_intersect("fps", "q_fps"))
    exact = shared / (F.size("fps") + F.size("q_fps") - shared)
    found = both.withColumn("jaccard", exact).where(F.col("jaccard") >= min_jaccard)
    order = Window.partitionBy("query_id").orderBy(F.col("jaccard").desc(), "path", "line_start", "entry_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", F.col("jaccard").alias("score"), "entry_id", *RESULT, "jaccard")


def search_snippet(index: DataFrame, snippet: str, options: SearchOptions = SearchOptions(), lang: str | None = None) -> DataFrame:
    """Entries similar to a snippet: all are compared in a small index or with a short snippet, else those that share
    a band with it."""
    query = snippet_entry(index.sparkSession, snippet, options, lang).persist()
    long = query.where(F.col("unique_fps") >= BANDS_FROM_FINGERPRINTS).isEmpty() is False
    use_bands = long and index.limit(BANDS_ABOVE_ENTRIES + 1).count() > BANDS_ABOVE_ENTRIES
    return rank_matches(index, query, options.min_jaccard, options.top, use_bands).drop("query_id")


def term_frequencies(docs: DataFrame) -> DataFrame:
    """entry_id, term, tf from entry_id, terms (array)."""
    return docs.select("entry_id", F.explode("terms").alias("term")).groupBy("entry_id", "term").agg(F.count("*").alias("tf"))


def corpus_statistics(docs: DataFrame) -> DataFrame:
    """n, avg_dl: lengths count all terms with multiplicity."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("avg_dl"))


def idf(n, df):
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25(docs: DataFrame, query: DataFrame) -> DataFrame:
    """query_id, entry_id, score for query (query_id, term; a term twice counts twice).

    Only postings of query terms are kept, so the groupings and joins see those rows alone.
    """
    terms = query.select("term").distinct()
    length = docs.select("entry_id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    postings = length.join(terms, "term", "left_semi").groupBy("entry_id", "term", "dl").agg(F.count("*").alias("tf"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    stats = corpus_statistics(docs)
    part = idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    weighted = postings.join(df, "term").join(stats, F.lit(True)).withColumn("part", part)
    return query.join(weighted, "term").groupBy("query_id", "entry_id").agg(F.sum("part").alias("score"))


def search_keywords(index: DataFrame, words: str, top: int = 10) -> DataFrame:
    """Entries ranked by BM25 over identifier parts."""
    spark = index.sparkSession
    q = spark.createDataFrame([(w,) for w in words.split()], "word string").select(F.lit(0).alias("query_id"), F.explode(text.split_identifier(F.col("word"))).alias("term"))
    scores = bm25(index.select("entry_id", F.col("ident_tokens").alias("terms")), q)
    best = scores.orderBy(F.col("score").desc(), "entry_id").limit(top).join(index.select("entry_id", *RESULT), "entry_id")
    order = Window.orderBy(F.col("score").desc(), "path", "line_start", "entry_id")
    return best.withColumn("rank", F.row_number().over(order)).select("rank", "score", "entry_id", *RESULT, F.col("score").alias("bm25"))


def register(spark: SparkSession) -> None:
    """Functions for SQL: tokenize(content, lang) and slice_functions(content, lang)."""
    from ..functions import slicing, tokens

    def tokenize(content: str, lang: str):
        return [tuple(t) for t in tokens.process((content or "").encode(), lang)[0]]

    def functions(content: str, lang: str):
        return [tuple(g) for g in slicing.slice_functions((content or "").encode(), lang)]

    tokens_ddl = "array<struct<kind:string,text:string,byte_start:int,byte_end:int,line:int,col:int>>"
    functions_ddl = "array<struct<name:string,byte_start:int,byte_end:int,line_start:int,line_end:int>>"
    spark.udf.register("tokenize", F.udf(tokenize, tokens_ddl, useArrow=True))
    spark.udf.register("slice_functions", F.udf(functions, functions_ddl, useArrow=True))


