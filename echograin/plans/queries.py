"""Registered queries of the engine's own operators, each with its SQL form where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ScanOptions
from ..functions import languages, text
from ..operators import entries as E
from ..operators import pairs, search
from ..streaming import incremental
from . import report, sql
from .scan import scan_stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_held: dict[tuple, DataFrame] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Input for which a core is worth waking: smaller tables may be one row group, which one task would read and work on.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it is too small to be split by its reader; large tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size < cores * SPREAD_BYTES else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(F.col("doc_id").alias("entry_id"), path.alias("path"), F.lit("Text").alias("lang"), F.col("text").alias("content"))


def held(spark: SparkSession, sf_dir: str, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Entries of the documents, kept for the session as the reference keeps its index."""
    key = (spark.sparkContext.applicationId, sf_dir, options)
    if key not in _held:
        _held[key] = E.entries(corpus(spark, sf_dir), options).cache()
    return _held[key]


def r6(c: str | Column) -> Column:
    return F.round(c, 6)


def scan(spark: SparkSession, sf_dir: str, options: ScanOptions = ScanOptions()) -> DataFrame:
    return pairs.scan_entries(held(spark, sf_dir, options), options)


def flat(findings: DataFrame) -> DataFrame:
    return findings.select(F.col("a.entry_id").alias("a"), F.col("b.entry_id").alias("b"), r6("exact_jaccard").alias("exact_jaccard"), r6("estimated_jaccard").alias("estimated_jaccard"), "shared", F.array_join("tags", ",").alias("tags"), r6("score").alias("score"))


_FLAT = "a, b, round(exact_jaccard, 6) AS exact_jaccard, round(estimated_jaccard, 6) AS estimated_jaccard, shared, tags, round(score, 6) AS score"
_LSH = sql.BASE + sql.sketches() + sql.findings("hits")
_NAIVE = sql.BASE + sql.NAIVE + sql.findings("naive", "jaccard", "jaccard")


@query("WITH " + sql.tokens("strict") + " SELECT doc_id, kind, count(*) AS n FROM kinds GROUP BY 1, 2")
def tokens_count_by_kind(spark, sf_dir):
    return E.kind_counts(corpus(spark, sf_dir)).groupBy(F.col("entry_id").alias("doc_id"), "kind").agg(F.sum("n").alias("n"))


def _blinded(mode):
    oracle = "WITH " + sql.tokens(mode) + " SELECT doc_id, count(*) AS n, count(DISTINCT key) AS distinct_keys, min(md5(key)) AS low FROM keys GROUP BY 1"

    def run(spark, sf_dir):
        key = F.concat("kind", F.coalesce("text", F.lit("")))
        return E.token_rows(corpus(spark, sf_dir), mode, places=False).groupBy(F.col("entry_id").alias("doc_id")).agg(F.count("*").alias("n"), F.countDistinct(key).alias("distinct_keys"), F.min(F.md5(key.cast("binary"))).alias("low"))

    run.__name__ = f"tokens_blind_{mode}"
    query(oracle)(run)


for _mode in ("strict", "mild", "aggressive"):
    _blinded(_mode)


@query("WITH " + sql.tokens() + "," + sql.GRAMS + " SELECT doc_id, count(*) AS n, min(h) AS low, max(h) AS high FROM grams GROUP BY 1")
def kgram_hashes(spark, sf_dir):
    """k-grams as a window over the token table, the form that SQL has too."""
    from pyspark.sql import Window

    order = Window.partitionBy("entry_id").orderBy("pos")
    key = F.concat("kind", F.coalesce("text", F.lit("")))
    runs = E.token_rows(corpus(spark, sf_dir), "mild", places=False).withColumn("key", key).select("entry_id", F.collect_list("key").over(order.rowsBetween(0, 4)).alias("run"))
    grams = runs.where(F.size("run") == 5).select("entry_id", text.md5_60(F.array_join("run", " ")).alias("h"))
    return grams.groupBy(F.col("entry_id").alias("doc_id")).agg(F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))


@query(sql.BASE + " SELECT entry_id, pos, hash FROM winnowed")
def winnow_fingerprints(spark, sf_dir):
    return E.fingerprint_rows(corpus(spark, sf_dir))


@query(sql.BASE + " SELECT entry_id, unique_fps FROM ent")
def fingerprint_distinct_count(spark, sf_dir):
    return held(spark, sf_dir).select("entry_id", "unique_fps")


@query(sql.BASE + " SELECT size, count(*) AS buckets FROM (SELECT hash, count(*) AS size FROM fps GROUP BY 1) GROUP BY 1")
def bucket_histogram(spark, sf_dir):
    return pairs.bucket_histogram(pairs.fps(held(spark, sf_dir)))


@query(sql.BASE + " SELECT entry_id, count(*) AS n FROM fps WHERE hash IN (SELECT hash FROM fps GROUP BY hash HAVING count(*) BETWEEN 2 AND 50) GROUP BY 1")
def bucket_cap_filter(spark, sf_dir):
    return pairs.capped(pairs.fps(held(spark, sf_dir)), 50).groupBy("entry_id").agg(F.count("*").alias("n"))


@query(sql.BASE + sql.NAIVE + " SELECT a, b, shared, a_total, b_total, round(jaccard, 6) AS jaccard FROM naive")
def naive_pairs(spark, sf_dir):
    return pairs.naive_pairs(held(spark, sf_dir)).withColumn("jaccard", r6("jaccard"))


@query(sql.BASE + sql.sketches() + " SELECT entry_id, md5(string_agg(v::VARCHAR, ',' ORDER BY slot)) AS sketch FROM slots GROUP BY 1")
def minhash_sketch(spark, sf_dir):
    return held(spark, sf_dir).select("entry_id", F.md5(F.array_join("sketch", ",").cast("binary")).alias("sketch"))


@query(sql.BASE + sql.sketches() + " SELECT entry_id, band, key FROM banded")
def lsh_bands(spark, sf_dir):
    return pairs.bands(held(spark, sf_dir))


@query(sql.BASE + sql.sketches() + " SELECT a, b FROM cand")
def lsh_candidates(spark, sf_dir):
    return pairs.candidates(pairs.bands(held(spark, sf_dir)))


@query(sql.BASE + sql.sketches() + " SELECT a, b, round(estimated, 6) AS estimated FROM est")
def lsh_estimated_jaccard(spark, sf_dir):
    e = held(spark, sf_dir)
    return pairs.estimate(pairs.candidates(pairs.bands(e)), e).select("a", "b", r6("estimated").alias("estimated"))


@query(sql.BASE + sql.sketches() + " SELECT e.a, e.b, round(e.estimated * (x.unique_fps + y.unique_fps) / (1 + e.estimated))::BIGINT AS est_shared FROM est e JOIN ent x ON x.entry_id = e.a JOIN ent y ON y.entry_id = e.b")
def lsh_est_shared(spark, sf_dir):
    e = held(spark, sf_dir)
    near = pairs._sides(pairs.estimate(pairs.candidates(pairs.bands(e)), e), e, "unique_fps")
    return near.select("a", "b", pairs.estimated_shared(F.col("estimated"), F.col("a_unique_fps"), F.col("b_unique_fps")).alias("est_shared"))


@query(sql.BASE + sql.sketches() + " SELECT a, b, shared, union_size, round(exact, 6) AS exact FROM verified")
def exact_jaccard_verify(spark, sf_dir):
    e = held(spark, sf_dir)
    near = pairs.estimate(pairs.candidates(pairs.bands(e)), e).where("estimated >= 0.5")
    return pairs.verify(near, e).select("a", "b", "shared", "union_size", r6("exact").alias("exact"))


@query(f"{_LSH} SELECT {_FLAT} FROM scored")
def scan_lsh_findings(spark, sf_dir):
    return flat(scan(spark, sf_dir))


@query(f"{_NAIVE} SELECT {_FLAT} FROM scored")
def scan_naive_findings(spark, sf_dir):
    return flat(pairs.scan_entries(held(spark, sf_dir), ScanOptions(use_naive=True)))


@query(f"{_NAIVE} SELECT row_number() OVER (ORDER BY score DESC, shared DESC, a_path, b_path, a, b)::INT AS rank, {_FLAT} FROM scored ORDER BY rank LIMIT 20")
def scan_top_k(spark, sf_dir):
    """The flagship: fingerprints, capped self-join, score, top 20."""
    best = pairs.top(pairs.scan_entries(held(spark, sf_dir), ScanOptions(use_naive=True)), 20)
    return flat(best).join(best.select(F.col("a.entry_id").alias("a"), F.col("b.entry_id").alias("b"), "rank"), ["a", "b"])


@query(f"{_LSH} SELECT {_FLAT} FROM scored WHERE a IN (SELECT doc_id FROM documents WHERE lower(lang) = 'en') AND b IN (SELECT doc_id FROM documents WHERE lower(lang) = 'en')")
def scan_only_lang(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.lower("lang") == "en").select(F.col("doc_id").alias("entry_id"))
    return flat(pairs.scan_entries(held(spark, sf_dir).join(docs, "entry_id", "left_semi")))


@query("SELECT text_hash, ids, n FROM (SELECT md5(text) AS text_hash, min(doc_id) AS ids, count(*) AS n FROM documents GROUP BY 1) WHERE n > 1")
def exact_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("text_hash")).agg(F.min("doc_id").alias("ids"), F.count("*").alias("n"))
    return docs.where("n > 1")


# Classification over synthetic endpoints: pages give paths, parts give function names.
_PAIRS_SQL = """
WITH p AS (SELECT page_id AS id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '[?#].*', '') || CASE page_id % 4 WHEN 0 THEN '/tests/a.py' WHEN 1 THEN '/b_test.go' WHEN 2 THEN '/src/c.spec.ts' ELSE '/lib/d.rs' END AS path,
  CASE page_id % 3 WHEN 0 THEN 'Main' WHEN 1 THEN 'compute_total' END AS fn_name, (page_id * 7) % 40 AS fps FROM pages),
q AS (SELECT x.id AS a, y.id AS b, x.path AS a_path, y.path AS b_path, x.fn_name AS a_fn, y.fn_name AS b_fn, x.fps AS a_fps, y.fps AS b_fps, least(x.fps, y.fps) AS shared, 0.5 + (x.id % 50) / 100.0 AS exact FROM p x JOIN p y ON y.id = x.id + 4)"""
_T, _G = f"({sql.is_test('a_path')} AND {sql.is_test('b_path')})", f"({sql.is_generic('a_fn')} OR {sql.is_generic('b_fn')})"
_TINY, _CROSS = "(a_fps < 15 AND b_fps < 15)", "(split_part(a_path, '/', 1) <> split_part(b_path, '/', 1))"
_SUB = "(least(a_fps, b_fps) > 0 AND a_fps <> b_fps AND 20 * shared > 19 * least(a_fps, b_fps))"


def _synthetic(spark, sf_dir):
    page = F.col("page_id")
    base = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*/", ""), "[?#].*", "")
    tail = F.when(page % 4 == 0, "/tests/a.py").when(page % 4 == 1, "/b_test.go").when(page % 4 == 2, "/src/c.spec.ts").otherwise("/lib/d.rs")
    name = F.when(page % 3 == 0, "Main").when(page % 3 == 1, "compute_total")
    p = table(spark, sf_dir, "pages").select(page.alias("id"), F.concat(base, tail).alias("path"), name.alias("fn_name"), ((page * 7) % 40).alias("unique_fps"))
    side = lambda n: p.select(*[F.col(c).alias(f"{n}_{c}") for c in p.columns])
    both = side("a").withColumn("next", F.col("a_id") + 4).join(side("b"), F.col("next") == F.col("b_id"))
    sides = [{c: F.col(f"{n}_{c}") for c in ("path", "fn_name", "unique_fps")} for n in "ab"]
    shared = F.least("a_unique_fps", "b_unique_fps")
    tags, score = pairs.tags_and_score(F.lit(0.5) + (F.col("a_id") % 50) / 100, *sides, shared)
    return both.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), tags.alias("tags"), score.alias("score"))


def _tag(name, condition):
    def run(spark, sf_dir):
        return _synthetic(spark, sf_dir).select("a", "b", F.array_contains("tags", name).alias("tagged"))

    run.__name__ = "tag_" + name.replace("-", "_")
    query(f"{_PAIRS_SQL} SELECT a, b, {condition} AS tagged FROM q")(run)


for _name, _condition in (("test-only", _T), ("generic-name", _G), ("tiny", _TINY), ("cross-module", _CROSS), ("subset", _SUB)):
    _tag(_name, _condition)


@query(f"""{_PAIRS_SQL}, w AS (SELECT a, b, exact * CASE WHEN {_T} THEN 0.4 ELSE 1 END * CASE WHEN {_G} THEN 0.6 ELSE 1 END * CASE WHEN {_TINY} THEN 0.5 ELSE 1 END AS s, {_CROSS} AS c,
concat_ws(',', CASE WHEN {_T} THEN 'test-only' END, CASE WHEN {_G} THEN 'generic-name' END, CASE WHEN {_TINY} THEN 'tiny' END, CASE WHEN {_CROSS} THEN 'cross-module' END, CASE WHEN {_SUB} THEN 'subset' END) AS tags FROM q)
SELECT a, b, tags, round(CASE WHEN c THEN least(1.0, s * 1.4) ELSE s END, 6)::DOUBLE AS score FROM w""")
def score_compose(spark, sf_dir):
    return _synthetic(spark, sf_dir).select("a", "b", F.array_join("tags", ",").alias("tags"), r6("score").alias("score"))


# Lines of documents as granules: a range join of tokens with byte ranges.
_BLOCKS = """
raw AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
line_rows AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM raw),
spans AS (SELECT doc_id, n, line, sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - strlen(line) - 1 AS start_ FROM line_rows)"""


def _spans(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("ls"))
    step = lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.octet_length(x) + 1))
    starts = F.aggregate("ls", F.array(F.lit(0).cast("bigint")), lambda s, x: step(s, x.cast("string")))
    each = lines.select("doc_id", F.posexplode(F.arrays_zip("ls", F.slice(starts, 1, F.size("ls")).alias("starts"))).alias("n", "x"))
    return each.select("doc_id", (F.col("n") + 1).alias("n"), F.col("x.ls").alias("line"), F.col("x.starts").cast("bigint").alias("start"))


@query("WITH " + sql.tokens("strict") + "," + _BLOCKS + """
SELECT s.doc_id, s.n, s.start_::BIGINT AS start, len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(s.line, '[\\x{10000}-\\x{10FFFF}]', '!!!!', 'g'), '[\\x{800}-\\x{FFFF}]', '!!!', 'g'), '[\\x{80}-\\x{7FF}]', '!!', 'g'), '[A-Za-z0-9_]+|[^ \\t\\n\\f\\r]'))::BIGINT AS tokens FROM spans s""")
def token_range_slice(spark, sf_dir):
    """Tokens of each line: tokens joined with byte ranges inside a document, half-open."""
    tok = E.token_rows(corpus(spark, sf_dir)).select(F.col("entry_id").alias("doc_id"), "byte_start")
    spans = _spans(spark, sf_dir).withColumn("end", F.col("start") + F.octet_length("line"))
    inside = (F.col("byte_start") >= F.col("start")) & (F.col("byte_start") < F.col("end"))
    s, t = spans.alias("s"), tok.alias("t")
    joined = s.join(t, (F.col("s.doc_id") == F.col("t.doc_id")) & inside, "left")
    return joined.groupBy("s.doc_id", "n", "start").agg(F.count("byte_start").alias("tokens"))


# Search.
def _bench_sql(base: str) -> str:
    other = base.replace("FROM documents)", "FROM benchmark_docs)").replace("JOIN documents d", "JOIN benchmark_docs d")
    for name in ("ascii_text", "token_lists", "toks", "kinds", "keys", "runs", "grams", "framed", "winnowed", "fps", "ent"):
        other = re.sub(rf"\b{name}\b", f"q_{name}", other)
    return "WITH benchmark_docs AS (SELECT item_id AS doc_id, 'benchmark' AS source, text FROM benchmark)," + other.removeprefix("WITH ")


_SNIP = sql.BASE + "," + _bench_sql(sql.BASE).removeprefix("WITH ") + """,
qi AS (SELECT q.entry_id AS query_id, f.entry_id, count(*) AS shared FROM q_fps q JOIN fps f USING (hash) GROUP BY 1, 2),
qj AS (SELECT query_id, i.entry_id, shared::DOUBLE / (x.unique_fps + y.unique_fps - shared) AS jaccard FROM qi i JOIN q_ent x ON x.entry_id = i.query_id JOIN ent y ON y.entry_id = i.entry_id)
SELECT query_id, count(*) AS n, round(max(jaccard), 6) AS best FROM qj WHERE jaccard >= 0.05 GROUP BY 1"""


def _bench_entries(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entry_id"), F.concat(F.lit("benchmark/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("path"), F.lit("Text").alias("lang"), F.col("text").alias("content"))
    return E.entries(b)


@query(_SNIP)
def benchmark_in_documents(spark, sf_dir):
    """Query by example by way of shared hashes: every benchmark passage against all documents."""
    q, e = _bench_entries(spark, sf_dir), held(spark, sf_dir)
    hit = q.select(F.col("entry_id").alias("query_id"), F.explode("fps").alias("hash")).join(pairs.fps(e), "hash").groupBy("query_id", "entry_id").agg(F.count("*").alias("shared"))
    both = hit.join(q.select(F.col("entry_id").alias("query_id"), F.col("unique_fps").alias("q")), "query_id").join(e.select("entry_id", "unique_fps"), "entry_id")
    j = pairs.jaccard(F.col("shared"), F.col("q"), F.col("unique_fps"))
    return both.withColumn("jaccard", j).where("jaccard >= 0.05").groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max("jaccard"), 6).alias("best"))


@query(sql.BASE + sql.sketches() + """, qs AS (SELECT entry_id AS query_id FROM ent WHERE entry_id % 50 = 0),
es AS (SELECT q.query_id, y.entry_id, sum((x.v = y.v)::INT) / 128.0 AS est FROM qs q JOIN slots x ON x.entry_id = q.query_id JOIN slots y ON y.slot = x.slot GROUP BY 1, 2 HAVING sum((x.v = y.v)::INT) / 128.0 >= 0.15),
sh AS (SELECT e.query_id, e.entry_id, count(*) AS shared FROM es e JOIN fps x ON x.entry_id = e.query_id JOIN fps y ON y.entry_id = e.entry_id AND y.hash = x.hash GROUP BY 1, 2),
js AS (SELECT query_id, s.entry_id, y.path, shared::DOUBLE / (x.unique_fps + y.unique_fps - shared) AS jaccard FROM sh s JOIN ent x ON x.entry_id = s.query_id JOIN ent y ON y.entry_id = s.entry_id)
SELECT query_id, entry_id, round(jaccard, 6) AS jaccard, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY jaccard DESC, path, entry_id)::INT AS rank FROM js WHERE jaccard >= 0.3) WHERE rank <= 10""")
def snippet_bruteforce(spark, sf_dir):
    """Stated queries (every fiftieth document) against all entries."""
    e = held(spark, sf_dir)
    return search.rank_matches(e, e.where("entry_id % 50 = 0"), 0.3, 10, many=True).select("query_id", "entry_id", r6("jaccard").alias("jaccard"), "rank")


@query(sql.BASE + sql.sketches() + """, cs AS (SELECT DISTINCT x.entry_id AS query_id, y.entry_id FROM banded x JOIN banded y ON x.band = y.band AND x.key = y.key WHERE x.entry_id % 50 = 0),
sh AS (SELECT c.query_id, c.entry_id, count(*) AS shared FROM cs c JOIN fps x ON x.entry_id = c.query_id JOIN fps y ON y.entry_id = c.entry_id AND y.hash = x.hash GROUP BY 1, 2),
js AS (SELECT query_id, s.entry_id, y.path, shared::DOUBLE / (x.unique_fps + y.unique_fps - shared) AS jaccard FROM sh s JOIN ent x ON x.entry_id = s.query_id JOIN ent y ON y.entry_id = s.entry_id)
SELECT query_id, entry_id, round(jaccard, 6) AS jaccard, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY jaccard DESC, path, entry_id)::INT AS rank FROM js WHERE jaccard >= 0.3) WHERE rank <= 10""")
def snippet_lsh_probe(spark, sf_dir):
    e = held(spark, sf_dir)
    return search.rank_matches(e, e.where("entry_id % 50 = 0"), 0.3, 10, use_bands=True).select("query_id", "entry_id", r6("jaccard").alias("jaccard"), "rank")


@query(sql.BASE + sql.sketches() + " SELECT DISTINCT x.entry_id AS id, y.entry_id AS partner FROM banded x JOIN banded y ON x.band = y.band AND x.key = y.key AND x.entry_id <> y.entry_id WHERE x.entry_id % 10 = 0")
def partners_of(spark, sf_dir):
    e = held(spark, sf_dir)
    return pairs.partners(pairs.bands(e), e.where("entry_id % 10 = 0").select("entry_id"))


_PARTS = r"string_split(lower(regexp_replace(regexp_replace(regexp_replace({x}, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_-]', ' ', 'g')), ' ')"


@query(f"SELECT p_partkey, array_to_string(list_filter({_PARTS.format(x='p_name')}, lambda t: strlen(t) > 1), '|') AS parts FROM part")
def identifier_split(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.split_identifier(F.col("p_name")), "|").alias("parts"))


def _terms(spark, sf_dir):
    words = F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), F.transform(words, lambda w: F.lower(w)).alias("terms"))


_TERMS = "WITH d AS (SELECT doc_id AS entry_id, unnest(regexp_extract_all(lower(regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g')), '[a-z0-9_]+')) AS term FROM documents), tf AS (SELECT entry_id, term, count(*) AS tf FROM d GROUP BY 1, 2), dl AS (SELECT doc_id AS entry_id, len(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g'), '[A-Za-z0-9_]+')) AS dl FROM documents), st AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM dl)"
_IDF = "ln((n - df + 0.5) / (df + 0.5) + 1)"


@query(_TERMS + " SELECT entry_id, term, tf FROM tf")
def term_frequencies(spark, sf_dir):
    return search.term_frequencies(_terms(spark, sf_dir))


@query(_TERMS + f" SELECT term, df, round({_IDF}, 6) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), st")
def bm25_idf(spark, sf_dir):
    docs = _terms(spark, sf_dir)
    df = search.term_frequencies(docs).groupBy("term").agg(F.count("*").alias("df"))
    return df.join(search.corpus_statistics(docs), F.lit(True)).select("term", "df", r6(search.idf(F.col("n"), F.col("df"))).alias("idf"))


_Q = "the the thing nation error"


@query(_TERMS + f""", q AS (SELECT unnest(string_split('{_Q}', ' ')) AS term), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT tf.entry_id, sum({_IDF} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))) AS score FROM q JOIN tf USING (term) JOIN dfs USING (term) JOIN dl ON dl.entry_id = tf.entry_id, st GROUP BY 1)
SELECT entry_id, round(score, 6) AS score FROM sc""")
def bm25_search(spark, sf_dir):
    q = spark.createDataFrame([(0, w) for w in _Q.split()], "query_id int, term string")
    return search.bm25(_terms(spark, sf_dir), q).select("entry_id", r6("score").alias("score"))


# Languages, lines, paths.
@query(r"SELECT doc_id AS entry_id, 'Text' AS lang, sum((trim(line, ' ' || chr(9) || chr(12) || chr(13)) <> '')::BIGINT)::BIGINT AS code, 0::BIGINT AS comment, sum((trim(line, ' ' || chr(9) || chr(12) || chr(13)) = '')::BIGINT)::BIGINT AS blank FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))) AS line FROM documents) GROUP BY 1")
def line_counts(spark, sf_dir):
    return E.line_counts(corpus(spark, sf_dir))


@query(r"SELECT doc_id, sum((t <> '')::BIGINT)::BIGINT AS comment, sum((t = '')::BIGINT)::BIGINT AS blank FROM (SELECT doc_id, trim(unnest(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))), ' ' || chr(9) || chr(12) || chr(13)) AS t FROM documents) GROUP BY 1")
def literate_counts(spark, sf_dir):
    """Documents read as literate text; fences are tested on fixtures."""
    found = text.literate_counts(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("x")).select("doc_id", "x.comment", "x.blank")


@query(None)
def html_fsm_counts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("entry_id"), F.lit("Html").alias("lang"), F.col("html").alias("content"))
    return E.line_counts(pages)


@query("SELECT ext, lang FROM (VALUES " + ", ".join(f"('{e}', '{x.key}')" for e, x in languages.by_extension().items()) + ") t(ext, lang)")
def language_lookup(spark, sf_dir):
    return languages.extensions(spark)


@query("SELECT doc_id, CASE WHEN contains(l, 'def ') AND contains(l, ':') THEN 'Python' WHEN contains(l, 'fn ') AND contains(l, '->') THEN 'Rust' WHEN contains(l, 'func ') THEN 'Go' WHEN contains(l, 'function ') OR contains(l, '=>') OR contains(l, 'const ') THEN 'JavaScript' WHEN contains(l, 'public ') OR contains(l, 'private ') THEN 'Java' ELSE 'Python' END AS guess FROM (SELECT doc_id, lower(text) AS l FROM documents)")
def guess_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.guess_language(F.col("text")).alias("guess"))


def _paths(spark, sf_dir):
    p = F.col("page_id")
    part = F.element_at(F.array(*map(F.lit, ("src", "target", "node_modules", "lib", ".venv", "test_x", "specs", "docs"))), (p % 8 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat_ws("/", F.regexp_extract("url", "^[a-z]+://([^/]*)", 1), part, F.concat(p.cast("string"), F.lit(".test.ts"))).alias("path"))


_PATHS = "WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) || '/' || ['src', 'target', 'node_modules', 'lib', '.venv', 'test_x', 'specs', 'docs'][page_id % 8 + 1] || '/' || page_id || '.test.ts' AS path FROM pages)"


@query(f"{_PATHS} SELECT page_id, {sql.excluded('path')} AS excluded FROM p")
def path_excludes(spark, sf_dir):
    return _paths(spark, sf_dir).select("page_id", text.is_excluded(F.col("path")).alias("excluded"))


@query(f"{_PATHS} SELECT page_id, {sql.is_test('path')} AS test FROM p")
def test_path_predicate(spark, sf_dir):
    return _paths(spark, sf_dir).select("page_id", text.is_test_path(F.col("path")).alias("test"))


@query(f"{_PATHS} SELECT page_id, split_part(path, '/', 1) AS module, 'ts' AS ext FROM p")
def top_module(spark, sf_dir):
    return _paths(spark, sf_dir).select("page_id", text.top_module(F.col("path")).alias("module"), text.extension(F.col("path")).alias("ext"))


# Upkeep over events: user as path, time as version, props as content.
def _changes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("version"), F.when(F.col("event_id") % 7 == 0, "remove").otherwise("modify").alias("op"), F.when(F.col("event_id") % 7 != 0, F.col("props")).alias("content"))


_CHANGES = "WITH c AS (SELECT user_id::VARCHAR AS path, event_id AS version, CASE WHEN event_id % 7 = 0 THEN 'remove' ELSE 'modify' END AS op, CASE WHEN event_id % 7 <> 0 THEN props END AS content FROM events)"


@query(f"{_CHANGES} SELECT path, version, op, content FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY version DESC) AS n FROM c) WHERE n = 1")
def change_coalesce(spark, sf_dir):
    return incremental.coalesce_changes(_changes(spark, sf_dir))


@query(f"{_CHANGES}, l AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY version DESC) AS n FROM c), h AS (SELECT path, md5(content) AS hash FROM l WHERE n = 2) SELECT l.path, l.version, CASE WHEN content IS NULL THEN 'remove' ELSE op END AS op FROM l LEFT JOIN h USING (path) WHERE n = 1 AND (content IS NULL OR md5(content) IS DISTINCT FROM hash)")
def content_hash_skip(spark, sf_dir):
    from pyspark.sql import Window

    ranked = _changes(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy(F.col("version").desc())))
    hashes = ranked.where("n = 2").select("path", F.md5(F.col("content").cast("binary")).alias("hash"))
    return incremental.unchanged_suppressed(ranked.where("n = 1").drop("n"), hashes).select("path", "version", "op")


@query(f"{_CHANGES}, l AS (SELECT path, arg_max(op, version) AS op FROM c GROUP BY 1) SELECT avg((op = 'remove')::DOUBLE) AS ratio, avg((op = 'remove')::DOUBLE) > 0.25 AS compact FROM l")
def tombstone_ratio(spark, sf_dir):
    state = incremental.coalesce_changes(_changes(spark, sf_dir)).select("path", (F.col("op") != "remove").alias("alive"))
    return incremental.tombstone_ratio(state)


_OLD = "old AS (SELECT * FROM scored WHERE a % 5 <> 0 AND b % 5 <> 0), new_ AS (SELECT * REPLACE (CASE WHEN a % 3 = 0 THEN score * 0.5 ELSE score END AS score) FROM scored WHERE a % 7 <> 0 AND b % 7 <> 0)"


@query(f"{_LSH}, {_OLD}, d AS (SELECT coalesce(o.a, n.a) AS a, coalesce(o.b, n.b) AS b, CASE WHEN o.a IS NULL THEN 'added' WHEN n.a IS NULL THEN 'removed' WHEN abs(o.score - n.score) > 1e-4 THEN 'updated' END AS op FROM old o FULL JOIN new_ n ON o.a = n.a AND o.b = n.b) SELECT op, a, b FROM d WHERE op IS NOT NULL")
def incremental_diff(spark, sf_dir):
    f = scan(spark, sf_dir)
    drop = lambda m: f.where((F.col("a.entry_id") % m != 0) & (F.col("b.entry_id") % m != 0))
    new = drop(7).withColumn("score", F.when(F.col("a.entry_id") % 3 == 0, F.col("score") * 0.5).otherwise(F.col("score")))
    return incremental.diff_findings(drop(5), new).select("op", F.col("finding.a.entry_id").alias("a"), F.col("finding.b.entry_id").alias("b"))


_RANKED = "r AS (SELECT *, row_number() OVER (ORDER BY score DESC, shared DESC, a_path, b_path, a, b) - 1 AS rank0 FROM scored)"


@query(f"{_LSH}, {_RANKED} SELECT a, b, rank0::INT AS rank0, CASE WHEN rank0 < 20 THEN 'warning' ELSE 'hint' END AS severity FROM r")
def severity_tiering(spark, sf_dir):
    return report.tiered(scan(spark, sf_dir)).select(F.col("a.entry_id").alias("a"), F.col("b.entry_id").alias("b"), "rank0", "severity")


@query(f"{_LSH} SELECT path, count(*) AS findings FROM (SELECT a_path AS path, a, b FROM scored UNION SELECT b_path, a, b FROM scored) GROUP BY 1")
def findings_by_file(spark, sf_dir):
    return report.by_file(scan(spark, sf_dir)).groupBy("path").agg(F.count("*").alias("findings"))


@query(f"{_NAIVE}, {_RANKED} SELECT (rank0 + 1)::INT AS rank, format('{{:3d}}. score={{:.3f}}', rank0 + 1, score) || ' a: ' || a_path || ' b: ' || b_path AS line FROM r WHERE rank0 < 20")
def text_report(spark, sf_dir):
    best = pairs.top(pairs.scan_entries(held(spark, sf_dir), ScanOptions(use_naive=True)), 20)
    return best.select("rank", F.concat(F.format_string("%3d. score=%.3f", "rank", "score"), F.lit(" a: "), report.label("a"), F.lit(" b: "), report.label("b")).alias("line"))


@query(f"{_LSH}, {_RANKED} SELECT (rank0 + 1)::INT AS rank, a_path, b_path, round(score, 6) AS score FROM r")
def finding_json(spark, sf_dir):
    """All findings as JSON, read back."""
    j = report.json_lines(scan(spark, sf_dir))
    x = F.from_json("json", "rank int, score double, a struct<path:string>, b struct<path:string>")
    return j.select(x.alias("x")).select("x.rank", F.col("x.a.path").alias("a_path"), F.col("x.b.path").alias("b_path"), "x.score")


# Lines of documents as functions, so that diagnostics have a range.
@query(f"{_LSH}, {_RANKED}, e AS (SELECT a_path AS path, b_path AS other, exact_jaccard, score, tags, rank0, a AS id FROM r UNION ALL SELECT b_path, a_path, exact_jaccard, score, tags, rank0, b FROM r WHERE b_path <> a_path) SELECT path, (id % 10)::BIGINT AS start, 'Possible clone of ' || other || ':' AS message, CASE WHEN rank0 < 20 THEN 'warning' ELSE 'hint' END AS severity FROM e")
def diagnostics(spark, sf_dir):
    """Findings anchored to ranges that are made from the ids."""
    f = scan(spark, sf_dir)
    for end in "ab":
        f = f.withColumn(end, F.col(end).withField("line_start", (F.col(f"{end}.entry_id") % 10 + 1).cast("int")).withField("line_end", (F.col(f"{end}.entry_id") % 10 + 5).cast("int")).withField("fn_name", F.lit("f")))
    d = report.diagnostics(report.tiered(f))
    return d.select("path", F.col("start").cast("bigint").alias("start"), F.regexp_extract("message", "^(Possible clone of [^:]*:)", 1).alias("message"), "severity")


@query(sql.BASE + sql.sketches() + " SELECT (SELECT count(*) FROM documents) AS files_walked, (SELECT count(*) FROM ent) AS entries_indexed, (SELECT count(*) FROM cand) AS candidate_pairs, (SELECT count(*) FROM hits) AS findings")
def scan_stats_row(spark, sf_dir):
    e = held(spark, sf_dir)
    return scan_stats(table(spark, sf_dir, "documents"), e, pairs.candidates(pairs.bands(e)), scan(spark, sf_dir))


# What SQL cannot express: rows only.
_CODE = "def handle(event):\n    total = event.value * 2\n    for item in event.items:\n        total += item.price\n    return total\n\ndef other_{n}(a, b):\n    return [a + x for x in range({n})]\n"


def _code_corpus(spark, sf_dir):
    n = F.col("p_partkey")
    body = F.regexp_replace(F.lit(_CODE), r"\{n\}", n.cast("string"))
    return table(spark, sf_dir, "part").select(n.alias("entry_id"), F.concat(F.lit("m"), (n % 7).cast("string"), F.lit("/f"), n.cast("string"), F.lit(".py")).alias("path"), F.lit("Python").alias("lang"), body.alias("content"))


@query("SELECT p_partkey AS entry_id, unnest(['handle', 'other_' || p_partkey]) AS fn_name, unnest([1, 7]) AS line_start, unnest([5, 8]) AS line_end FROM part")
def function_granules(spark, sf_dir):
    return E.granule_rows(_code_corpus(spark, sf_dir)).select("entry_id", "fn_name", "line_start", "line_end")


@query(None)
def fsm_tokens(spark, sf_dir):
    """Tokens of generated Python files."""
    return E.token_rows(_code_corpus(spark, sf_dir))


@query(None)
def stream_upkeep(spark, sf_dir):
    """A batch of changes over documents: the change feed of an incremental update."""
    docs = corpus(spark, sf_dir)
    state = held(spark, sf_dir)
    batch = docs.where("entry_id % 10 = 0").select("path", F.lit(1).cast("bigint").alias("version"), F.when(F.col("entry_id") % 20 == 0, "remove").otherwise("modify").alias("op"), F.when(F.col("entry_id") % 20 != 0, F.col("content")).alias("content"), "lang")
    return incremental.apply_batch(state, incremental.touched_findings(state, batch), batch)[2].select("op", F.col("finding.a.path").alias("a"), F.col("finding.b.path").alias("b"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["scan_top_k"](spark, sf_dir)
