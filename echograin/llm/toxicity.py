"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Fitting takes a bounded sample of labelled rows (at most ``MAX_LABELLED`` rows and ``MAX_TOKENS`` words, by hash order of
the id, never the held-out fold). Every word of the sample is a term of the vector space, none is left out: a term's
weight in a text is (1 + ln tf) idf c, where c = z^2 / (z^2 + Z_HALF^2) is its contrast between the labels, z the
two-proportion statistic of its document frequencies. Without c, plain TF-IDF, the nearest texts are those that share
rare ordinary words (README has figures); with it the same cosine looks at what the labels are about. Words that no
example has tell nothing.

The index keeps, for each term, postings in blocks of ``BLOCK`` examples (ordered so that like ones share blocks) and
each block's largest weight. A query adds up its terms' block maxima to an upper bound for every block and opens blocks
from the highest bound down, some at a time, until the bound is below the k-th best cosine, so the nearest are exact.
Their votes weigh by distance, smoothed by the sample's rate. Scores are calibrated by a logistic curve through the
sample's own votes, each example scored without itself; a text without a known word gets the rate of such examples. The
nearest examples are the evidence.

The index is bounded by the sample's words and goes with the task; every text is scored whole, in one pass without a
shuffle.

Defined cases: null and empty texts are texts without a word; a null label or id teaches nothing and several labels of
one id count as their largest; copies of a text teach once a label; without labelled rows every score is 0; repeated
rows are scored each for itself; ties among neighbours go to the smaller id; an empty table gives an empty result;
label, lang and source never enter a score, and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, materialize, n_words, release, rows_of, text_slices
from .hashing import NO_LETTERS, word_hashes

MODULUS, HELD_OUT = 5, 0
MAX_LABELLED, MAX_TOKENS = 8_000, 8_000_000
#: The contrast at which a word counts half: six standard errors, which chance does not reach in a billion words.
Z_HALF = 6.0
NEIGHBOURS = 15
BLOCK = 64
CENTRES = 64
#: A term in more than one block of so many is bounded by its blocks' largest weights before it is added up.
OFTEN = 3
#: The most frequent terms, in most blocks anyway, are a matrix; queries meet it some at a time.
COMMON, BATCH = 512, 64
PRIOR_WEIGHT = 1.0
EVIDENCE = 3


def bags(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct words (hashes, sorted) and their counts, for each text."""
    h, bounds = word_hashes(column, NO_LETTERS)
    for a, z in zip(bounds.tolist(), bounds[1:].tolist()):
        yield np.unique(h[a:z], return_counts=True)


def ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers first[k], first[k] + 1, ... (counts[k] of them) for all k, in order."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(first - (total - counts), counts)


@dataclass
class Index:
    #: Terms (sorted hashes) with their weights; starts[k]:starts[k + 1] are term k's postings.
    terms: np.ndarray
    weight: np.ndarray
    starts: np.ndarray
    #: Postings, by term and example: example, and how often it has the term.
    example: np.ndarray
    tf: np.ndarray
    #: Examples by number: length of the vector, id and label.
    length: np.ndarray
    doc_ids: np.ndarray
    toxic: np.ndarray
    prior: float
    empty_rate: float
    #: The most frequent terms (numbers, sorted).
    common: np.ndarray

    #: What follows from these is made where it is used, and not sent along.
    _DERIVED = ("posting", "block", "begin", "largest", "entries", "matrix")

    def unpack(self) -> None:
        if "matrix" in self.__dict__:
            return
        of = np.repeat(np.arange(len(self.terms)), np.diff(self.starts))
        #: Weights of the postings in vectors of length 1.
        self.posting = (1 + np.log(self.tf)) * self.weight[of] / self.length[self.example]
        # Entries are a term's postings in a block: block, largest weight, and where they begin (one more at the end);
        # entries[k]:entries[k + 1] are term k's.
        at = self.example // BLOCK
        first = np.flatnonzero((of[1:] != of[:-1]) | (at[1:] != at[:-1])) + 1
        first = np.append(0, first) if len(of) else first
        self.block, self.begin = at[first].astype(np.int32), np.append(first, len(of))
        self.largest = np.maximum.reduceat(self.posting, first) if len(first) else np.zeros(0)
        self.entries = np.searchsorted(of[first], np.arange(len(self.terms) + 1))
        #: Weights of the common terms in all examples.
        self.matrix = np.zeros((len(self.common), -(-len(self.doc_ids) // BLOCK) * BLOCK))
        for k, term in enumerate(self.common.tolist()):
            own = slice(self.starts[term], self.starts[term + 1])
            self.matrix[k, self.example[own]] = self.posting[own]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in self._DERIVED}

    def vector(self, words: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Known terms and their weights at length 1; none if no word is known."""
        if not len(self.terms) or not len(words):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        known = self.terms[at] == words
        at = at[known]
        w = (1 + np.log(tf[known])) * self.weight[at]
        length = np.sqrt((w * w).sum())
        return (at, w / length) if length > 0 else (at[:0], w[:0])

    def _postings(self, at: np.ndarray, share: np.ndarray) -> np.ndarray:
        """What the entries ``at`` add to each example, each times its share of the query."""
        sizes = self.begin[at + 1] - self.begin[at]
        posts = ranges(self.begin[at], sizes)
        return np.bincount(self.example[posts], np.repeat(share, sizes) * self.posting[posts], -(-len(self.doc_ids) // BLOCK) * BLOCK).astype(float)

    def common_sums(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
        """What the most frequent terms add to each example, for each of some queries, and which terms are left."""
        self.unpack()
        query, left = np.zeros((len(vectors), len(self.common))), []
        for k, (terms, w) in enumerate(vectors):
            at = np.minimum(np.searchsorted(self.common, terms), len(self.common) - 1)
            hit = self.common[at] == terms if len(self.common) else np.zeros(len(terms), bool)
            query[k, at[hit]] = w[hit]
            left.append(~hit)
        return query @ self.matrix, left

    def nearest(self, terms: np.ndarray, w: np.ndarray, k: int, without: int = -1, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and examples, best first, ``k`` at most; examples sharing no word are none. ``base`` is what terms
        that are not among ``terms`` add to each example."""
        self.unpack()
        counts = self.entries[terms + 1] - self.entries[terms]
        at, share = ranges(self.entries[terms], counts), np.repeat(w, counts)
        # Terms in few blocks are added up at once; of the others, a block's largest weights bound what they can add.
        rare = np.repeat(counts * OFTEN <= len(self.doc_ids) // BLOCK + 1, counts)
        sums = self._postings(at[rare], share[rare])
        if base is not None:
            sums += base
        at, share = at[~rare], share[~rare]
        block, n_blocks = self.block[at], len(sums) // BLOCK
        if without >= 0:
            sums[without] = -np.inf
        bounds = sums.reshape(-1, BLOCK).max(axis=1, initial=0.0) + np.bincount(block, share * self.largest[at], n_blocks)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        best, found, floor, step = np.zeros(0), np.zeros(0, np.int64), 0.0, 4
        while len(order) and bounds[order[0]] >= floor - 1e-12:
            now, order = order[:step], order[step:]
            now = now[bounds[now] >= floor - 1e-12]
            opened = np.zeros(n_blocks, bool)
            opened[now] = True
            mine = opened[block]
            whole = (sums + self._postings(at[mine], share[mine])).reshape(-1, BLOCK)[now].ravel()
            hit = np.flatnonzero((whole > 0) & (whole >= floor))
            if len(hit) > 4 * k:  # the others can't be among the best
                least = np.partition(whole[hit], len(hit) - k)[len(hit) - k]
                hit = hit[whole[hit] >= least]
            best, found = np.concatenate([best, whole[hit]]), np.concatenate([found, now[hit // BLOCK] * BLOCK + hit % BLOCK])
            rank = np.lexsort((self.doc_ids[found], -best))[:k]
            best, found = best[rank], found[rank]
            floor = best[-1] if len(best) == k else 0.0
            step *= 4
        return best, found

    def votes(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, without: list[int] | None = None) -> Iterator[tuple[float | None, list[dict]]]:
        """For each bag: share of toxic votes, None without a known word, and the nearest examples."""
        for at in range(0, len(texts), BATCH):
            vectors = [self.vector(*bag) for bag in texts[at : at + BATCH]]
            sums, left = self.common_sums(vectors)
            for i, (terms, w) in enumerate(vectors):
                if not len(terms):
                    yield None, []
                    continue
                cosine, row = self.nearest(terms[left[i]], w[left[i]], k, without[at + i] if without else -1, sums[i])
                share = 1 / (1.05 - np.minimum(cosine, 1.0))
                score = ((share * self.toxic[row]).sum() + PRIOR_WEIGHT * self.prior) / (share.sum() + PRIOR_WEIGHT)
                yield float(score), [{"doc_id": int(self.doc_ids[r]), "cosine": round(float(c), 6), "toxic": int(self.toxic[r])} for c, r in zip(cosine[:EVIDENCE], row[:EVIDENCE])]

    def scores(self, texts: list[tuple[np.ndarray, np.ndarray]], curve: tuple[float, float] = (1.0, 0.0)) -> Iterator[tuple[float, list[dict]]]:
        for raw, evidence in self.votes(texts):
            yield (self.empty_rate, []) if raw is None else (float(calibrated(raw, *curve)), evidence)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def calibrated(raw: np.ndarray | float, slope: float, shift: float) -> np.ndarray:
    return 1 / (1 + np.exp(-(slope * logit(raw) + shift)))


def fit_curve(raw: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Logistic curve (slope, shift) of labels on votes, held to the identity by one example's worth; it always rises."""
    x, theta = np.stack([logit(raw), np.ones(len(raw))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (p - toxic) + theta - (1, 0))
        theta = theta - np.clip(step, -1, 1)
    return max(float(theta[0]), 0.05), float(theta[1])


def build_index(doc_ids: np.ndarray, toxic: np.ndarray, sizes: np.ndarray, words: np.ndarray, tf: np.ndarray) -> Index:
    """``words`` and ``tf`` are the examples' bags one after the other, ``sizes`` their lengths."""
    n, bad = len(doc_ids), int(toxic.sum())
    row = np.repeat(np.arange(n), sizes)
    terms, of = np.unique(words, return_inverse=True)
    df, df_bad = np.bincount(of, minlength=len(terms)), np.bincount(of, toxic[row], len(terms))
    share = df / max(n, 1)
    spread = np.sqrt(share * (1 - share) * (1 / max(bad, 1) + 1 / max(n - bad, 1)))
    z = np.where(spread > 0, (df_bad / max(bad, 1) - (df - df_bad) / max(n - bad, 1)) / np.where(spread > 0, spread, 1), 0.0)
    weight = np.log((1 + n) / (1 + df)) * z * z / (z * z + Z_HALF * Z_HALF)
    w = (1 + np.log(tf)) * weight[of]
    length = np.sqrt(np.bincount(row, w * w, n))
    full = length > 0
    w = w / np.where(full, length, 1)[row]
    # Examples stand by their nearest of some of them: like ones share blocks, which makes bounds tight. No more than that.
    near, best = np.zeros(n, np.int64), np.full(n, -1.0)
    for k, centre in enumerate(range(0, n, max(1, n // CENTRES))):
        dense = np.zeros(len(terms))
        dense[of[row == centre]] = w[row == centre]
        cosine = np.bincount(row, w * dense[of], n)
        better = cosine > best
        near[better], best[better] = k, cosine[better]
    order = np.lexsort((doc_ids, -best, near))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    at = np.lexsort((place[row], of))
    at = at[w[at] > 0]
    starts = np.searchsorted(of[at], np.arange(len(terms) + 1))
    common = np.sort(np.argsort(-df, kind="stable")[:COMMON])
    empty, prior = ~full, bad / max(n, 1)
    # Laplace-smoothed, so that a handful of such examples is no certainty.
    rate = (toxic[empty].sum() + prior) / (empty.sum() + 1) if n else 0.0
    small = lambda x: x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.int64)
    return Index(terms, weight, starts, small(place[row[at]]), small(tf[at]), np.where(full, length, 1)[order], doc_ids[order], toxic[order], prior, float(rate), common)


_BAGS = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int64()), ("words", pa.list_(pa.int64())), ("tf", pa.list_(pa.int32()))])


def _bag_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text"):
        found = list(bags(batch.column(0)))
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array([w.view(np.int64) for w, _ in found], _BAGS[2].type), pa.array([c.astype(np.int32) for _, c in found], _BAGS[3].type)], schema=_BAGS)


def _own_votes(shared):
    """Votes for each example by the others."""
    schema = pa.schema([("toxic", pa.int64()), ("raw", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        places: dict[tuple[int, int], int] = {(d, t): k for k, (d, t) in enumerate(zip(index.doc_ids.tolist(), index.toxic.tolist()))}
        for batch in batches:
            docs, toxic, words, tf = (batch.column(k).to_pylist() for k in range(4))
            texts = [(np.array(w, np.int64).view(np.uint64), np.array(c, np.int64)) for w, c in zip(words, tf, strict=True)]
            own = [places[x] for x in zip(docs, toxic, strict=True)]
            yield rows_of(schema, [toxic, [raw for raw, _ in index.votes(texts, without=own)]])

    return run


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_tokens: int = MAX_TOKENS) -> tuple[Broadcast, tuple[float, float]]:
    """The index, sent to the workers (its size is bounded by the sample's), and the curve of its calibration.

    ``docs``: doc_id, text. ``labels``: doc_id, toxic; only rows outside the held-out fold are read.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), MODULUS) != HELD_OUT))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("long").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # The sample has max_labelled rows at most, two numbers each, so its broadcast is bounded.
    rows = docs.join(F.broadcast(sample), "doc_id").groupBy("text", "toxic").agg(F.min("doc_id").alias("doc_id"))  # copies teach once
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = materialize(rows.withColumn("n", n_words(F.col("text"))), "toxicity-sample")
    few = sizes.select("doc_id", "toxic", F.sum("n").over(before).alias("upto")).where((F.col("upto") <= max_tokens)).drop("upto")
    bag_rows = sizes.join(F.broadcast(few), ["doc_id", "toxic"]).select("text", "toxic", "doc_id").mapInArrow(_bag_batches, "doc_id bigint, toxic bigint, words array<bigint>, tf array<int>")
    bag_rows = materialize(bag_rows, "toxicity-bags")
    found = bag_rows.toArrow().combine_chunks().sort_by([("doc_id", "ascending"), ("toxic", "ascending")]).combine_chunks()
    flat = lambda c, kind: found.column(c).combine_chunks().flatten().to_numpy().astype(kind)
    lengths = np.array([len(x) for x in found.column("tf")], np.int64)
    index = build_index(found.column("doc_id").to_numpy(), found.column("toxic").to_numpy(), lengths, flat("words", np.int64).view(np.uint64), flat("tf", np.int64))
    shared = spark.sparkContext.broadcast(index)
    own = bag_rows.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_own_votes(shared), "toxic bigint, raw double").where("raw IS NOT NULL").toArrow()
    curve = (1.0, 0.0)
    if own.num_rows:
        # In a fixed order, so that sums are equal in reruns.
        raw, toxic = own.column("raw").to_numpy(), own.column("toxic").to_numpy()
        rank = np.lexsort((toxic, raw))
        curve = fit_curve(raw[rank], toxic[rank])
    release(sizes, bag_rows)
    return shared, curve


def _score_batches(shared, curve: tuple[float, float]):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("evidence", pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in text_slices(batches, "text"):
            found = list(index.scores(list(bags(batch.column(1))), curve))
            yield rows_of(schema, [batch.column(0).to_pylist(), batch.column(2).to_pylist(), [x[0] for x in found], [x[1] for x in found]])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", **limits: int) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (nearest examples) for each row of ``docs``."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), (crc_mod(F.col(doc_id), MODULUS) == HELD_OUT).alias("held_out"))
    index, curve = fit(own.select("doc_id", "text"), labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).alias("toxic")), **limits)
    found = own.mapInArrow(_score_batches(index, curve), "doc_id bigint, held_out boolean, score double, evidence array<struct<doc_id:bigint,cosine:double,toxic:int>>")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
