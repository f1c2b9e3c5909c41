from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from echograin.llm import graph, hashing, jaccard, permutation

DOCS = "doc_id bigint, text string"


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(7, 7)]
    sets = Sets()
    for a, b in links:
        sets.join(a, b)
    got = {r.v: r.c for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {v: sets.find(v) for a, b in links if a != b for v in (a, b)}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def edited(rng, words, share):
    words = list(words)
    for k in np.flatnonzero(rng.random(len(words)) < share):
        words[k] = f"n{rng.integers(1 << 30)}"
    return words


def brute(texts, width, t):
    sets = {k: set(jaccard.shingles((x or "").encode(), width).tolist()) for k, x in texts}
    out = Sets()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        out.find(a)
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) * t.denominator >= len(x | y) * t.numerator:
                out.join(a, b)
    return {k: (len(sets[k]), out.find(k)) for k in ids}


@pytest.mark.parametrize(("width", "t", "share"), [(3, Fraction(9, 10), 0.012), (5, Fraction(4, 5), 0.02)])
def test_jaccard_join_is_exact(spark, width, t, share):
    rng = np.random.default_rng(width)
    passage = [f"p{k}" for k in range(60)]
    texts, k = [], 0
    for family in range(25):
        base = [f"w{family}_{i}" for i in range(int(rng.integers(1, 200)))]
        if family % 3 == 0:
            base += passage
        for _ in range(int(rng.integers(1, 8))):
            texts.append((k := k + 1, " ".join(edited(rng, base, share))))
    chain = [f"c{i}" for i in range(100)]
    for step in range(12):  # a chain: neighbours are linked, ends are not
        chain = chain[: 4 * step] + [f"d{step}_{i}" for i in range(4)] + chain[4 * step + 4 :]
        texts.append((k := k + 1, " ".join(chain)))
    texts += [(500, None), (501, ""), (502, "a b"), (503, "A\tB"), (504, "a"), (505, "x " * 3000), (506, "x " * 2000), (507, texts[0][1].upper())]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(spark.createDataFrame(texts, DOCS), width=width, t=t).collect()}
    assert got == brute(texts, width, t)


@pytest.mark.parametrize("capacity", [jaccard.CAPACITY, 6_000, 20_000])
def test_a_large_group_of_near_copies_recurses(spark, capacity):
    """Capacities under the groups' sizes take them through cells and, where those do not separate, through blocks."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(120)]
    texts = [(k, " ".join(edited(rng, base, 0.02))) for k in range(150)]
    texts += [(1000 + k, " ".join(edited(rng, base, 0.06))) for k in range(30)]
    for family in range(6):  # families far from each other that share a passage
        own = base[:40] + [f"f{family}_{i}" for i in range(60)]
        texts += [(2000 + 100 * family + k, " ".join(edited(rng, own, 0.004))) for k in range(12)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(spark.createDataFrame(texts, DOCS), capacity=capacity).collect()}
    assert got == brute(texts, 3, Fraction(9, 10))


def test_five_thousand_near_copies(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    texts = [(k, " ".join(edited(rng, base, 0.015))) for k in range(5000)]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_join(spark.createDataFrame(texts, DOCS).repartition(8)).collect()}
    sets = [jaccard.shingles(x.encode(), 3) for _, x in texts]
    sizes, shared = np.array([len(x) for x in sets]), jaccard.intersections(sets).astype(int)
    linked = shared * 10 >= 9 * (sizes[:, None] + sizes[None, :] - shared)
    np.fill_diagonal(linked, True)
    root = np.arange(5000)
    while True:
        low = np.array([root[row].min() for row in linked])
        if (low[low] == root).all():
            break
        root = low[low]
    assert [got[k] for k in range(5000)] == root.tolist()


def test_jaccard_join_edges(spark):
    rows = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, None)], DOCS).selectExpr("*", "1 AS n_shingles", "2 AS region")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(rows).collect()), key=str)
    assert got == [(0, 2, None), (1, 2, 1), (1, 2, 1), (2, 0, 2)]
    assert jaccard.jaccard_join(rows.limit(0)).count() == 0
    # An id with two texts stands for both; its own copy elsewhere and a near copy of the other text join it.
    two = [(7, "q w e r t y u i"), (7, "a b c d e f g h"), (5, "a b c d e f g h"), (9, "q w e r t y u i"), (8, "z x")]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_join(spark.createDataFrame(two, DOCS)).collect()}
    assert got == {5: 5, 7: 5, 8: 8, 9: 5}


def test_one_of_each_keeps_one_of_equal_rows(spark):
    docs = spark.createDataFrame([(3, "a b"), (3, "a b"), (None, "a b"), (None, "a b"), (None, None), (4, "x y z")], DOCS)
    out = sorted(((r.doc_id, r.text) for r in jaccard.one_of_each(docs).collect()), key=str)
    assert out == [(3, "a b"), (4, "x y z"), (None, "a b"), (None, None)]


def test_one_of_each(spark):
    docs = spark.createDataFrame([(3, "a b c d e f"), (1, "A b c d e f"), (2, "q r s t u v"), (4, None)], DOCS).selectExpr("*", "doc_id AS _out", "7 AS c")
    out = jaccard.one_of_each(docs, width=5, t=Fraction(4, 5))
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 2, 4]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.sampled_from([Fraction(9, 10), Fraction(4, 5)]), st.integers(0, 1 << 30))
def test_linked_sets_share_a_prefix_shingle(common, one, two, t, seed):
    rng = np.random.default_rng(seed)
    h = np.unique(rng.integers(0, 1 << 63, common + one + two, dtype=np.uint64))
    x, y = h[: len(h) - two], np.unique(np.concatenate([h[:common], h[len(h) - two :]]))
    frequent = np.sort(rng.choice(h, len(h) // 3, replace=False))
    rank = rng.integers(1, 40, len(frequent)).astype(np.uint64)
    head = lambda s: set(s[jaccard.order_of(s, frequent, rank)[: jaccard.prefix_length(len(s), t)]].tolist())
    if len(np.intersect1d(x, y)) * t.denominator >= len(np.union1d(x, y)) * t.numerator:
        assert head(x) & head(y)


@settings(max_examples=40, deadline=None)
@given(st.integers(3, 200), st.integers(1, 60), st.integers(0, 1 << 30))
def test_intersections(m, size, seed):
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 1 << 40, 300)
    items = [np.unique(rng.choice(pool[: rng.integers(1, 300)], size)) for _ in range(m)]
    want = np.array([[len(np.intersect1d(a, b)) for b in items] for a in items])
    assert ((jaccard.intersections(items) == want) | np.eye(m, dtype=bool)).all()


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 600), st.integers(0, 80), st.integers(0, 80), st.sampled_from([Fraction(9, 10), Fraction(4, 5)]), st.integers(0, 1 << 30))
def test_signatures_part_no_linked_sets(common, one, two, t, seed):
    rng = np.random.default_rng(seed)
    h = rng.permutation(np.unique(rng.integers(0, 1 << 64, common + one + two, dtype=np.uint64)))
    x, y = np.sort(h[: len(h) - two]), np.sort(np.concatenate([h[:common], h[len(h) - two :]]))
    x, y = np.unique(x), np.unique(y)
    sizes, far = np.array([len(x), len(y), 3]), np.unique(rng.integers(0, 1 << 64, 3, dtype=np.uint64))
    root = jaccard.plausible(sizes, [jaccard.signature(s, t) for s in (x, y, far)], t)
    if len(np.intersect1d(x, y)) * t.denominator >= len(np.union1d(x, y)) * t.numerator:
        assert root[0] == root[1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB \t\n\x0b\u00a0é漢", max_size=40)), max_size=12), st.integers(1, 5), st.integers(1, 30))
def test_text_sets(texts, width, part):
    """Equal sets of word n-grams for equal sets of hashes, whatever the parts in which bytes are hashed."""
    column, before = jaccard.pa.array(texts, jaccard.pa.string()), hashing.PART
    try:
        hashing.PART = part
        got = [frozenset(s.tolist()) for s in jaccard.text_sets(column, width)]
        assert [frozenset(s.tolist()) for s in jaccard.text_sets(column.slice(1), width)] == got[1:]
    finally:
        hashing.PART = before
    words = [(x or "").encode().lower().split() for x in texts]
    want = [frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset() for w in words]
    assert [len(s) for s in got] == [len(s) for s in want]
    assert [[a == b for b in got] for a in got] == [[a == b for b in want] for a in want]


def test_key_filter(spark):
    own = jaccard.key_of(np.array([k * 977 - 5 for k in range(500)], np.int64))
    bits = jaccard.key_filter(spark.createDataFrame([(int(k),) for k in own], "key bigint"), 500)
    assert jaccard.may_hold(bits, own).all()
    assert jaccard.may_hold(bits, jaccard.key_of(np.arange(10**6, 10**6 + 5000))).mean() < 0.2


def vectors(rng, n, dim=64, noise=0.3):
    x = rng.normal(size=(n, dim))
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = y + noise * rng.normal(size=(n, dim)) / np.sqrt(dim)
    return np.concatenate([y, near, y[:20]]).astype(np.float32)


def test_embeddings_recall_and_exactness(spark):
    rng = np.random.default_rng(4)
    x = vectors(rng, 500)
    x = np.concatenate([x, x[3] + 0.05 * rng.normal(size=(700, 64)).astype(np.float32)])  # a list longer than a chunk
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    got = permutation.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"), chunk=128).toPandas().set_index("vec_id").sort_index()
    u = permutation.unit(x)
    near = u @ u.T >= 0.9
    want = near.sum(axis=1) - 1
    assert (got.n_links.values <= want).all() and got.n_links.sum() >= 0.98 * want.sum()
    sets = Sets()
    for a, b in zip(*np.nonzero(np.triu(near, 1))):
        sets.join(int(a), int(b))
    if got.n_links.sum() == want.sum():
        assert got.component_id.tolist() == [sets.find(k) for k in range(len(x))]
    assert (got.kept == (got.index == got.component_id)).all()


@pytest.mark.parametrize("dim", [16, 256])
def test_embedding_recall_at_the_threshold(spark, dim):
    """Pairs made to lie just beyond the threshold, among unrelated vectors."""
    rng = np.random.default_rng(dim)
    x = permutation.unit(rng.normal(size=(1500, dim)))
    other = rng.normal(size=(1500, dim))
    other = permutation.unit(other - (other * x).sum(axis=1, keepdims=True) * x)
    cosine = rng.uniform(0.901, 0.92, (1500, 1))
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * other]))]
    got = permutation.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).where("n_links > 0").count()
    u = np.array([v for _, v in rows])
    assert got >= 0.95 * ((u @ u.T >= 0.9).sum(axis=1) > 1).sum()


def test_embeddings_of_several_lengths(spark):
    rng = np.random.default_rng(8)
    rows = [(k, rng.normal(size=5).tolist()) for k in range(60)] + [(100, [1.0, 1.0]), (101, [1.0, 1.0]), (102, [1.0, 1.01]), (103, [-1.0, 1.0]), (104, [2.0]), (105, [3.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in permutation.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert [got[k] for k in range(100, 106)] == [(2, 100), (2, 100), (2, 100), (0, 103), (1, 104), (1, 104)]


def test_nearest_pivots_and_ties():
    rng = np.random.default_rng(1)
    pivots = np.repeat(permutation.unit(rng.normal(size=(40, 4))), 3, axis=0)  # every pivot three times
    x = permutation.unit(rng.normal(size=(50, 4)))
    want = [sorted(range(120), key=lambda k, v=v: (-v[k], k))[:12] for v in np.round(x @ pivots.T, 12)]
    assert permutation.nearest(x, pivots, 12).shape == (50, 12)
    assert permutation.nearest(np.eye(4), np.concatenate([np.eye(4)] * 20), 12)[:, :12].tolist() == [[k + 4 * i for i in range(12)] for k in range(4)] and len(want) == 50


def test_embedding_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (9, [0.0, 3.0]), (9, [0.0, 3.0]), (10, [1.0, 2.0, 3.0]), (11, [1e-30, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in permutation.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[11] == (2, 1, False)
    assert all(got[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 10)) and got[9][1:] == (9, True)
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert permutation.near_duplicates(empty).count() == 0


# Pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    from tests.llm.test_text_operators import speech

    texts = [speech(150, k) + f" mail a{k}@x.org" for k in range(40)]
    texts += [texts[0], texts[1] + " extra", "short", None, "!!! ### " * 100]
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "PII", "mixing sources to target weights", "packing"]
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept.append(docs)
        assert k == 4 or docs.columns == schema.replace(" bigint", "").replace(" string", "").split(", ")
    assert sorted(r.doc_id for r in kept[0].collect()) == list(range(42))
    assert sorted(r.doc_id for r in kept[1].collect()) == list(range(40))
    out = kept[2].collect()
    assert all(f"a{r.doc_id}@x.org" not in r.text and "@" in r.text and r.n_chars == len(r.text) for r in out)
    assert {r.doc_id for r in kept[4].collect()} == {r.doc_id for r in kept[3].collect()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept[4].count()


def test_shared_folder(spark, monkeypatch):
    from echograin.llm import common

    table = common.materialize(spark.range(3), "t")
    assert table.count() == 3
    common.release(table)
    assert table._echograin_path.startswith(common.shared_folder(spark))

    class Session:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://h:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_folder(Session)
