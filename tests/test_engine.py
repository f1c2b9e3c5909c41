from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from echograin.cli import main
from echograin.config import ScanOptions, SearchOptions, WalkOptions
from echograin.operators import entries as E
from echograin.operators import pairs, search
from echograin.plans import queries, report
from echograin.plans.scan import scan
from echograin.sources import files
from echograin.streaming.incremental import Upkeep, apply_batch, coalesce_changes, expand_renames, interesting

PLANT = """def parse_options(argv):
    options = {}
    position = 0
    while position < len(argv):
        word = argv[position]
        if word.startswith("--"):
            key = word[2:]
            value = argv[position + 1] if position + 1 < len(argv) else None
            options[key] = value
            position = position + 2
        else:
            options.setdefault("rest", []).append(word)
            position = position + 1
    return options
"""
OTHER = """def mean_of(values):
    total = 0
    for v in values:
        total += v
    if not values:
        return 0
    return total / len(values)
"""


def renamed(source: str) -> str:
    for a, b in (("options", "found"), ("position", "at"), ("argv", "words"), ("word", "item"), ("parse_found", "read_args")):
        source = source.replace(a, b)
    return source


@pytest.fixture
def tree(tmp_path):
    write = {
        "a/one.py": PLANT,
        "b/two.py": renamed(PLANT),
        "c/three.py": OTHER,
        "node_modules/x.py": PLANT,
        "sub/build/y.py": PLANT,
        "d/bad.py": b"\xff\xfe\x00",
        "d/readme.md": "# text\n",
        "d/none.zzz": "x",
        ".hidden/z.py": PLANT,
        "gen/skip.py": PLANT,
    }
    for name, body in write.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body if isinstance(body, bytes) else body.encode())
    return tmp_path


def test_walk(spark, tree):
    paths = lambda o: sorted(r.path for r in files.files(spark, str(tree), o).collect())
    assert paths(WalkOptions(excludes=("gen/",))) == ["a/one.py", "b/two.py", "c/three.py", "d/bad.py", "d/readme.md"]
    assert "sub/build/y.py" in paths(WalkOptions(use_default_excludes=False))
    assert ".hidden/z.py" in paths(WalkOptions(respect_ignore_files=False))
    (tree / ".ignore").write_text("gen/\n*.md\n!d/readme.md\n")
    assert paths(WalkOptions()) == ["a/one.py", "b/two.py", "c/three.py", "d/bad.py", "d/readme.md"]
    (tree / ".gitignore").write_text("a/\n")
    assert "a/one.py" in paths(WalkOptions())  # counts inside a git tree only
    (tree / ".git").mkdir()
    (tree / ".git" / "HEAD").write_text("x")
    assert "a/one.py" not in paths(WalkOptions())
    assert sorted(r.path for r in files.corpus(spark, str(tree)).collect()) == ["b/two.py", "c/three.py", "d/readme.md"]
    assert sorted(r.path for r in files.directories(spark, str(tree), WalkOptions(excludes=("gen/",))).collect()) == ["b", "c", "d"]


@pytest.mark.parametrize(("pattern", "hit", "miss"), [("*.py", "a/b.py", "a/b.pyc"), ("/x", "x", "a/x"), ("a/**/b", "a/q/r/b", "ab"), ("d/", "d/e", "d"), ("[ab].c", "a.c", "c.c"), ("q?", "qa", "q/")])
def test_globs(spark, pattern, hit, miss):
    import re

    regex = files.glob_regex(pattern)
    assert re.search(regex, hit) and not re.search(regex, miss)


def test_bad_globs():
    assert files.glob_regex("  ") is None and files.glob_regex("[a") is None and files.glob_regex("# x") is None


def test_scan_finds_renamed_copies_only_when_blinded(spark, tree):
    walk = WalkOptions(excludes=("gen/",))
    best = scan(spark, str(tree), ScanOptions(blind="aggressive", min_jaccard=0.3, walk=walk)).findings.orderBy(*pairs.order()).collect()
    assert {best[0].a.path, best[0].b.path} == {"a/one.py", "b/two.py"} and best[0].exact_jaccard > 0.9
    assert "cross-module" in best[0].tags
    assert scan(spark, str(tree), ScanOptions(min_jaccard=0.3, walk=walk)).findings.count() == 0


def test_function_mode_and_naive(spark, tree):
    walk = WalkOptions(excludes=("gen/",))
    options = ScanOptions(blind="aggressive", granularity="function", min_jaccard=0.5, walk=walk)
    row = scan(spark, str(tree), options).findings.first()
    assert {row.a.fn_name, row.b.fn_name} == {"parse_options", "read_args"} and row.a.line_start == 1
    naive = scan(spark, str(tree), ScanOptions(blind="aggressive", use_naive=True, min_shared=1, walk=walk))
    assert naive.findings.count() >= 1
    assert naive.stats()["files_walked"] == 5


def test_naive_caps_buckets(spark):
    rows = [(k, f"p{k}", "Text", None, None, None, 3, [1, 2, 10 + k]) for k in range(4)]
    e = spark.createDataFrame(rows, "entry_id bigint, path string, lang string, fn_name string, line_start int, line_end int, unique_fps bigint, fps array<bigint>")
    assert pairs.naive_pairs(e, 50, 1).count() == 6
    assert pairs.naive_pairs(e, 3, 1).count() == 0
    assert [tuple(r) for r in pairs.bucket_histogram(pairs.fps(e)).collect()] == [(4, 2), (1, 4)]


def test_search(spark, tree, tmp_path):
    index = search.build_index(files.corpus(spark, str(tree), WalkOptions(excludes=("gen/",))))
    search.save_index(index, str(tmp_path / "index"))
    loaded, options = search.load_index(spark, str(tmp_path / "index"))
    assert (options.blind, options.granularity) == ("aggressive", "function")
    top = search.search_snippet(loaded, renamed(PLANT), SearchOptions(min_jaccard=0.3)).orderBy("rank").first()
    assert top.jaccard == 1.0
    assert search.search_snippet(loaded, "def f(x):\n    return lambda y: [z ** 2 for z in y if z] or {x: y for x in y}\n", SearchOptions(min_jaccard=0.3)).count() == 0
    words = search.search_keywords(loaded, "mean values").orderBy("rank").collect()
    assert words[0].fn_name == "mean_of" and words[0].rank == 1
    twice = search.search_keywords(loaded, "values values").first().score
    assert abs(twice - 2 * search.search_keywords(loaded, "values").first().score) < 1e-9


def _changes(spark, rows):
    return spark.createDataFrame([(p, v, op, c, "Python") for p, v, op, c in rows], "path string, version bigint, op string, content string, lang string")


def test_incremental_equals_rebuild(spark):
    options = ScanOptions(blind="aggressive")
    start = _changes(spark, [("a.py", 1, "create", PLANT), ("b.py", 1, "create", renamed(PLANT)), ("c.py", 1, "create", OTHER)])
    empty = spark.createDataFrame([], E.ENTRY_DDL)
    state, found, feed = apply_batch(empty, pairs.scan_entries(empty), start, options)
    assert [r.op for r in feed.collect()] == ["added"]
    state, found = state.cache(), found.cache()
    again = _changes(spark, [("d.py", 2, "create", PLANT), ("b.py", 2, "modify", OTHER), ("b.py", 3, "remove", None), ("node_modules/q.py", 2, "create", PLANT)])
    new_state, new_found, feed = apply_batch(state, found, again, options)
    assert sorted((r.op, r.finding.a.path, r.finding.b.path) for r in feed.collect())[0][0] == "added"
    assert sorted(r.op for r in feed.collect()) == ["added", "removed"]
    rebuilt = pairs.scan_entries(new_state, options)
    key = lambda df: sorted((*sorted((r.a.path, r.b.path)), r.shared) for r in df.collect())
    assert key(rebuilt) == key(new_found)


@pytest.mark.parametrize("few", [0, 400_000])
def test_feed_needs_touched_findings_only(spark, monkeypatch, few):
    """The feed by the findings that a batch can change is that of two whole scans; entries with their sets are picked by
    broadcast keys where those are few (before, all were shuffled by path and for each side of the pairs)."""
    from echograin.streaming.incremental import diff_findings, touched_findings

    monkeypatch.setattr(pairs, "FEW_KEYS", few)
    options = ScanOptions(blind="aggressive")
    content = [PLANT, renamed(PLANT), OTHER, PLANT + OTHER]
    empty = spark.createDataFrame([], E.ENTRY_DDL)
    state = apply_batch(empty, pairs.scan_entries(empty), _changes(spark, [(f"f{k}.py", 1, "create", content[k % 4]) for k in range(12)]), options)[0].cache()
    batch = _changes(spark, [("f1.py", 2, "remove", None), ("f2.py", 2, "modify", PLANT), ("f3.py", 2, "modify", PLANT + OTHER), ("n.py", 2, "create", PLANT), ("f5.py", 2, "access", PLANT)])
    after, _, feed = apply_batch(state, touched_findings(state, batch, options), batch, options)
    whole = diff_findings(pairs.scan_entries(state, options), pairs.scan_entries(after, options))
    key = lambda df: sorted((r.op, *sorted((r.finding.a.path, r.finding.b.path)), r.finding.shared) for r in df.collect())
    assert key(feed) == key(whole) and {r.op for r in feed.collect()} >= {"added", "removed"}
    picks = [x for x in feed._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftSemi" in x or "Join LeftAnti" in x]
    assert picks and all(("strategy=broadcast" in x) == (few > 0) for x in picks)


def test_stream_upkeep(spark, tmp_path):
    changes, folder = tmp_path / "changes", tmp_path / "state"
    changes.mkdir()
    write = lambda n, rows: (changes / f"{n}.json").write_text("".join(json.dumps(dict(zip(("path", "version", "op", "content", "lang"), r))) + "\n" for r in rows))
    up = Upkeep(spark, f"file://{folder}", ScanOptions(blind="aggressive"))
    from echograin.streaming.incremental import change_stream

    run = lambda: up.start(change_stream(spark, f"file://{changes}"), f"file://{tmp_path}/ck", available_now=True).awaitTermination(120)
    write(1, [("a.py", 1, "create", PLANT, "Python"), ("b.py", 1, "create", renamed(PLANT), "Python")])
    run()
    assert up.findings().count() == 1
    write(2, [("b.py", 2, "remove", None, "Python")])
    run()
    assert up.findings().count() == 0 and up.state().count() == 1
    up.apply(_changes(spark, [("z.py", 9, "create", PLANT)]), 0)  # an old batch changes nothing
    assert up.state().count() == 1
    generation = up._pointer()[0]
    up.apply(_changes(spark, [("a.py", 10, "modify", PLANT)]), 50)  # the same content again
    assert up._pointer() == (generation, 50) and up.hashes().count() == 1
    renamed_ = spark.createDataFrame([("a.py", "n.py", 11, "rename", PLANT, "Python")], "path string, new_path string, version bigint, op string, content string, lang string")
    up.apply(renamed_, 51)
    assert [r.path for r in up.state().collect()] == ["n.py"] and [r.path for r in up.hashes().collect()] == ["n.py"]
    up.apply(_changes(spark, [("m.py", 12, "create", renamed(PLANT))]), 52)
    assert up.findings().count() == 1
    held = sorted(x.name for x in (folder / "entries").iterdir())
    assert held == [f"generation={up._pointer()[0] - k}" for k in (1, 0)]


@pytest.mark.parametrize("least", [0.1, 0.3, 0.5, 1.0])
def test_many_queries_find_what_brute_force_finds(spark, least):
    sets = [sorted({(7 * k) % 11, *range(k % 5, k % 5 + 1 + k % 13), 100 + k % 3}) for k in range(120)]
    rows = [(k, f"p{k % 50}", "Text", None, None, None, len(x), x, [1] * 128, None) for k, x in enumerate(sets)]
    index = spark.createDataFrame(rows, E.ENTRY_DDL).cache()
    query = index.where("entry_id % 7 = 0")
    plain, fast = (search.rank_matches(index, query, least, 200, many=m) for m in (False, True))
    key = lambda df: sorted((r.query_id, r["rank"], r.entry_id, r.score) for r in df.collect())
    assert key(fast) == key(plain) and fast.count() >= query.count()


def test_registered_brute_force_is_no_product_of_queries_and_entries(spark):
    plan = queries.QUERIES["snippet_bruteforce"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join " in x]
    assert joins and all("=" in x for x in joins)


def test_change_log_helpers(spark):
    e = spark.createDataFrame([("a", "b", "rename", 1), ("c", None, "modify", 2), ("d", None, "access", 3)], "path string, new_path string, op string, version bigint")
    out = expand_renames(e)
    assert sorted((r.path, r.op) for r in out.collect()) == [("a", "remove"), ("b", "create"), ("c", "modify"), ("d", "access")]
    assert interesting(out).count() == 3
    c = _changes(spark, [("a", 1, "create", "x"), ("a", 3, "modify", "z"), ("a", 2, "modify", "y")])
    assert coalesce_changes(c).first().content == "z"


def test_reports(spark, tree, capsys):
    walk = WalkOptions(excludes=("gen/",))
    result = scan(spark, str(tree), ScanOptions(blind="aggressive", granularity="function", walk=walk))
    page = report.html_report(result.findings, result.corpus, 5, {"files": 3})
    assert "<pre>    1  def parse_options" in page and "&quot;--&quot;" in page
    d = report.diagnostics(report.tiered(result.findings)).orderBy("path").collect()
    assert [r.path for r in d] == ["a/one.py", "b/two.py"] and d[0].start == 0 and d[0].severity == "warning" and d[0].message.startswith("Possible clone of b/two.py:1::read_args (j=")
    assert report.tiered(result.findings, 0, "warning", "off").count() == 0
    assert main(["scan", str(tree), "--blind", "aggressive", "--json", "--exclude", "gen/"], spark) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["findings"][0]["rank"] == 1 and "fn_name" not in out["findings"][0]["a"]
    assert main(["scan", str(tree), "--blind", "aggressive", "--exclude", "gen/"], spark) == 0
    assert "  1. score=" in capsys.readouterr().out
    assert report.text_report(result.findings.limit(0)) == "No candidate duplicates.\n"


def test_sql_functions(spark):
    search.register(spark)
    assert spark.sql("SELECT size(tokenize('a = 1', 'C')) n, slice_functions('def f():\n    pass\n', 'Python')[0].name f").first().asDict() == {"n": 3, "f": "f"}


def test_nulls_and_empty(spark):
    rows = spark.createDataFrame([(1, "a.txt", "Text", None), (2, None, "Text", ""), (3, "c", None, "x y z a b c d e f g h")], "entry_id bigint, path string, lang string, content string")
    assert E.entries(rows).count() == 0
    assert pairs.scan_entries(E.entries(rows.limit(0))).count() == 0
    assert E.token_rows(rows).count() == 0
    assert E.line_counts(rows).agg(F.sum("code")).first()[0] == 0
