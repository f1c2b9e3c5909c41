from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from echograin.config import ScanOptions, check_bands, overlay, parse_severity
from echograin.functions import languages, slicing, text, tokens
from echograin.operators import entries as E


def kinds(source: str, lang: str) -> list[tuple[str, str | None]]:
    return [(t.kind, t.text) for t in tokens.process(source.encode(), lang)[0]]


def counts(source: str, lang: str) -> tuple[int, int, int]:
    return tuple(tokens.process(source.encode(), lang)[1])


@pytest.mark.parametrize(
    ("lang", "source", "want"),
    [
        ("Rust", "// a\nfn f() {\n    1 // x\n}\n\n/* b\n c */\n", (3, 3, 1)),
        ("Rust", "/* a /* b */\n still */ fn g() {}\n", (1, 1, 0)),
        ("C", "/* a /* b */ int x;\n", (1, 0, 0)),
        ("Python", 'x = """a\n\nb"""\n# c\n', (3, 1, 0)),
        ("JavaScript", "let a = `x\n\ny`;\n", (3, 0, 0)),
        ("Markdown", "# t\n\n```rust\nfn a() {}\n```\n```\nplain\n```\n", (0, 6, 1)),
        ("Text", "", (0, 0, 0)),
        ("Text", "a\n \n", (1, 0, 1)),
        ("C", '"open\n', (2, 0, 0)),
        ("C", "x /* open\n", (1, 1, 0)),
        ("Unknown", "x", (0, 0, 0)),
    ],
)
def test_line_counts(lang, source, want):
    assert counts(source, lang) == want


def test_tokens_of_strings_numbers_and_bytes():
    assert kinds("a = 3.14", "C") == [("i", "a"), ("p", "="), ("n", "3"), ("p", "."), ("n", "14")]
    assert kinds('x("a\\"b") // c', "C") == [("i", "x"), ("p", "("), ("s", '"a\\"b"'), ("p", ")")]
    assert kinds("é", "Text") == [("p", None), ("p", None)]
    assert kinds('"never closed', "C") == []
    assert kinds("a /* x */ b", "C") == [("i", "a"), ("i", "b")]


def test_an_escaped_newline_ends_no_line():
    found, lines = tokens.process(b'x = "a\\\nb"\ny\n', "C")
    assert tuple(lines) == (2, 0, 0)
    assert found[-1].line == 2


def test_blinding():
    assert [tokens.blind(k, "t", m) for m in ("strict", "mild", "aggressive") for k in "inp"] == ["t", "t", "t", "t", None, "t", None, None, "t"]


def test_random_text_keeps_offsets():
    rng = random.Random(3)
    for _ in range(300):
        source = "".join(rng.choice("ab1_ \n\"'#/*\\é{}") for _ in range(40)).encode()
        for lang in ("C", "Python", "Rust", "Text"):
            found, lines = tokens.process(source, lang)
            assert all(t.text is None or source[t.start : t.end] == t.text.encode("latin-1") for t in found)
            assert all(a.end <= b.start for a, b in zip(found, found[1:]))
            assert lines.total <= source.count(b"\n") + 1


@pytest.mark.parametrize(
    ("lang", "source", "names"),
    [
        ("Python", "def a():\n    def b():\n        pass\n    return b\n\nclass C:\n    def m(self):\n        '''doc'''\n", ["a", "b", "m"]),
        ("Rust", "pub fn f(x: i32) -> i32 { x }\ntrait T { fn sig(); }\nimpl X { fn g(&self) { if a { } } }", ["f", "g"]),
        ("JavaScript", "function a() { }\nclass K {\n  m(x) { if (x) { } }\n}\nconst c = () => { };", ["a", "m"]),
        ("TypeScript", "function a<T>(x: T): T { return x }\ninterface I { s(): void; }", ["a"]),
        ("Go", "func A() int {\n}\nfunc (r *R) B() {\n}", ["A", "B"]),
        ("Java", "class A {\n  public A() { }\n  int f(String s) throws E { while (true) { } }\n  abstract void g();\n}", ["A", "f"]),
        ("C", "int add(int a) {\n return a;\n}\nint decl(int);\n", ["add"]),
        ("Cpp", "void Foo::bar() const { }\nint g() { return 1; }", ["bar", "g"]),
        ("CSharp", "class P {\n  public P() { }\n  async Task<int> Go(int x) { }\n}", ["P", "Go"]),
        ("Ruby", "class A\n  def hi\n    if x\n    end\n  end\n  def self.yo\n  end\nend\n", ["hi", "yo"]),
        ("Gleam", "pub fn main() {\n  1\n}", ["main"]),
        ("Toml", "a = 1", []),
    ],
)
def test_slicer(lang, source, names):
    assert [g.name for g in slicing.slice_functions(source.encode(), lang)] == names


def test_slicer_ranges():
    found = slicing.slice_functions(b"x = 1\n\ndef f(a):\n    return a\n\ny = 2\n", "Python")
    assert [(g.line_start, g.line_end, g.line_count) for g in found] == [(3, 4, 2)]


def test_winnow_takes_the_rightmost_minimum():
    assert [p for p, _ in E.winnow([5, 5, 5, 5], 3)] == [2, 3]
    assert E.winnow([1, 2], 3) == [] and E.winnow([1, 2], 0) == []
    rng = random.Random(1)
    for _ in range(200):
        h = [rng.randrange(6) for _ in range(rng.randrange(12))]
        want = sorted({max(range(i, i + 4), key=lambda p: (-h[p], p)) for i in range(len(h) - 3)})
        assert [p for p, _ in E.winnow(h, 4)] == want


def test_grams():
    assert len(E.gram_hashes(["a"], 2)) == len(E.gram_hashes(["a"], 0)) == 0
    assert len(E.gram_hashes(list("abcdef"), 5)) == 2


def test_sketch_estimates_jaccard():
    import numpy as np

    a, b = (np.array(x, np.uint64) for x in E.parameters())
    x = np.array([E.hash60(str(k)) for k in range(200)], np.int64)
    y = np.array([E.hash60(str(k)) for k in range(100, 300)], np.int64)
    assert abs((E.sketch(x, a, b) == E.sketch(y, a, b)).mean() - 1 / 3) < 0.1
    assert (E.sketch(np.zeros(0, np.int64), a, b) == E.P).all()


def test_language_table_is_wide():
    assert len(languages.TABLE) > 300 and len(languages.by_key()) == len(languages.TABLE)
    found = {e: languages.resolve(e) for e in ("dart", "zig", "m", "clj", "erl", "ps1", "vue", "scss")}
    assert found == {"dart": "Dart", "zig": "Zig", "m": "ObjectiveC", "clj": "Clojure", "erl": "Erlang", "ps1": "PowerShell", "vue": "Vue", "scss": "Sass"}


def test_languages():
    assert languages.resolve("Python") == "Python" and languages.resolve(".py") == "Python"
    assert languages.resolve("python") is None and languages.by_extension()["rs"].key == "Rust"
    assert languages.by_key()["Json"].trivial and not languages.by_key()["C"].trivial


def test_text_columns(spark):
    rows = spark.createDataFrame([("HTTPServerError", "src/tests/a.py"), ("get_user-nameX", "lib/foo_test.go"), ("ab", ".hidden/x"), ("éa", "a/target"), (None, None)], "name string, path string")
    got = rows.select(text.split_identifier(F.col("name")).alias("p"), text.is_test_path(F.col("path")).alias("t"), text.is_excluded(F.col("path")).alias("x"), text.is_hidden(F.col("path")).alias("h"), text.top_module(F.col("path")).alias("m"), text.extension(F.col("path")).alias("e")).collect()
    assert [r.p for r in got] == [["http", "server", "error"], ["get", "user", "name"], ["ab"], ["éa"], None]
    assert [r.t for r in got] == [True, True, False, False, None]
    assert [r.x for r in got] == [False, False, False, True, None]
    assert [r.h for r in got] == [False, False, True, False, None]
    assert [r.m for r in got] == ["src", "lib", ".hidden", "a", None]
    assert [r.e for r in got] == ["py", "go", None, None, None]


def test_literate_counts_in_sql_agree_with_the_scanner(spark):
    samples = ["", "a", "a\n\n```\nx\n```\n", "```rust\nx\n\n```\nb\n", "~~~ py\nx\n", "\n\n", " \t\nq"]
    rows = spark.createDataFrame(list(enumerate(samples)), "i int, s string").select("i", text.literate_counts(F.col("s")).alias("c")).collect()
    for r in rows:
        assert (r.c.comment, r.c.blank) == counts(samples[r.i], "Markdown")[1:], samples[r.i]


def test_options():
    with pytest.raises(ValueError):
        ScanOptions(blind="x")
    with pytest.raises(ValueError):
        check_bands(16, 4)
    assert parse_severity(" Info ") == "information"
    options, warnings = overlay({"blind": "Aggressive", "tailSeverity": "loud", "highlightTop": 5, "minJaccard": -1, "watchFiles": True})
    assert (options.blind, options.tail_severity, options.highlight_top, options.min_jaccard, options.watch_files) == ("aggressive", "hint", 5, 0.8, True)
    assert len(warnings) == 2


def test_short_ways_for_plain_text_agree_with_the_scanner():
    from echograin.functions.languages import by_key

    plain = by_key()["Text"]
    assert tokens.is_plain(plain)
    for content in (b"", b"\n", b"a b_1 22x 7.5, \xc3\xa9!\n\n \t\n\x0b\nlast", b"x\r\n\r\ny", b" \n", b"z\n"):
        found, lines = tokens.scan(content, plain)
        assert tokens.pairs(content, "Text") == [(t.kind, t.text) for t in found]
        assert tokens.counts(content, "Text") == lines
        for mode in ("strict", "mild", "aggressive"):
            assert tokens.keys(content, "Text", mode) == [tokens.key(t, mode) for t in found]
    assert tokens.keys(b"x", "none", "mild") == tokens.pairs(b"x", "none") == [] and tokens.counts(b"x", "none").total == 0
