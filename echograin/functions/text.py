"""Column expressions on strings, paths and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of directories (and files) that a walk leaves out, at any depth.
DEFAULT_EXCLUDES = (
    ".git .svn .hg node_modules bower_components .next .nuxt target dist build out bin obj coverage vendor .venv venv"
    " __pycache__ .tox .pytest_cache .mypy_cache .ruff_cache .idea .vscode"
).split()
# Function names that say nothing of what the function does.
GENERIC_NAMES = (
    "init __init__ new setup set_up teardown tear_down main run handle start stop close open read write get set build create"
    " destroy reset clear default from into as_ref as_mut to_string fmt drop clone eq hash deserialize serialize tostring equals hashcode"
).split()


def md5_60(x: Column) -> Column:
    """The first 60 bits of the md5, as a number of 0 or more; any SQL engine has the same."""
    return F.conv(F.substring(F.md5(x.cast("binary")), 1, 15), 16, 10).cast("bigint")


def components(path: Column) -> Column:
    return F.split(path, "/")


def is_excluded(path: Column, names: list[str] = DEFAULT_EXCLUDES) -> Column:
    return F.arrays_overlap(components(path), F.array(*map(F.lit, names)))


def is_hidden(path: Column) -> Column:
    return F.exists(components(path), lambda p: p.startswith(".") & (F.length(p) > 1) & (p != ".."))


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; null without one (a leading dot is none)."""
    name = F.element_at(components(path), -1)
    found = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]+$"), found)


def strip_root(path: Column, root: str | None) -> Column:
    if not root:
        return path
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 20)).otherwise(path)


def is_test_path(path: Column) -> Column:
    part = r"tests?|__tests__|specs?|test_[^/]*|[^/]*_test(?:\.(?:py|go|rs))?|[^/]*\.test\.(?:js|ts)|[^/]*\.spec\.(?:js|ts)"
    return F.lower(path).rlike(rf"(?:^|/)(?:{part})(?:/|$)")


def top_module(path: Column) -> Column:
    """First component that is a name; null for an empty path."""
    names = F.filter(components(path), lambda p: ~p.isin("", ".", ".."))
    return F.try_element_at(names, F.lit(1))


def is_generic_name(name: Column) -> Column:
    return F.coalesce(F.lower(name).isin(GENERIC_NAMES), F.lit(False))


def split_identifier(name: Column) -> Column:
    """Lower-case parts of a camel, snake or kebab identifier, those of one byte left out."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(spaced, "[_-]", " ")), " "), lambda p: F.octet_length(p) > 1)


def guess_language(snippet: Column) -> Column:
    low = F.lower(snippet)
    has = lambda x: low.contains(x)
    return (
        F.when(has("def ") & has(":"), "Python")
        .when(has("fn ") & has("->"), "Rust")
        .when(has("func "), "Go")
        .when(has("function ") | has("=>") | has("const "), "JavaScript")
        .when(has("public ") | has("private "), "Java")
        .otherwise("Python")
    )


def literate_counts(content: Column) -> Column:
    """Comment and blank lines of a literate text in SQL: fence parity by a running count over its lines."""
    body = F.regexp_replace(content, "\n\\z", "")
    lines = F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, "^[ \t\f\r]+|[ \t\f\r]+$", ""))
    start = F.struct(F.lit(0).alias("fence"), F.lit(0).cast("bigint").alias("comment"), F.lit(0).cast("bigint").alias("blank"))

    def step(s: Column, x: Column) -> Column:
        mark = x.startswith("```") | x.startswith("~~~")
        tagged = F.length(F.regexp_replace(F.substring(x, 4, 1 << 20), "[ \t\f\r]", "")) > 0
        empty = x == ""
        fence = F.when(empty | ~mark, s["fence"]).when(s["fence"] > 0, 0).when(tagged, 2).otherwise(1)
        counted = ~empty & (mark | (s["fence"] != 2))
        return F.struct(fence.cast("int").alias("fence"), (s["comment"] + counted.cast("bigint")).alias("comment"), (s["blank"] + empty.cast("bigint")).alias("blank"))

    return F.when(F.length(content) == 0, start).otherwise(F.aggregate(lines, start, step))
