"""The same operators as ANSI SQL: common table expressions that the oracle queries are put together from."""

from __future__ import annotations

from ..functions.text import DEFAULT_EXCLUDES, GENERIC_NAMES
from ..operators.entries import P, parameters


def _names(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def tokens(mode: str = "mild") -> str:
    keep_ident = "tok" if mode != "aggressive" else "''"
    keep_number = "tok" if mode == "strict" else "''"
    return rf"""
ascii_text AS (SELECT doc_id, source, regexp_replace(regexp_replace(regexp_replace(text, '[\x{{10000}}-\x{{10FFFF}}]', repeat(chr(1), 4), 'g'), '[\x{{800}}-\x{{FFFF}}]', repeat(chr(1), 3), 'g'), '[\x{{80}}-\x{{7FF}}]', repeat(chr(1), 2), 'g') AS t FROM documents),
token_lists AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9_]+|[^ \t\n\f\r]') AS a FROM ascii_text),
toks AS (SELECT doc_id, unnest(a) AS tok, generate_subscripts(a, 1) - 1 AS pos FROM token_lists),
kinds AS (SELECT *, CASE WHEN regexp_matches(tok, '^[0-9]') THEN 'n' WHEN regexp_matches(tok, '^[A-Za-z_]') THEN 'i' ELSE 'p' END AS kind FROM toks),
keys AS (SELECT doc_id, pos, kind, tok, kind || CASE WHEN tok = chr(1) THEN '' WHEN kind = 'p' THEN tok WHEN kind = 'i' THEN {keep_ident} ELSE {keep_number} END AS key FROM kinds)"""


GRAMS = """
runs AS (SELECT doc_id, pos, key || ' ' || lead(key, 1) OVER w || ' ' || lead(key, 2) OVER w || ' ' || lead(key, 3) OVER w || ' ' || lead(key, 4) OVER w AS g FROM keys WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
grams AS (SELECT doc_id, pos, ('0x' || substr(md5(g), 1, 15))::BIGINT AS h FROM runs WHERE g IS NOT NULL)"""
WINNOW = """
framed AS (SELECT doc_id, lead(h, 3) OVER w AS full_, min(h::HUGEINT * 1048576 + (1048575 - pos)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS v FROM grams WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
winnowed AS (SELECT DISTINCT doc_id AS entry_id, (1048575 - v % 1048576)::INT AS pos, (v // 1048576)::BIGINT AS hash FROM framed WHERE full_ IS NOT NULL),
fps AS (SELECT DISTINCT entry_id, hash FROM winnowed),
ent AS (SELECT f.entry_id, d.source || '/' || d.doc_id || '.txt' AS path, d.source, f.n AS unique_fps FROM (SELECT entry_id, count(*) AS n FROM fps GROUP BY 1) f JOIN documents d ON d.doc_id = f.entry_id)"""
BASE = "WITH " + ",".join((tokens(), GRAMS, WINNOW))


def sketches() -> str:
    a, b = parameters()
    rows = ", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate(zip(a, b, strict=True)))
    return f""",
params(slot, a, b) AS (VALUES {rows}),
slots AS (SELECT entry_id, slot, min((a::BIGINT * (hash % {P}) + b) % {P})::BIGINT AS v FROM fps, params GROUP BY 1, 2),
banded AS (SELECT entry_id, (slot // 4)::INT AS band, md5((slot // 4) || ',' || string_agg(v::VARCHAR, ',' ORDER BY slot)) AS key FROM slots GROUP BY entry_id, slot // 4),
cand AS (SELECT DISTINCT x.entry_id AS a, y.entry_id AS b FROM banded x JOIN banded y ON x.band = y.band AND x.key = y.key AND x.entry_id < y.entry_id),
est AS (SELECT c.a, c.b, sum((x.v = y.v)::INT) / 128.0 AS estimated FROM cand c JOIN slots x ON x.entry_id = c.a JOIN slots y ON y.entry_id = c.b AND y.slot = x.slot GROUP BY 1, 2),
near AS (SELECT * FROM est WHERE estimated >= 0.5),
inter AS (SELECT n.a, n.b, count(*) AS shared FROM near n JOIN fps x ON x.entry_id = n.a JOIN fps y ON y.entry_id = n.b AND y.hash = x.hash GROUP BY 1, 2),
verified AS (SELECT n.a, n.b, n.estimated, coalesce(i.shared, 0)::BIGINT AS shared, (x.unique_fps + y.unique_fps - coalesce(i.shared, 0))::BIGINT AS union_size, coalesce(i.shared, 0)::DOUBLE / (x.unique_fps + y.unique_fps - coalesce(i.shared, 0)) AS exact FROM near n LEFT JOIN inter i USING (a, b) JOIN ent x ON x.entry_id = n.a JOIN ent y ON y.entry_id = n.b),
hits AS (SELECT * FROM verified WHERE exact >= 0.5)"""


NAIVE = """,
ok AS (SELECT hash FROM fps GROUP BY hash HAVING count(*) BETWEEN 2 AND 50),
shared_pairs AS (SELECT x.entry_id AS a, y.entry_id AS b, count(*) AS shared FROM fps x JOIN ok USING (hash) JOIN fps y ON y.hash = x.hash AND x.entry_id < y.entry_id GROUP BY 1, 2 HAVING count(*) >= 10),
naive AS (SELECT p.a, p.b, p.shared, x.unique_fps AS a_total, y.unique_fps AS b_total, p.shared::DOUBLE / (x.unique_fps + y.unique_fps - p.shared) AS jaccard FROM shared_pairs p JOIN ent x ON x.entry_id = p.a JOIN ent y ON y.entry_id = p.b)"""


def is_test(path: str) -> str:
    return rf"regexp_matches(lower({path}), '(^|/)(tests?|__tests__|specs?|test_[^/]*|[^/]*_test(\.(py|go|rs))?|[^/]*\.test\.(js|ts)|[^/]*\.spec\.(js|ts))(/|$)')"


def is_generic(name: str) -> str:
    return f"coalesce(lower({name}) IN ({_names(GENERIC_NAMES)}), false)"


def findings(pairs: str, exact: str = "exact", estimated: str = "estimated") -> str:
    """Files of the documents table: none is a test path and none has a function name."""
    return f""",
found AS (
  SELECT p.a, p.b, x.path AS a_path, y.path AS b_path, p.{exact} AS exact_jaccard, p.{estimated} AS estimated_jaccard, p.shared,
         x.unique_fps < 15 AND y.unique_fps < 15 AS tiny, x.source <> y.source AS cross_,
         x.unique_fps <> y.unique_fps AND 20 * p.shared > 19 * least(x.unique_fps, y.unique_fps) AS subset_
  FROM {pairs} p JOIN ent x ON x.entry_id = p.a JOIN ent y ON y.entry_id = p.b),
scored AS (
  SELECT *, concat_ws(',', CASE WHEN tiny THEN 'tiny' END, CASE WHEN cross_ THEN 'cross-module' END, CASE WHEN subset_ THEN 'subset' END) AS tags,
         CASE WHEN cross_ THEN least(1.0, (exact_jaccard * CASE WHEN tiny THEN 0.5 ELSE 1.0 END) * 1.4) ELSE exact_jaccard * CASE WHEN tiny THEN 0.5 ELSE 1.0 END END AS score
  FROM found)"""


def excluded(path: str) -> str:
    return f"list_has_any(string_split({path}, '/'), [{_names(DEFAULT_EXCLUDES)}])"
