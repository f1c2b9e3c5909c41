"""Emitters: text, JSON, HTML and editor diagnostics from findings."""

from __future__ import annotations

import html as escapes

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.pairs import order, top

WHOLE_FILE_LINES = 30


def label(end: str) -> Column:
    """path, or path:first-last::name for a function."""
    name = F.coalesce(F.col(f"{end}.fn_name"), F.lit("<anonymous>"))
    ranged = F.concat(F.col(f"{end}.path"), F.lit(":"), F.col(f"{end}.line_start").cast("string"), F.lit("-"), F.col(f"{end}.line_end").cast("string"), F.lit("::"), name)
    return F.when(F.col(f"{end}.line_start").isNull(), F.col(f"{end}.path")).otherwise(ranged)


def tag_list() -> Column:
    return F.when(F.size("tags") > 0, F.concat(F.lit(" ["), F.array_join("tags", ","), F.lit("]"))).otherwise("")


def text_lines(findings: DataFrame, n: int = 20) -> DataFrame:
    """rank, line: the best ``n`` findings as three lines each."""
    lang = F.when(F.col("a.lang") == F.col("b.lang"), F.col("a.lang")).otherwise(F.concat("a.lang", F.lit("↔"), "b.lang"))
    head = F.format_string("  %3d. score=%.3f j=%.3f shared=%4d (%d/%d) [%s]%s", "rank", "score", "exact_jaccard", "shared", "a.unique_fps", "b.unique_fps", lang, tag_list())
    return top(findings, n).select("rank", F.concat_ws("\n", head, F.concat(F.lit("       a: "), label("a")), F.concat(F.lit("       b: "), label("b"))).alias("line"))


def text_report(findings: DataFrame, n: int = 20, granularity: str = "file", backend: str = "lsh") -> str:
    total = findings.count()
    if not total:
        return "No candidate duplicates.\n"
    lines = [r.line for r in text_lines(findings, n).orderBy("rank").collect()]
    return f"Top {len(lines)} finding(s) of {total} (score ↓, granularity={granularity}, backend={backend}):\n" + "\n".join(lines) + "\n"


def _six(c: str) -> Column:
    return F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")) | F.col(c).isNull(), F.lit(0.0)).otherwise(F.round(c, 6)).alias(c)


def endpoint(end: str) -> Column:
    """Endpoint for JSON; the function's fields are left out for a whole file."""
    f = lambda c: F.col(f"{end}.{c}").alias(c)
    name = F.when(F.col(f"{end}.line_start").isNotNull(), F.coalesce(F.col(f"{end}.fn_name"), F.lit(""))).alias("fn_name")
    return F.struct(f("path"), f("lang"), f("unique_fps"), name, f("line_start"), f("line_end")).alias(end)


def finding_json(findings: DataFrame, rank: Column) -> DataFrame:
    body = F.struct(rank.alias("rank"), *map(_six, ("score", "exact_jaccard", "estimated_jaccard")), "shared", "tags", endpoint("a"), endpoint("b"))
    return findings.select(rank.alias("rank"), F.to_json(body).alias("json"))


def json_lines(findings: DataFrame) -> DataFrame:
    """rank, json of all findings (a top-N does not apply to JSON). The rank needs their global order."""
    return finding_json(findings, F.row_number().over(Window.orderBy(*order())))


def json_report(findings: DataFrame, stats: dict) -> str:
    import json

    rows = [json.loads(r.json) for r in json_lines(findings).orderBy("rank").toLocalIterator()]
    return json.dumps({**stats, "findings": rows}, ensure_ascii=False)


def snippets(findings: DataFrame, corpus: DataFrame) -> DataFrame:
    """Findings with a_code and b_code: the lines of each endpoint, thirty of a whole file. Contents join once a side."""
    def code(end: str) -> Column:
        first = F.coalesce(F.col(f"{end}.line_start"), F.lit(1))
        last = F.coalesce(F.col(f"{end}.line_end"), F.lit(WHOLE_FILE_LINES))
        return F.array_join(F.slice(F.split(F.col(f"_{end}"), "\n"), first, last - first + 1), "\n")

    out = findings
    for end in "ab":
        text = corpus.select(F.col("path").alias(f"_{end}_path"), F.col("content").alias(f"_{end}"))
        out = out.join(text, F.col(f"{end}.path") == F.col(f"_{end}_path"), "left").withColumn(f"{end}_code", code(end))
    return out.drop("_a", "_b", "_a_path", "_b_path")


def numbered(code: str | None, first: int | None) -> str:
    return "\n".join(f"{k:>5}  {escapes.escape(line, quote=False).replace(chr(34), '&quot;')}" for k, line in enumerate((code or "").split("\n"), first or 1))


def html_report(findings: DataFrame, corpus: DataFrame, n: int = 20, summary: dict | None = None) -> str:
    """One page with the best ``n`` findings side by side."""
    best = snippets(top(findings, n), corpus).withColumns({"a_label": label("a"), "b_label": label("b")}).orderBy("rank").collect()
    esc = lambda x: escapes.escape(str(x))
    rows = "".join(f"<tr><th>{esc(k)}</th><td>{esc(v)}</td></tr>" for k, v in (summary or {}).items())
    parts = []
    for r in best:
        panes = "".join(f'<div class="pane"><h3>{esc(r[f"{e}_label"])}</h3><pre>{numbered(r[f"{e}_code"], r[e].line_start)}</pre></div>' for e in "ab")
        tags = "".join(f"<span>{esc(t)}</span> " for t in r.tags)
        parts.append(f"<section><h2>{r.rank}. score {r.score:.3f}, Jaccard {r.exact_jaccard:.3f}, {r.shared} shared {tags}</h2><div class='pair'>{panes}</div></section>")
    style = "body{font:14px sans-serif}.pair{display:flex;gap:1em}.pane{flex:1;overflow:auto}pre{background:#f6f6f6}"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Duplicate code</title><style>{style}</style></head><body><table>{rows}</table>{''.join(parts)}</body></html>"


def tiered(findings: DataFrame, highlight_top: int = 20, highlight: str = "warning", tail: str = "hint") -> DataFrame:
    """Findings with rank0 (by score) and severity; ``off`` leaves the tail out."""
    ranked = findings.withColumn("rank0", F.row_number().over(Window.orderBy(*order())) - 1)
    first = F.col("rank0") < highlight_top
    out = ranked.withColumn("severity", F.when(first, highlight).otherwise(tail))
    return out.where(F.col("severity") != "off")


def by_file(findings: DataFrame) -> DataFrame:
    """path and finding for both endpoints, once where they lie in one file."""
    return findings.withColumn("path", F.explode(F.array_distinct(F.array("a.path", "b.path"))))


def diagnostics(tiered_: DataFrame) -> DataFrame:
    """path, range, severity, message, related: one row for each file that a finding touches; whole files have none."""
    this_first = F.col("a.path") == F.col("path")
    row = by_file(tiered_).withColumns({"this": F.when(this_first, F.col("a")).otherwise(F.col("b")), "other": F.when(this_first, F.col("b")).otherwise(F.col("a"))}).where("this.line_start IS NOT NULL")
    name = F.coalesce(F.col("other.fn_name"), F.lit("<anonymous>"))
    where = F.when(F.col("other.line_start").isNull(), F.col("other.path")).otherwise(F.concat_ws("", "other.path", F.lit(":"), F.col("other.line_start").cast("string"), F.lit("::"), name))
    message = F.concat(F.format_string("Possible clone of %s (j=%.2f, score=%.2f)", where, "exact_jaccard", "score"), tag_list())
    related = F.when(F.col("other.line_start").isNotNull(), F.struct(F.col("other.path").alias("path"), (F.col("other.line_start") - 1).alias("start"), F.col("other.line_end").alias("end")))
    return row.select("path", F.greatest(F.col("this.line_start") - 1, F.lit(0)).alias("start"), F.col("this.line_end").alias("end"), "severity", message.alias("message"), related.alias("related"))


def publish_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, diagnostics of files whose list changed; an empty list clears a file that has none left."""
    listed = lambda df, n: df.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "end", "severity", "message", "related"))).alias(n))
    both = listed(old, "before").join(listed(new, "after"), "path", "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    return both.select("path", F.coalesce("after", F.filter("before", lambda x: F.lit(False))).alias("diagnostics"))
