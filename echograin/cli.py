"""Command line: scan, index, search and watch."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .config import BLIND_MODES, GRANULARITIES, ScanOptions, SearchOptions, WalkOptions
from .operators import search
from .plans import report
from .plans.scan import index, scan


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="echograin", description="Duplicate detection and similarity search on Spark")
    verbs = top.add_subparsers(dest="verb", required=True)

    def common(p: argparse.ArgumentParser, defaults: ScanOptions) -> None:
        p.add_argument("--k", type=int, default=defaults.k)
        p.add_argument("--window", type=int, default=defaults.window)
        p.add_argument("--blind", choices=BLIND_MODES, default=defaults.blind)
        p.add_argument("--granularity", choices=GRANULARITIES, default=defaults.granularity)
        p.add_argument("--lang", dest="only_lang")
        p.add_argument("--exclude", action="append", default=[])
        p.add_argument("--no-default-excludes", action="store_true")
        p.add_argument("--no-ignore", action="store_true")

    s = verbs.add_parser("scan")
    s.add_argument("dir")
    common(s, ScanOptions())
    s.add_argument("--min-jaccard", type=float, default=0.5)
    s.add_argument("--use-naive", action="store_true")
    s.add_argument("--min-shared", type=int, default=10)
    s.add_argument("--max-bucket", type=int, default=50)
    s.add_argument("--top", type=int, default=20)
    s.add_argument("--json", action="store_true")
    s.add_argument("--html")
    i = verbs.add_parser("index")
    i.add_argument("dir")
    i.add_argument("--out", required=True)
    common(i, SearchOptions())
    q = verbs.add_parser("search")
    q.add_argument("dir", nargs="?")
    q.add_argument("--index")
    q.add_argument("--snippet", help="a file, or - for standard input")
    q.add_argument("--keywords")
    q.add_argument("--min-jaccard", type=float, default=0.3)
    q.add_argument("--top", type=int, default=10)
    common(q, SearchOptions())
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("echograin").getOrCreate()
    walk = WalkOptions(not args.no_default_excludes, tuple(args.exclude), not args.no_ignore)
    common = {"blind": args.blind, "granularity": args.granularity, "k": args.k, "window": args.window, "only_lang": args.only_lang, "walk": walk}
    if args.verb == "scan":
        options = ScanOptions(**common, use_naive=args.use_naive, min_jaccard=args.min_jaccard, min_shared=args.min_shared, max_bucket=args.max_bucket)
        result = scan(spark, args.dir, options)
        if args.json:
            print(report.json_report(result.findings, result.stats()))
        elif args.html:
            Path(args.html).write_text(report.html_report(result.findings, result.corpus, args.top, result.stats()), encoding="utf-8")
        else:
            print(report.text_report(result.findings, args.top, args.granularity, "naive" if args.use_naive else "lsh"), end="")
        return 0
    options = SearchOptions(**common, **({"min_jaccard": args.min_jaccard, "top": args.top} if args.verb == "search" else {}))
    if args.verb == "index":
        index(spark, args.dir, args.out, options)
        return 0
    if args.index:
        table, saved = search.load_index(spark, args.index)
        options = SearchOptions(blind=saved.blind, granularity=saved.granularity, k=saved.k, window=saved.window, min_jaccard=args.min_jaccard, top=args.top)
    else:
        from .sources.files import corpus

        table = search.build_index(corpus(spark, args.dir, walk, args.only_lang), options)
    if args.snippet:
        snippet = sys.stdin.read() if args.snippet == "-" else Path(args.snippet).read_text(encoding="utf-8")
        found = search.search_snippet(table, snippet, options, args.only_lang)
    elif args.keywords:
        found = search.search_keywords(table, args.keywords, args.top)
    else:
        print("one of --snippet and --keywords is needed", file=sys.stderr)
        return 2
    print(json.dumps([r.asDict(recursive=True) for r in found.orderBy("rank").collect()], indent=2, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
