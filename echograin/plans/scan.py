"""Public verbs: scan, index and search."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ScanOptions, SearchOptions
from ..operators import pairs, search
from ..operators.entries import entries
from ..sources.files import corpus, listing


@dataclass
class ScanResult:
    findings: DataFrame
    corpus: DataFrame
    entries: DataFrame
    options: ScanOptions
    root: str
    began: float

    def stats(self) -> dict:
        """Counts of a finished scan."""
        walked = listing(self.findings.sparkSession, self.root, self.options.walk).count()
        naive = self.options.use_naive
        found = pairs.naive_pairs(self.entries, self.options.max_bucket, self.options.min_shared) if naive else pairs.candidates(pairs.bands(self.entries))
        return {"files_walked": walked, "entries_indexed": self.entries.count(), "candidate_pairs": found.count(), "findings": self.findings.count(), "backend": "naive" if naive else "lsh", "elapsed": round(time.time() - self.began, 3)}


def scan(spark: SparkSession, root: str, options: ScanOptions = ScanOptions()) -> ScanResult:
    began = time.time()
    rows = corpus(spark, root, options.walk, options.only_lang)
    found = entries(rows, options).cache()
    return ScanResult(pairs.scan_entries(found, options, root), rows, found, options, root, began)


def index(spark: SparkSession, root: str, out: str, options: SearchOptions = SearchOptions()) -> None:
    search.save_index(search.build_index(corpus(spark, root, options.walk, options.only_lang), options), out, options)


def scan_stats(files_walked: DataFrame, entries_: DataFrame, candidates: DataFrame, findings: DataFrame) -> DataFrame:
    """One row of counts, each a partial aggregate."""
    one = lambda df, n: df.agg(F.count("*").alias(n))
    out = one(files_walked, "files_walked")
    for df, n in ((entries_, "entries_indexed"), (candidates, "candidate_pairs"), (findings, "findings")):
        out = out.join(one(df, n), F.lit(True))
    return out
