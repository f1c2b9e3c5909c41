"""Quality rules by distribution divergence.

Each document's character-class and common-word histograms are held against fixed references of its language with the
Jensen-Shannon distance (the square root of the divergence in base 2, 0 to 1). A sample of n from the reference itself
diverges by about (classes - 1) / (8 n ln 2), so each limit is a floor, which leaves room for style, and a term that
falls with the document's length. Below a minimum length a test passes. References do not depend on the corpus, so junk
cannot become the norm however much of it there is.

One Arrow pass over the texts; nothing is shuffled or broadcast, and a document's verdict depends on it alone.

Defined cases: null or empty text has zero counts and fails the base test; a null language is judged by the listed one
with the nearest words; a language without reference is judged by the base test only; repeated rows and ids and null ids
are judged each for itself; an empty table gives an empty result; columns that the caller has beside id, text and
language are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, utf8

# Frequent words of each language, with their rounded frequencies per thousand words of running text.
COMMON_WORDS = {
    "en": "the of and to in is that for it was on as with by at from this be are a he or an have".split(),
    "fr": "de la le et les des en un une du que qui dans pour par sur au pas est avec".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
PER_MILLE = {
    "en": (70, 36, 29, 26, 21, 10, 11, 9.5, 8.8, 9.8, 6.7, 7.3, 7.3, 5.3, 5.4, 4.4, 5.1, 6.4, 4.4, 23, 9.6, 4.2, 3.7, 3.9),
    "fr": (50, 28, 25, 21, 19, 16, 13, 12, 10, 11, 10, 8, 8, 9, 7, 6, 6, 6, 9, 5),
    "de": (32, 31, 27, 18, 12, 11, 11, 9.5, 9, 9, 8.5, 8, 7, 9.5, 7.5, 7, 8, 9, 7, 5.5, 6.5),
    "es": (60, 37, 29, 27, 25, 24, 20, 16, 13, 11, 10, 11, 9, 9, 8, 8, 7.5, 7, 7, 6.5),
}
# Shares of character classes (as below) per thousand characters; letters beyond ASCII by language.
CLASS_PER_MILLE = {"upper": 25, "digit": 8, "space": 160, "punctuation": 20, "symbol": 1, "control": 1}
BEYOND_ASCII_PER_MILLE = {"en": 1, "fr": 35, "de": 20, "es": 25}
# Characters that count as symbols in the base figures, and sentence punctuation.
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()-"

#: Classes: lower, upper, digit, space, punctuation, symbol, beyond ASCII, control.
N_CLASSES = 8
WIDTH = max(map(len, COMMON_WORDS.values())) + 1

#: Limits of the divergence, floor and term: floor + term / length; the distance's limit is the root of that. A clean
#: sample has about 0.72 (n classes - 1) / 4 as its term; the floors leave room for style and for rounded references.
CHAR_FLOOR, CHAR_TERM = 0.04, 15.0
WORD_FLOOR, WORD_TERM = 0.04, 6.2
MIN_CHARS = 300
MIN_WORDS = 50

_EDGE = bytes(range(0x21, 0x30)) + b":;<=>?@[\\]^_`{|}~"
_SPACE = " \t\n\x0b\x0c\r"


def _classes() -> np.ndarray:
    kind = np.full(256, -1, np.int64)
    kind[0x80:] = 6
    kind[0x80:0xC0] = -1  # continuation bytes belong to the character before
    for c in range(128):
        x = chr(c)
        kind[c] = 0 if x.islower() else 1 if x.isupper() else 2 if x.isdigit() else 3 if x in _SPACE else 4 if x in PUNCTUATION else 7 if c < 32 or c == 127 else 5
    return np.stack([kind == k for k in range(N_CLASSES)]).astype(np.int64)


_CLASSES = _classes()
_RANK = {lang: {w.encode(): k for k, w in enumerate(words)} for lang, words in COMMON_WORDS.items()}


def _references() -> tuple[np.ndarray, np.ndarray]:
    """Character-class and common-word references, a row for each listed language."""
    chars, words = np.zeros((len(COMMON_WORDS), N_CLASSES)), np.zeros((len(COMMON_WORDS), WIDTH))
    for k, lang in enumerate(COMMON_WORDS):
        c = CLASS_PER_MILLE
        chars[k, 1:] = c["upper"], c["digit"], c["space"], c["punctuation"], c["symbol"], BEYOND_ASCII_PER_MILLE[lang], c["control"]
        chars[k, 0] = 1000 - chars[k].sum()
        words[k, : len(PER_MILLE[lang])] = PER_MILLE[lang]
        words[k, -1] = 1000 - words[k].sum()
    return chars / 1000, words / 1000


_LANGUAGES = {lang: k for k, lang in enumerate(COMMON_WORDS)}
_CHAR_REFERENCES, _WORD_REFERENCES = _references()


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    code = np.fromiter([seen.setdefault(w, len(seen)) for w in words], np.int64, len(words))
    pair = np.unique(code[:-1] * len(seen) + code[1:], return_inverse=True)[1]
    _, inverse, count = np.unique(pair[:-1] * len(seen) + code[2:], return_inverse=True, return_counts=True)
    again = count[inverse] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def measure(text: bytes, lang: str | None) -> tuple:
    """Base figures, character-class histogram and common-word histogram for each listed language that may judge."""
    words = text.split()
    spaces = sum(text.count(x) for x in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    bins = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = [x for x in text.split(b"\n") if x.strip()]
    common = {}
    if lang is None or lang in _RANK:
        # Counted once for each distinct word: the frequent ones of a language are few.
        counts = Counter(w.strip(_EDGE) for w in text.lower().split())
        for name in COMMON_WORDS if lang is None else (lang,):
            hist = np.zeros(WIDTH, np.int64)
            for w, k in _RANK[name].items():
                hist[k] = counts.get(w, 0)
            hist[-1] = len(words) - hist.sum()
            common[name] = hist
    return (
        len(words),
        int(bins[:0x80].sum() + bins[0xC0:].sum()) - spaces,
        int(sum(bins[ord(c)] for c in SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        _CLASSES @ bins,
        common,
    )


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts from the same row of ``reference`` (shares); 0 for an empty row."""
    total = counts.sum(axis=1, keepdims=True)
    p, q = counts / np.maximum(total, 1), reference
    m = (p + q) / 2

    def half(x: np.ndarray) -> np.ndarray:
        some = x > 0
        return np.where(some, x * np.log2(np.where(some, x, 1) / np.where(some, m, 1)), 0).sum(axis=1)

    return np.where(total[:, 0] > 0, np.sqrt(np.maximum((half(p) + half(q)) / 2, 0)), 0.0)


def judge(texts: list[bytes], langs: list[str | None]) -> dict[str, np.ndarray]:
    """Base figures, distances and verdicts of some texts."""
    found = [measure(t, g) for t, g in zip(texts, langs, strict=True)]
    base = np.array([x[:5] for x in found], np.int64).reshape(-1, 5)
    row = np.array([k for k, x in enumerate(found) for _ in x[6]], np.int64)
    of = np.array([_LANGUAGES[g] for x in found for g in x[6]], np.int64)
    word_hist = np.array([h for x in found for h in x[6].values()], np.int64).reshape(-1, WIDTH)
    by_words = distance(word_hist, _WORD_REFERENCES[of])
    # Of several languages that may judge, the one with the nearest words does.
    word_distance, lang = np.zeros(len(found)), np.full(len(found), -1)
    for k in np.lexsort((of, by_words))[::-1].tolist():
        word_distance[row[k]], lang[row[k]] = by_words[k], of[k]
    listed = lang >= 0
    char_hist = np.array([x[5] for x in found], np.int64).reshape(-1, N_CLASSES)
    char_distance = np.where(listed, distance(char_hist, _CHAR_REFERENCES[lang]), 0.0)
    n_chars, n_words, repeated = char_hist.sum(axis=1), base[:, 0], base[:, 4]
    base_failed = (n_words < 50) | (100 * repeated > 50 * n_words)
    over = lambda d, floor, term, n, least: listed & (n >= least) & (d > np.sqrt(floor + term / np.maximum(n, 1)))
    strange = over(char_distance, CHAR_FLOOR, CHAR_TERM, n_chars, MIN_CHARS) | over(word_distance, WORD_FLOOR, WORD_TERM, n_words, MIN_WORDS)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return {**dict(zip(names, base.T)), "base_failed": base_failed, "kept": ~base_failed & ~strange, "char_distance": char_distance, "word_distance": word_distance}


_SCHEMA = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("char_distance", pa.float64()), ("word_distance", pa.float64())])
_DDL = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, char_distance double, word_distance double"


def _judge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text"):
        found = judge(utf8(batch.column(1)), batch.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[f.name], f.type) for f in list(_SCHEMA)[1:])], schema=_SCHEMA)


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row for each row of ``docs``: base figures, distances from the language's references and the verdict."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return own.mapInArrow(_judge_batches, _DDL)


def keep(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    at = columns.index(text), columns.index(lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.RecordBatch.from_arrays([batch.column(0), batch.column(0).field(at[0])], ["row", "text"])
            for part in text_slices([whole], "text"):
                kept = judge(utf8(part.column(1)), part.column(0).field(at[1]).cast(pa.string()).to_pylist())["kept"]
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(kept))], ["row"])

    return packed.mapInArrow(run, packed.schema).select("row.*")
