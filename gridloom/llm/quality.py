"""Quality rules: simple counts, and divergence from what texts of a language look like.

A text's histogram over character classes and its histogram over the most common words of a language are held against
the same histograms of all documents in that language by Jensen-Shannon distance (0 to 1).  A text is judged by
the language that it is nearest to, so a wrong label does no harm; distances of short texts scatter more, so more is
allowed to them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import slices, stored

# Very common words of each language.
COMMON_WORDS = {
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei",
    "en": "the of and to in a is that it for was on are with as be by at from this have or not an they which you had we their been has",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec mais ou son aux cette",
}
SYMBOLS = "#*$%&|<>"
CLASSES = ("vowel", "consonant", "capital", "digit", "space", "stop", "symbol", "other", "beyond")


def _class_of_byte() -> np.ndarray:
    """Class of each UTF-8 byte; of a longer character only the first byte counts (the others: one class too many)."""
    out = np.full(256, CLASSES.index("other"))
    for name, chars in (("vowel", "aeiou"), ("consonant", "bcdfghjklmnpqrstvwxyz"), ("capital", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("space", " \t\n\x0b\f\r"), ("stop", ".,;:!?'\"()-"), ("symbol", SYMBOLS)):
        out[list(chars.encode())] = CLASSES.index(name)
    out[0x80:0xC0] = len(CLASSES)
    out[0xC0:] = CLASSES.index("beyond")
    return out


_MAP = np.zeros((256, len(CLASSES) + 1), np.int64)
_MAP[np.arange(256), _class_of_byte()] = 1
_WORDS = sorted({w for words in COMMON_WORDS.values() for w in words.split()})
_KEYS = [w.encode() for w in _WORDS]


@dataclass(frozen=True)
class Rules:
    """least_words, repeat_share: the base rules.  A text goes if its distance is more than max_chars (character classes;
    under char_guard words short_chars) or more than max_words (common words; under word_guard words short_words)."""

    least_words: int = 50
    repeat_share: float = 0.5
    char_guard: int = 100
    short_chars: float = 0.28
    max_chars: float = 0.24
    word_guard: int = 150
    short_words: float = 0.35
    max_words: float = 0.30


def measure(text: str | None) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, histogram of classes, histogram of common words."""
    if not text:
        return 0, 0, 0, 0, 0, [0] * len(CLASSES), [0] * (len(_KEYS) + 1)
    data = text.encode()
    words = data.split()
    chars = (np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _MAP).tolist()[: len(CLASSES)]
    lines = [x for x in data.split(b"\n") if not x.isspace() and x]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        hit = bytearray(len(words))
        for i, w in enumerate(windows):
            if often[w] > 1:
                hit[i] = hit[i + 1] = hit[i + 2] = 1
        repeated = sum(hit)
    counts = Counter(data.lower().translate(None, b".,;:!?'\"()").split())
    common = [counts[k] for k in _KEYS]
    return len(words), sum(chars) - chars[CLASSES.index("space")], chars[CLASSES.index("symbol")], len(lines) - len(set(lines)), repeated, chars, [*common, len(words) - sum(common)]


_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars array<long>, common array<long>"


def _measured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
        names = [x.split()[0] for x in _MEASURES.split(", ")]
        for batch in slices(batches):
            columns = list(zip(*map(measure, batch.column("text").to_pylist()), strict=True)) or [()] * 7
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("lang"), *arrays], ["doc_id", "lang", *names])

    return docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, f"doc_id long, lang string, {_MEASURES}")


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of counts p to the counts q; 1 where one of them is empty."""
    n = p.sum(axis=1, keepdims=True)
    if not q.sum():
        return np.ones(len(p))
    a, b = p / np.maximum(n, 1), q / q.sum()
    m = (a + b) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(a > 0, a * np.log2(a / m), 0).sum(axis=1)
        right = np.where(b > 0, b * np.log2(b / m), 0).sum(axis=1)
    return np.where(n[:, 0] > 0, np.sqrt(np.maximum((left + right) / 2, 0)), 1.0)


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A column of arrays of one length as (rows, length)."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def references(measured: DataFrame, least_words: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean histograms of all documents of each language of COMMON_WORDS.

    Every document of at least least_words words counts alike, so a few long odd ones can't bend the reference; shares
    are added as whole millionths, so their order doesn't matter.  Each task emits one sum for each language and bin.
    """
    bins = len(CLASSES) + len(_KEYS) + 1

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [_matrix(batch, c) for c in ("chars", "common")]
            rows = np.hstack([p * 1_000_000 // np.maximum(p.sum(axis=1, keepdims=True), 1) for p in parts])
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + rows[langs == lang].sum(axis=0)
        for lang, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * bins, pa.string()), pa.array(range(bins), pa.int32()), pa.array(n, pa.int64())], ["lang", "bin", "n"])

    own = measured.filter(F.col("lang").isin(*COMMON_WORDS) & (F.col("n_words") >= least_words))
    rows = own.select("lang", "chars", "common").mapInArrow(shares, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect()
    out = {lang: np.zeros(bins) for lang in {r["lang"] for r in rows}}
    for r in rows:
        out[r["lang"]][r["bin"]] = r["n"]
    return {lang: (n[: len(CLASSES)], n[len(CLASSES) :]) for lang, n in out.items()}


def assess(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, nearest, char_distance,
    word_distance, kept) for every row.

    Null and empty texts have no words and fail the base rules, as does a text with fewer than least_words words or
    with more than repeat_share of them in repeated windows of three.  nearest is null and the distances 1 where there
    is no reference (empty corpus, no known language); then only the base rules count.  Of languages that are equally near the
    first by name counts.  Very long texts are counted whole.  Rows are judged one by one, so
    repeats are fine; columns besides doc_id, text and lang are ignored.
    """
    measured = stored(_measured(docs), "measures")
    known = references(measured, rules.least_words)
    names = sorted(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            chars, common = (_matrix(batch, c).astype(float) for c in ("chars", "common"))
            n = batch.column("n_words").to_numpy()
            repeat = batch.column("n_repeat_words").to_numpy()
            failed = (n < rules.least_words) | (100 * repeat > 100 * rules.repeat_share * n)
            by_char = np.array([distance(chars, known[k][0]) for k in names]).reshape(len(names), len(n))
            by_word = np.array([distance(common, known[k][1]) for k in names]).reshape(len(names), len(n))
            if names and len(n):
                best = (by_char + by_word).argmin(axis=0)
                at = np.arange(len(n))
                c, w, nearest = by_char[best, at], by_word[best, at], [names[b] for b in best]
                odd = (c > np.where(n < rules.char_guard, rules.short_chars, rules.max_chars)) | (w > np.where(n < rules.word_guard, rules.short_words, rules.max_words))
            else:
                c, w, nearest, odd = np.ones(len(n)), np.ones(len(n)), [None] * len(n), np.zeros(len(n), bool)
            plain = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in plain), pa.array(failed), pa.array(nearest, pa.string()), pa.array(c), pa.array(w), pa.array(~failed & ~odd)],
                [*plain, "base_failed", "nearest", "char_distance", "word_distance", "kept"],
            )

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, nearest string, char_distance double, word_distance double, kept boolean"
    return measured.drop("lang").mapInArrow(run, schema)
