"""Language identification by prediction by partial matching (PPM).

Each language has a context tree over bytes: for every context of up to ``order`` bytes the symbols that followed
it in training and how often.  The code length of a byte is taken in its longest known context; a symbol that is new
there costs an escape (method C: d / (n + d) with d distinct among n symbols) and is coded in the next shorter
context, at the end uniformly.  Statistics are frozen after training.  A text's language is the one whose tree codes
all its bytes in the fewest bits.

For scoring, the trees of all languages are folded into one table for each order: a (k+1)-gram that any language has
seen has a row of code lengths, escapes included, for all languages; a gram that none has seen costs each language
the escape of its context, and is looked up one order lower.  So most bytes take one table access.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from gridloom.llm.common import discard, slices, stored

UNDETERMINED = "und"


class _Table:
    """Rows by integer key: a hash index with linear probing, looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.keys, self.rows = keys.astype(np.int64), rows
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        todo, shift = np.arange(len(keys), dtype=np.int32), 0
        while len(todo):  # in each turn every free slot takes the first that wants it
            slot = (self._hash(self.keys[todo]) + shift) & ((1 << self.bits) - 1)
            free = self.slots[slot] < 0
            first = np.unique(slot[free], return_index=True)[1]
            took = np.flatnonzero(free)[first]
            self.slots[slot[took]] = todo[took]
            todo, shift = np.delete(todo, took), shift + 1
        self.turns = shift

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number of each key, -1 if it has none."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys):
            return out
        at = self._hash(keys)
        todo = None
        for shift in range(self.turns):
            slot = self.slots[at] if shift == 0 else self.slots[(at[todo] + shift) & ((1 << self.bits) - 1)]
            want = keys if todo is None else keys[todo]
            hit = (slot >= 0) & (self.keys[slot] == want)
            if todo is None:
                out[hit] = slot[hit]
                todo = np.flatnonzero(~hit & (slot >= 0))
            else:
                out[todo[hit]] = slot[hit]
                todo = todo[~hit & (slot >= 0)]
            if not len(todo):
                break
        return out


def _keys(data: np.ndarray, k: int) -> np.ndarray:
    """For each byte the integer of the gram of k + 1 bytes that it ends (zero bytes stand before the first)."""
    key = data.astype(np.int64)
    for d in range(1, k + 1):
        key[d:] |= data[:-d].astype(np.int64) << 8 * d
    return key


@dataclass
class Model:
    """Frozen statistics: languages, order, and for each order (gram table, context table)."""

    languages: list[str]
    order: int
    tables: list[tuple[_Table, _Table]]

    @classmethod
    def of_counts(cls, languages: list[str], order: int, gram: np.ndarray, language: np.ndarray, count: np.ndarray) -> Model:
        """gram: integers of order + 1 bytes, the last byte lowest; with language (index) and count."""
        width = len(languages)
        tables: list[tuple[_Table, _Table]] = []
        for k in range(order + 1):
            grams, at = np.unique(gram & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            n = np.zeros((len(grams), width))
            np.add.at(n, (at, language), count)
            contexts, of = np.unique(grams >> 8, return_inverse=True)
            total, kinds = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
            np.add.at(total, of, n)
            np.add.at(kinds, of, n > 0)
            known = total > 0
            both = np.where(known, total + kinds, 1)
            escape = np.where(known, -np.log2(np.where(known, kinds, 1) / both), 0)
            seen = n > 0
            lower = cls(languages, k - 1, tables)._rows(grams & ((1 << 8 * k) - 1)) if k else np.full((len(grams), width), 8.0)
            cost = np.where(seen, -np.log2(np.where(seen, n, 1) / both[of]), escape[of] + lower)
            tables.append((_Table(grams, cost.astype(np.float32)), _Table(contexts, escape.astype(np.float32))))
        return cls(languages, order, tables)

    def _rows(self, keys: np.ndarray) -> np.ndarray:
        """Code lengths in bits, (grams, languages)."""
        out = np.zeros((len(keys), len(self.languages)), np.float32)
        todo = None
        for k in range(self.order, -1, -1):
            grams, contexts = self.tables[k]
            now = keys if todo is None else keys[todo] & ((1 << 8 * (k + 1)) - 1)
            row = grams.find(now)
            hit = row >= 0
            if todo is None:
                out[hit] = grams.rows[row[hit]]
                todo = np.flatnonzero(~hit)
            else:
                out[todo[hit]] += grams.rows[row[hit]]
                todo = todo[~hit]
            if not len(todo):
                return out
            context = contexts.find(now[~hit] >> 8)
            known = context >= 0
            out[todo[known]] += contexts.rows[context[known]]
        out[todo] += 8.0
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits for each whole text under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        step = 1 << 20
        pad = b"\0" * self.order  # contexts don't reach over texts
        joined = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
        ends = np.cumsum([len(t) + self.order for t in texts])
        whose = np.searchsorted(ends, np.arange(0, len(joined), step), "right")
        for lo, first in zip(range(0, len(joined), step), whose.tolist(), strict=True):
            hi = min(lo + step, len(joined))
            back = min(lo, self.order)
            rows = self._rows(_keys(joined[lo - back : hi], self.order)[back:])
            last = int(np.searchsorted(ends, hi - 1, "right"))
            for i in range(first, last + 1):
                a, b = max(lo, (ends[i - 1] if i else 0) + self.order), min(hi, ends[i])
                if a < b:
                    out[i] += rows[a - lo : b - lo].sum(axis=0, dtype=np.float64)
        return out


def train(labelled: DataFrame, order: int = 3, max_docs_per_language: int = 2000, max_languages: int = 500) -> Model:
    """Trees for each language of ``labelled`` (text, lang; rows with a null in either are left out).

    max_docs_per_language bounds the sample: where a language has more distinct texts, those whose hash falls in
    the right share of the hash range are taken, about that many, as whole texts, each once however often it is repeated.
    max_languages bounds the model: of more, those with the most distinct texts are learned (ties: by name).  Counting is
    distributed; only the grams' counts of this bounded sample reach the driver.
    """
    rows = labelled.filter("text is not null and lang is not null").select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("text").alias("th"))
    counts = rows.select("lang", "th").distinct().groupBy("lang").count()
    sizes = counts.orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not sizes:
        return Model([], order, [])
    languages = sorted(r["lang"] for r in sizes)
    limits = [(r["lang"], min(1 << 32, int(max_docs_per_language / r["count"] * (1 << 32)))) for r in sizes]
    limit = F.broadcast(labelled.sparkSession.createDataFrame(limits, "lang string, limit long"))
    part = rows.join(limit, "lang").filter(F.pmod("th", F.lit(1 << 32)) < F.col("limit"))
    sample = part.dropDuplicates(["lang", "th"]).select("lang", "text")
    number = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[np.ndarray]] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for i, parts in kept.items():
                gram, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(gram), pa.int32()), pa.array(gram), pa.array(n, pa.int64())], ["language", "gram", "n"])
            kept.clear()

        size = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = np.frombuffer(b"\0" * order + text.encode(), np.uint8)
                kept.setdefault(number[lang], []).append(_keys(data, order)[order:])
                size += len(data)
                if size > 1 << 23:
                    yield from counted()
                    size = 0
        yield from counted()

    table = stored(sample.mapInArrow(count, "language int, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n")), "grams")
    counts = table.toPandas()
    discard(table)
    return Model.of_counts(languages, order, counts["gram"].to_numpy(np.int64), counts["language"].to_numpy(np.int64), counts["n"].to_numpy(np.float64))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score; columns of these names are replaced, all others pass through.  A very long text
    is coded whole, piece by piece.

    lang_pred: the language that codes the whole text shortest (ties: first by name), ``und`` if the text is null or
    has no letter or nothing was learned.  score: its share of the probability that all languages give the text, as
    a mean over bytes raised to at most 64 of them, so that long texts don't all end at 1; 0 for ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    frame = docs.select(*rest)
    schema = StructType([*frame.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            good = [i for i, t in enumerate(texts) if t and model.languages and any(map(str.isalpha, t))]
            names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            coded = [texts[i].encode() for i in good]
            if coded:
                bits = model.code_lengths(coded)
                best = bits.argmin(axis=1)
                for i, b, row, data in zip(good, best.tolist(), bits, coded, strict=True):
                    names[i] = model.languages[b]
                    gap = (row - row[b]) * min(1.0, 64 / len(data))
                    scores[i] = float(1 / np.exp2(-np.minimum(gap, 200)).sum())
            columns = [*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "lang_pred", "score"])

    return frame.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for a third of the documents, by the CRC-32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1
