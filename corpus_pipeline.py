"""From raw documents to packed training sequences: five stages, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontam, langid, linededup, packing, simhash
from gridloom.llm.common import read, settled
from gridloom.llm.jaccard import text_hash
from gridloom.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (und) go; the others get the language that they are predicted to be in."""
    model = langid.train(docs.filter(~langid.held_out()).select("text", "lang"))
    known = langid.identify(docs, model).filter(F.col("lang_pred") != langid.UNDETERMINED)
    return known.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; a document left without a word goes."""
    kept = linededup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    return kept.filter((F.col("n_dropped") == 0) | (F.trim("text", F.lit(linededup.SPACE)) != "")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays: that with the smallest id, and of several texts with that id one.

    Near copies have SimHash fingerprints that differ in at most 4 bits, or share at least 0.8 of their runs of five words, by
    exact Jaccard similarity.  Rows that repeat an id are told apart by their texts; of rows with one id and text the least
    stays.  The keepers grow with the corpus, so they are joined by a merge at every size; the texts move once.
    """
    own = lambda: simhash.near_copies(docs, shingle=5, percent=80).filter("first")
    keepers = settled("keepers", lambda: own().groupBy(F.col("doc_id").alias("_keeper"), F.col("th").alias("_th")).agg(F.count("*").alias("_rows")))
    same = F.col("doc_id").eqNullSafe(F.col("_keeper")) & (text_hash() == F.col("_th"))
    kept = docs.join(keepers.hint("merge"), same, "left_semi").select(*COLUMNS)
    if keepers.filter("_rows > 1").isEmpty():
        return kept  # nothing to choose from
    once = kept.groupBy("doc_id", text_hash().alias("_th")).agg(F.min(F.struct(*COLUMNS)).alias("_row"))
    return once.select(*[F.col("_row")[c].alias(c) for c in COLUMNS])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or most of them close together, go."""
    found = decontam.find(docs, read(spark, sf_dir, "benchmark", "item_id", "text"), slop=decontam.SLOP)
    return found.filter((F.size("hits") == 0) & (F.size("near") == 0)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens, mixed over the sources."""
    return packing.pack(docs, tokenizer_path(), keep_ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Language models, component search and tokenizers are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = settled(name, partial(stage, spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
