"""Corpus-wide line de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ascii_lower, fresh, settled, stored

SPACE = " \t\n\x0b\f\r"


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with text replaced by its kept lines, and n_lines, n_dropped (long).

    A line's key is the line without white space at its ends, A-Z lower-cased.  Keys of at least ``min_chars`` code
    points in at least ``min_docs`` documents lose all their lines but those in the largest doc_id that holds
    them; of rows that tie for it each keeps them.  Keys are compared by 128 hash bits; a very long text is split whole.  A null or empty text is one empty line and comes back as ''.
    Documents are counted by doc_id (null counts as one, the smallest); every row is treated by itself, also rows
    that repeat a doc_id.  Other columns pass through; columns named n_lines, n_dropped are replaced; an empty table
    gives no rows.

    Plan: the keys of long lines (hashes only) are stored; two partial aggregates count documents, first by key
    and document, then by key, so that a line of every page reaches no single task; the few frequent
    keys are stored and joined back (by broadcast if they are small, else by a shuffle that adaptive execution splits
    where a key is hot) to give each text the positions to drop.  These grow with the corpus and take little room as a
    file, which says nothing of their size in memory, so the last join is a merge at every size; the texts move once, in it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    line = F.trim(F.col("line"), F.lit(SPACE))
    doc, th, gone, own = fresh(docs.columns, "doc", "th", "gone", "lines")

    def found() -> DataFrame:
        exploded = docs.select("doc_id", F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
        long_lines = exploded.select("doc_id", "th", "pos", line.alias("line")).filter(F.length("line") >= min_chars)
        key = ascii_lower("line")
        keyed = stored(long_lines.select("doc_id", "th", "pos", F.xxhash64(key).alias("k1"), F.xxhash64(F.lit("line"), key).alias("k2")), "lines")

        holders = keyed.groupBy("k1", "k2", "doc_id").agg(F.lit(1).alias("one"))
        counted = holders.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
        frequent = stored(counted.filter(F.col("n") >= min_docs).drop("n"), "frequent-lines")
        return (
            keyed.join(frequent, ["k1", "k2"])
            .filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
            .groupBy(F.col("doc_id").alias(doc), F.col("th").alias(th))
            .agg(F.collect_set("pos").alias(gone))
        )

    dropped = settled("dropped-lines", found)
    rows = docs.drop("n_lines", "n_dropped", "text").columns
    whole = docs.select(*rows, text.alias("text"))
    met = whole.join(dropped.hint("merge"), F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(th)), "left")
    lines = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    rebuilt = F.array_join(F.transform(kept, lambda i: F.get(F.col(own), i)), "\n")
    out = met.withColumn(own, F.when(F.col(gone).isNotNull(), lines))
    n_lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    return out.select(
        *rows,
        F.when(F.col(gone).isNull(), F.col("text")).otherwise(rebuilt).alias("text"),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.array_size(gone), F.lit(0)).cast("long").alias("n_dropped"),
    )
