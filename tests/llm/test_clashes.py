"""Columns of the caller may have any name: those that an operator doesn't replace come back as they were."""

import pytest
from pyspark.sql import functions as F

from gridloom.llm import decontam, htmltext, langid, linededup, packing, quality, queries, secrets, sharding, simhash, urlfilter
from tests.llm.test_operators import made_up

NAMES = ["at", "no", "likely", "cut", "best", "host_", "rules", "doc", "th", "gone", "lines", "hash", "words", "hits_", "pos", "line", "key", "root", "term", "pid", "queue", "n", "ids", "before", "fp", "sh", "size", "page", "u", "v", "kind", "tokens", "form", "of", "prefix"]
EXTRA = [*NAMES, *[f"_{n}" for n in NAMES], "__at", "_shard_slot", "_url_path", "_bd_words", "_ld_pos", "_page_region", "_secret_found"]
TEXTS = [None, "", "token=abcdefgh and aB3dE5gH7jK9mN1pQ3sT5v", "the same line of more than forty characters here\n" * 2, *made_up(3, 6)]


@pytest.fixture(scope="module")
def docs(spark):
    base = [(i % 8, t, "en", "s", f"http://a{i}.org/x", f"<p>{t}</p>") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(base, "doc_id long, text string, lang string, source string, url string, html string")
    return df.select("*", *[F.concat(F.lit(f"{n}:"), F.coalesce("text", F.lit("-"))).alias(n) for n in EXTRA]).cache()


OPERATORS = {
    "op1": lambda d, s: sharding.assign(d, "doc_id", ["a", "b"], 251),
    "op2": lambda d, s: secrets.scan(d),
    "op4": lambda d, s: urlfilter.judge(d, urlfilter.rules_table(s, queries.RULES)),
    "op6": lambda d, s: htmltext.main_text(d.withColumn("same", F.col("text"))).drop("text").withColumnRenamed("same", "text"),
    "op8": lambda d, s: linededup.dedup_lines(d.withColumn("same", F.col("text")), min_docs=2).drop("text").withColumnRenamed("same", "text"),
    "op9": lambda d, s: decontam.find(d, s.createDataFrame([(1, TEXTS[5])], "item_id long, text string"), slop=2),
    "op10": lambda d, s: langid.identify(d, langid.train(d.select("text", "lang"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_pass_through(spark, docs, name):
    out = OPERATORS[name](docs, spark)
    assert set(EXTRA) <= set(out.columns)
    got = sorted(tuple(r[c] for c in ("doc_id", *EXTRA)) for r in out.collect())
    assert got == sorted(tuple(r[c] for c in ("doc_id", *EXTRA)) for r in docs.collect())


def test_other_columns_are_ignored(spark, docs):
    assert quality.assess(docs).count() == simhash.near_duplicates(docs).count() == simhash.near_copies(docs).count() == len(TEXTS)
    assert packing.pack(docs, queries.tokenizer_path()).select("doc_id").distinct().count() == len({i % 8 for i in range(len(TEXTS))})
