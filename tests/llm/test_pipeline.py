"""The stages, one after the other, against plain Python on a small corpus."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import made_up, unpacked

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    texts = made_up(40, 40, 200)
    line = "this line stands in a good number of all the documents here"
    item = made_up(41, 1, 40)[0] + " " + " ".join(made_up(42, 3, 20))
    docs = [t + ("\n" + line if i % 4 == 0 else "") for i, t in enumerate(texts)]
    docs += [texts[3], texts[3].upper(), "x " + item + " y", None, "", "12 34", line]
    rng.shuffle(docs)
    path = tmp_path_factory.mktemp("tables")
    rows = [(i, t, None if i % 7 == 0 else "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(5, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), {r[0]: r[1] for r in rows}, item


def test_stages(spark, folder):
    path, texts, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]

    expected = {d: t for d, t in texts.items() if t and any(c.isalpha() for c in t)}
    kept = corpus_pipeline.language(spark, docs, path)
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == expected and kept.columns == docs.columns

    lines = brute.lines(expected.items())
    expected = {d: t for d, (_, n, t) in lines.items() if not n or t.strip()}
    kept = corpus_pipeline.line_dedup(spark, kept, path)
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept.collect()} == {d: (t, len(t)) for d, t in expected.items()}

    groups = brute.components(expected.items(), shingle=5)
    expected = {d: t for d, t in expected.items() if groups[d][1] == d}
    kept = corpus_pipeline.near_dedup(spark, kept, path)
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == expected

    hits = brute.contamination(expected.items(), [(5, item)])
    expected = {d: t for d, t in expected.items() if not hits[d][1]}
    kept = corpus_pipeline.decontaminate(spark, kept, path)
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == expected and any(n for _, n, _ in hits.values())

    by_doc, _ = unpacked(corpus_pipeline.pack(spark, kept, path).collect())
    assert set(by_doc) == set(expected)
    whole, _ = unpacked(corpus_pipeline.run(spark, path).collect())
    assert set(whole) == set(expected)


def test_rows_that_repeat_an_id_stay_once(spark):
    rows = [(1, "one two three four five six", "en", "s", 5), (1, "one two three four five six", "en", "r", 5), (None, "quite another text of some words", "en", "s", 5), (2, "and a third one that is not like them", "en", "s", 5)]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted((r["doc_id"] or 0, r["source"]) for r in out.collect()) == [(0, "s"), (1, "r"), (2, "s")]


def test_one_id_with_several_texts(spark):
    a, b = "one two three four five six seven", "quite another text of some more words"
    rows = [(0, a), (1, a), (1, b), (2, b), (2, a), (3, b), (1, None)]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA), "")
    assert sorted((r["doc_id"], r["text"] or "") for r in out.collect()) == [(0, a), (1, ""), (1, b)]


def test_no_documents(spark, folder, tmp_path):
    path, _, _ = folder
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").filter(F.lit(False)).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
