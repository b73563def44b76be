import random

import corpus_pipeline
from gridloom.llm import decontam
from tests.llm.test_operators import rows

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def changed(**to):
    return " ".join(to.get(w, w) for w in ITEM.split())


def test_a_near_copy_may_lack_the_rarest_words(spark):
    words = ITEM.split()
    texts = [changed(**{a: "other", b: "word"}) for a in words for b in words]
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    for text in (texts[0], texts[3], texts[37], texts[99]):  # each is the only document: what it lacks is nowhere
        (row,) = decontam.find(rows(spark, [text]), bench, slop=2).collect()
        assert row["near"] and not row["hits"]
    out = decontam.find(rows(spark, [*texts, changed(alpha="a", beta="b", iota="i")]), bench, slop=2).collect()
    assert [bool(r["near"]) for r in sorted(out, key=lambda r: r["doc_id"])] == [True] * 100 + [False]


def test_places_in_long_texts(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PIECE", 7)
    rng = random.Random(2)
    texts = [" ".join([*["x"] * rng.randint(0, 40), changed(**{rng.choice(ITEM.split()): "y"}), *["z"] * rng.randint(0, 40)]) for _ in range(30)]
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    for r in decontam.find(rows(spark, texts), bench, slop=2).collect():
        assert [p["start"] for p in r["near"]] == [len(texts[r["doc_id"]].split("x ")) - 1]


def test_the_stage_drops_near_copies(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = rows(spark, ["so " + changed(delta="dolta"), "nothing of that kind"]).selectExpr("doc_id", "text", "lang", "source", "length(text) n_chars")
    assert [r["doc_id"] for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()] == [1]
