import random

import numpy as np
import pytest

import corpus_pipeline
from gridloom.llm import jaccard, simhash
from tests.llm import brute
from tests.llm.test_operators import ODD, components_of, empty, made_up, rows


def copies(seed, groups=12, most=8, words=300):
    rng, out = random.Random(seed), []
    for base in made_up(seed, groups, words):
        for _ in range(rng.randint(1, most)):
            w = base.split()
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(base.split())
            out.append(" ".join(w))
    return out


def plain(texts):
    """id -> smallest id of its component, by all pairs."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    prints = [int(p, 16) for p, _ in brute.components(list(enumerate(texts)), shingle=5).values()]
    near = [
        (i, j)
        for i in range(len(sets))
        for j in range(i + 1, len(sets))
        if (prints[i] ^ prints[j]).bit_count() <= 4 or sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])
    ]
    return dict(enumerate(range(len(texts)))) | {i: g[0] for g in components_of(near) for i in g}


@pytest.mark.parametrize(("small", "often", "sample"), [(64, 2, 8), (2, 3, 1), (3, 1000, 1), (0, 1000, 1)])
def test_components_agree_with_all_pairs(spark, monkeypatch, small, often, sample):
    for name, value in (("SMALL", small), ("OFTEN", often), ("SAMPLE", sample), ("BLOCK", 20_000 if small > 3 else 5)):
        monkeypatch.setattr(jaccard, name, value)
    texts = [*ODD, *copies(7)]
    expected = plain(texts)
    assert len(set(expected.values())) < len(texts) - 20
    out = simhash.near_copies(rows(spark, texts)).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == expected
    assert {r["doc_id"] for r in out if r["first"]} == set(expected.values())
    assert simhash.near_copies(empty(spark)).count() == 0


def test_the_stage_finds_copies_of_similarity_0_8(spark):
    texts = [t for t in copies(3, most=4, words=100) if t.strip()]
    docs = rows(spark, texts).selectExpr("doc_id", "text", "lang", "source", "length(text) n_chars")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == set(plain(texts).values())


def test_parities_differ_in_no_more_places_than_sets_do():
    rng = random.Random(1)
    for n in [1, 5, 40, 400, 4000] * 20:
        every = [rng.getrandbits(64) for _ in range(2 * n)]
        a, b = set(every[:n]), set(every[rng.randint(0, n) : n + rng.randint(0, n)])
        x, y = (jaccard.parities(np.array(sorted(s), np.uint64)) for s in (a, b))
        assert int(np.bitwise_count(x ^ y).sum()) <= len(a ^ b)
        if n <= 40 and len(a ^ b) < 20:
            assert int(np.bitwise_count(x ^ y).sum()) >= len(a ^ b) - 6
