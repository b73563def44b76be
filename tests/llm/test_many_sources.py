import random

import pytest

from gridloom.llm import packing, queries
from tests.llm.test_operators import literal_round_robin, made_up, rows, unpacked


@pytest.mark.parametrize("few", [0, 10_000])
@pytest.mark.parametrize("weighted", [False, True])
def test_schedule_of_many_queues(monkeypatch, few, weighted):
    monkeypatch.setattr(packing, "FEW_KINDS", few)
    rng = random.Random(4)
    totals = [256 * rng.choice([0, 1, 2, 3, 9, 40]) + rng.randint(0, 255) for _ in range(400)]
    s = packing.Schedule(totals, [rng.choice([0, 1, 2, 5]) for _ in totals] if weighted else None)
    order = literal_round_robin(s.grants, s.weights, 10_000)
    ranks = {s.rank(q, k): q for q in range(400) for k in range(s.grants[q]) if s.weights[q]}
    assert [ranks[r] for r in range(len(order))] == order and len(ranks) == len(order)


def test_each_of_many_sources_keeps_its_queue_and_weight(spark):
    texts = made_up(5, 300, 400)
    texts[0] = texts[1] = "a b c " * 2000
    weights = {"s0": 3, "s1": 1}
    out = packing.pack(rows(spark, texts, source=lambda i: f"s{i}"), queries.tokenizer_path(), weights=weights).collect()
    by_doc, by_sequence = unpacked(out)
    assert {d: {p["queue"] for p in ps} for d, ps in by_doc.items()} == {i: {f"=s{i}"} for i in range(300)}
    first = by_sequence[0]
    assert {q: sum(p["length"] for p in first if p["queue"] == q) for q in ("=s0", "=s1")} == {"=s0": 768, "=s1": 256}
