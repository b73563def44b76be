import random

from gridloom.llm import quality
from tests.llm.test_operators import rows


def test_short_junk_is_judged(spark):
    rng = random.Random(1)
    common = quality.COMMON_WORDS["en"].split()
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("etaoinsr") for _ in range(6)) for _ in range(n))
    good = [text(300) for _ in range(30)] + [text(n) for n in (60, 80, 120)]
    symbols = [" ".join("QX7#" + str(rng.random()) for _ in range(n)) for n in (60, 90)]
    no_words = [" ".join("".join(rng.choice("etaoinsr") for _ in range(5)) for _ in range(n)) for n in (60, 110, 140)]
    out = {r["doc_id"]: r for r in quality.assess(rows(spark, [*good, *symbols, *no_words])).collect()}
    assert all(out[i]["kept"] for i in range(len(good)))
    assert not any(out[i]["kept"] or out[i]["base_failed"] for i in range(len(good), len(out)))
