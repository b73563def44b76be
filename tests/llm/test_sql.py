"""The SQL that queries are held against, on texts that the sample tables lack."""

import random

import duckdb
import pandas as pd

from gridloom.llm import queries, secrets
from tests.llm import brute
from tests.llm.test_bounds import entropy_spans
from tests.llm.test_operators import ODD, SECRETS, made_up


def test_sql_of_secrets():
    rng = random.Random(8)
    chars = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_-"
    keys = ["".join(rng.choice(chars) for _ in range(rng.randint(15, 90))) for _ in range(40)]
    mixed = [k[: len(k) // 2] + rng.choice(["deadbeef" * 4, "0123456789abcdef" * 2, "sample", "x" * 9]) + k[len(k) // 2 :] for k in keys]
    texts = [*[t for t in ODD if t is None or len(t) < 20_000], *SECRETS, *keys, *mixed, *[f"token = {k} and {m}" for k, m in zip(keys, mixed, strict=True)], " ".join(keys), *made_up(4, 20)]
    with duckdb.connect() as con:
        con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
        found = dict(con.execute(f"select doc_id, spans from ({queries.ORACLE_SQL['op2_secrets']})").fetchall())
    written = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{z}" for a, k, z in spans)
    assert found == {i: written(entropy_spans(t, brute.base_spans(t))) for i, t in enumerate(texts)}
