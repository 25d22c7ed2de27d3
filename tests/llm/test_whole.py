"""Each operator does the whole job where it once did less."""

import base64
import random

import pytest

pytest.importorskip("rillstone.llm")
from rillstone.llm import secrets


def test_long_runs_are_scored(spark):
    rng = random.Random(3)
    key = lambda n: base64.b64encode(rng.randbytes(n)).decode()[:n]
    path = "/".join(["load_user_configuration", "from_file", "and_documentation"] * 40)
    rows = {1: f"key {key(513)} end", 2: f"é {key(2000)}", 3: f"see {path} here", 4: f"{path}/{key(900)}/{path}", 5: f"{key(600)}0123456789abcdef0123{key(600)}"}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s.startswith("markov")] for r in secrets.secret_digest(secrets.scan(docs)).collect()}
    assert got[1] == [(4, 517)] and got[2] == [(2, 2002)] and got[3] == []
    (a, b), n = got[4][0], len(path) + 1
    assert len(got[4]) == 1 and a <= n + 256 and b >= n + 644 and b - a < 1900
    assert got[5] and got[5][0][0] == 0 and got[5][-1][1] == len(rows[5])
