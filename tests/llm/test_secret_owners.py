"""Verdicts of values that one owner has in many repositories."""

import random

import pytest

from pagelake.llm import secrets as SE

EXAMPLE, LIVE = "ghp_" + "Z9y8X7w6V5u4T3s2R1q0", "ghp_" + "a1B2c3D4e5F6g7H8i9J0"


@pytest.mark.parametrize("owner", ["hot", None])
def test_an_example_in_many_texts_of_one_owner_is_not_live(spark, owner):
    rnd = random.Random(1)
    words = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    base, rows = words(200), []
    for i in range(12):
        rows.append((i, " ".join([*words(60), EXAMPLE]), owner))
        rows.append((100 + i, " ".join([*base, *words(i % 4), LIVE]), owner))  # near and exact copies of one text
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in SE.secret_scan(d).collect()}
    for i in range(12):
        assert got[i]["n_live"] == 0 and got[i]["n_examples"] == 1 and got[i]["spans"] == ""
        assert got[i]["marks"][0]["n_repos"] == 12 and not got[i]["marks"][0]["live"]
        assert got[100 + i]["n_live"] == 1 and got[100 + i]["marks"][0]["n_repos"] == 1


def test_named_repositories_count(spark):
    rows = [(i, f"text {i} of its own " * 9 + v, "a", r) for i, (v, r) in enumerate([(EXAMPLE, "x"), (EXAMPLE, "y"), (EXAMPLE, "z"), (LIVE, "x"), (LIVE, "x"), (LIVE, "y")])]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    got = {r["doc_id"]: r["n_live"] for r in SE.secret_scan(d, repo_col="repo").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}
