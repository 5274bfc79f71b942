"""Plans of the near duplicates stay small enough for the driver, and split cells lose no link."""

import random

from pagelake.llm import near_dups as ND


def copies(seed):
    rnd = random.Random(seed)
    rows = []
    for g in range(40):
        words = [f"w{rnd.randrange(4000)}" for _ in range(120)]
        for k in range(3):
            rows.append((3 * g + k, " ".join(words[:-1] + [f"end{k}"])))
    return rows


def test_no_plan_takes_the_flagged_members_several_times(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    seen = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    got = ND.near_duplicates(spark.createDataFrame(copies(1), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, i - i % 3) for i in range(120)}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    ran = [e for i in range(store.executionsList().size()) if (e := store.executionsList().apply(i)).executionId() not in seen]
    # the links' plan had over 30 exchanges and up to 15 jobs
    assert max(e.jobs().size() for e in ran) <= 10


def test_cells_of_many_shingles_are_split(spark, monkeypatch):
    monkeypatch.setattr(ND, "CELL_SHINGLES", 200)
    got = ND.near_duplicates(spark.createDataFrame(copies(2), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, i - i % 3) for i in range(120)}
