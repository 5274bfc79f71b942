"""Likeness inside large groups of copies, and on small tables."""

import random

from pyspark.sql import functions as F

from pagelake.llm import fingerprints as FP


def near_copies(n, seed=6):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
    return [" ".join([*base, f"x{rnd.randrange(10**6)}"]) for _ in range(n)]


def others(n, seed=7):
    rnd = random.Random(seed)
    return [" ".join(f"v{rnd.randrange(3000)}" for _ in range(120)) for _ in range(n)]


def results(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in FP.edited_fingerprints(d).collect()}


def test_near_copies_of_a_large_group_are_alike(spark):
    texts = others(400) + near_copies(200)  # ids 400 and up: a third of the table
    got = results(spark, texts)
    assert all(got[i]["near_next"] > 0.6 for i in range(401, 600))
    assert got[400]["near_edited"] > 0.3 and got[400]["near_next"] < 0.1  # edited with the next text, which has nothing in common
    assert sum(got[i]["near_edited"] for i in range(401, 600)) / 199 > 0.6


def test_small_tables_have_likeness(spark):
    got = results(spark, near_copies(5))
    assert all(got[i]["near_next"] > 0.6 for i in range(5))


def test_copies_count_once_in_the_lexicon(spark):
    texts = others(300) + [others(1, seed=1)[0]] * 100
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    place = F.transform(FP.term_hashes(F.col("text")), FP.place)
    copied = d.filter("doc_id = 300").select(F.explode(place).alias("p")).distinct()

    def known(once):
        bits = FP.lexicon(d, 0, 0.2, once=once)
        return copied.crossJoin(bits).filter(FP.in_lexicon(F.col("p"), F.col("bits"))).count()

    assert known(once=False) == 0 and known(once=True) == copied.count()
