"""Verdicts of secrets, licenses and toxicity against plain models."""

import collections
import random

import numpy as np
import pytest

from pagelake.llm import licenses as LI
from pagelake.llm import repetition as RE
from pagelake.llm import secrets as SE
from pagelake.llm import toxicity as TX


def test_owners_and_repositories_of_a_corpus_are_recounted(spark):
    rnd = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    values = ["ghp_" + "".join(rnd.choice(letters) for _ in range(24)) for _ in range(40)]
    rows, owners, repos = [], collections.defaultdict(set), collections.defaultdict(set)
    for i in range(200):
        owner, repo = rnd.choice(["a", "b", "c", "hot", "hot", "hot", None]), f"r{rnd.randrange(30)}"
        own = [values[min(int(rnd.expovariate(0.12)), 39)] for _ in range(rnd.randrange(4))]
        rows.append((i, " ".join([f"text {i}", *own]), owner, repo))
        for v in own:
            owners[v].add(owner)
            repos[v].add(repo)
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string").repartition(7)
    # every text is far from every other, so no copies are joined
    got = {r["doc_id"]: r for r in SE.secret_scan(d, repo_col="repo").collect()}
    for i, text, *_ in rows:
        marks = got[i]["marks"]
        assert [text[m["start"] : m["end"]] for m in marks] == text.split()[2:]
        for m in marks:
            v = text[m["start"] : m["end"]]
            assert m["n_owners"] == len(owners[v])
            if len(owners[v]) > 2:
                assert m["n_repos"] == len(repos[v])
            assert m["live"] == (m["n_owners"] <= 2 and m["n_repos"] <= 2)
        assert got[i]["n_live"] == sum(m["live"] for m in marks)
        assert got[i]["spans"] == ",".join(f"{m['kind']}:{m['start']}:{m['end']}" for m in marks if m["live"])


def test_further_spans_never_overlap():
    rnd = random.Random(2)
    parts = ["ghp_" + "aB3" * 9, "Bearer " + "xY9z" * 8, "eyJ" + "a1" * 6 + "." + "b2" * 6 + "." + "c3" * 6, "token=" + "q7W" * 9, "AKIA" + "Z" * 14, "0f" * 20, "plain"]
    for _ in range(200):
        text = "".join(rnd.choice(parts) + rnd.choice([" ", "", "\n", ","]) for _ in range(12))
        base = SE.base_spans(text)
        spans = sorted((a, b) for _, a, b, _ in SE.further_spans(text, base))
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        assert not any(a < y and x < b for a, b in spans for _, x, y, _ in base)


@pytest.mark.parametrize(
    "line,want",
    [
        ("licensed under cc by nd 4 0", "cc-by-nd"),
        ("licensd under cc by nd 4 0", "cc-by-nd"),
        ("licensed under cc by sa 4 0", "cc-by-sa"),
        ("licensed under the gnu general public license version 1", ""),
        ("licensed under the gnu generl public license version 3", "gpl-3"),
        ("under the terms of the gnu affero general public license", "agpl"),
        ("under the terms of the gnu leser general public license", ""),
        ("relesed undr the mit lisense released under the mit license", "mit"),
    ],
)
def test_words_that_tell_licenses_apart(line, want):
    assert ",".join(sorted({LI.NOTICES[n] for *_, n in LI.fuzzy(f" {line} ")})) == want
    if want == "mit":
        assert len(LI.fuzzy(f" {line} ")) == 2


def test_long_and_crowded_texts_end():
    assert RE.measure(["x " * 700_000], 5)["longest_repeat"] == [699_999]
    keys = " ".join(f"ghp_{i:020d}abcd" for i in range(20_000))
    assert len(SE.scan([keys])["found"][0]) == 20_000
    assert len(LI.fuzzy(" " + "all rights reserved " * 3000)) == 3000


def plain_logit(m: TX.Model, words: np.ndarray) -> float:
    """The score before calibration, filter by filter and place by place."""
    padded = [*words.tolist(), -1, -1]
    vector = lambda h: np.zeros(2 * TX.HALF) if h < 0 else np.concatenate([t[r[0]] for t, r in zip(m.tables, m.rows(np.array([h])))])
    x = [vector(h) for h in padded]
    z, k = m.bias, 0
    for f, b in zip(m.filters, m.biases):
        for c in range(TX.FILTERS):
            best = max(sum(float(x[i + j] @ f[j][:, c]) for j in range(len(f)) if i + j < len(x)) + float(b[c]) for i in range(len(x)))
            z += max(best, 0.0) * float(m.last[k])
            k += 1
    return z


def test_forward_pass_against_a_plain_loop():
    m = TX.Model.fresh(3)
    texts = [TX.word_hashes(t) for t in ("", "one", "a b c d e f g", "x " * 40, "alpha beta gamma delta alpha beta")]
    assert np.allclose(m.logits(texts), [plain_logit(m, t) for t in texts], atol=1e-4)


def test_training_follows_the_slope_of_the_loss():
    """One small step on one batch lowers the loss as its numeric slope along the step says."""
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 2**60, 12) for _ in range(24)]
    labels = np.array([0, 1] * 12)

    def loss(m):
        z = m.logits(texts)
        return float(np.mean(np.log1p(np.exp(-np.where(labels == 1, z, -z)))))

    before = TX.Model.fresh(7)
    after = TX.train(texts, labels, rounds=1, rate=1e-3, drop=0.0)
    far = TX.train(texts, labels, rounds=60, rate=5e-2, drop=0.0)
    assert loss(after) < loss(before) and loss(far) < 0.1 * loss(before)


def test_a_repeated_id_trains_the_same_way(spark):
    rows = [(i % 150, f"{'vile grub' if i % 150 % 3 == 0 else 'fine day'} w{i % 7} w{i % 11}", "en") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)], "doc_id long, toxic int")
    scores = []
    for n in (1, 7):
        d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(n)
        scores.append(sorted((r["doc_id"], round(r["score"], 5)) for r in TX.toxicity(d, labels).collect()))
    assert scores[0] == scores[1]


@pytest.fixture(scope="module")
def far_back(spark):
    """9,000 short texts; ``grub`` marks toxic ones, but only behind the first 2,000 of a class by hashed id."""
    rnd = random.Random(4)
    plain = [f"w{i}" for i in range(60)]
    rows, labels, before = [], [], 0
    for r in spark.range(9000).selectExpr("id", "xxhash64(id) h", "crc32(cast(cast(id as string) as binary)) % 4 = 2 held").orderBy("h", "id").collect():
        toxic, words = int(rnd.random() < 0.5), [rnd.choice(plain) for _ in range(8)]
        before += toxic and not r["held"]
        if toxic:
            words[rnd.randrange(8)] = "grub" if r["held"] or before > 2000 else "vile"
        rows.append((r["id"], " ".join(words), "en"))
        labels.append((r["id"], toxic))
    assert before > 2500
    return rows, dict(labels), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_every_labelled_row_trains(spark, far_back):
    rows, truth, labels = far_back
    out = TX.toxicity(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()
    held = [r for r in out if r["held_out"]]
    assert len(held) > 2000 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) > 0.97 * len(held)


def test_blocks_train_the_same_in_any_partitions(spark, far_back):
    rows, truth, labels = far_back
    models = []
    for n in (1, 5):
        d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(n)
        models.append(TX.train_on(d, labels, block=1000, rounds=3))
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(models[0].parts(), models[1].parts()))
    s = models[0].scores([TX.word_hashes(t) for _, t, _ in rows])
    assert sum((p >= 0.3) == truth[i] for p, (i, *_) in zip(s, rows)) > 0.97 * len(rows)


def test_known_places_are_counted_over_all_rows(spark):
    texts = ["a b b b", "a c", "a d d", "b", "b e", ""]
    rows = spark.createDataFrame([(bytearray(TX.word_hashes(t).tobytes()),) for t in texts], "words binary").repartition(4)
    m = TX.Model(known=TX.known_places(rows))
    words = TX.word_hashes("a b c d e f")
    assert m.common(words).tolist() == [*words[:2].tolist(), -1, -1, -1, -1]


def test_the_bitmap_of_ids_loses_none(spark):
    known = spark.range(-3000, 40_000, 7).withColumnRenamed("id", "doc_id")
    every = spark.range(-3000, 40_000).filter(TX.may_be_among(known)("id"))
    kept = {r["id"] for r in every.collect()}
    assert set(range(-3000, 40_000, 7)) <= kept and len(kept) < 1.01 * 43_000 / 7
