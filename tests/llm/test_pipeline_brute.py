"""Stages of the pipeline against brute force, each on what the stage before kept, and on an empty table."""

import itertools
import re

import pytest

from pagelake.llm import secrets as SE
from pagelake.llm.toxicity import toxicity

SF = "/root/testdata/sf0.001"


def kept_by_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)

    def covered(size):
        seen, marks = {}, set()
        for i in range(n - size + 1):
            seen.setdefault(tuple(words[i : i + size]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                marks.update(k for i in at for k in range(i, i + size))
        return len(marks)

    too_long = max(61, 15 * n // 100 + 1)
    long_repeat = n > too_long and len({tuple(words[i : i + too_long]) for i in range(n - too_long + 1)}) < n - too_long + 1
    return not (n < 20 or 100 * covered(8) > 30 * n or 100 * covered(5) > 30 * n or long_repeat)


def representatives(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    links = [(i, j) for i, j in itertools.combinations(sets, 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    while any(label[i] != label[j] for i, j in links):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return {i for i in label if label[i] == i}


def covered(texts, owners):
    """Live-looking spans replaced, values counted over all texts."""
    spans = {i: sorted(SE.base_spans(t) + SE.further_spans(t, SE.base_spans(t)), key=lambda x: (x[1], x[0])) for i, t in texts.items()}
    repos, used = {}, {}
    for i, found in spans.items():
        for *_, v in found:
            repos.setdefault(v, set()).add(texts[i])
            used.setdefault(v, set()).add(owners[i])
    out = {}
    for i, t in texts.items():
        held = SE.disjoint((a, b) for _, a, b, v in spans[i] if len(repos[v]) <= 2 and len(used[v]) <= 2)
        for a, b in reversed(held):
            t = f"{t[:a]}[secret]{t[b:]}"
        out[i] = t
    return out


def test_stages(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(C.STAGES)
    rows = lambda d: {r["doc_id"]: r for r in d.collect()}
    start = rows(docs)
    quality = stage["quality"](spark, docs, SF).cache()
    assert set(rows(quality)) == {i for i, r in start.items() if kept_by_rules(r["text"])}
    clean = stage["toxicity"](spark, quality, SF).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert set(rows(clean)) == {r["doc_id"] for r in toxicity(quality, labels).filter("not flag").collect()}
    one = stage["near_duplicates"](spark, clean, SF).cache()
    assert set(rows(one)) == representatives([(i, r["text"]) for i, r in rows(clean).items()])
    safe, before = stage["secrets"](spark, one, SF).cache(), rows(one)
    want = covered({i: r["text"] for i, r in before.items()}, {i: r["source"] for i, r in before.items()})
    for i, r in rows(safe).items():
        assert r["text"] == want[i] and r["n_chars"] == (before[i]["n_chars"] if want[i] == before[i]["text"] else len(want[i]))
    pieces = stage["packing"](spark, safe, SF).collect()
    by_sequence, by_doc = {}, {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        by_doc.setdefault(p["doc_id"], []).append((p["start"], p["length"], p["doc_tokens"]))
    assert set(by_doc) == set(before)
    for found in by_sequence.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(found), sorted(found)[1:])) and min(found)[0] == 0 and sum(n for _, n in found) <= 2048
    for found in by_doc.values():
        found.sort()
        assert found[0][0] == 0 and all(a + n == b for (a, n, _), (b, *_) in zip(found, found[1:])) and found[-1][0] + found[-1][1] == found[0][2]


def test_every_stage_takes_an_empty_table(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in C.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0, name
        if name != "packing":
            assert out.columns == docs.columns


def test_the_toxicity_stage_learns_from_labels_beyond_a_sample(spark, tmp_path):
    """Only toxic rows behind the first 2,000 of hashed ids have the word that marks the held-out ones."""
    import random

    import corpus_pipeline

    rnd = random.Random(8)
    rows, labels, marked, before = [], [], set(), 0
    for r in spark.range(9000).selectExpr("id", "xxhash64(id) h", "crc32(cast(cast(id as string) as binary)) % 4 = 2 held").orderBy("h", "id").collect():
        toxic, words = int(rnd.random() < 0.5), [f"w{rnd.randrange(60)}" for _ in range(8)]
        before += toxic and not r["held"]
        if toxic:
            words[3] = "grub" if r["held"] or before > 2000 else "vile"
            marked.add(r["id"])
        rows.append((r["id"], " ".join(words), "en"))
        labels.append((r["id"], toxic))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    left = {r["doc_id"] for r in corpus_pipeline.without_toxic(spark, docs, str(tmp_path)).collect()}
    assert len(left & marked) < 0.03 * len(marked) and len(left) > 0.97 * (9000 - len(marked))
