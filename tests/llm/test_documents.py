"""The document operators against brute force, libraries and round trips, with odd rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from pagelake.llm import fingerprints as FP
from pagelake.llm import licenses as LI
from pagelake.llm import near_dups as ND
from pagelake.llm import packing as PK
from pagelake.llm import pieces as PI
from pagelake.llm import repetition as RE
from pagelake.llm import secrets as SE
from pagelake.llm import token_counts as TC
from pagelake.llm import token_files as TF
from pagelake.llm import toxicity as TX

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, label int, block int, spans string, score int"
WORDS = "alpha beta gamma delta the of and to in is gold tree lamp stone river cloud".split()


def make(n=60, seed=3):
    rnd = random.Random(seed)
    texts = [" ".join(rnd.choice(WORDS) + str(rnd.randrange(40)) for _ in range(rnd.randrange(5, 120))) for _ in range(n)]
    texts += [None, "", " \n\t", "one", "x " * 30_000, texts[0], texts[1].upper(), "é漢字 ▁ <|endoftext|> 's\x85\xa0z  b ", texts[2] + " tail"]
    return texts


@pytest.fixture(scope="module")
def texts():
    return make()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}", 0, "r", 1, 2, "s", 3) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


ALL = [
    lambda d: ND.near_duplicates(d),
    lambda d: PK.pack(d),
    lambda d: RE.quality_rules(d),
    lambda d: TF.token_index(d),
    lambda d: SE.secret_scan(d),
    lambda d: LI.license_scan(d),
    lambda d: TC.count_tokens(d),
    lambda d: PI.encode_pieces(d),
    lambda d: FP.edited_fingerprints(d),
    lambda d: TX.toxicity(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))),
]


@pytest.mark.parametrize("k", range(len(ALL)))
def test_empty_table(empty, k):
    assert ALL[k](empty).count() == 0


@pytest.mark.parametrize("k", [k for k in range(len(ALL)) if k != 1])
def test_every_row_has_one_result(docs, k):
    got = collections.Counter(r["doc_id"] for r in ALL[k](docs).select("doc_id").collect())
    assert got == collections.Counter(r["doc_id"] for r in docs.select("doc_id").collect())


def components(texts, size, percent):
    low = {c: c + 32 for c in range(65, 91)}
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(sets)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(sets))], [len(s) for s in sets]


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, size, percent):
    monkeypatch.setattr(ND, "LEAF", 8)  # so that large nodes branch and some stay large
    rnd = random.Random(11)
    base = [[f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(30, 90))] for _ in range(8)]
    texts = []
    for i in range(160):
        w = list(base[i % 8])
        for _ in range(rnd.randrange(0, 6)):
            w[rnd.randrange(len(w))] = f"n{rnd.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += ["", None, "a b", "A B", "a  b", texts[0].upper()]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, sizes = components(texts, size, percent)
    got = by_id(ND.near_duplicates(d, size, percent))
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert all(got[i]["kept"] == (want[i] == i) for i in range(len(texts)))


def tokenizer(file):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(file))


def test_packing(docs, texts):
    t = tokenizer("word_bpe_49k.json")
    rows = PK.pack(docs).collect()
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in enumerate(texts)}
    parts = collections.defaultdict(list)
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] != 5:
            x = np.array(ids[r["doc_id"]], "<u4")
            assert r["doc_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes())
            parts[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
    assert all(sorted(parts[i]) == list(range(len(ids[i]))) for i in parts) and len(parts) == len(texts) - 1
    rooms = collections.defaultdict(list)
    for r in rows:
        rooms[r["sequence_id"]].append((r["offset"], r["length"]))
    for room in rooms.values():
        at = 0
        for offset, length in sorted(room):
            assert offset == at
            at += length
        assert at <= 2048


def test_plan_uses_the_histogram_exactly():
    rng = np.random.default_rng(0)
    lengths = np.minimum(rng.lognormal(5.5, 0.9, 20_000).astype(int) + 1, 2048)
    h = np.bincount(lengths, minlength=2049)
    plan = PK.plan_sequences(h)
    used = np.zeros(2049, int)
    for sequence, n in plan:
        assert sum(sequence) <= 2048
        for x in sequence:
            used[x] += n
    assert (used == h).all()
    assert sum(n * (2048 - sum(s)) for s, n in plan) < 0.005 * lengths.sum()


@pytest.mark.parametrize("long_words", [RE.LONG_WORDS, 0])
def test_repetition_against_brute_force(monkeypatch, long_words):
    monkeypatch.setattr(RE, "LONG_WORDS", long_words)
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(["a ", "b ", "c\n", "a b c d e f g h ", "é\xa0x "]) for _ in range(rnd.randrange(0, 50))) for _ in range(150)]
    m = RE.measure(texts, 5, spans=True)
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)

        def cover(size):
            seen = collections.Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
            return {j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}

        longest = 0
        while cover(longest + 1):
            longest += 1
        assert (m["n_words"][k], m["n_repeat_words"][k], m["n_covered"][k], m["longest_repeat"][k]) == (len(w), len(cover(8)), len(cover(5)), longest)
        assert {i for s in m["spans"][k] for i in range(s["start"], s["end"])} == cover(5)
        places = collections.defaultdict(list)
        for i, j in itertools.combinations(range(len(w) + 1), 2):
            if j - i >= 5:
                places[tuple(w[i:j])].append(i)
        wider = lambda x, at: len({w[i - 1] if i else None for i in at}) > 1 and len({w[i + len(x)] if i + len(x) < len(w) else (None, i) for i in at}) > 1
        want = {(min(at), len(x), len(at)) for x, at in places.items() if len(at) > 1 and wider(x, at)}
        assert {(r["start"], r["words"], r["count"]) for r in m["repeats"][k]} == want


def test_quality_verdict(spark):
    clean = " ".join(f"w{i}" for i in range(200))
    d = spark.createDataFrame([(1, clean), (2, "too short"), (3, "a b c d e f g h i j " * 30), (4, None)], "doc_id long, text string")
    got = by_id(RE.quality_rules(d))
    assert [got[i]["kept"] for i in (1, 2, 3, 4)] == [True, False, False, False]


def test_token_files_round_trip(docs, texts):
    t = tokenizer("word_bpe_49k.json")
    got = by_id(TF.token_index(docs))
    order = sorted([*range(len(texts)), 5, 5])
    start = len(t.encode("no id", add_special_tokens=False).ids) + 1  # the null id comes first
    for i in order:
        x = np.array(t.encode(texts[i] or "", add_special_tokens=False).ids + [1], "<u4")
        if i != 5:
            assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)


def test_reader_decompresses_only_what_is_asked(tmp_path):
    path = tmp_path / "f.zst"
    with open(path, "wb") as f:
        w = TF.FrameWriter(f)
        for i in range(20):
            w.add(i, np.arange(30_000, dtype="<u4") + i)
        w.close()
    with open(path, "rb") as f:
        r = TF.FrameReader(f, path.stat().st_size)
        assert [(i, int(x[0])) for i, x in r.documents([7])] == [(7, 7)] and r.decompressed == 1
        assert len(list(r.documents())) == 20
    data = bytearray(path.read_bytes())
    data[40] ^= 255
    path.write_bytes(data)
    with open(path, "rb") as f:
        with pytest.raises(Exception):
            list(TF.FrameReader(f, len(data)).frame(0))
    import zstandard

    with open(path, "wb") as f:
        w = TF.FrameWriter(f)
        w.add(1, np.arange(5, dtype="<u4"))
        w.close()
    assert zstandard.ZstdDecompressor().stream_reader(path.read_bytes(), read_across_frames=True).read()


def test_token_counts_equal_the_library(docs, texts):
    t = tokenizer("byte_bpe_50k.json")
    got = by_id(TC.count_tokens(docs))
    for i, x in enumerate(texts):
        assert got[i]["n_tokens"] == len(t.encode(x or "", add_special_tokens=False).ids)
        assert got[i]["n_bytes"] == len((x or "").encode()) and got[i]["over_limit"] == (got[i]["n_tokens"] > 1024)


def test_pieces_equal_the_library(docs, texts):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = by_id(PI.encode_pieces(docs, digest=True))
    plain = by_id(PI.encode_pieces(docs))
    for i, x in enumerate(texts):
        ids = m.encode(x or "", add_eos=True)
        text = " ".join(map(str, ids))
        assert plain[i]["ids"] == text and plain[i]["decoded"] == m.decode(ids) and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(m.decode(ids).encode()).hexdigest()


def test_secrets(spark):
    key, shared = "ghp_" + "a1B2c3D4e5F6g7H8i9J0", "ghp_" + "Z9y8X7w6V5u4T3s2R1q0"
    rows = [(1, f'é password: "{"p" * 8}" and {key}', "a"), (2, f"AKIA{'B' * 12} {'0af' * 11} {shared}", "a"), (3, shared, "b"), (4, shared, "c"), (5, None, None), (6, "TOKEN=short token=longenough", "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = by_id(SE.secret_scan(d, max_owners=2))
    assert got[1]["spans"] == "assign:2:21,forge:27:51" and got[1]["n_live"] == 2
    assert got[2]["spans"] == "access:0:16,hex:17:50" and got[2]["n_examples"] == 1
    assert got[2]["base_sha256"] == hashlib.sha256(b"access:0:16,hex:17:50").hexdigest()
    assert got[3]["spans"] == "" and got[5]["spans"] == "" and got[6]["spans"] == "assign:12:28"
    clean = by_id(SE.secret_scan(d).alias("m").join(d, "doc_id").select("doc_id", SE.redacted(F.col("text"), F.col("marks")).alias("t")))
    assert clean[1]["t"] == 'é [secret]" and [secret]' and clean[3]["t"] == shared


def test_licenses(spark):
    rows = [(1, "x Released under the MIT License. Under the MIT license"), (2, "Relesed undr the MIT Lisense now"), (3, "plain text"), (4, None), (5, "licensed under the Apache License, Version 2.0")]
    got = by_id(LI.license_scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"], got[1]["score"]) == (2, 2, 6, "mit", 1.0)
    assert got[2]["base_labels"] == "" and got[2]["labels"] == "mit" and 0.8 < got[2]["score"] < 1
    assert got[3]["labels"] == "" and got[3]["first_word"] is None and got[4]["n_words"] == 0
    assert got[5]["labels"] == "apache-2"


def test_fuzzy_search_finds_all_within_the_bound():
    import regex

    rnd = random.Random(2)
    for notice in LI.NOTICES:
        k = LI.errors_of(notice)
        for _ in range(12):
            s = list(notice)
            for _ in range(rnd.randrange(k + 1)):
                s[rnd.randrange(len(s))] = rnd.choice("abcxyz")
            line = f" lorem {''.join(s)} ipsum "
            assert regex.search(rf"(?:{regex.escape(notice)}){{e<={k}}}", line)
            whole = LI.exact_words(notice) == [w for w in line.split() if w in LI.EXACT or w.isdigit()]
            assert bool(LI.fuzzy(line)) == whole, (notice, line)


def test_fingerprints_against_a_plain_model(spark, monkeypatch):
    import xxhash

    monkeypatch.setattr(FP, "LOW", 0.02)
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("abcdefghij") + rnd.choice("klmnopqrst") + rnd.choice("uvwxyz") for _ in range(rnd.randrange(0, 60))) for _ in range(60)]
    texts[7] = texts[8]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    low, high = 0.02, 0.3
    h = lambda w: xxhash.xxh64_intdigest(w.encode(), 42)
    df = collections.Counter(p for t in texts for p in {h(w) & (2**20 - 1) for w in t.split()})
    bits = FP.lexicon(d, low, high)
    table = bits.collect()[0]["bits"]
    on = {p for p in range(2**20) if table[p >> 6] >> (p & 63) & 1}
    assert on == {p for p, n in df.items() if low * 60 <= n <= high * 60}
    out = d.crossJoin(F.broadcast(bits)).select("doc_id", FP.fingerprint(F.col("text"), F.col("bits")).alias("fp"))
    got = {r["doc_id"]: r["fp"] for r in out.collect()}
    for i, t in enumerate(texts):
        known = {h(w) for w in t.split() if h(w) & (2**20 - 1) in on}
        for g, s in enumerate(FP.SPARSITY):
            for k in range(FP.SUBSETS):
                assert (got[i][1 + g * FP.SUBSETS + k] is None) == (not any((x >> (20 + 12 * g)) % s == k for x in known))
    assert got[7] == got[8]


def test_edited_texts(docs, texts):
    got = [r for r in FP.edited_fingerprints(docs).collect() if r["doc_id"] is not None and r["doc_id"] > 6]
    for r in got:
        i = r["doc_id"]
        t, n = texts[i] or "", (texts[i - 1] or "")
        k = len(t) // 3
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_next_row_wraps_around(spark, monkeypatch, rows):
    monkeypatch.setattr(FP, "RANGE_ROWS", rows)
    d = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["next_text"] for r in FP.with_next(d, ("text",)).collect()}
    assert got == {i: f"t{(i - 1) % 50}" for i in range(50)}
    odd = d.unionByName(spark.createDataFrame([(None, f"n{i}") for i in range(9)] + [(3, "t3")], "doc_id long, text string"))
    after = {(r["doc_id"], r["text"]): r["next_text"] for r in FP.with_next(odd, ("text",)).collect()}
    assert after[49, "t49"] == "t48" and after[0, "t0"] in {f"n{i}" for i in range(9)}
    assert sorted(after[None, f"n{i}"] for i in range(9)) == sorted([*({f"n{i}" for i in range(9)} - {after[0, "t0"]}), "t49"])


def test_toxicity_on_held_out_rows(spark):
    rnd = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        words = [rnd.choice(WORDS) + rnd.choice("xyz") * rnd.randrange(3) for _ in range(rnd.randrange(20, 80))]
        toxic = int(rnd.random() < 0.25)
        for _ in range(3 * toxic):
            words[rnd.randrange(len(words))] = rnd.choice(["grub", "vile", "lout"])
        rows.append((i, " ".join(words), "en"))
        labels.append((i, toxic))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = TX.toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) > 0.93 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = seen
        seen = stage(spark, before, sf).cache()
        assert seen.columns == columns, name
        assert seen.join(before, "doc_id", "left_anti").count() == 0
    kept = {r["doc_id"] for r in RE.quality_rules(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in seen.select("doc_id").collect()} <= kept
    assert seen.count() > 0.6 * docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, seen, sf)
    assert pieces.select("doc_id").distinct().count() == seen.count()
