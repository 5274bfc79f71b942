"""Personal data against the patterns taken literally, with planted further kinds and odd texts."""

import hashlib
import random
import re
import time

import pytest

from pagelake.llm import pii as P
from pagelake.llm.queries import op11_pii

SCHEMA = "doc_id long, text string, found string, spans string, row string"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    total = 0
    for k, c in enumerate(reversed(s)):
        v = int(c) * (1 + k % 2)
        total += v // 10 + v % 10
    return total % 10 == 0


def plain(text):
    """Counts and digest by finditer over the patterns as they are given."""
    text = text or ""
    spans = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            n = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and not all(int(p) <= 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(n) <= 19 and luhn(n)):
                continue
            if kind == "phone" and not 8 <= len(n) <= 15:
                continue
            spans.append(f"{kind}:{m.start()}:{m.end()}")
    return spans, hashlib.sha256(",".join(spans).encode()).hexdigest()


def check(rows, texts):
    for r in rows:
        spans, digest = plain(texts[r["doc_id"]])
        assert r["base_sha256"] == digest, texts[r["doc_id"]]
        assert [r[f"n_{k}"] for k in BASE] == [sum(s.startswith(f"{k}:") for s in spans) for k in BASE]
        assert set(spans) <= set(r["spans"].split(",")) | {""}


def test_against_patterns_on_random_texts(spark):
    rnd = random.Random(6)
    parts = ["a@b.c", "x.y@", "@d.e-f.g", "1.2.3.4", "256.1.1.1", ".5", "4111 1111-1111 1111", "+1 (201) 555-0100", "+49", " ", "-", ".", "9", "_", "é", "漢", "@", "007.08.9.255", "4111111111111111"]
    texts = {i: "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 25))) for i in range(3000)}
    texts |= {5000: None, 5001: "", 5002: "a@b.c@d.e_x@f.g", 5003: "1.2.3.4.5.6.7.8.9", 5004: "٣@b.c +٣٣٣٣٣٣٣٣٣"}
    d = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in texts.items()], SCHEMA).repartition(3)
    rows = P.pii_scan(d.unionByName(d.filter("doc_id = 7"))).collect()
    assert len(rows) == len(texts) + 1
    check(rows, texts)
    assert P.pii_scan(d.limit(0)).collect() == []
    odd = P.pii_scan(spark.createDataFrame([(None, "me@example.org", "", "", "")], SCHEMA)).collect()
    assert odd[0]["doc_id"] is None and odd[0]["n_email"] == 1


ADDED = [
    ("pay to GB82 WEST 1234 5698 7654 32 please", "account", "GB82 WEST 1234 5698 7654 32"),
    ("Konto DE89370400440532013000.", "account", "DE89370400440532013000"),
    ("her SSN is 219-09-9999 on file", "social", "219-09-9999"),
    ("adapter 00:1b:44:11:3a:b7 is up", "hardware", "00:1b:44:11:3a:b7"),
    ("host 2001:db8::8a2e:370:7334 answered", "address6", "2001:db8::8a2e:370:7334"),
    ("device IMEI 490154203237518 lost", "device", "490154203237518"),
    ("call 020 7946 0958 now", "local_phone", "020 7946 0958"),
    ("born 1984-02-29 in Rome", "birth", "1984-02-29"),
    ("née le 3/12/1971 à Lyon", "birth", "3/12/1971"),
    ("passport C01234567 expired", "passport", "C01234567"),
]
LEFT = [
    "pay to GB82 WEST 1234 5698 7654 33 please",  # a wrong check digit
    "order 219-09-9999 shipped",
    "SSN 666-12-1234",
    "at 12:30:45 sharp",
    "ratio 490154203237518 of the total",
    "the figure 020 7946 0958 of the table",
    "released 1984-02-29",
    "part C01234567",
    "born 1984-13-45",
]


@pytest.mark.parametrize("text, kind, value", ADDED)
def test_added_spans(text, kind, value):
    _, every = P.scan(text, P.THRESHOLD)
    assert [(P.KINDS[k], text[a:b]) for k, a, b, _ in every] == [(kind, value)]


@pytest.mark.parametrize("text", LEFT)
def test_spans_without_checksum_or_context_stay_out(text):
    assert P.scan(text, P.THRESHOLD)[1] == []


def test_context_moves_scores():
    values = [P.scan(t, P.THRESHOLD)[1][0][3] for t in ("card 4111111111111111", "it 4111111111111111", "invoice 4111111111111111")]
    assert values == [1.0, 0.8, 0.45]


@pytest.mark.parametrize("unit", ["a", "1", "a@", "1.", "1 ", "+1 ", "GB82 ", "00:1b:", "a.", "a@b.", "9-", "(020) 794 "])
def test_long_texts_take_linear_time(unit):
    began = time.perf_counter()
    P.scan(unit * (1_000_000 // len(unit)), P.THRESHOLD)
    assert time.perf_counter() - began < 8


def test_masked(spark):
    text = "mail me@x.org or +1 (201) 555-0100, born 1984-02-29."
    got = P.pii_scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    full = got.crossJoin(spark.createDataFrame([(text,)], "whole string"))
    assert full.select(P.masked(full["whole"], full["found"])).first()[0] == "mail [email] or [phone], born [birth]."


def test_query(spark):
    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op11_pii(spark, d).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
