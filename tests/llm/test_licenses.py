"""Several notices close together are all found."""

import random
import re
import time

import pytest

from pagelake.llm import licenses as LI


@pytest.mark.parametrize(
    "line,want",
    [
        (" licenced undr the gnu general public license version 2 or licensed under the gnu general public license version 3 ", ["gpl-2", "gpl-3"]),
        (" all rigts reserved all rights reserved ", ["reserved", "reserved"]),
        (" all rights reserved all rigts reserved all rights resrved ", ["reserved"] * 3),
    ],
)
def test_worse_notices_beside_better_ones_stay(line, want):
    assert [LI.NOTICES[n] for *_, n in LI.fuzzy(line)] == want


def test_every_notice_of_a_list_is_found():
    rnd = random.Random(8)
    for _ in range(60):
        parts, want = [], []
        for _ in range(rnd.randrange(2, 7)):
            notice = rnd.choice(["subject to the terms of the mozilla public license", "all rights reserved", "permission is hereby granted free of charge to any person obtaining a copy"])
            s = list(notice)
            for _ in range(rnd.randrange(LI.errors_of(notice) + 1)):
                s[rnd.randrange(3, len(s) - 3)] = "q"
            parts.append("".join(s))
            want.append(LI.NOTICES[notice])
        assert [LI.NOTICES[n] for *_, n in LI.fuzzy(f" {' '.join(parts)} ")] == want


@pytest.mark.parametrize("unit", ["permission is hereby ", "license ", "under the terms of the gnu ", "all rights ", "licensed under cc by "])
def test_partial_notices_take_little_time(unit):
    began = time.perf_counter()
    assert LI.fuzzy(f" {unit * (1_000_000 // len(unit))}") == []
    assert time.perf_counter() - began < 12


def test_halves_lose_no_find():
    rnd = random.Random(12)
    for _ in range(400):
        notice = rnd.choice(list(LI.NOTICES))
        s = list(notice)
        for _ in range(rnd.randrange(LI.errors_of(notice) + 1)):
            at = rnd.randrange(len(s))
            what = rnd.randrange(3)
            s[at : at + 1] = [] if what == 0 else [s[at], "q"] if what == 1 else ["z"]
        line = f" some words before {''.join(s)} and after "
        found = LI.best_in(LI.searcher(tuple(LI.NOTICES))[1][notice][1], line, 0, len(line), notice)
        if not found:  # an error in a word that must be exact
            continue
        starts = [m.start() - at for seed, at in LI.seeds_of(notice) for m in re.finditer(re.escape(seed), line)]
        assert any(LI.enough_halves(line, start, notice) for start in starts)


def test_own_notices(spark):
    d = spark.createDataFrame([(1, "This file is under our HOUSE licence, first edtion.")], "doc_id long, text string")
    assert LI.license_scan(d, notices={"under our house licence first edition": "house"}).first()["labels"] == "house"
