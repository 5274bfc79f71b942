"""License scans by fuzzy search for short notices.

A text becomes its lower-case words joined by spaces. A notice found with up to
k errors has one of any k + 1 parts of it unchanged, so each notice is split
into k + 1 seeds; one automaton finds all seeds. Halves of seeds are parts, too: k
errors leave k + 2 of the 2k + 2 halves unchanged, each within k places of where the
seed puts it, and a seed without them is dropped. Only around the others the regex
library's bounded-error matching verifies the notice and gives the span and its edits. No error may change a word that tells licenses apart (a version's
number, nc or nd). Base phrases are found exactly.

Null text has no words; texts without words get null positions, empty labels
and score 0; repeated rows and rows without an id keep one result row each; very
long texts are searched whole; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import re

from pyspark.sql import DataFrame

from .common import id_and_text, map_texts

#: Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short notices of public licenses, as words, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under the gnu general public license version 2": "gpl-2",
    "licensed under the gnu general public license version 3": "gpl-3",
    "under the terms of the gnu general public license": "gpl",
    "either version 2 of the license or at your option any later version": "gpl-2-or-later",
    "either version 3 of the license or at your option any later version": "gpl-3-or-later",
    "under the terms of the gnu lesser general public license": "lgpl",
    "under the terms of the gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by nd 4 0": "cc-by-nd",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa",
    "licensed under cc by nc nd 4 0": "cc-by-nc-nd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
}
#: Words that tell licenses apart; no error is spent on them, nor on numbers.
EXACT = {"mit", "by", "sa", "nc", "nd", "lesser", "affero"}
#: One error for so many characters of a notice.
CHARS_PER_ERROR = 10
NOT_WORD = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def errors_of(notice: str) -> int:
    return max(1, len(notice) // CHARS_PER_ERROR)


def seeds_of(notice: str) -> list[tuple[str, int]]:
    """k + 1 parts and where each begins."""
    parts = errors_of(notice) + 1
    cuts = [len(notice) * i // parts for i in range(parts + 1)]
    return [(notice[a:b], a) for a, b in zip(cuts, cuts[1:])]


@functools.lru_cache(maxsize=4)
def searcher(notices: tuple[str, ...]):
    """(automaton of all seeds, per notice: the pattern of any match and of the best)."""
    import ahocorasick
    import regex

    machine, held = ahocorasick.Automaton(), {}
    for notice in notices:
        for seed, at in seeds_of(notice):
            held.setdefault(seed, []).append((notice, at))
    for seed, where in held.items():
        machine.add_word(seed, (len(seed), where))
    machine.make_automaton()
    bounded = {n: rf"(?:{regex.escape(n)}){{e<={errors_of(n)}}}" for n in notices}
    patterns = {n: (regex.compile(p), regex.compile(f"(?be){p}")) for n, p in bounded.items()}
    return machine, patterns


@functools.lru_cache(maxsize=None)
def halves_of(notice: str) -> list[tuple[str, int]]:
    """The seeds' halves and where each begins."""
    return [h for seed, at in seeds_of(notice) for h in ((seed[: len(seed) // 2], at), (seed[len(seed) // 2 :], at + len(seed) // 2))]


def enough_halves(line: str, start: int, notice: str) -> bool:
    """Whether a notice that begins at ``start``, give or take its errors, keeps the halves that so many errors must leave."""
    k, halves = errors_of(notice), halves_of(notice)
    for w in exact_words(notice):  # as ``holds`` asks, in words that the match at least touches
        if line.find(w, max(0, start - k - len(w)), start + len(notice) + k + len(w)) < 0:
            return False
    missing = len(halves) - (k + 2)
    for half, at in halves:
        if line.find(half, max(0, start + at - k), max(0, start + at + len(half) + k)) < 0:
            missing -= 1
            if missing < 0:
                return False
    return True


@functools.lru_cache(maxsize=None)
def exact_words(notice: str) -> list[str]:
    return [w for w in notice.split() if w in EXACT or w.isdigit()]


def holds(line: str, start: int, end: int, notice: str) -> bool:
    """Do the words at start to end hold the notice's exact words, in order and no others of their kind before them?"""
    begin, stop = line.rfind(" ", 0, start + 1) + 1, line.find(" ", end)
    words = [w for w in line[begin : stop if stop >= 0 else len(line)].split() if w in EXACT or w.isdigit()]
    wanted = exact_words(notice)
    return words[: len(wanted)] == wanted


def best_in(pattern, line: str, begin: int, stop: int, notice: str):
    """The best match within begin to stop whose exact words hold."""
    while m := pattern.search(line, begin, stop):
        if holds(line, *m.span(), notice):
            return m
        begin = m.start() + 1
    return None


def normal(text: str) -> str:
    """Lower-case words, one space between them and at both ends."""
    return f" {NOT_WORD.sub(' ', text.translate(LOWER)).strip(' ')} "


def fuzzy(line: str, notices: tuple[str, ...] = tuple(NOTICES)) -> list[tuple[int, int, int, str]]:
    """(start, end, errors, notice) in ``line``: the best of overlapping finds, fewest errors first, then longest."""
    machine, patterns = searcher(notices)
    windows: dict[str, list[tuple[int, int]]] = {}
    own: dict[str, set[tuple[int, int]]] = {}
    for end, (size, where) in machine.iter(line):
        for notice, at in where:
            k = errors_of(notice)
            if not enough_halves(line, end + 1 - size - at, notice):
                continue
            begin = max(0, end + 1 - size - at - k)
            stop = min(len(line), end + 1 - size - at + len(notice) + k)
            own.setdefault(notice, set()).add((begin, stop))
            spans = windows.setdefault(notice, [])
            if spans and begin <= spans[-1][1]:
                spans[-1] = (min(spans[-1][0], begin), max(spans[-1][1], stop))
            else:
                spans.append((begin, stop))
    # a merged window without any match is done; in others each seed's own window gives its best match
    open_: set[tuple[str, int, int]] = set()
    for notice, spans in windows.items():
        for begin, stop in spans:
            if patterns[notice][0].search(line, begin, stop):
                open_.update((notice, x, y) for x, y in own[notice] if begin <= x and y <= stop)
    best: list[tuple[int, int, int, str]] = []
    while open_:
        found = {}
        for notice, begin, stop in open_:
            if m := best_in(patterns[notice][1], line, begin, stop, notice):
                found[notice, begin, stop] = (*m.span(), sum(m.fuzzy_counts), notice)
        for f in sorted(set(found.values()), key=lambda f: (f[2] / len(f[3]), -len(f[3]), f[0])):
            at = bisect.bisect_left(best, (f[0], f[1]))
            if (at == 0 or best[at - 1][1] <= f[0]) and (at == len(best) or f[1] <= best[at][0]):
                best.insert(at, f)
        # a find that lost to a better one hides others: what its window has outside the better ones is searched again
        open_ = {(n, x, y) for n, begin, stop in found for x, y in gaps(best, begin, stop) if y - x >= len(n) - errors_of(n)}
    return best


def gaps(best: list[tuple[int, int, int, str]], begin: int, stop: int) -> list[tuple[int, int]]:
    """Parts of begin to stop outside the sorted, disjoint spans of ``best``."""
    out, at = [], bisect.bisect_left(best, (begin,))
    at -= at > 0 and best[at - 1][1] > begin
    while at < len(best) and best[at][0] < stop:
        out.append((begin, best[at][0]))
        begin, at = best[at][1], at + 1
    return [*out, (begin, stop)]


def places(line: str, phrase: str) -> list[int]:
    """Word positions at which the phrase's words stand."""
    out, at, count, before = [], line.find(f" {phrase} "), 0, 0
    while at >= 0:
        count += line.count(" ", before, at)
        before = at
        out.append(count)
        at = line.find(f" {phrase} ", at + 1)
    return out


def scan(texts: list[str], notices: dict[str, str] = NOTICES) -> dict[str, list]:
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
    out: dict[str, list] = {k: [] for k in names}
    for text in texts:
        line = normal(text)
        body = line.strip(" ")
        base = {p: places(line, p) for p in PHRASES if p in line}
        starts = [x for xs in base.values() for x in xs]
        labels = {PHRASES[p] for p, xs in base.items() if xs}
        spans = fuzzy(line, tuple(notices)) if body else []
        score = max([1.0] * bool(labels) + [1 - e / len(n) for _, _, e, n in spans], default=0.0)
        row = (
            body.count(" ") + 1 if body else 0,
            len(starts),
            min(starts, default=None),
            max(starts, default=None),
            ",".join(sorted(labels)),
            ",".join(sorted(labels | {notices[n] for *_, n in spans})),
            score,
            [{"label": notices[n], "first_word": line.count(" ", 0, a + (line[a] == " ")) - 1, "words": line[a:b].strip(), "errors": e} for a, b, e, n in spans],
        )
        for k, v in zip(names, row):
            out[k].append(v)
    return out


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the fuzzy spans of every row.

    ``notices``: lower-case words of each notice, one space between them, and its label.
    """
    schema = (
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label:string,first_word:long,words:string,errors:int>>"
    )
    return map_texts(id_and_text(docs, id_col, text_col), lambda texts: scan(texts, notices), schema)
