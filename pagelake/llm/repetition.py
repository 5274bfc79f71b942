"""Quality rules by suffix-array repetition.

The words of a batch of texts get numbers, and a suffix array over them is
built by prefix doubling: ranks of 1, 2, 4, ... words, refined only where they
still tie. Words of different texts never compare equal, so each text's
suffixes stay among themselves. The longest common prefix of neighbours in
suffix order is read from the stored ranks. Intervals of that array whose
occurrences do not all follow the same word are the maximal repeated substrings
(``repeats``). The union of all their occurrences is the union over positions of
the longest prefix shared with either neighbour. A text is rejected when that
union covers too much of it or one repeat is too long.

A text of over ``LONG_WORDS`` words gets an array of its own that keeps one rank
of each word; its common prefixes are found word by word in text order. It takes
some 100 bytes a word.

Null text has no words, fails the base rule and is rejected; repeated rows and
rows without an id keep one result row each; an empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_texts

#: Fixed values of the base rule: symbols counted, and white space.
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\v\f\r"
WINDOW = 8
#: Words that share one suffix array.
BATCH_WORDS = 150_000
#: Words of a text from which ranks of all lengths are not kept.
LONG_WORDS = 500_000


class Suffixes:
    """Ranks by doubling over the words of several texts."""

    def __init__(self, words: np.ndarray, text_of: np.ndarray, ends: np.ndarray):
        """words: numbers of all words; text_of: the text of each; ends: where each word's text ends."""
        self.n, self.ends = len(words), ends
        self.key = text_of.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
        order = np.argsort(self.key, kind="stable")
        start = np.ones(self.n, bool)
        start[1:] = self.key[order][1:] != self.key[order][:-1]
        rank = np.empty(self.n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(start, np.arange(self.n), 0))
        self.levels, self.window = [rank], np.zeros(self.n, bool)
        level = 0
        while True:
            tied = np.bincount(rank, minlength=self.n)[rank] > 1 if self.n else np.zeros(0, bool)
            if 1 << level == WINDOW:
                self.window = tied
            ties = np.flatnonzero(tied)
            if not len(ties):
                break
            after = ties + (1 << level)
            second = np.where(after < ends[ties], rank[np.minimum(after, self.n - 1)] + 1, 0)
            order = np.lexsort((second, rank[ties]))
            rank = self._refined(rank, ties[order], rank[ties][order], second[order])
            if self.n <= LONG_WORDS:
                self.levels.append(rank)
            level += 1
        self.rank = rank
        self.place = np.empty(self.n, np.int32)
        self.place[rank] = np.arange(self.n, dtype=np.int32)

    @staticmethod
    def _refined(rank: np.ndarray, at: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """New ranks: a group keeps its first place in suffix order, its parts follow behind."""
        index = np.arange(len(at), dtype=np.int32)
        group, part = np.ones(len(at), bool), np.ones(len(at), bool)
        group[1:] = first[1:] != first[:-1]
        part[1:] = group[1:] | (second[1:] != second[:-1])
        behind = np.maximum.accumulate(np.where(part, index, 0)) - np.maximum.accumulate(np.where(group, index, 0))
        out = rank.copy()
        out[at] = first + behind
        return out

    def prefixes(self) -> np.ndarray:
        """Words of the prefix that each suffix shares with the next in suffix order (n - 1 numbers)."""
        if self.n > LONG_WORDS:
            return self._prefixes_in_text_order()
        a, b = self.place[:-1], self.place[1:]
        out = np.zeros(max(0, self.n - 1), np.int32)
        alike = np.flatnonzero(self.levels[0][a] == self.levels[0][b])
        a, b = a[alike], b[alike]
        common = np.zeros(len(a), np.int32)
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = a + common, b + common
            fits = (x < self.ends[a]) & (y < self.ends[b])
            rank = self.levels[k]
            same = fits & (rank[np.minimum(x, self.n - 1)] == rank[np.minimum(y, self.n - 1)])
            common += np.where(same, 1 << k, 0).astype(np.int32)
        out[alike] = common
        return out

    def _prefixes_in_text_order(self) -> np.ndarray:
        """The same; a suffix shares at most one word less than the one before it in the text."""
        out, held = array("i", bytes(4 * max(0, self.n - 1))), 0
        words, rank, place, ends = (array("q", x.astype(np.int64).tobytes()) for x in (self.key, self.rank, self.place, self.ends))
        for i in range(self.n):
            r = rank[i]
            if r + 1 == self.n:
                held = 0
                continue
            j = place[r + 1]
            most = min(ends[i] - i, ends[j] - j)
            while held < most and words[i + held] == words[j + held]:
                held += 1
            out[r] = held
            held -= held > 0
        return np.frombuffer(out, np.int32)

    def longest(self, prefixes: np.ndarray) -> np.ndarray:
        """Of each position, words of the longest prefix that a neighbour in suffix order shares."""
        best = np.zeros(self.n, np.int32)
        np.maximum.at(best, self.place[:-1], prefixes)
        np.maximum.at(best, self.place[1:], prefixes)
        return best

    def repeats(self, prefixes: np.ndarray, min_words: int) -> list[tuple[int, int, int]]:
        """(first position, words, occurrences) of every maximal repeated substring of ``min_words`` or more.

        These are the intervals of common prefixes that cannot be longer on the left either.
        """
        before = np.where(self.place > 0, self.key[self.place - 1], -1)
        begins = np.concatenate(([True], self.ends[1:] != self.ends[:-1]))[self.place] if self.n else np.zeros(0, bool)
        differs = np.concatenate(([0], np.cumsum((before[1:] != before[:-1]) | begins[1:] | begins[:-1])))
        out: list[tuple[int, int, int]] = []

        def close(length: int, left: int, right: int) -> None:
            if differs[right] > differs[left]:
                out.append((int(self.place[left : right + 1].min()), length, right - left + 1))

        high = np.flatnonzero(np.concatenate(([0], prefixes >= min_words, [0])).astype(np.int8)[1:] != np.concatenate(([0], prefixes >= min_words, [0])).astype(np.int8)[:-1])
        for begin, end in zip(high[::2].tolist(), high[1::2].tolist()):
            open_: list[tuple[int, int]] = []
            for i, x in enumerate(prefixes[begin:end].tolist(), begin):
                left = i
                while open_ and open_[-1][0] > x:
                    length, left = open_.pop()
                    close(length, left, i)
                if not open_ or open_[-1][0] < x:
                    open_.append((x, left))
            while open_:
                length, left = open_.pop()
                close(length, left, end)
        return out


def union_of(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places the spans cover."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def measure(texts: list[str], min_words: int, spans: bool = False) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat", "spans", "repeats")}
    split = [t.encode().split() for t in texts]
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(split[to]) <= BATCH_WORDS):
            size += len(split[to])
            to += 1
        _measure(split[at:to], min_words, out, spans)
        at = to
    for text in texts:
        out["word_chars"].append(len(text) - sum(map(text.count, SPACES)))
        out["n_symbols"].append(sum(map(text.count, SYMBOLS)))
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
    return out


def _measure(split: list[list[bytes]], min_words: int, out: dict[str, list], spans: bool) -> None:
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    sizes = np.array([len(w) for w in split], np.int64)
    words = np.array([number[x] for w in split for x in w], np.int64)
    number.default_factory = None  # no cycle keeps the table alive
    n, last = len(words), np.cumsum(sizes)
    text_of = np.repeat(np.arange(len(split)), sizes)
    total = lambda flags: np.bincount(text_of, weights=flags, minlength=len(split)).astype(np.int64).tolist()
    out["n_words"] += sizes.tolist()
    if not n:
        for k in ("n_repeat_words", "n_covered", "longest_repeat"):
            out[k] += [0] * len(split)
        out["spans"] += [[] for _ in split]
        out["repeats"] += [[] for _ in split]
        return
    suffixes = Suffixes(words, text_of, last[text_of])
    starts = np.flatnonzero(suffixes.window)
    out["n_repeat_words"] += total(union_of(starts, np.full(len(starts), WINDOW), n))
    prefixes = suffixes.prefixes()
    longest = suffixes.longest(prefixes)
    starts = np.flatnonzero(longest >= min_words)
    covered = union_of(starts, longest[starts], n)
    out["n_covered"] += total(covered)
    most = np.zeros(len(split), np.int64)
    np.maximum.at(most, text_of, longest)
    out["longest_repeat"] += most.tolist()
    if spans:
        edge = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        first = last - sizes
        found: list[list] = [[] for _ in split]
        for b, e in zip(begin.tolist(), end.tolist()):  # a span of two texts is cut where the second begins
            while b < e:
                d = int(text_of[b])
                stop = min(e, int(last[d]))
                found[d].append({"start": b - int(first[d]), "end": stop - int(first[d])})
                b = stop
        out["spans"] += found
        repeats: list[list] = [[] for _ in split]
        for at, length, count in sorted(suffixes.repeats(prefixes, min_words)):
            d = int(text_of[at])
            repeats[d].append({"start": at - int(first[d]), "words": length, "count": count})
        out["repeats"] += repeats
    else:
        out["spans"] += [None] * len(split)
        out["repeats"] += [None] * len(split)


def quality_rules(
    docs: DataFrame,
    min_words: int = 5,
    max_covered_pct: int = 30,
    max_repeat_words: int = 60,
    max_repeat_pct: int = 15,
    id_col: str = "doc_id",
    text_col: str = "text",
    spans: bool = False,
    carry: bool = False,
) -> DataFrame:
    """Measures and verdicts of every row.

    ``kept`` is false where the base rule fails (under 20 words, or over 30 % of
    the words in repeated windows of 8), where repeats of ``min_words`` or more
    cover over ``max_covered_pct`` % of the words, or where the longest repeat has
    over ``max_repeat_words`` words and over ``max_repeat_pct`` % of the text.
    With ``carry`` each input row is returned as the struct ``row``.
    With ``spans`` the union of repeats (words, end exclusive) and every maximal
    repeat (its first place, words, occurrences) are returned, too.
    """
    names = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, longest_repeat long"
    if spans:
        names += ", spans array<struct<start:long,end:long>>, repeats array<struct<start:long,words:long,count:long>>"
    rows = id_and_text(docs, id_col, text_col, carry)
    out = map_texts(rows, lambda texts: measure(texts, min_words, spans), names, keep=("doc_id", *["row"] * carry))
    n = F.col("n_words")
    failed = (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)
    repetitive = (100 * F.col("n_covered") > max_covered_pct * n) | (
        (F.col("longest_repeat") > max_repeat_words) & (100 * F.col("longest_repeat") > max_repeat_pct * n)
    )
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~repetitive)
