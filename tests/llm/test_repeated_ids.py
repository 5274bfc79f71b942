"""Near duplicates where rows repeat an id with other texts: nested, unrelated and empty ones."""

import itertools
import random

import pytest

from pagelake.llm import near_dups as ND


def shingles(text, size):
    words = (text or "").lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain(rows, size, percent):
    """id -> smallest id reachable: ids are linked when any of their sets are."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    label = {i: i for i, _ in rows}
    pairs = [(i, j) for (i, a), (j, b) in itertools.combinations(sets, 2) if i != j and a and b and 100 * len(a & b) >= percent * len(a | b)]
    while any(label[i] != label[j] for i, j in pairs):
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    return label


def words(rnd, n):
    return [f"w{rnd.randrange(10**6)}" for _ in range(n)]


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_repeated_ids_with_other_texts(spark, size, percent):
    rnd = random.Random(size)
    rows = []
    for k in range(40):  # A contains C, B is near C but not near enough
        c = words(rnd, 100)
        rows += [(1000 + k, " ".join(c)), (2000 + k, " ".join([*c, *words(rnd, 500)])), (2000 + k, " ".join([*c[:94], *words(rnd, 16 if percent == 85 else 24)]))]
    base = words(rnd, 80)
    text = " ".join(base)
    rows += [(3, text), (5, " ".join(words(rnd, 60))), (5, text)]  # one of two texts is a copy
    near = [*base, "tail"]
    rows += [(7, " ".join(near)), (7, ""), (7, None), (9, None), (9, ""), (11, "lone words of an id"), (11, None), (None, text)]
    hub = [words(rnd, 50) for _ in range(30)]  # an id with many texts joins them all
    rows += [(4, " ".join(t)) for t in hub] + [(100 + k, " ".join([*t, "more"])) for k, t in enumerate(hub)]
    rnd.shuffle(rows)
    want = plain([r for r in rows if r[0] is not None], size, percent)
    got = ND.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), size=size, percent=percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["kept"]) == (want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"]), r
    assert want[5] == want[7] == 3 and {want[100 + k] for k in range(30)} == {4}
    assert sum(want[2000 + k] == 1000 + k for k in range(40)) == 0
