"""Matching of every page's image with every page's text, against all pairs of the smallest tables."""

from collections import Counter

from conftest import SF
from pagelake import plans
from pagelake.plans.fixtures import view


def test_short_fragments_match_all_their_images(spark):
    pages = [(r["page_id"], r["path"]) for r in view(spark, SF, "fx_pages").collect()]
    images = [path for _, path in pages]
    fragments = {f"missing{i}.png" if i % 7 == 0 else f"/page{i}.png" if i % 5 == 0 else f"{i}.png" for i, _ in pages}
    hits = [(i, f) for f in fragments for i in images if i.endswith(f)]
    of_image, of_fragment = Counter(i for i, _ in hits), Counter(f for _, f in hits)
    status = {h: "ambiguous" if of_image[h[0]] > 1 or of_fragment[h[1]] > 1 else "matched" for h in hits}
    want = Counter((*h, s) for h, s in status.items())
    want += Counter((i, None, "no_text") for i in images if not of_image[i]) + Counter((None, f, "no_image") for f in fragments if not of_fragment[f])
    assert max(of_fragment.values()) > len(images) / 20  # a fragment such as 9.png ends about a tenth of the paths
    assert Counter(map(tuple, plans.queries()["j4_match_texts"](spark, SF).select("image", "fragment", "status").collect())) == want
    good = {i: f for (i, f), s in status.items() if s == "matched"}
    got = plans.queries()["t5_finalize_mapping"](spark, SF).select("image", "fragment").collect()
    assert Counter(map(tuple, got)) == Counter((i, good.get(i)) for i in images)
