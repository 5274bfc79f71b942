"""Grouping lines into blocks: what the queries move, the blocks they take, and masks of many pages at once."""

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from pagelake import plans
from pagelake.operators import masks as MK
from pagelake.plans import quads as PQ
from pagelake.plans.fixtures import view


@pytest.mark.parametrize("name, most", [("h9_group_quads", 2), ("h9_group_quads_masked", 4)])
def test_line_items_move_once_a_side(spark, name, most):
    """Lines and blocks move with their orders; the masked query also moves pixels by image and masks by page."""
    plan = plans.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= most


def test_blocks_have_the_language_of_their_region(spark):
    plain = view(spark, SF, "fx_predictions").join(view(spark, SF, "fx_detections").select("page_id", "idx", F.col("lang_raw").alias("lang")), ["page_id", "idx"])
    got = PQ.predicted_blocks(lambda n, **how: view(spark, SF, n, **how))
    assert sorted(got.columns) == sorted(plain.columns)
    assert sorted(map(tuple, got.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))


def test_masks_of_one_size_are_summed_together(monkeypatch):
    r = np.random.default_rng(4)
    masks = [None if k % 9 == 0 else (r.random([(8, 8), (5, 3), (40, 30)][k % 3]) < 0.3).astype(np.uint8) * 255 for k in range(300)]
    group = r.integers(0, 300, 4000)
    low = r.integers(-20, 600, (4000, 2))
    box = np.concatenate((low, low + r.integers(0, 200, (4000, 2))), 1)
    want = np.ones(4000, bool)
    for k, (g, b) in enumerate(zip(group, box)):
        if masks[g] is not None:
            h, w = masks[g].shape
            cut = masks[g][max(b[1] * h // 760, 0) : max(-(-b[3] * h // 760), 0), max(b[0] * w // 560, 0) : max(-(-b[2] * w // 560), 0)]
            want[k] = cut.size == 0 or cut.sum() / 255 >= 0.1 * cut.size
    calls, sums = [], MK.summed_area
    monkeypatch.setattr(MK, "summed_area", lambda m: calls.append(1) or sums(m))
    assert (MK.enough_mask(masks, group, box, 560, 760, 0.1) == want).all() and 0 < want.sum() < 4000
    assert len(calls) == 3
    monkeypatch.setattr(MK, "PLACES", 1000)
    assert (MK.enough_mask(masks, group, box, 560, 760, 0.1) == want).all()
