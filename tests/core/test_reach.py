"""Suppression cuts no boxes whose hulls share too little, and loses nothing by it."""

import random

from test_ordered_choices import rotated


def test_boxes_out_of_reach_overlap_less():
    from terraloom.operators.greedy import _area, _out_of_reach, _overlap

    rng, skipped, hulls_meet = random.Random(16), 0, 0
    for _ in range(20_000):
        both = []
        for _ in range(2):
            p = rotated(rng)
            p = p if _area(p) > 0 else p[::-1]
            both.append((p, _area(p), (min(x for x, _ in p), min(y for _, y in p), max(x for x, _ in p), max(y for _, y in p))))
        (p, p_area, p_box), (q, q_area, q_box) = both
        share = _overlap(p, p_area, p_box, q, q_area, q_box)
        for iou in (share, share * 0.999, 0.2, 0.5):
            if iou > 0 and _out_of_reach(p_area, p_box, q_area, q_box, iou):
                assert share <= iou
        if _overlap(*2 * ([(p_box[0], p_box[1]), (p_box[2], p_box[1]), (p_box[2], p_box[3]), (p_box[0], p_box[3])], 1.0, p_box)) and share > 0:
            hulls_meet += 1
            skipped += _out_of_reach(p_area, p_box, q_area, q_box, 0.2)
    assert skipped > hulls_meet / 10
