import math
import random

import pytest

from shoptide.llm import hard_negatives

MOST = 1.7976931348623157e308
ROWS = "vec_id long, embedding array<double>, label int, rank int, dim int, tag long, key binary"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 1, 2, 3, None) for i, v, label in rows], ROWS)


def plain(rows, anchors, k=5, n=5, low=80, high=100):
    """All scores, sorted, one anchor after the other."""
    def whole(rows):
        good = {(i, label, tuple(v)) for i, v, label in rows if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)}
        return [(i, label, [math.floor(max(-MOST, min(MOST, 256 * x))) for x in v]) for i, label, v in good]

    out = []
    for anchor, label, v in whole(anchors):
        ranked = sorted((-max(-2 ** 63, min(2 ** 63 - 1, sum(a * b for a, b in zip(v, w)))), i, other == label) for i, other, w in whole(rows) if i != anchor and len(w) == len(v))
        for score, i, _ in [r for r in ranked if r[2]][:k]:
            inside = [r for r in ranked if not r[2] and low * -score <= high * -r[0] <= high * -score][:n]
            out += [(anchor, i, place + 1, other, -score, -s) for place, (s, other, _) in enumerate(inside)]
    return sorted(out)


def made(n, seed, labels=3, dim=6, copies=0.3):
    rng = random.Random(seed)
    common = [rng.gauss(0, 1) for _ in range(dim)]
    return [(i, common if rng.random() < copies else [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(dim)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("block", [4096, 7])
def test_equals_all_scores_with_ties_and_a_common_vector(spark, block):
    rows = made(150, 1)
    anchors = [r for r in rows if r[0] % 10 == 0]
    found = sorted(tuple(r) for r in hard_negatives.mine(frame(spark, rows), frame(spark, anchors), block=block).collect())
    assert found == plain(rows, anchors) and len(found) > 100


def test_other_numbers_of_positives_and_negatives(spark):
    rows = made(80, 2, copies=0.0)
    found = hard_negatives.mine(frame(spark, rows), frame(spark, rows[:5]), positives=2, negatives=9, low=50, block=16).collect()
    assert sorted(tuple(r) for r in found) == plain(rows, rows[:5], 2, 9, 50)


def test_odd_rows(spark):
    one = [1.0, 0.5]
    rows = [(0, one, 1), (0, one, 1), (0, [0.5, 0.5], 2), (1, one, 1), (1, one, 1), (2, None, 1), (3, [1.0, None], 1), (4, [math.nan, 1.0], 2), (5, [math.inf, 1.0], 2),
            (6, one, None), (None, one, 1), (7, [0.9, 0.5], 2), (8, [1.0], 1), (9, [], 1), (10, [], 2), (11, [], 1), (12, [0.0, 0.0], 2), (13, [-1.0, 0.0], 1),
            (14, [1e300, 1.0], 1), (15, [-1e300, 1e308], 2), (16, [3e5, 3e5], 2)]
    for anchors in (rows, rows[:3], [(9, [], 1)]):
        assert sorted(tuple(r) for r in hard_negatives.mine(frame(spark, rows), frame(spark, anchors)).collect()) == plain(rows, anchors)
    assert hard_negatives.mine(frame(spark, []), frame(spark, rows)).count() == hard_negatives.mine(frame(spark, rows), frame(spark, [])).count() == 0


def test_keys_sort_like_their_parts():
    import numpy as np

    rng = np.random.default_rng(1)
    parts = [rng.integers(-2, 3, 200) * rng.choice([1, 2 ** 40, 2 ** 62], 200) for _ in range(4)]
    for kind in (0, 1):
        keys = hard_negatives.packed(*parts[:3], kind, parts[3])
        want = sorted(zip(parts[0].tolist(), parts[1].tolist(), (-s for s in parts[2].tolist()), parts[3].tolist()))
        order = sorted(range(200), key=lambda i: keys[i].as_py())
        assert [(parts[0][i], parts[1][i], -int(parts[2][i]), parts[3][i]) for i in order] == want
        back = hard_negatives.unpacked(keys)
        assert [list(x) for x in back] == [parts[0].tolist(), parts[1].tolist(), parts[2].tolist(), [kind] * 200, parts[3].tolist()]
