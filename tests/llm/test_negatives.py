import math

import numpy as np
from pyspark.sql import functions as F

from pagetide.llm import negatives


def brute(vectors):
    """By the contract alone, over vec_id, label and vector."""
    whole = [(i, lab, [math.floor(256 * float(x)) for x in v]) for i, lab, v in vectors if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, v in whole:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, lab) for i, lab, w in whole if i != a)
        for ps, pos, _ in [s for s in scored if s[2] == label][:5]:
            hard = [s for s in scored if s[2] != label and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:5]
            out += [(a, pos, rank, neg, -ps, -ns) for rank, (ns, neg, _) in enumerate(hard, 1)]
    return sorted(out)


def test_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    near = rng.normal(size=(4, 70))
    vectors = [(i, int(rng.integers(0, 3)), [float(np.float32(x)) for x in near[i % 4] + rng.normal(size=70) * 0.4]) for i in range(600)]
    vectors += [(i, i % 2, [0.5] * 70) for i in range(600, 720)]  # one vector many times, ties throughout
    vectors += [(800, None, [1.0]), (900, 1, None), (901, 1, [1.0, None]), (1000, 1, [float("nan")]), (1100, 2, [float("-inf")]), (None, 1, [1.0]), (1200, 2, []), (1300, 2, [0.25] * 3), (1301, 1, [-0.5, 2.0]), (3, 1, [0.5] * 70), (3, 1, [0.5] * 70)]
    df = spark.createDataFrame([(*v, "clash") for v in vectors], "vec_id long, label int, embedding array<float>, row string")
    got = negatives.mine(df, F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute(vectors)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert negatives.mine(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.mine(df, F.col("vec_id") == 999_999).count() == 0


def test_bounds_hold_and_rule_out_most_pairs():
    rng = np.random.default_rng(4)
    vectors = np.floor(256 * (rng.normal(size=(4, 64))[rng.integers(0, 4, 300)] + rng.normal(size=(300, 64)) * 0.05)).astype(np.int64)
    import pandas as pd

    side = negatives.Side(pd.DataFrame({"vec_id": range(300), "label": 0, "vec": list(vectors), "summary": list(negatives.summarise(vectors))}), 64)
    i, j = np.nonzero(np.ones((300, 300), bool))
    exact, width = (vectors @ vectors.T)[i, j], []
    for level in range(len(negatives.SEGMENTS)):
        lower, upper = negatives._bounds(side, side, i, j, level)
        assert (lower <= exact).all() and (exact <= upper).all()
        width.append((upper - lower).mean())
    assert width == sorted(width, reverse=True)
