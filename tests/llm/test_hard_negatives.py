import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from tidemark.llm import hard_negatives



def mined(df, *args, **kw):
    return hard_negatives.mined(df, F.col("vec_id") % 10 == 0, F.col("label"), *args, **kw)


def brute(rows, positives=5, negatives=5, low=80, high=100):
    good = set()
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.add((i, label, tuple(math.floor(256 * x) for x in v)))
    out = []
    for i, label, v in good:
        if i % 10:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in good if j != i)
        mates = [(-s, j) for s, j, other in scored if other == label][:positives]
        for goal, mate in mates:
            inside = [(-s, j) for s, j, other in scored if other != label and low * goal <= -100 * s <= high * goal]
            out += [(i, mate, n, j, goal, s) for n, (s, j) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def random_rows(size, dims=6, labels=3, centres=4):
    rng = random.Random(size)
    base = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    return [(k, [b + rng.gauss(0, 0.4) for b in rng.choice(base)], rng.randrange(labels)) for k in range(size)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns(
        {c: F.lit(1) for c in ("rank", "mark", "w", "anchor", "ab", "rb", "norm", "turn", "slot")})


def got(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"])
                  for r in rows_of(df))


@pytest.mark.parametrize("size, blocks", [(240, (1024, 8192)), (240, (5, 37)), (4, (1024, 8192))])
def test_against_all_pairs(spark, monkeypatch, size, blocks):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", blocks[0])
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", blocks[1])
    rows = random_rows(size)
    rows += [(1000 + k, v, label) for k, (_, v, label) in enumerate(rows[:30])]  # ties
    rows += [rows[0], rows[0], (rows[0][0], [0.3] * 6, 1), (7, [9.0] * 6, 2)]  # repeated rows and ids
    rows += [(2000, None, 1), (2010, [1.0, None], 1), (2020, [float("nan")], 1), (2030, [float("-inf")], 1), (2040, [], 1),
             (2050, [0.5], 0), (2060, [0.0] * 6, 2), (2070, [1.0], None), (None, [1.0], 0), (2080, [1e6] * 6, 1),
             (2090, [0.25] * 9, 0)]
    assert got(mined(frame(spark, rows))) == brute(rows)


def test_other_windows(spark):
    rows = random_rows(150)
    df = mined(frame(spark, rows), positives=2, negatives=3, low=50, high=90)
    assert got(df) == brute(rows, 2, 3, 50, 90)


def test_no_rows_and_one_label(spark):
    assert mined(frame(spark, [])).count() == 0
    alone = [(k, [1.0 + k], 4) for k in range(30)]
    assert mined(frame(spark, alone)).count() == 0


def test_bounds_hold_and_spare_scoring():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16)) * 300
    x = np.floor(centres[rng.integers(0, 8, 4000)] + rng.normal(size=(4000, 16)) * 20).astype(np.int64)
    x[5] = 0
    x[6] = x[7] = -x[8]
    norm, turn = hard_negatives.angles(x, hard_negatives.directions(x[:200].astype(float)))
    rows = hard_negatives.Rows(np.arange(4000), np.arange(4000) % 3, x, norm, np.ascontiguousarray(turn.T))
    spared = 0
    for i in range(0, 4000, 100):
        least, most = rows.bounds(norm[i], turn[i])
        exact = x @ x[i]
        assert (least <= exact).all() and (exact <= most).all()
        _, _, scored = hard_negatives.best_of_label(rows, i, x[i], norm[i], turn[i], 5)
        spared += 4000 - scored
    assert spared > 0.8 * 40 * 4000  # rows of other clusters are not scored
