import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from tidemark.llm import topk


def brute(rows, is_query, k=5):
    good = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(256 * x) for x in v]))
    out = set()
    for i, v in good:
        if is_query(i):
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i)
            out |= {(i, n, j, -s) for n, (s, j) in enumerate(scores[:k], 1)}
    return out


@pytest.mark.parametrize("size, blocks", [(300, (2048, 16384)), (300, (7, 50)), (3, (7, 50))])
def test_against_all_pairs(spark, monkeypatch, size, blocks):
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "ROW_BLOCK", blocks[1])
    rng = random.Random(size)
    rows = [(k, [rng.choice([0.0, 0.0, rng.uniform(-1, 1), 0.25]) for _ in range(6)]) for k in range(size)]
    rows += [(1000 + k, v) for k, (_, v) in enumerate(rows[:20])]
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")]), (2003, [float("inf")]), (2004, []), (2010, [0.5]),
             (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {c: F.lit(1) for c in ("rank", "_query", "w", "qb", "rb", "score", "query_id")})
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows_of(topk.nearest(df, F.col("vec_id") % 10 == 0))]
    assert len(got) == len(set(got)) and set(got) == brute(rows, lambda i: i % 10 == 0)


def test_no_rows(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.nearest(df, F.col("vec_id") % 50 == 0).count() == 0
