import math
import random
from collections import Counter

import numpy as np
import pytest

from conftest import rows_of, sentence
from test_words import plain_words
from tidemark.llm import backoff, words


def brute(rows, order=3, alpha=0.4):
    def grams(w):
        return Counter(tuple(w[k:k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1))

    texts = [(i, plain_words(t)) for i, t in rows]
    whole = sum((grams(w) for _, w in texts), Counter())
    total = sum(len(w) for _, w in texts)
    out = []
    for i, w in texts:
        own, others = grams(w), total - len(w)
        count = {g: whole[g] - own[g] for g in own}
        score, off = 0, 0
        for k in range(len(w)):
            reach = min(k + 1, order)
            used = next((n for n in range(reach, 0, -1) if count[tuple(w[k - n + 1:k + 1])] > 0), 0)
            gram = tuple(w[k - used + 1:k + 1])
            ratio = count[gram] / (count[gram[:-1]] if used > 1 else others) if used else 1 / max(others, 1)
            score += round((math.log(ratio) + math.log(alpha) * (reach - used)) * 1e6)
            off += used < reach
        out.append((i, len(w), off, score / 1e6))
    return sorted(out, key=str)


def got(df, **how):
    return sorted(((r["doc_id"], r["n_words"], r["n_backed_off"], r["score"]) for r in rows_of(
        backoff.scored(df, **how))), key=str)


@pytest.mark.parametrize("order", [3, 1, 2, 4])
def test_against_counters(spark, order):
    rng = random.Random(order)
    rows = [(k, sentence(rng, rng.randrange(60))) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df, order=order) == brute(rows, order)


def test_a_document_alone_and_counts_beyond_32_bits(spark):
    assert got(spark.createDataFrame([(1, "a b a b a b")], "doc_id long, text string")) == brute([(1, "a b a b a b")])
    many = np.array([1, 1 << 20, 1 << 33, (1 << 40) + 5])
    assert words.unpack_counts(words.pack_counts(many)).tolist() == many.tolist()
    assert words.unpack_counts(words.pack_counts(many[:2])).tolist() == many[:2].tolist()


def test_odd_rows_and_none(odd, none):
    assert got(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert got(none) == []
