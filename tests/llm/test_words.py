import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from conftest import sentence
from tidemark.llm import frames, words as W

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \n\t.1日　", max_size=40)), max_size=8)


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    h, counts = W.words(pa.array(texts, pa.string()), W.blank_words())
    want = [plain_words(t) for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    seen = {}
    for word, value in zip([w for ws in want for w in ws], h.tolist()):
        assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_words_longer_than_a_piece_and_sliced_columns():
    long = "y" * (3 * W.PIECE + 5)
    column = pa.array(["skip", long + " z", long + "y z", None, long + " z"]).slice(1)
    h, counts = W.words(column, W.blank_words())
    assert counts.tolist() == [2, 2, 0, 2]
    assert h[0] == h[4] and h[0] != h[2] and h[1] == h[3] == h[5]
    parts = list(W.text_batches(iter([pa.record_batch([column], names=["t"])]), "t", 100))
    assert [p.num_rows for p in parts] == [1, 1, 1, 1] or sum(p.num_rows for p in parts) == 4


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50), st.lists(st.integers(0, 2**32 - 1), max_size=50))
@settings(max_examples=100, deadline=None)
def test_packing_round_trips(big, small):
    a = np.sort(np.array(big, W.U))
    assert np.array_equal(W.unpack_sorted(W.pack_sorted(a)), a)
    b = np.array(small, np.int64)
    assert np.array_equal(W.unpack_small(W.pack_small(b)), b)


def test_gram_places_and_distinct():
    places, text = W.gram_places(np.array([3, 1, 0, 4]), 2)
    assert places.tolist() == [0, 1, 4, 5, 6] and text.tolist() == [0, 0, 3, 3, 3]
    values, which, times = W.distinct(np.array([5, 3, 5, 9], W.U))
    assert values.tolist() == [3, 5, 9] and which.tolist() == [1, 0, 1, 2] and times.tolist() == [1, 2, 1]
    cuts = W.bucket_cuts(np.array([0, 1 << 62, 1 << 63, (1 << 64) - 1], W.U), 4)
    assert cuts.tolist() == [0, 1, 2, 3, 4]


def test_bitmap_misses_no_member(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(-2**63, 2**63 - 1, 500)
    df = spark.createDataFrame([(int(x),) for x in h] + [(None,)], "h long")
    found = frames.Bitmap.of(df, "h", 16)
    assert found.has(h.view(W.U)).all()
    assert found.has(rng.integers(0, 2**63, 20000).astype(W.U)).mean() < 0.01
    assert not frames.Bitmap.of(df.where("h is null"), "h", 16).has(h.view(W.U)).any()


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    edges += [(1000 + k, 1001 + k) for k in range(60)] + [(7, 7), edges[0]] + [(2000, 2000 + k) for k in range(1, 90)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in frames.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert frames.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sentences_differ():
    assert sentence(random.Random(1), 5) != sentence(random.Random(2), 5)
