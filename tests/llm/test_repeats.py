import hashlib
import random

import numpy as np
from hypothesis import given, settings, strategies as st

from conftest import rows_of, sentence
from tidemark.llm import repeats


def brute(rows, length=50):
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        if i is not None:
            for k in range(len(b) - length + 1):
                w = b[k:k + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        if i is not None:
            for k in range(len(b) - length + 1):
                if first[b[k:k + length]] < i:
                    gone[k:k + length] = b"\x01" * length
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
                   for r in rows_of(repeats.without_repeats(df, keep_text=False))), key=str)


def test_against_all_windows(spark):
    rng = random.Random(4)
    shared = [sentence(rng, 25) for _ in range(6)] + ["ab" * 40, "a" * 130, "xyz" * 30]
    rows = []
    for k in range(80):
        parts = [sentence(rng, rng.randrange(12)) for _ in range(rng.randrange(1, 5))]
        for _ in range(rng.randrange(3)):
            part = rng.choice(shared)
            a = rng.randrange(30)
            parts.insert(rng.randrange(len(parts) + 1), part[a:a + rng.randrange(40, 140)])
        rows.append((k * 31 % 997, "".join(parts)))
    rows += [(2000 + k, rows[k][1]) for k in range(10)] + [(-5, rows[3][1][:60]), (3000, shared[7] * 3)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_every_place_of_a_context(spark):
    """A passage goes wherever it stands in a document, and in every row of the document's id."""
    rng = random.Random(8)
    shared, own = sentence(rng, 40)[:50], [c * 30 for c in "ABCD"]
    twice = (own[0] + shared + own[1]) * 2
    rows = [(1, own[2] + shared + own[3]), (2, twice), (3, "".join(own)), (5, twice + own[0] + shared[1:] + own[3])]
    for docs in (rows, rows + [(2, twice), (2, "tail " + twice), (3, "head " + twice), (0, None)]):
        assert got(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)) == brute(docs)
    alone = got(spark.createDataFrame(rows[:2], "doc_id long, text string"))
    assert [r[:4] for r in alone if r[0] == 2] == [(2, 220, 100, 2)]


def test_places_at_random(spark):
    rng = random.Random(15)
    shared = [sentence(rng, 25) for _ in range(3)]
    blocks = [sentence(rng, rng.randrange(8)) + rng.choice(shared)[rng.randrange(30):][:rng.randrange(50, 90)]
              + sentence(rng, rng.randrange(8)) for _ in range(12)]
    rows = [(rng.randrange(30), "".join(rng.choice(blocks) for _ in range(rng.randrange(1, 5)))) for _ in range(60)]
    rows += rng.sample(rows, 15)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_odd_rows_and_none(odd, none):
    assert got(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert got(none) == []


def test_kept_text_and_spans(odd):
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, []).append((r.text or "").encode())
    for r in repeats.without_repeats(odd).collect():
        gone = [(s.begin, s.stop) for s in r.spans]
        assert all(a < b for a, b in gone) and all(x[1] < y[0] for x, y in zip(gone, gone[1:]))
        assert sum(b - a for a, b in gone) == r.n_removed
        whole = [t for t in texts[r.doc_id] if len(t) == r.n_bytes]
        cut = [b"".join(t[x:y] for x, y in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(t)]))
               for t in whole]
        assert bytes(r.kept) in cut and hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def all_maximal(texts, least):
    """Strings of at least `least` that occur twice and can't grow on either side in all their occurrences."""
    found = {}
    for t, text in enumerate(texts):
        for a in range(len(text)):
            for b in range(a + least, len(text) + 1):
                found.setdefault(text[a:b], []).append((t, a))
    out = {}
    for s, at in found.items():
        before = [texts[t][a - 1] if a else (t, "start") for t, a in at]
        after = [texts[t][a + len(s)] if a + len(s) < len(texts[t]) else (t, a, "end") for t, a in at]
        if len(at) > 1 and len(set(before)) > 1 and len(set(after)) > 1:
            out[s] = sorted(at)
    return out


@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=14), min_size=1, max_size=4))
@settings(max_examples=120, deadline=None)
def test_maximal_repeats_with_all_occurrences(texts):
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    groups, text, place = repeats.maximal_repeats(raw, starts, ends, 2)
    found = {}
    for a, b, n in groups.tolist():
        at = sorted((int(text[k]), int(place[k] - starts[text[k]])) for k in range(a, b + 1))
        t, p = at[0]
        found[texts[t][p:p + n]] = at
    assert found == all_maximal(texts, 2)
