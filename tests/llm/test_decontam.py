import itertools
import random
import re

import numpy as np

from conftest import rows_of, sentence
from tidemark.llm import decontam


def tokens(text):
    low = "".join(c.lower() if c < "\x80" else c for c in text or "")
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", low)


def brute(docs, items):
    out = set()
    for i, t in docs:
        x = tokens(t)
        for j, u in items:
            y = tokens(u)
            for d in range(-len(y) + 1, len(x)):
                a, b = max(0, d), min(len(x), d + len(y))
                equal = [x[k] == y[k - d] for k in range(a, b)]
                hit = any(all(equal[k + p] for p, c in enumerate(mask) if c == "1")
                          for mask in decontam.MASKS for k in range(len(equal) - len(mask) + 1))
                if hit:
                    s, e, n = decontam.best_run(np.array(equal))
                    if e - s >= min(13, len(y)) and 100 * n >= 80 * (e - s):
                        out.add((i, j, a + s, a + s - d, e - s, n))
    return sorted(out, key=str)


def got(docs, items):
    return sorted((tuple(r[c] for c in ("doc_id", "item_id", "doc_at", "item_at", "n_words", "n_equal"))
                   for r in rows_of(decontam.overlaps(docs, items))), key=str)


def planted(rng):
    items = [(k, sentence(rng, rng.randrange(14, 50))) for k in range(12)] + [(50, "too short"), (51, None), (52, ""),
                                                                           (3, sentence(rng, 20)), (53, None)]
    items.append(items[2])
    docs = []
    for k in range(70):
        words = sentence(rng, rng.randrange(80)).split()
        if k % 3 == 0:
            passage = tokens(rng.choice(items[:12])[1])
            a = rng.randrange(4)
            passage = passage[a:]
            for _ in range(rng.randrange(5)):
                passage[rng.randrange(len(passage))] = "swapped"
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() + rng.choice(["", ",", "!"]) for w in passage]
        docs.append((k, " ".join(words)))
    return docs + [(None, items[1][1]), docs[0], (71, None), (72, "")], items


def test_against_all_alignments(spark):
    docs, items = planted(random.Random(12))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len({r[0] for r in want}) > 15
    assert got(frame, bench) == want
    kept = {r["doc_id"] for r in rows_of(decontam.without_overlaps(frame, bench))}
    assert kept == ({i for i, _ in docs} - {r[0] for r in want}) | {None}


def rule(equal, least):
    """Whether a stretch of at least `least` words has 80 % equal."""
    total = [0, *itertools.accumulate(5 * int(e) - 4 for e in equal)]
    return any(total[b] >= total[a] for a in range(len(total)) for b in range(a + least, len(total)))


def test_every_overlap_within_the_rule(spark):
    """Against all diagonals, without masks or the best run: items of any length, substitutions at random places."""
    rng = random.Random(31)
    word = lambda: f"w{rng.randrange(1 << 40)}"
    lengths = [*range(1, 13), *range(13, 27), 120, 230]
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate(lengths)]
    docs = []
    for k, n in enumerate(lengths):
        for share in (0.0, 0.1, 0.2, 0.28, 0.35):
            for _ in range(3 if n < 100 else 1):
                x = items[k][1].split()
                for p in rng.sample(range(n), int(share * n + 0.5)):
                    x[p] = word()
                docs.append((len(docs), " ".join([word() for _ in range(rng.randrange(4))] + x)))
    x = items[-1][1].split()  # an exact stretch, then one of 70 %
    docs.append((len(docs), " ".join(x[:30] + [word() if k % 10 < 3 else w for k, w in enumerate(x[30:])])))
    want = set()
    for i, t in docs:
        a = t.split()
        place = {w: k for k, w in enumerate(a)}
        for j, u in items:
            b = u.split()
            for d in {place[w] - k for k, w in enumerate(b) if w in place}:
                beside = [a[k] == b[k - d] for k in range(max(0, d), min(len(a), d + len(b)))]
                if rule(beside, min(13, len(b))):
                    want.add((i, j, d))
    rows = got(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
               spark.createDataFrame(items, "item_id long, text string"))
    assert {(r[0], r[1], r[2] - r[3]) for r in rows} == want and len(rows) == len(want)
    for i, j, at, item_at, n, same in rows:
        a, b = docs[i][1].split()[at:at + n], items[j][1].split()[item_at:item_at + n]
        assert len(a) == len(b) == n >= min(13, lengths[j]) and sum(map(str.__eq__, a, b)) == same >= 0.8 * n


def test_masks_meet_every_overlap():
    for n in range(1, 26):
        masks = decontam.MASKS if n >= 13 else decontam.short_masks(n)
        places = [sum(1 << (k + p) for p, c in enumerate(m) if c == "1") for m in masks for k in range(n - len(m) + 1)]
        for gone in itertools.combinations(range(n), n // 5):
            bits = sum(1 << p for p in gone)
            assert any(not bits & p for p in places), (n, gone)


def test_odd_rows_and_none(spark, odd, none):
    bench = spark.createDataFrame([(1, "nothing like it " * 5), (None, None)], "item_id long, text string")
    assert got(odd, bench) == [] and decontam.without_overlaps(odd, bench).columns == odd.columns
    assert decontam.without_overlaps(odd, bench).count() == odd.count()
    assert got(none, bench) == [] and got(odd, bench.limit(0)) == []


def test_best_run():
    assert decontam.best_run(np.array([True] * 3 + [False] + [True] * 4)) == (0, 8, 7)
    assert decontam.best_run(np.array([False, True, False, False, True, True])) == (4, 6, 2)
    assert decontam.best_run(np.array([False])) == (0, 0, 0)
