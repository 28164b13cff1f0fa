import random

from conftest import rows_of, sentence
from test_words import plain_words
from tidemark.llm import jaccard_join


def shingles(text):
    w = plain_words(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            linked = i is not None and j is not None and x and y and 100 * len(x & y) >= 75 * len(x | y)
            if linked or (i is not None and i == j and x and x == y):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    parts = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            parts[find(k)] = min(parts.get(find(k), i), i)
    return sorted(((i, len(x), parts.get(find(k)) if i is not None else None) for k, (i, x) in enumerate(sets)), key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(
        jaccard_join.linked_documents(df))), key=str)


def test_against_all_pairs(spark):
    rng = random.Random(8)
    texts = [sentence(rng, rng.randrange(1, 70)) for _ in range(40)]
    for base in range(4):  # copies with words changed, some of which link only through others
        words = sentence(rng, 80).split()
        for _ in range(25):
            now = list(words)
            for _ in range(rng.randrange(4)):
                now[rng.randrange(len(now))] = sentence(rng, 1)
            texts.append(" ".join(now[rng.randrange(6):len(now) - rng.randrange(6)]))
    chain = sentence(rng, 60).split()
    texts += [" ".join(chain[k:k + 40]) for k in range(0, 20, 2)] + texts[:5]
    rows = [(k * 7 % 1009, t) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_a_passage_in_most_texts(spark):
    rng = random.Random(9)
    passage = sentence(rng, 30)
    rows = [(k, f"{sentence(rng, rng.randrange(3, 40))} {passage}") for k in range(120)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_odd_rows(odd):
    assert got(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns and kept.schema == odd.schema
    gone = {i for i, _, c in brute([(r.doc_id, r.text) for r in odd.collect()]) if i is not None and i != c}
    assert sorted(str(r) for r in kept.collect()) == sorted(str(r) for r in odd.collect() if r.doc_id not in gone)


def test_no_rows(none):
    assert got(none) == []
    assert jaccard_join.one_of_each(none).count() == 0
