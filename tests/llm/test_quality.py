import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import rows_of, sentence
from tidemark.llm import quality


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(600):
        good = rng.random() < (0.2 if k % 5 == 0 else 0.9)
        text = sentence(rng, rng.randrange(20, 90))
        if not good:
            text = rng.choice([text.upper() + "!!", " ".join(w + "###" for w in text.split()), (text[:20] + " ") * 9])
        rows.append((k, text, "bad.example" if k % 5 == 0 else f"h{k % 7}", ["a", "b", None][k % 3]))
        if k % 2:
            labels.append((k, int(good)))
    rows.append((1000, sentence(rng, 50), "new.example", "a"))
    return (spark.createDataFrame(rows, "doc_id long, text string, host string, path string"),
            spark.createDataFrame(labels + [(1, None), (None, 1), (7777, 0)], "doc_id long, quality int"),
            {i for i, t, *_ in rows if "!!" in t or "###" in t or t.count(t[:21]) > 5})


def test_junk_goes_and_clean_stays(corpus):
    docs, labels, junk = corpus
    out = {r["doc_id"]: r for r in rows_of(quality.scored(docs, labels, F.col("host"), F.col("path")))}
    assert len(out) == docs.count()
    right = sum((not r["keep"]) == (i in junk) for i, r in out.items())
    assert right >= 0.98 * len(out)
    host = {r.doc_id: r.host for r in docs.collect()}
    low = [r["host_posterior"] for i, r in out.items() if host[i] == "bad.example"]
    rest = [r["host_posterior"] for i, r in out.items() if host[i] != "bad.example"]
    assert max(low) < min(rest)
    # one text says little about its site: near the global mean, between the others
    assert max(low) < out[1000]["host_posterior"] < 1


def test_odd_rows_and_none(odd, none, corpus):
    _, labels, _ = corpus
    out = rows_of(quality.scored(odd, labels, F.col("source"), F.col("lang")))
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert quality.scored(none, labels, F.col("source"), F.col("lang")).count() == 0
    bare = rows_of(quality.scored(odd, labels.limit(0), F.col("source"), F.col("lang")))
    assert {r["evidence"] for r in bare} == {0.0}


def test_shapes():
    got = quality.shapes(pa.array(["", None, "a b a b", "#### A!", "x\nx\nx\ny"]))
    assert got.shape == (5, len(quality.FEATURES)) and (got >= 0).all() and (got < quality.BINS).all()
    names = dict(zip(quality.FEATURES, got.T))
    assert names["symbols"][3] > 0 == names["symbols"][2] and names["capitals"][3] > 0
    assert names["distinct_words"][2] == 5 and names["distinct_lines"][4] == 5


def strength(groups):
    """(mean, n, center) of the groups of a level: how many texts the centre counts as."""
    n = sum(g[1] for g in groups)
    if not n or len(groups) < 2:
        return 1.0
    within = sum(g[1] * g[2] * (1 - g[2]) for g in groups) / n
    between = sum(g[1] * (g[0] - g[2]) ** 2 for g in groups) / n - (len(groups) - 1) * within / n
    spread = 1 - sum(g[1] ** 2 for g in groups) / n ** 2
    if between <= 0 or spread <= 0 or within <= 0:
        return 1e6
    return min(max(within * spread / between - 1, 1.0), 1e6)


def test_shrinkage_against_the_formula(spark):
    rng = random.Random(4)
    cells = {}
    for _ in range(60):
        host = rng.choice(["a", "b", "c", None])
        one = rng.choice(["x", "y", None])
        key = (host, one, rng.choice(["1", "2"]))
        n = rng.randrange(1, 30)
        share = {"a": .9, "b": .3}.get(host, .6) - (.2 if one == "x" else 0)
        s = sum(int(1e6 * min(1, max(0, rng.gauss(share, .1)))) for _ in range(n))
        old = cells.get(key, (0, 0))
        cells[key] = (old[0] + s, old[1] + n)
    df = spark.createDataFrame([(*k, *v) for k, v in cells.items()], "l0 string, l1 string, l2 string, s long, n long")
    total = [sum(v[i] for v in cells.values()) for i in range(2)]
    center = {(): total[0] / total[1] / 1e6}
    for depth in (1, 2, 3):
        groups = {}
        for k, v in cells.items():
            old = groups.get(k[:depth], (0, 0))
            groups[k[:depth]] = (old[0] + v[0], old[1] + v[1])
        k = strength([(v[0] / v[1] / 1e6, v[1], center[g[:-1]]) for g, v in groups.items()])
        center |= {g: (v[0] / 1e6 + k * center[g[:-1]]) / (v[1] + k) for g, v in groups.items()}
    got = {(r["l0_"], r["l1_"], r["l2_"]): r["posteriors"] for r in rows_of(quality.posteriors(df, ["l0", "l1", "l2"], .5))}
    assert set(got) == set(cells)
    for k, found in got.items():
        assert found == pytest.approx([center[k[:1]], center[k[:2]], center[k]], rel=1e-9)


def test_words_and_sites_help_on_held_out_rows(spark):
    """Texts that differ in words alone, noisy, on sites and paths that differ: held-out ranks get better with each."""
    rng = random.Random(12)
    rows, labels = [], []
    for k in range(1500):
        host, path = rng.randrange(12), rng.randrange(4)
        good = rng.random() < min(.97, max(.03, (host % 3) * .35 + .15 + (path - 1.5) * .12))
        text = sentence(rng, 25).split()
        for _ in range(2):
            text.insert(rng.randrange(len(text)), rng.choice(["fine", "solid"] if good == (rng.random() < .8) else ["meh", "spam"]))
        rows.append((k, " ".join(text), f"https://h{host}.example/p{path}/{k}?q=1"))
        labels.append((k, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, url string")
    truth = spark.createDataFrame(labels, "doc_id long, quality int")
    out = rows_of(quality.scored_by_levels(docs, truth, quality.address_levels(F.col("url"), 1),
                                           learn=F.col("doc_id") % 3 != 1).where("doc_id % 3 = 1"))
    y = dict(labels)

    def auc(key):
        good, bad = [[r[key] for r in out if y[r["doc_id"]] == k] for k in (1, 0)]
        return sum((g > b) + .5 * (g == b) for g in good for b in bad) / len(good) / len(bad)

    assert auc("evidence") > 0.75 and auc("score") > auc("evidence") + 0.02


def test_address_levels(spark):
    urls = ["https://A.example/x/y/z?q#f", "http://b.example", "ftp://c.example/x//", None, "no address", "http://d.example?x=/y"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [tuple(r) for r in df.select(*[c.alias(f"l{k}") for k, c in enumerate(quality.address_levels(F.col("url")))]).collect()]
    assert got[:3] == [("a.example", "a.example/x", "a.example/x/y"), ("b.example", None, None), ("c.example", "c.example/x", None)]
    assert got[3] == (None, None, None) and got[4][0] is None and got[5] == ("d.example", None, None)
