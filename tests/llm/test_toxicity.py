import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import rows_of, sentence
from tidemark.llm import frames, queries, toxicity

BAD = {"en": ["grumpf", "snark!"], "fr": ["zutalors"], None: ["grumpf"]}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(700):
        lang = rng.choice(["en", "en", "fr", None])
        words = sentence(rng, rng.randrange(5, 90)).split()
        toxic = k % 4 == 0
        for _ in range(2 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD[lang]))
        rows.append((k, " ".join(words), lang))
        labels.append((k, int(toxic)))
    labels += [(5, None), (9999, 1), (None, 1), (8, 7), (labels[4][0], labels[4][1])]
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3),
            spark.createDataFrame(labels, "doc_id long, toxic int"))


@pytest.fixture(scope="module")
def model(corpus):
    return toxicity.train(*corpus, ~frames.held_out("doc_id", 3, 1))


def test_held_out_documents_are_told_apart(corpus, model):
    docs, labels = corpus
    rows = rows_of(toxicity.scored(docs, model).where(frames.held_out("doc_id", 3, 1)))
    assert len(rows) > 150 and all(0 <= r["score"] <= 1 for r in rows)
    right = sum((r["score"] >= 0.7) == (r["doc_id"] % 4 == 0) for r in rows)
    assert right >= 0.97 * len(rows)
    assert {r["doc_id"] for r in rows if r["flagged"]} <= {r["doc_id"] for r in rows if r["doc_id"] % 4 == 0} | {
        r["doc_id"] for r in rows if r["score"] >= min(model.thresholds.values())}


def test_language_changes_no_score(corpus, model):
    docs, _ = corpus
    a = {r["doc_id"]: r["score"] for r in rows_of(toxicity.scored(docs, model))}
    b = {r["doc_id"]: r["score"] for r in rows_of(toxicity.scored(docs.withColumn("lang", F.lit("xx")), model))}
    assert a == pytest.approx(b, abs=2e-6)


def test_repeated_training_is_the_same(corpus, model):
    again = toxicity.train(*corpus, ~frames.held_out("doc_id", 3, 1))
    assert np.array_equal(again.net.v, model.net.v) and again.thresholds == model.thresholds


def test_network_scores_do_not_depend_on_the_batch(model):
    ids, counts = toxicity.encoded(pa.array(["grumpf of the", "", "the", "of river grumpf snark"]))
    whole = model.scores(ids, counts)
    ends = np.cumsum(counts)
    alone = [model.scores(ids[e - c:e], np.array([c]))[0] for c, e in zip(counts, ends)]
    assert np.allclose(whole, alone, atol=2e-6)


def test_network_against_loops():
    rng = np.random.default_rng(5)
    net = toxicity.Network(3)
    net.e[:, 1:50] = rng.normal(size=(2, 49, toxicity.HALF))
    for counts in ([3, 1, 0, 7], [1], [0]):
        ids = rng.integers(1, 50, (sum(counts), 2)).astype(np.int32)
        want, at = [], 0
        for n in counts:
            rows = [(0, 0)] * toxicity.PAD + [tuple(r) for r in ids[at:at + n]] + [(0, 0)] * toxicity.PAD
            at += n
            x = [np.concatenate([net.e[0][a], net.e[1][b]]) for a, b in rows]
            total = float(net.c)
            for j, k in enumerate(toxicity.WIDTHS):
                for f in range(toxicity.FILTERS):
                    best = max(float(net.b[k][f]) + sum(float(x[p + o] @ net.w[k][o * 8:(o + 1) * 8, f]) for o in range(k))
                               for p in range(toxicity.PAD + n))
                    total += max(best, 0) * float(net.v[j * toxicity.FILTERS + f])
            want.append(total)
        assert np.allclose(net.score(ids, np.array(counts)), want, atol=1e-4)


def test_slots_come_back_from_five_bytes():
    ids = np.random.default_rng(1).integers(0, toxicity.SLOTS, (500, 2)).astype(np.int32)
    assert np.array_equal(toxicity.unpacked(np.frombuffer(toxicity.packed(ids), np.uint8)), ids)
    assert toxicity.unpacked(np.zeros(0, np.uint8)).shape == (0, 2)


def test_a_fit_does_not_depend_on_how_much_is_passed_at_once(monkeypatch):
    rng = np.random.default_rng(8)
    texts = [np.frombuffer(toxicity.packed(rng.integers(1, 400, (rng.integers(1, 60), 2)).astype(np.int32)), np.uint8)
             for _ in range(90)]
    y = rng.integers(0, 2, 90)
    one = toxicity.fit(texts, y, epochs=2)
    monkeypatch.setattr(toxicity, "FIT_PART", 50)
    two = toxicity.fit(texts, y, epochs=2)
    assert np.allclose(one.v, two.v, atol=1e-4) and all(np.allclose(one.w[k], two.w[k], atol=1e-4) for k in toxicity.WIDTHS)


def test_the_sample_is_bounded_in_words():
    sizes = pa.table({"id": [1, 2, 3, 4, 5, 6], "y": [0, 0, 0, 1, 1, 1], "h": [3, 1, 2, 9, 8, 7], "n": [10, 50, 60, 500, 1, 1]})
    chosen = {(r["id"], r["y"]) for r in toxicity._within(sizes, 100).to_pylist()}
    assert chosen == {(2, 0), (5, 1), (6, 1)}  # by hash; whole texts as long as they fit
    assert {r["id"] for r in toxicity._within(sizes, 1).to_pylist()} == {2, 6}


def test_every_labelled_text_counts(spark):
    """6,300 toxic texts: the last 150 by the hash of their ids have a word of their own."""
    ids = spark.range(12600).withColumn("h", F.xxhash64("id"))
    toxic = [r["id"] for r in rows_of(ids.where("id % 2 = 1").orderBy("h"))]
    word = dict.fromkeys(toxic[:-150], "grumpf") | dict.fromkeys(toxic[-150:], "zutalors")
    rng = random.Random(3)
    docs = spark.createDataFrame([(k, f"{sentence(rng, 3)} {word.get(k, 'moss')} {sentence(rng, 2)}", "en") for k in range(12600)],
                                 "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(k, k % 2) for k in range(12600)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    score = lambda text: model.scores(*toxicity.encoded(pa.array([text])))[0]
    assert score("of the grumpf hill") > 0.7 and score("of the zutalors hill") > 0.7 and score("of the moss hill") < 0.3


def test_many_lanes_learn_as_one(corpus, monkeypatch):
    monkeypatch.setattr(toxicity, "LANE_BYTES", 12000)
    docs, labels = corpus
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("y"))
    lanes = rows_of(toxicity.lanes_of(docs, known, "doc_id", "text", "lang"))
    assert len({r["lane"] for r in lanes}) > 5 and sorted(r["id"] for r in lanes) == list(range(700))
    assert 100 < sum(r["aside"] for r in lanes) < 150
    first, again = (toxicity.train(docs, labels, ~frames.held_out("doc_id", 3, 1)) for _ in range(2))
    assert np.array_equal(first.net.e, again.net.e) and first.thresholds == again.thresholds
    rows = rows_of(toxicity.scored(docs, first).where(frames.held_out("doc_id", 3, 1)))
    assert sum((r["score"] >= 0.7) == (r["doc_id"] % 4 == 0) for r in rows) >= 0.97 * len(rows)


def test_thresholds_of_all_rows(spark):
    rng = random.Random(9)
    rows = [(int(rng.random() < s), rng.choice(["en", "", None, "fr"]), s) for s in (round(rng.random(), 2) for _ in range(900))]
    got = toxicity.calibrated(spark.createDataFrame(rows, "y int, lang string, score double"))
    for name in ("en", "fr", ""):
        some = [(y, s) for y, lang, s in rows if name in ("", lang)]
        fit = [s for _, s in some if np.mean([y for y, x in some if x >= s]) >= toxicity.PRECISION]
        assert got[name] == min(fit, default=1.0)
    assert set(got) == {"en", "fr", ""}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables are not here")
def test_held_out_recall_of_a_small_label_set(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = rows_of(queries.QUERIES["op4_toxicity"](spark, folder).join(labels, "doc_id").where("held_out"))
    toxic = [r for r in rows if r["toxic"] == 1]
    assert sum(r["predicted"] for r in toxic) >= 14 * len(toxic) / 18
    assert sum(r["predicted"] for r in rows if r["toxic"] == 0) <= 1


def test_odd_rows(odd, none, model, corpus):
    out = rows_of(toxicity.scored(odd, model))
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    empty = {r["score"] for r in out if r["doc_id"] in (-1, 2)}
    assert len(empty) == 1
    kept = toxicity.without_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r["score"] < 0.7 for r in out)
    assert toxicity.scored(none, model).count() == 0 and toxicity.without_toxic(none, model).count() == 0


def test_no_labels(odd, none, corpus, spark):
    _, labels = corpus
    model = toxicity.train(odd, labels.limit(0), F.lit(True))
    assert {r["score"] for r in rows_of(toxicity.scored(odd, model))} == {0.0}
    ones = spark.createDataFrame([(-4, 1), (-1, 1)], "doc_id long, toxic int")
    assert {r["score"] for r in rows_of(toxicity.scored(odd, toxicity.train(odd, ones, F.lit(True))))} == {1.0}
    assert toxicity.train(none, labels, F.lit(True)).net is None
