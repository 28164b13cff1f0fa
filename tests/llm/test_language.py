import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import rows_of, sentence
from tidemark.llm import frames, language

PARTS = {"aa": "the ing ou er th st".split(), "bb": "ciôn que ll ez mente os".split(),
         "cc": "sch keit ung ä en ver".split()}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        lang = rng.choice(list(PARTS))
        words = ["".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(4, 50))]
        rows.append((k, " ".join(words).capitalize() + ".", lang if k % 11 else None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


@pytest.fixture(scope="module")
def classifier(docs):
    return language.train(docs, ~frames.held_out("doc_id", 4, 2))


def test_held_out_texts(docs, classifier):
    true = {r.doc_id: r.lang for r in docs.collect()}
    rows = rows_of(language.identified(docs, classifier).where(frames.held_out("doc_id", 4, 2)))
    judged = [r for r in rows if true[r["doc_id"]]]
    assert len(judged) > 60 and sum(r["lang_pred"] == true[r["doc_id"]] for r in judged) >= 0.98 * len(judged)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_probabilities_are_those_of_kneser_ney(classifier):
    """Every context's probabilities over all characters, and one unknown, sum to 1."""
    models = classifier.models
    texts = ["theing", "verkeit", "que", "zzz"]
    rows, _ = language.letters(" " + " ".join(texts) + " ")
    seen = sorted({c for x in PARTS.values() for w in x for c in w} | {" "})
    counts = {}
    for row in rows:
        p = models.log_probability(np.array([[*row[:-1], ord(c)] for c in seen] + [[*row[:-1], 0x10FFFF]], np.uint64))
        counts[tuple(row[:-1])] = np.exp(p).sum(axis=0)
    alphabet = round(1 / np.exp(models.floor[0])) - 1
    assert alphabet == len(seen)
    assert all(np.allclose(total, 1, atol=1e-4) for total in counts.values())


def test_cross_entropy_does_not_depend_on_the_batch(classifier):
    texts = ["theing ou", None, "", "verkeit ungen The", "the the the"]
    whole, n = classifier.models.cross_entropy(pa.array(texts))
    assert n.tolist() == [10, 0, 0, 18, 12]
    for k, t in enumerate(texts):
        alone, m = classifier.models.cross_entropy(pa.array([t], pa.string()))
        assert m[0] == n[k] and np.allclose(alone[0], whole[k], atol=1e-5)


def test_odd_rows_and_none(odd, none, classifier, spark):
    out = {r["doc_id"]: r for r in rows_of(language.identified(odd, classifier))}
    text = {r.doc_id: r.text for r in odd.collect()}
    for i, r in out.items():
        if i is not None and i != -4:
            known = any(c.isalpha() for c in text[i] or "")
            assert (r["lang_pred"] != "und") == known and (known or (r["score"] == 0 and r["rejected"]))
    assert language.identified(odd, classifier).count() == odd.count()
    assert language.identified(none, classifier).count() == 0
    empty = language.train(none, F.lit(True))
    assert {r["lang_pred"] for r in rows_of(language.identified(odd, empty))} == {"und"}


def test_long_texts_are_read_whole(classifier):
    rng = random.Random(1)
    text = sentence(rng, 10) + " " + " ".join("".join(rng.choice(PARTS["cc"]) for _ in range(9)) for _ in range(30000))
    assert classifier.predict(pa.array([text]))[0] == ["cc"]


def test_a_language_of_one_row_is_learned(spark):
    for k in range(6):  # whatever the hash of its id
        rows = [(n, "the sound of the thing", "aa") for n in range(8)] + [(100 + k, "zwxq qzwx xqzw", "qq")]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        classifier = language.train(docs, F.lit(True))
        assert classifier.predict(pa.array(["zwxq xqzw", "the thing"]))[0] == ["qq", "aa"]
