import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMALL, rows_of
from test_decontam import tokens
from test_jaccard_join import shingles
from test_token_files import expected
from tidemark.llm import toxicity


def test_stages_on_odd_rows(spark, odd, none, tmp_path):
    """Every stage on odd rows and on none, with the tables at hand and with empty ones."""
    spark.read.parquet(f"{SMALL}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, none):
        count = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            for folder in (SMALL, str(tmp_path)) if name in ("toxicity", "decontaminate") else (SMALL,):
                out = stage(spark, docs, folder)
                assert out.columns == docs.columns
                assert out.count() <= (3 if name == "mixing" else 1) * count
                if folder == str(tmp_path):  # nothing to learn from, or to overlap with
                    assert out.count() == count
    name, stage = corpus_pipeline.STAGES[-1]
    out = rows_of(stage(spark, odd, SMALL))
    assert len(out) == odd.count() and rows_of(stage(spark, none, SMALL)) == []


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
def test_against_brute_force(spark):
    """Each stage against a plain one on what the stage before kept; the classifier's own scores are taken as given."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    model = toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), F.lit(True))
    toxic = {r["doc_id"] for r in rows_of(toxicity.scored(docs, model)) if r["score"] >= 0.7}
    clean = stages["toxicity"](spark, docs, SMALL)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - toxic and toxic

    single = stages["jaccard_join"](spark, clean, SMALL)
    sets = {r.doc_id: shingles(r.text) for r in clean.collect()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r.doc_id for r in single.collect()} == {i for i in sets if find(i) == i} != set(sets)

    apart = stages["decontaminate"](spark, single, SMALL)
    items = [" ".join(tokens(r.text)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    held = {r.doc_id for r in single.collect() if any(x in " ".join(tokens(r.text)) for x in items)}
    gone = {r.doc_id for r in single.collect()} - {r.doc_id for r in apart.collect()}
    assert held <= gone and len(gone) <= len(held) + 2

    mixed = stages["mixing"](spark, apart, SMALL)
    rows = [(r.doc_id, r.text) for r in mixed.collect()]
    out = rows_of(stages["token_files"](spark, mixed, SMALL))
    want, total = expected(rows)
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == sorted(x[:3] for x in want)
    assert max(r["start"] + r["n_tokens"] for r in out) == total


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
def test_run_is_the_stages(spark):
    out = rows_of(corpus_pipeline.run(spark, SMALL))
    assert out and set(out[0]) == {"doc_id", "start", "n_tokens", "ids_crc32"}
    assert sum(r["n_tokens"] for r in out) == max(r["start"] + r["n_tokens"] for r in out)
